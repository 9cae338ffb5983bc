"""URL rules against plain Python: long hosts and paths, equal rules, dots at odd places, empty tables."""

import time

from gridwise.llm import url_filter as uf

RULES = "verdict string, host string, path string"
URLS = [
    "http://a.example.com/en/7/x", "https://EXAMPLE.com/en/", "http://com/en/1", "http://notexample.com/en/7", "ftp://x.y.example.net/de/8?q", "http://example.net/de/7", "http://.com/en/", "http://a..com/en/",
    "http://com./en/", "http:///en/", "no scheme", None, "", "http://org#/es/", "http://o.org/es/#f", "http://a.b.c.d.e.f.org/es/1", "://com/en/", "http://com", "x://y://com/en/", "http://example.com/en/7",
]


def plain(urls, rules):
    out = []
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
        host = cut(rest, "/?#")
        path = cut(rest[len(host) :], "?#")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((i, host, path, best and best[2], best[3] if best else "allow"))
    return out


def test_equals_plain(spark):
    rules = [*uf.RULES, ("allow", "org", "/es/"), ("block", "e.f.org", ""), ("allow", "a.example.com", "/en"), ("block", "d.e.f.org", "/es/1")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string, rule string").repartition(3)
    got = sorted(tuple(r) for r in uf.judge(pages, spark.createDataFrame(rules, RULES)).collect())
    assert got == sorted(plain(URLS, rules) * 2)


def test_long_urls(spark):
    """A host of 40,000 labels and a path of a megabyte are judged whole, at once."""
    urls = ["http://" + "a." * 40_000 + "example.com/en/7", "http://org/es/" + "x/" * 500_000, "http://" + "b" * 100_000 + ".net/de/8"]
    begin = time.time()
    got = [r["verdict"] for r in uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(list(uf.RULES), RULES)).orderBy("page_id").collect()]
    assert got == ["allow", "block", "allow"] and time.time() - begin < 30


def test_empty(spark):
    none, rules = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(list(uf.RULES), RULES)
    assert uf.judge(none, rules).collect() == []
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert {r["verdict"] for r in uf.judge(pages, rules.limit(0)).collect()} == {"allow"}
