"""License scans against plain Python, with awkward rows and other templates."""

import re

from data import documents

from gridwise.llm import license_scan as ls

MIT = ls.TEMPLATES[12][1]
AWKWARD = [
    (900, "Licensed under CC-BY cc by CC by."), (901, "All rights   RESERVED\nall\nrights,reserved all rights"), (902, "The GNU General\n Public-License; general public licenses"),
    (903, "Released under the MIT License."), (904, "the MIT; license: released, under"), (905, "Released under the license."), (906, "x " * 40 + MIT + " y" * 40),
    (907, "x " * 61 + " ".join(w for w in MIT.split() if w not in ("hereby",)) + " y" * 40), (908, "x " * 30 + " ".join(MIT.split()[:14])), (909, "cc by"), (910, "by cc"), (911, "reserved rights all"),
    (912, "Ä cc" + "é by"), (913, "z " * 20_000 + "all rights reserved " + "z " * 500 + "cc by"), (None, "cc by"), (None, "cc by"), (914, "'quoted' \\ back"), (914, "other"),
]


def plain(docs, templates=ls.TEMPLATES, phrases=ls.PHRASES, threshold=ls.THRESHOLD, width=ls.WIDTH, step=ls.STEP):
    out = []
    for i, text in docs:
        w = re.findall(ls.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        at = sorted((k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        base = {label for _, label in at}
        met = {}
        for lo in range(0, max(len(w) - (width - step), 1), step):
            block = set(w[lo : lo + width])
            for label, t in templates:
                tokens = set(t.split(" "))
                if len(block & tokens) >= threshold * len(tokens) - 1e-9:
                    met[label] = max(met.get(label, 0), len(block & tokens) / len(tokens))
        score = 1.0 if base else max(met.values(), default=0.0)
        out.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | set(met))), round(score, 9)))
    return sorted(map(str, out))


def got(df):
    return sorted(str((*tuple(r)[:-1], round(r["score"], 9))) for r in df.collect())


def test_equals_plain(spark):
    docs = documents() + AWKWARD
    df = spark.createDataFrame([(i, t, 1, "b", 5) for i, t in docs], "doc_id long, text string, row int, blocks string, n_words int").repartition(5)
    want = plain(docs)
    assert got(ls.scan(df)) == want
    assert sum("mit" in r for r in want) >= 4


def test_other_templates(spark):
    """Templates of corpus words: prefixes overlap, blocks share many words, ties of frequency."""
    docs = documents(11, 90) + AWKWARD
    templates = tuple((f"t{k}", " ".join(f"w{(k * 7 + j * j) % 60}" for j in range(6))) for k in range(40)) + (("one", "same"), ("two", "it's don't"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold, width, step in ((0.5, 64, 32), (0.34, 24, 8), (1.0, 500, 250)):
        want = plain(docs, templates, threshold=threshold, width=width, step=step)
        assert got(ls.scan(df, templates, threshold=threshold, width=width, step=step)) == want
    assert any(",t" in r for r in want) or any("t1" in r for r in plain(docs, templates, threshold=0.34))


def test_empty(spark):
    assert ls.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_is_native(spark):
    """No Python on the main path, and no join but equi-joins on words and rows."""
    plan = ls.scan(spark.createDataFrame(AWKWARD, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "Arrow" not in plan
