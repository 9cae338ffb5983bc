"""Token output, PII, rules, chat formatting, mixing and URLs against plain Python versions."""

from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from data import documents

from gridwise.llm import chat_format, mixing, pii, quality_rules, token_output, url_filter

SCHEMA = "doc_id long, text string"


def test_tokens_equal_the_tokenizer_on_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = documents(3, 60) + [(None, "null id"), (5, "again"), (5, "again"), (900, "café ﬁ ΑΣ a\x1cb \u00a0x don't 12ab FOO<|endoftext|>. ʼN")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in token_output.token_digests(df).collect()), key=lambda r: r[1])
    assert got == brute.tokens(docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert token_output.token_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pseudonyms_keep_format_link_values_and_come_back():
    text = "mail ana.Maria7@x.example.com, card 4111 1111 1111 1111 and 4111111111111112, ip 10.0.0.255, 999.1.1.1, ssn 123-45-6789 666-45-6789, tel +1 (017) 555-7713, on 2024-02-29 or 31/12/1999 not 2023-02-30, GB82 WEST 1234 5698 7654 32."
    new, counts = pii.pseudonymise(text, "k")
    assert counts == {"email": 1, "card": 1, "ip": 1, "ssn": 1, "phone": 1, "date": 2, "iban": 1}
    assert pii.restore(new, "k") == text and new != pii.pseudonymise(text, "other")[0]
    for gone in ("ana.Maria7@", "4111 1111", "10.0.0.255", "123-45-6789", "555-7713", "2024-02-29", "WEST 1234"):
        assert gone not in new
    for kept in ("4111111111111112", "999.1.1.1", "666-45-6789", "2023-02-30"):
        assert kept in new
    card = new.split("card ")[1][:19].replace(" ", "")
    assert pii.luhn_digit(card[:-1]) == card[-1]
    assert pii.pseudonymise("x 10.0.0.255 y", "k")[0].split()[1] in new


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_permutations_are_permutations(size):
    assert sorted(pii.permute(x, size, b"k", "t") for x in range(size)) == list(range(size))
    assert all(pii.permute(pii.permute(x, size, b"k", "t"), size, b"k", "t", True) == x for x in range(size))
    p = mixing.Permutation(size, "k")
    assert sorted(p.of(np.arange(size)).tolist()) == list(range(size))
    assert p.back(p.of(np.arange(size))).tolist() == list(range(size))


def test_pii_rows(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, "", 1), (2, "8.8.8.8", 1)], SCHEMA + ", n_card int")
    got = sorted((r["doc_id"], r["text"] or "", r["n_replaced"]) for r in pii.pseudonymised(rows, "k").collect())
    assert [g[2] for g in got] == [0, 0, 1] and pii.restore(got[2][1], "k") == "8.8.8.8"
    assert pii.pseudonymised(spark.createDataFrame([], SCHEMA), "k").collect() == []


def test_rules_equal_brute_force(spark):
    docs = documents(5, 80) + [(900, "a b c d e f g h " * 20 + "|#"), (901, "x\n" * 50 + "\n\n \n"), (901, None)]
    got = {}
    for r in quality_rules.quality_rules(spark.createDataFrame(docs, SCHEMA).repartition(3)).collect():
        got[r["doc_id"], r["n_words"]] = r
    for doc, text in docs:
        want = brute.quality_base(text)
        r = got[doc, want[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []


def test_compression_bands_reject_repetition_and_noise():
    import random

    import zstandard

    c = zstandard.ZstdCompressor(level=3).compress
    rng = random.Random(1)
    noise = bytes(rng.randrange(33, 127) for _ in range(20_000))
    prose = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "quality"]) + str(rng.randrange(99)) for _ in range(3000)).encode()
    assert quality_rules.compression(b"spam and eggs " * 900, c)[3] is False
    assert quality_rules.compression(noise, c)[3] is False
    assert quality_rules.compression(prose, c)[2:] == (0, True)


ROWS = [(1, 0, "system", "be <s>kind</s>"), (1, 1, "user", "[INST] hi \\ [\\INST]"), (1, 2, "assistant", "<\\s> ok </s>"), (1, 3, "critic[/ROLE]", None), (1, 4, "assistant", "fin"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
ROWS += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * 40) for i in range(60)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(5)
    windows = chat_format.format_conversations(df, budget=200, history=90, count=chat_format.words_and_marks)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(windows).collect()}
    want = defaultdict(list)
    for conv, _, role, text in ROWS:
        want[conv].append((role, text))
    assert got == {k: brute.conversation(v) for k, v in want.items()}
    mine = [w for w in windows.collect() if w["conv_id"] == 4]
    assert len(mine) > 10 and all(w["n_tokens"] <= 200 for w in mine) and all(len(chat_format.parse(w["text"])) > w["n_new"] for w in mine if w["window"])
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).collect() == []


def test_mix_meets_targets(spark):
    docs = [(d, ("a", "b", "c", None, "é")[d % 5], t) for d, t in documents(9, 150) if d != 14]
    docs += [(d + 1000, "a", "word " * 300) for d in range(60)] + [(1, "b", "twice the id"), (None, "b", "no id")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.taken(df.repartition(4), block=64).collect()
    assert len(rows) == len(docs)
    again = mixing.taken(df.repartition(7), block=64).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source_size"], r["target"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(k[1] for k in by) - 1.5 * total) < 1e-6 * total and len(by) == 5
    for (size, target), mine in by.items():
        assert sum(r["size"] for r in mine) == size and abs(sum(r["taken"] for r in mine) - target) <= 1
    assert mixing.taken(df.limit(0)).collect() == []


def test_mixed_documents_are_the_words_taken(spark):
    docs = [(d, t, "xx", "ab"[d % 2], len(t or "")) for d, t in documents(9, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(df, block=64).collect()}
    got = Counter()
    for r in mixing.mixed_documents(df, block=64).collect():
        got[r["doc_id"]] += len(brute.words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_targets_reshare_excess():
    assert mixing.targets(np.array([100, 100, 100])).tolist() == pytest.approx([200.0, 500 / 3, 250 / 3])
    assert mixing.targets(np.array([0, 0])).tolist() == [0.0, 0.0] and mixing.targets(np.array([])).tolist() == []
    assert mixing.targets(np.array([10])).tolist() == [15.0]


def test_urls_equal_sql(spark):
    urls = [None, "", "nothing", "http://", "https://A.Example.COM/en/7x?y", "http://example.com/en/8", "http://xexample.net/de/8", "http://sub.example.net/de/8/9#f", "http://org/es/", "http://a.org", "http://a.org?/es/", "ftp://x://y.com/en/", "http://com/en/z", "http://a..com/en/", "http://a.com./en/"]
    rows = [(i, u, "h") for i, u in enumerate(urls * 2)] + [(None, urls[4], "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = [tuple(r) for r in url_filter.judge(df, spark.createDataFrame(list(url_filter.RULES), "verdict string, host string, path string")).collect()]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert sorted(map(str, got)) == sorted(map(str, con.execute(url_filter.OP10_SQL).fetchall()))
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r["verdict"] for r in url_filter.judge(df, none).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0), none).collect() == []
