"""Equal doc_ids in several sources keep their own words; blocks come in the order of the mix."""

from collections import Counter, defaultdict

import brute

from gridwise.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOURCES = ["a", "b", "c", None, ""]


def docs_of(spark, same):
    rows = [(d, " ".join(f"w{d}_{i}" if same else f"{s}{d}_{i}" for i in range(40 + d * 7)), "xx", s, 0) for s in SOURCES for d in range(12)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_taken_is_per_source(spark):
    _, df = docs_of(spark, True)
    rows = mixing.taken(df, block=64).collect()
    assert len(rows) == 60 and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * sum(r["size"] for r in rows)) <= 5


def test_mixed_documents_keep_their_source(spark):
    _, df = docs_of(spark, True)
    pieces = mixing.mix(df, block=64)[1].collect()
    want, got = Counter(), Counter()
    for p in pieces:
        want[p["source"], p["doc_id"]] += p["n_words"]
    for r in mixing.mixed_documents(df, block=64).collect():
        got[r["source"], r["doc_id"]] += len(brute.words(r["text"]))
    assert got == want and {s for s, _ in got} == set(SOURCES)


def test_blocks_come_in_order(spark):
    rows, df = docs_of(spark, False)
    stream = defaultdict(list)
    for s, d in sorted({(s, d) for _, _, _, s, d in ((0, 0, 0, r[3], r[0]) for r in rows)}, key=lambda x: (x[0] is None, x)):
        stream[s] += next(r[1] for r in rows if r[3] == s and r[0] == d).split(" ")
    out = mixing.mixed_blocks(df, block=64).withColumn("part", mixing.F.spark_partition_id()).collect()
    shards, blocks = defaultdict(set), []
    for r in out:
        shards[r["shard"]].add(r["part"])
        key = (r["shard"], r["source"], r["slot"])
        if not blocks or blocks[-1][0] != key:
            blocks.append((key, r["position"], []))
        blocks[-1][2].extend(brute.words(r["text"]))
    assert all(len(p) == 1 for p in shards.values()) and len({b[0] for b in blocks}) == len(blocks)
    assert all(words == stream[key[1]][at : at + len(words)] and at % 64 == 0 for key, at, words in blocks)
    slots = [(k[1], k[2]) for k, _, _ in blocks]
    assert slots != sorted(slots, key=str)


def test_taken_equals_reading_every_slot(spark):
    """Brute force: each slot of the plan reads its block of the source's words, one word at a time."""
    rows = [(d % 37, "w " * (3 + 11 * d % 97), None, SOURCES[d % 5], 0) for d in range(90)] + [(7, None, None, "a", 0), (8, "", None, None, 0), (9, "x " * 3000, None, "b", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(brute.words(r[1])) for r in rows if r[3] == s) for s in order]
    words = {i: [(d, len(t)) for d, t in sorted((r[0], brute.words(r[1])) for r in rows if r[3] == s) for _ in t] for i, s in enumerate(order)}
    plan = mixing.pd.DataFrame({"source": mixing.pd.Series(order, dtype=object), "source_no": range(5), "source_size": sizes, "target": mixing.targets(mixing.np.array(sizes))})
    want = Counter()
    for r in mixing.slots(spark, plan, 32, mixing.SEED, 4).collect():
        for word in words[r["source_no"]][r["block"] * 32 :][: min(32, r["n_words"])]:
            want[r["source_no"], *word] += 1
    got = Counter()
    numbers = {s: i for i, s in enumerate(sizes)}
    for r in mixing.taken(df, block=32).collect():
        got[numbers[r["source_size"]], r["doc_id"], r["size"]] += r["taken"]
    assert len(numbers) == 5 and got == want


def test_draws_agree_wherever_they_are_made():
    counts = [1000, 0, 37, 512]
    whole = list(mixing.shard_draws(counts, 9, 0, 9, 20))
    assert [s for s, _, _ in whole] == list(range(9))
    assert [sum(d) for _, _, d in whole] == [173] + [172] * 8 and sum(counts) == 173 + 172 * 8
    assert [sum(x) for x in zip(*(d for _, _, d in whole), strict=True)] == counts
    before = [0] * 4
    for _, first, drawn in whole:
        assert first == before and min(drawn) >= 0
        before = [a + b for a, b in zip(before, drawn, strict=True)]
    for i in range(9):
        assert list(mixing.shard_draws(counts, 9, i, i + 1, 20)) == [whole[i]]
    assert list(mixing.shard_draws(counts, 9, 0, 9, 21)) != whole
    big = [3 * 10**12, 10**12, 5]
    shards = sum(big) // 256
    for shard, first, drawn in mixing.shard_draws(big, shards, shards // 2, shards // 2 + 3, 20):
        assert sum(drawn) in (256, 257) and 150 < drawn[0] < 235 and first[0] / sum(first) > 0.74


def test_clashing_columns_and_nulls(spark):
    rows = [(1, "a b c", "s", 7, 8, 9, 10, 11), (1, "a b c", "s", 7, 8, 9, 10, 11), (None, None, None, None, None, None, None, None)]
    names = "doc_id long, text string, source string, text_hash long, key long, pieces long, shard long, _shard long"
    df = spark.createDataFrame(rows, names)
    out = mixing.mixed_documents(df, block=2)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len(r["text"].split()) for r in got) == 9 and {tuple(r)[2:] for r in got} == {("s", 7, 8, 9, 10, 11)}
    blocks = mixing.mixed_blocks(df, block=2)
    assert blocks.columns == ["doc_id", "text", "source", "text_hash", "key", "pieces", "_shard", "shard", "slot", "position"] and blocks.count() == len(got)
    assert sorted(r["taken"] for r in mixing.taken(df, block=2).collect())[0] == 0
    assert mixing.mixed_documents(df.limit(0)).collect() == []


def test_rows_that_differ_in_another_column_keep_their_own_pieces(spark):
    """Whatever the partitions: each of the equal texts is read as often as its own place says, with its own columns."""
    text = " ".join(f"w{i}" for i in range(700))
    rows = [(1, text, lang, "s", 0, extra) for lang, extra in (("en", {"k": 1}), ("de", {"k": 1}), ("fr", {"k": 1}), (None, None), ("en", {"k": 2}), ("en", {"k": 1}))]
    df = spark.createDataFrame(rows, SCHEMA + ", row_hash map<string, int>")
    seen = set()
    for parts in (1, 3, 6):
        out = mixing.mixed_documents(df.repartition(parts, *(["lang"] if parts == 3 else [])), block=64)
        assert out.columns == df.columns
        words = Counter()
        for r in out.collect():
            words[r["lang"], str(r["row_hash"])] += len(brute.words(r["text"]))
        seen.add(tuple(sorted(words.items(), key=str)))
    (got,) = seen
    assert len(got) == 5 and sum(n for _, n in got) == 6 * 700 * 3 // 2 and all(n >= 700 for _, n in got)


def test_batches_that_begin_no_source(spark):
    """A partition of several batches for Python, most of which only go on with a source."""
    rows, df = docs_of(spark, True)
    whole = sorted(map(tuple, mixing.taken(df, block=64).collect()))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "2")
    try:
        assert sorted(map(tuple, mixing.taken(df, block=64).collect())) == whole
        sizes, at = defaultdict(int), {}
        for r in sorted(mixing.mix(df, block=64)[0].collect(), key=lambda r: (str(r["source_no"]), r["doc_id"])):
            at[r["source_no"], r["doc_id"]] = r["start"], sizes[r["source_no"]]
            sizes[r["source_no"]] += r["size"]
        assert all(got == want for got, want in at.values())
    finally:
        spark.conf.set(setting, before)
