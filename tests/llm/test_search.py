import brute
import pyarrow as pa
import pytest
from data import documents
from pyspark.sql import functions as F

from gridwise.llm import jaccard_join, substring_dedup

SCHEMA = "doc_id long, text string"


def digest(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    docs = documents(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    assert digest(substring_dedup.dedup_substrings(df)) == brute.substrings(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    docs = documents(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute.jaccard(docs)


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup.dedup_substrings(empty).collect() == []
    assert jaccard_join.jaccard_join(empty).collect() == []
    text = " ".join(f"t{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text, 9), (1, text, 9), (None, text, 9), (2, None, 9)], SCHEMA + ", row_id int")
    kept = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.dedup_substrings(rows).collect())
    assert kept == [(False, 0, 0), (True, 1, 30), (True, 1, 30), (True, 2, 0)]
    linked = [(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_join(rows).collect()]
    assert sorted(map(str, linked)) == sorted(map(str, [(None, None), (1, None), (1, None), (2, 2)]))


def test_tasks_without_any_repeat(spark):
    """What a task sends may lack entries of one kind: no repeated anchor, no repeated window, no signature."""
    docs = [(1, " ".join(f"a{i}" for i in range(30))), (2, " ".join(f"b{i}" for i in range(22)))]
    for part in (docs[:1], docs, [*docs, (3, "")], [(4, None)], [(4, None), (5, " ")]):
        df = spark.createDataFrame(part, SCHEMA).repartition(2)
        assert digest(substring_dedup.dedup_substrings(df)) == brute.substrings(part)
        got = sorted(tuple(r) for r in jaccard_join.jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute.jaccard(part)


def test_a_last_gather_without_repeats(spark, monkeypatch):
    """The rows after a task's last full gather are sent on their own."""
    shared = " ".join(f"s{i}" for i in range(40))
    docs = [(i, shared) for i in range(20)] + [(99, " ".join(f"u{i}" for i in range(25)))]
    monkeypatch.setattr(substring_dedup, "GATHER", 10)
    batches = lambda: iter([pa.RecordBatch.from_pydict({"row_id": [d], "text": [t]}) for d, t in docs])
    sent = list(substring_dedup._anchors(4)(batches()))
    assert len(sent) == len(docs)
