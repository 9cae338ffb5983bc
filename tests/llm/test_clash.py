"""Pipeline stages on tables with nulls, repeated rows, long texts and columns named like the operators' own."""

import pytest

import corpus_pipeline as cp

EXTRA = "score double, row_id long, row string, text_hash long, _key long, rep long, held_out boolean"


def tables(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{i % 97}" for i in range(n))
    good = "The quick survey of 1999 found that most of the towns kept their old bridges, walls and wells. "
    texts = [good * 3, good * 3, good * 3 + words("x", 3), words("long", 60_000), None, "", good + words("y", 40)]
    rows = [(i % 6 if i else None, t, "xx", ("a", None)[i % 2], len(t or ""), 0.1, 5, "r", 6, 7, 8, True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[1:3], "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words("x", 3)), (2, None), (3, "towns kept their old bridges,")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs


@pytest.mark.parametrize("name,f", cp.STAGES[:4])
def test_stages_keep_columns(spark, tmp_path, name, f):
    docs = tables(spark, tmp_path)
    out = f(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    rows = out.collect()
    assert {tuple(r)[5:] for r in rows} <= {(0.1, 5, "r", 6, 7, 8, True)}
    if name != "mix":
        assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    if name == "copies":  # all texts of the same sentences, and of each other group one; null and empty ones stay
        assert len(rows) == 5
    if name == "leaks":
        assert len(rows) == 3
    assert f(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_tokens_of_such_tables(spark, tmp_path):
    docs = tables(spark, tmp_path)
    rows = cp.tokens(spark, docs, str(tmp_path)).orderBy("start").collect()
    assert len(rows) == docs.count() and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    assert cp.tokens(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from gridwise.llm.common import scratch

    session = lambda master, folder: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}))
    assert scratch(session("spark://h:7077", "hdfs://x/y/")) == "hdfs://x/y"
    assert scratch(session("local[2]", None)).startswith("file:")
    for master in ("spark://h:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError):
            scratch(session(master, None))
