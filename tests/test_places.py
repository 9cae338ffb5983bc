"""Places in a total order, numbered in several tasks."""

from pyspark.sql import functions as F

from gridwise.operators import graph


def test_places_take_no_single_task(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 101).alias("k"), "id")
    out = graph.placed(df, "place", F.desc("k"), F.col("id").asc())
    want = sorted(((i * 37 % 101, i) for i in range(1000)), key=lambda r: (-r[0], r[1]))
    assert [(r["k"], r["id"]) for r in sorted(out.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in out.collect()) == list(range(1, 1001))
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert graph.placed(df.limit(0), "place", F.col("id").asc()).collect() == []
