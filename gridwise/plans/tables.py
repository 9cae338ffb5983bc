"""The driver's tables read as samples, frames and trajectories, in Spark and in the same words in SQL.

Columns serve as coordinates: the operators are what is tested, not rooms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

XYZ = ("x", "y", "z")


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


#: A total order of lineitem rows; rows equal in all of it are equal in every column used here.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as samples: x, y, z from quantity, discount and tax; frame from the return flag; r, g, b in [0, 1]."""
    li = read(spark, sf, "lineitem")
    return li.select(
        "*",
        (F.col("l_quantity") - 25).alias("x"),
        (F.col("l_discount") * 100 - 5).alias("y"),
        (F.col("l_tax") * 100).alias("z"),
        F.col("l_returnflag").alias("frame"),
        (F.col("l_quantity") / 50).alias("r"),
        (F.col("l_discount") * 10).alias("g"),
        (F.col("l_tax") * 12.5).alias("b"),
        F.col("l_quantity").alias("w"),
    )


LINES = "li AS (SELECT *, l_quantity - 25 AS x, l_discount * 100 - 5 AS y, l_tax * 100 AS z, l_returnflag AS frame, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 12.5 AS b, l_quantity AS w FROM lineitem)"


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as oriented samples: position, unit normal, colour and counts."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    raw = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("frame"),
        e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("a"), e(4).alias("b"), e(5).alias("c"),
        F.least(F.lit(1.0), F.abs(e(6)) * 4).alias("red"), F.least(F.lit(1.0), F.abs(e(7)) * 4).alias("green"), F.least(F.lit(1.0), F.abs(e(8)) * 4).alias("blue"),
        (F.lit(1) + F.col("vec_id") % 5).cast("int").alias("seen"), (F.lit(1) + F.col("vec_id") % 3).cast("int").alias("views"),
    )
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    return raw.select("id", "frame", *XYZ, *((F.col(k) / n).alias(f"n{x}") for k, x in zip("abc", XYZ, strict=True)), "red", "green", "blue", "seen", "views")


_E = lambda i: f"embedding[{i + 1}]::DOUBLE"
SAMPLES = f"""
    raw AS (SELECT vec_id AS id, label AS frame, {_E(0)} AS x, {_E(1)} AS y, {_E(2)} AS z, {_E(3)} AS a, {_E(4)} AS b, {_E(5)} AS c,
                   least(1.0, abs({_E(6)}) * 4) AS red, least(1.0, abs({_E(7)}) * 4) AS green, least(1.0, abs({_E(8)}) * 4) AS blue,
                   (1 + vec_id % 5)::INT AS seen, (1 + vec_id % 3)::INT AS views FROM embeddings),
    s AS (SELECT id, frame, x, y, z, a / sqrt(a*a + b*b + c*c) AS nx, b / sqrt(a*a + b*b + c*c) AS ny, c / sqrt(a*a + b*b + c*c) AS nz,
                 red, green, blue, seen, views FROM raw)"""


def poses(spark: SparkSession, sf: str) -> DataFrame:
    """events as poses of one device a user: time in microseconds and milliseconds, position and heading from the value."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return read(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", t.alias("t"), (t / 1000).alias("ms"),
        (F.col("value") / 100).alias("px"), (F.col("event_id") % 7 / 10).alias("py"), (F.col("event_id") % 11 / 10).alias("pz"),
        (F.col("event_id") * 37 % 360).cast("double").alias("yaw"),
    )


POSES = """p AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, epoch_us(ts) / 1000 AS ms, value / 100 AS px,
             event_id % 7 / 10 AS py, event_id % 11 / 10 AS pz, (event_id * 37 % 360)::DOUBLE AS yaw FROM events)"""
