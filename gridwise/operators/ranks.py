"""Places and quantiles of keys of any size.

Rows are dealt out by ranges of (keys, order), each range counts for itself, and what lies before a range is added:
one row a range and key. No key is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.operators.graph import settled


def running(rows: DataFrame, keys: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """rows with before, the weights (1 each, where there is none) of the rows of its keys before it in a total order, and
    total, that of all of its keys."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.lit(1).cast("long") if weight is None else weight.cast("long")
    ranged = settled(rows.withColumn("_w", weight).repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    each = ranged.groupBy("_range", *keys).agg(F.sum("_w").alias("_sum"))
    own = Window.partitionBy(*keys)  # a row a range: as many as there are partitions at most
    bases = each.withColumn("_base", F.coalesce(F.sum("_sum").over(own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("_sum").over(own))
    local = F.coalesce(F.sum("_w").over(Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("_local", local)
    same = F.col("_range") == F.col("r_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("r_" + k))
    bases = bases.select(F.col("_range").alias("r_range"), *(F.col(k).alias("r_" + k) for k in keys), "_base", "total")
    out = placed.join(bases, same).withColumn("before", F.col("_base") + F.col("_local"))
    return out.select(*rows.columns, "before", "total")


#: The place (from 0) of a quantile among n values: A nearest rank, B floor of (n - 1) f, D floor of n f.
PLACES = {"A": lambda n, f: F.ceil(n * F.lit(f)) - 1, "B": lambda n, f: F.floor((n - 1) * F.lit(f)), "D": lambda n, f: F.floor(n * F.lit(f))}


def _counted(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """The distinct values of x of each key, with their number and place."""
    counts = rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    return running(counts, keys, [x], F.col("_n"))


def _at(x: str, how: str, f: float) -> Column:
    """The value of x at a quantile's place, of rows of _counted()."""
    place = F.greatest(F.lit(0), PLACES[how](F.col("total"), f))
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("_n")), F.col(x)))


def quantiles(rows: DataFrame, keys: list[str], x: str, at: dict[str, float], how: str = "A") -> DataFrame:
    """For each of keys the quantiles of x, as columns named by at. Equal values are counted first."""
    return _counted(rows, keys, x).groupBy(*keys).agg(*(_at(x, how, f).alias(name) for name, f in at.items()))


def medians(rows: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """The median of x for each of keys: the mean of the two middle values where their number is even."""
    return _counted(rows, keys, x).groupBy(*keys).agg(((_at(x, "B", 0.5) + _at(x, "D", 0.5)) / 2).alias(name))
