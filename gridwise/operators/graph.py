"""Connected components, union of groups and growth from seeds, as rounds of joins.

Each round's table is written with checkpoint() where a checkpoint folder is set, so lineage stays short and
survives lost executors.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window, functions as F


def settled(df: DataFrame) -> DataFrame:
    """df behind a cut of its lineage, in the folder of spark.checkpoint.dir; where it is unset, one of our own, on one
    machine only."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridwise-"))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of nodes(id) under undirected edges(a, b): the smallest id that is reachable. Labels
    spread to neighbours and then jump to their own label's label, so rounds grow with the logarithm of a path."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = settled(edges.select(ways.alias("e")).select("e.a", "e.b").distinct())
    labels = settled(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = spread.select(F.col("id").alias("component"), F.col("component").alias("further"))
        now = settled(spread.join(jump, "component", "left").select("id", "old", F.least("component", "further").alias("component")))
        changed = now.filter("component != old").limit(1).count()
        labels = now.select("id", "component")
        if not changed:
            return labels


def grow(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, seed, step): what seeds(id, seed) reach along directed edges(a, b); the earliest step wins, then the
    smallest seed."""
    reached = settled(seeds.groupBy("id").agg(F.min("seed").alias("seed")).withColumn("step", F.lit(0)))
    frontier, step = reached, 0
    while rounds is None or step < rounds:
        step += 1
        new = frontier.join(edges, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("seed").alias("seed"))
        frontier = settled(new.join(reached, "id", "left_anti").withColumn("step", F.lit(step)))
        if not frontier.head(1):
            break
        reached = settled(reached.unionByName(frontier))
    return reached


def placed(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with name, their place (from 1) in a total order: ranges are numbered each on its own, from the count before."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    bases, seen = [], 0
    for part, count in sorted(map(tuple, ranged.groupBy("_range").count().collect())):  # one row a range
        bases.append((part, seen))
        seen += count
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    bases = F.broadcast(spark.createDataFrame(bases, "_range int, _base long"))
    return ranged.withColumn(name, local).join(bases, "_range").withColumn(name, F.col("_base") + F.col(name)).drop("_range", "_base")


def stable_ids(groups: DataFrame, key: str, *order: Column, prefix: str) -> DataFrame:
    """groups with name, prefix-1, prefix-2, ... in the given order (one row a group)."""
    out = placed(groups, "name", *order, F.col(key).asc())
    return out.withColumn("name", F.concat(F.lit(prefix + "-"), F.col("name").cast("string")))
