"""Spatial joins on a grid: equi-joins on cell keys with the exact predicate as residual.

One side is expanded to the cells around its own, the other keeps its cell, so Spark plans a hash or
sort-merge join on three integers and never a product of the sides. Cell width, reach (in cells) and radius are
separate: a radius above width * reach finds only what lies in the cells that are looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.functions.numeric import cells
from gridwise.operators import near

KEYS = ["cx", "cy", "cz"]


def around(df: DataFrame, reach: int = 1, dims: int = 3) -> DataFrame:
    """Each row once for every cell within reach of its own."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    for k in KEYS[:dims]:
        df = df.withColumn("_d", F.explode(steps)).withColumn(k, F.col(k) + F.col("_d")).drop("_d")
    return df


def grid_pairs(left: DataFrame, right: DataFrame, width: float, radius: float | None = None, reach: int = 1, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """Pairs of left and right rows (columns l_* and r_*) in cells within reach, with d2, at most radius apart."""
    left = left.select(*(F.col(x).alias(f"l_{x}") for x in left.columns), *cells(width))
    right = right.select(*(F.col(x).alias(f"r_{x}") for x in right.columns), *cells(width))
    d2 = sum((F.pow(F.col(f"r_{a}") - F.col(f"l_{a}"), 2) for a in "xyz"), F.lit(0.0))
    pairs = around(left, reach).join(right, KEYS).drop(*KEYS).withColumn("d2", d2)
    return pairs if radius is None else pairs.filter(F.col("d2") <= radius * radius)


def best(pairs: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The k first rows of each key under a total order, numbered by rank."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def nearest_compatible(left: DataFrame, right: DataFrame, width: float, radius: float, judge: Callable, reach: int = 1) -> DataFrame:
    """For each left row its right row of lowest score among those within radius that are compatible: judge(l, r, d2) of
    near.best() gives both."""
    found = near.best(left, right, radius, lambda a, b, d2: (*judge(a, b, d2), np.zeros(len(d2), bool)), (width, reach))
    return found.filter("r_id is not null").select("l_id", "r_id", "score")


def match_report(left: DataFrame, right: DataFrame, width: float, radius: float, most_plane: float, least_dot: float, reach: int = 1) -> DataFrame:
    """As nearest_compatible for surfaces, with the reason of a failure: near, but normal or plane disagree, or none."""

    def judge(a: near.Rows, b: near.Rows, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dot, off = normal_dot(a, b), plane_offset(a, b)
        agree, flat = dot >= least_dot, abs(off) <= most_plane
        return agree & flat, d2 + off * off - dot * 1e-4, agree & ~flat

    found = near.best(left, right, radius, judge, (width, reach))
    out = left.select(F.col("id").alias("l_id")).join(found, "l_id", "left")
    return out.select(
        "l_id",
        "r_id",
        F.when(F.col("r_id").isNotNull(), "matched").when(F.coalesce("candidates", F.lit(0)) == 0, "no-candidate").when(F.col("flagged") > 0, "plane-mismatch").otherwise("normal-mismatch").alias("outcome"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
    )


def normal_dot(a: near.Rows, b: near.Rows) -> np.ndarray:
    """Of pairs in arrays, as all of these."""
    return a("nx") * b("nx") + a("ny") * b("ny") + a("nz") * b("nz")


def plane_offset(a: near.Rows, b: near.Rows) -> np.ndarray:
    """Of the left point from the right row's tangent plane."""
    return sum((a(x) - b(x)) * b(f"n{x}") for x in "xyz")


def tangent_offset(a: near.Rows, b: near.Rows, d2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, d2 - plane_offset(a, b) ** 2))


def knn(left: DataFrame, right: DataFrame, width: float, radius: float, k: int, fits: near.Fits | None = None, reach: int = 1, self_join: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The k nearest right rows of each left row within radius, in cells within reach; ties by x, y, z, then id. keep: the
    columns r_* and d2 that are wanted."""
    return spread(near.nearest(left, right, radius, k, fits, (width, reach) if radius > width * reach else None, self_join, keep))


def spread(hoods: DataFrame) -> DataFrame:
    """near.nearest() with a row for each neighbour (r_*, d2, rank)."""
    names = [f.name for f in hoods.schema["near"].dataType.elementType.fields]
    pairs = hoods.select("*", F.posexplode("near").alias("_i", "_r"))
    return pairs.select(*(c for c in hoods.columns if c != "near"), *(F.col(f"_r.{n}").alias(n if n == "d2" else f"r_{n}") for n in names), (F.col("_i") + 1).alias("rank"))


def within_time(left: DataFrame, right: DataFrame, tolerance_us: int, keys: list[str]) -> DataFrame:
    """For each left row the right row of equal keys nearest in time (column t, microseconds), if within the
    tolerance: an equi-join on time buckets of that width. Ties by the earlier t, then id."""
    bucket = F.floor(F.col("t") / tolerance_us)
    left = left.select(*keys, *(F.col(x).alias(f"l_{x}") for x in left.columns if x not in keys), bucket.alias("b")).withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    right = right.select(*keys, *(F.col(x).alias(f"r_{x}") for x in right.columns if x not in keys), bucket.alias("b"))
    pairs = left.join(right, [*keys, "b"]).drop("b").withColumn("dt", F.abs(F.col("l_t") - F.col("r_t"))).filter(F.col("dt") <= tolerance_us)
    return best(pairs, ["l_id"], F.col("dt"), F.col("r_t"), F.col("r_id"))
