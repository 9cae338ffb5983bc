"""Planes: ownership, relations, robust fits and hypotheses. A plane is a unit normal and n.x = k."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridwise.functions import vector as vm
from gridwise.operators.spatial import best

#: Planes, patches and frames of one scan are few; a table above this is an error, not a broadcast.
MOST_SMALL_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast once its size is known to be small."""
    rows = df.limit(MOST_SMALL_ROWS + 1).count()
    if rows > MOST_SMALL_ROWS:
        raise ValueError(f"more than {MOST_SMALL_ROWS} rows on the small side of a join")
    return F.broadcast(df)


def own(points: DataFrame, planes: DataFrame, most_residual: float, least_dot: float, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Each point's plane of lowest score among those near enough and of similar normal."""
    pl = planes.select("plane", *(F.col(f"n{a}").alias(f"p_n{a}") for a in "xyz"), F.col("k").alias("p_k"))
    n = vm.v("p_n")
    pairs = points.join(small(pl), F.abs(vm.plane_residual(vm.v(), n, F.col("p_k"))) <= most_residual)
    residual, dot = F.abs(vm.plane_residual(vm.v(), n, F.col("p_k"))), F.abs(vm.dot(vm.v("n"), n))
    pairs = pairs.withColumn("residual", residual).withColumn("agreement", dot).filter(F.col("agreement") >= least_dot)
    return best(pairs.withColumn("score", score(F.col("residual"), F.col("agreement"))), ["id"], F.col("score"), F.col("plane"))


def relationships(planes: DataFrame, parallel: float = 12.0, perpendicular: float = 78.0) -> DataFrame:
    """Every unordered pair of planes with its angle in degrees and kind."""
    side = lambda p, name: planes.select(F.col("plane").alias(name), *(F.col(f"n{a}").alias(f"{p}n{a}") for a in "xyz"), F.col("k").alias(f"{p}k"))
    pairs = side("a", "first").join(small(side("b", "second")), F.col("first") < F.col("second"))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(vm.dot(vm.v("an"), vm.v("bn"))))))
    kind = F.when(F.round("angle", 4) <= parallel, "parallel").when(F.round("angle", 4) >= perpendicular, "perpendicular").otherwise("oblique")
    return pairs.withColumn("angle", angle).withColumn("kind", kind)


def in_polygons(points: DataFrame, patches: DataFrame) -> DataFrame:
    """Of points (id, u, v) inside patches (patch, polygon): the patch whose edge is farthest away."""
    inside, edge = vm.polygon_status(F.col("u"), F.col("v"), F.col("polygon"))
    box = lambda f, k: f(F.transform("polygon", lambda p: p[k]))
    boxed = patches.select("*", box(F.array_min, "u").alias("u0"), box(F.array_max, "u").alias("u1"), box(F.array_min, "v").alias("v0"), box(F.array_max, "v").alias("v1"))
    pairs = points.join(small(boxed), F.col("u").between(F.col("u0"), F.col("u1")) & F.col("v").between(F.col("v0"), F.col("v1")))
    pairs = pairs.withColumn("inside", inside).withColumn("edge", edge).filter("inside")
    return best(pairs, ["id"], F.desc("edge"), F.col("patch"))


def smallest_eigenvector(c: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit eigenvector of the smallest eigenvalue of a symmetric matrix, its largest component positive."""
    values, vectors = np.linalg.eigh(c)
    n = vectors[:, 0]
    return n * (1.0 if n[np.argmax(np.abs(n))] >= 0 else -1.0), float(max(0.0, values[0]))


def fitted(moments: DataFrame, *keys: str) -> DataFrame:
    """Planes from covariance(): nx, ny, nz, k, rms for each row (one a group, so few)."""

    def fit(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                c = np.array([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]])
                n, value = smallest_eigenvector(c)
                rows.append((*n, float(n @ [r.mx, r.my, r.mz]), value**0.5))
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(rows, columns=["nx", "ny", "nz", "k", "rms"], dtype=float)], axis=1)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in moments.schema.fields)
    return moments.mapInPandas(fit, fields + ", nx double, ny double, nz double, k double, rms double")


def robust_fit(points: DataFrame, key: str, passes: int = 3, error: float = 0.045, tolerance: float = 0.05, least: float = 0.005, spread: float = 3.0) -> DataFrame:
    """A plane for each key. Each pass keeps, of the points still held, those within
    min(tolerance, max(error, median + max(least, spread * MAD))) of the plane so far, and fits again; a key whose
    points all stay has the same plane in the next pass, and one with fewer than three has none."""
    from gridwise.operators.aggregate import covariance, moments
    from gridwise.operators.graph import settled

    held = points.select(key, "x", "y", "z", "w")
    planes = fitted(covariance(moments(held, key)))
    for _ in range(passes):
        off = held.join(planes.select(key, "nx", "ny", "nz", "k").withColumnsRenamed({"nx": "pn_x", "ny": "pn_y", "nz": "pn_z", "k": "pk"}), key)
        off = off.withColumn("off", F.abs(F.col("x") * F.col("pn_x") + F.col("y") * F.col("pn_y") + F.col("z") * F.col("pn_z") - F.col("pk")))
        off = settled(off.select(key, "x", "y", "z", "w", "off"))
        median = off.groupBy(key).agg(F.expr("percentile(off, 0.5)").alias("med"))
        dev = off.join(median, key).withColumn("dev", F.abs(F.col("off") - F.col("med"))).groupBy(key, "med").agg(F.expr("percentile(dev, 0.5)").alias("mad"))
        adaptive = F.col("med") + F.greatest(F.lit(least), F.col("mad") * spread)
        limit = dev.select(key, F.least(F.lit(tolerance), F.greatest(F.lit(error), adaptive)).alias("limit"))
        held = off.join(limit, key).filter("off <= limit").select(key, "x", "y", "z", "w")
        enough = held.groupBy(key).count().filter("count >= 3").select(key)
        held = settled(held.join(enough, key, "left_semi"))
        planes = fitted(covariance(moments(held, key)))
    return planes


def xorshift(state: int):
    """The fixed generator of hypotheses: 32-bit xorshift, values in [0, 1)."""
    while True:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        yield state / 4294967296


def hypothesis_scores(points: DataFrame, tries: np.ndarray, inlier: float, least_area: float) -> DataFrame:
    """For each row (nx, ny, nz, k) of tries, by its number h: inliers, and its score, the inliers' weight times qualities of
    their bounds' area and of their weighted RMS distance. One pass over the points, with sums for each task."""
    normals, offsets = tries[:, :3], tries[:, 3]
    helper = np.where(np.abs(normals[:, 1:2]) < 0.9, [[0.0, 1.0, 0.0]], [[1.0, 0.0, 0.0]])
    u = np.cross(helper, normals)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.cross(normals, u)

    def sums(batches):
        n, w, w2 = np.zeros(len(tries), np.int64), np.zeros(len(tries)), np.zeros(len(tries))
        low, high = np.full((2, len(tries)), np.inf), np.full((2, len(tries)), -np.inf)
        for pdf in batches:
            p, weight = pdf[["x", "y", "z"]].to_numpy(float), pdf["w"].to_numpy(float)
            for lo in range(0, len(p), 2_000):
                part, pw = p[lo : lo + 2_000], weight[lo : lo + 2_000]
                off = np.abs(part @ normals.T - offsets)
                on = off <= inlier
                h, row = np.nonzero(on.T)  # the inliers, hypothesis by hypothesis: few of all pairs
                if not len(h):
                    continue
                near, pw_ = off[row, h], pw[row]
                n += np.bincount(h, minlength=len(tries))
                w += np.bincount(h, pw_, len(tries))
                w2 += np.bincount(h, pw_ * near * near, len(tries))
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                for i, axis in enumerate((u, v)):
                    at = np.einsum("ij,ij->i", part[row], axis[h])
                    low[i][h[first]] = np.minimum(low[i][h[first]], np.minimum.reduceat(at, first))
                    high[i][h[first]] = np.maximum(high[i][h[first]], np.maximum.reduceat(at, first))
        yield pd.DataFrame({"h": np.arange(len(tries), dtype=np.int32), "n": n, "w": w, "w2": w2, "u0": low[0], "u1": high[0], "v0": low[1], "v1": high[1]})[n > 0]

    each = points.select("x", "y", "z", "w").mapInPandas(sums, "h int, n long, w double, w2 double, u0 double, u1 double, v0 double, v1 double")
    total = each.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "w", "w2")), F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.min("v0").alias("v0"), F.max("v1").alias("v1"))
    rms = F.when(F.col("w") > 0, F.sqrt(F.col("w2") / F.col("w"))).otherwise(inlier)
    clamped = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    area = 0.5 + 0.5 * clamped((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")) / max(2 * least_area, 1.0))
    return total.select("h", F.col("n").alias("inliers"), (F.col("w") * area * (0.5 + 0.5 * (1 - clamped(rms / inlier)))).alias("score"))


def dominant_planes(points: DataFrame, planes: int = 12, hypotheses: int = 320, inlier: float = 0.04, enough: float = 0.7, seed: int = 0x6D2B79F5, sample: int = 2_000, least_points: int = 24, least_area: float = 0.2) -> DataFrame:
    """Planes of points (id, x, y, z, w), as they are found: hypotheses are triples of `sample` points drawn from what is
    left (which points are tried is a sample by nature; `sample` bounds what the driver holds), each scored over all
    of what is left; the best takes its inliers away. Ends when `enough` of the points are taken."""
    from gridwise.operators.aggregate import covariance, moments
    from gridwise.operators.graph import settled

    spark, left, found = points.sparkSession, settled(points.select("id", "x", "y", "z", "w")), None
    n = total = left.count()
    random = xorshift(seed)
    for number in range(1, planes + 1):
        if n < least_points or total - n >= enough * total:
            break
        step = max(1, n // sample)
        some = np.array([[r.x, r.y, r.z] for r in left.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
        if len(some) < 3:
            break
        tries = []
        for _ in range(hypotheses):
            a, b, c = some[[int(next(random) * len(some)) for _ in range(3)]]
            normal = np.cross(b - a, c - a)
            size = np.linalg.norm(normal)
            if size > 1e-9:
                tries.append((*(normal / size), normal @ a / size))
        if not tries:
            break
        tries = np.array(tries)
        top = hypothesis_scores(left, tries, inlier, least_area).filter(F.col("inliers") >= least_points).orderBy(F.desc(F.round("score", 6)), "h").first()
        if top is None:
            break
        hx, hy, hz, hk = map(float, tries[top["h"]])
        near = F.abs(F.col("x") * hx + F.col("y") * hy + F.col("z") * hz - F.lit(hk)) <= inlier
        plane = fitted(covariance(moments(left.filter(near).withColumn("plane", F.lit(number)), "plane"))).select("plane", "n", "nx", "ny", "nz", "k", "rms")
        found = plane if found is None else found.unionByName(plane)
        left, n = settled(left.filter(~near)), n - top["inliers"]
    return found if found is not None else spark.createDataFrame([], "plane int, n long, nx double, ny double, nz double, k double, rms double")
