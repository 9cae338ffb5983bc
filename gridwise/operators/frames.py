"""Depth frames and coverage: grid neighbours, depth ratios, consistency with what is established, lookups, support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.functions import vector as vm
from gridwise.operators.spatial import grid_pairs


def grid_neighbours(grid: DataFrame, *values: str) -> DataFrame:
    """grid(frame, row, col, ...) with left_, right_, up_ and down_ values, null beyond the border or a missing cell. A row
    or a column of one frame is a window of its own."""
    along, down = Window.partitionBy("frame", "row").orderBy("col"), Window.partitionBy("frame", "col").orderBy("row")
    for name, window, axis, step in (("left", along, "col", -1), ("right", along, "col", 1), ("up", down, "row", -1), ("down", down, "row", 1)):
        place = F.lag if step < 0 else F.lead
        there = place(axis).over(window) == F.col(axis) + step
        grid = grid.withColumns({f"{name}_{v}": F.when(there, place(v).over(window)) for v in values})
    return grid


def depth_ratios(grid: DataFrame) -> DataFrame:
    """For each frame of grid(frame, row, col, depth, valid): jumps among its pairs of neighbours, and valid cells that differ
    from three or four neighbours, as shares."""
    g = grid_neighbours(grid.withColumn("d", F.when(F.col("valid"), F.col("depth"))).select("frame", "row", "col", "d"), "d").filter("d is not null")
    d, sides = F.col("d"), [F.col(f"{s}_d") for s in ("left", "right", "up", "down")]
    number = lambda test, some: sum((F.coalesce(test(s).cast("int"), F.lit(0)) for s in some), F.lit(0))
    known = lambda s: s.isNotNull()
    jump = lambda s: F.abs(d - s) > F.greatest(F.lit(0.12), F.least(d, s) * 0.08)
    odd = lambda s: F.abs(d - s) > F.greatest(F.lit(0.25), d * 0.25)
    ahead = [sides[1], sides[3]]
    out = g.groupBy("frame").agg(
        F.count("*").alias("valid"), F.sum(number(known, ahead)).alias("pairs"), F.sum(number(jump, ahead)).alias("jumps"),
        F.count_if((number(known, sides) >= 3) & (number(odd, sides) >= 3)).alias("outliers"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return out.select("frame", "valid", share("jumps", "pairs").alias("jump_ratio"), share("outliers", "valid").alias("outlier_ratio"))


def established_relations(points: DataFrame, stable: DataFrame) -> DataFrame:
    """For points (id, position, normal): consistent with a stable sample (3.5 cm, normals within .8), else a duplicate
    (12 cm, 2.8 cm off its plane, normals within .94), else unknown."""
    cols = ["id", "x", "y", "z", "nx", "ny", "nz"]
    pairs = grid_pairs(points.select(*cols), stable.select(*cols), 0.1, 0.12, 2)
    dot = F.abs(vm.dot(vm.v("l_n"), vm.v("r_n")))
    residual = F.abs(vm.dot(vm.sub(vm.v("l_"), vm.v("r_")), vm.v("r_n")))
    found = pairs.groupBy(F.col("l_id").alias("id")).agg(
        F.max((F.col("d2") <= 0.035**2) & (dot >= 0.8)).alias("same"), F.max((residual >= 0.028) & (dot >= 0.94)).alias("beside")
    )
    relation = F.when(F.col("same"), "consistent").when(F.col("beside"), "duplicate").otherwise("unknown")
    return points.join(found, "id", "left").withColumn("relation", relation).drop("same", "beside")


def frame_consistency(points: DataFrame, stable: DataFrame, least: int = 32, most: int = 256) -> DataFrame:
    """Shares of each frame's relations, over about `most` of its points (every ceil(n / most)-th); all unknown as long as
    fewer than `least` samples are stable."""
    chosen = strided(points, "frame", ["id"], most)
    enough = stable.limit(least).count() == least
    related = established_relations(chosen, stable) if enough else chosen.withColumn("relation", F.lit("unknown"))
    share = lambda kind: F.avg((F.col("relation") == kind).cast("int"))
    return related.groupBy("frame").agg(F.count("*").alias("considered"), *(share(k).alias(k) for k in ("consistent", "duplicate", "unknown")))


def strided(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Every ceil(n / most)-th row of each key, in order. A key is a frame: a window of its own."""
    own = Window.partitionBy(key)
    placed = rows.withColumn("_n", F.count("*").over(own)).withColumn("_k", F.row_number().over(own.orderBy(*order)) - 1)
    return placed.filter(F.col("_k") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_n", "_k")


def coverage_lookup(points: DataFrame, covered: DataFrame, regions: DataFrame, width: float = 0.05, region: float = 0.1, plane: float = 0.04, reach: float = 0.1) -> DataFrame:
    """What covered(id, position, state) cells know of points (id, position): the nearest of the point's own cell (exact),
    else the nearest region (id, position, normal, state) it is coplanar with or the nearest cell around (neighbor), else
    a miss."""
    at, cols = ["id", "x", "y", "z"], lambda df, *more: df.select("id", "x", "y", "z", *more)
    near = grid_pairs(points.select(*at), cols(covered, "state"), width, None, 1)
    same = F.lit(True)
    for a in "xyz":
        same = same & (F.floor(F.col(f"l_{a}") / width) == F.floor(F.col(f"r_{a}") / width))
    first = lambda test: F.min(F.when(test, F.struct("d2", "r_id", "r_state")))
    near = near.withColumn("same", same).groupBy(F.col("l_id").alias("id")).agg(first(F.col("same")).alias("own"), first(~F.col("same") & (F.col("d2") < reach * reach)).alias("around"))
    flat = F.abs(vm.dot(vm.sub(vm.v("l_"), vm.v("r_")), vm.v("r_n"))) <= plane
    areas = grid_pairs(points.select(*at), cols(regions, "nx", "ny", "nz", "state"), region, region, 1).filter(flat)
    areas = areas.groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct("d2", "r_id", "r_state")).alias("area"))
    out = points.select("id").join(near, "id", "left").join(areas, "id", "left")
    kind = F.when(F.col("own").isNotNull(), "exact").when(F.coalesce("area", "around").isNotNull(), "neighbor").otherwise("miss")
    return out.select("id", kind.alias("kind"), F.coalesce("own.r_state", "area.r_state", "around.r_state").alias("state"))


def trimmed_support(points: DataFrame, key: str, trim: float = 0.05, least: int = 8) -> DataFrame:
    """points(key, u, v) inside the trimmed range of both axes; a key of fewer than `least`, or of which fewer than three
    would stay, keeps all."""
    q = lambda c, f: F.expr(f"percentile({c}, {f})")
    ranges = points.groupBy(key).agg(F.count("*").alias("_n"), q("u", trim).alias("_u0"), q("u", 1 - trim).alias("_u1"), q("v", trim).alias("_v0"), q("v", 1 - trim).alias("_v1"))
    within = lambda c: F.col(c).between(F.col(f"_{c}0") - 1e-9, F.col(f"_{c}1") + 1e-9)  # noqa: E731  an end counts, however it was rounded
    inside = within("u") & within("v")
    marked = points.join(ranges, key).withColumn("_in", inside)
    left = marked.groupBy(key).agg(F.count_if("_in").alias("_left"))
    return marked.join(left, key).filter((F.col("_n") < least) | (F.col("_left") < 3) | F.col("_in")).select(*points.columns)


def sidedness(points: DataFrame, lines: DataFrame, near: float = 0.04, opposing: float = 0.18, dominance: float = 0.72) -> DataFrame:
    """For lines (patch, line, u0, v0, u1, v1) and points (patch, u, v): how many lie on either side and near, and whether
    the line bounds the patch (with the side to keep), runs inside it, or cannot be told."""
    du, dv = F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0")
    size = F.sqrt(du * du + dv * dv)
    signed = (du * (F.col("v") - F.col("v0")) - dv * (F.col("u") - F.col("u0"))) / size
    pairs = lines.withColumn("size", size).join(points, "patch", "left").withColumn("off", F.when(F.col("size") > 2.3e-16, signed))
    c = pairs.groupBy("patch", "line", "size").agg(F.count_if(F.col("off") > near).alias("positive"), F.count_if(F.col("off") < -near).alias("negative"), F.count_if(F.abs("off") <= near).alias("close"))
    both = F.col("positive") + F.col("negative")
    kind = (
        F.when(F.col("size") <= 2.3e-16, "rejected").when(both == 0, "ambiguous").when(F.least("positive", "negative") / both >= opposing, "internal")
        .when((F.greatest("positive", "negative") / both < dominance) | (F.col("positive") == F.col("negative")), "ambiguous").otherwise("boundary")
    )
    c = c.withColumn("kind", kind)
    return c.select("patch", "line", "positive", "negative", "close", "kind", F.when(F.col("kind") == "boundary", F.signum(F.col("positive") - F.col("negative")).cast("int")).otherwise(0).alias("keep"))


def barred(triangles: DataFrame, samples: DataFrame) -> DataFrame:
    """triangles(triangle, a, b, c) with barrier: whether a corner is foreground or has the class of an object (2 or 3)."""
    corners = triangles.select("triangle", F.explode(F.array("a", "b", "c")).alias("id"))
    bars: Column = F.col("foreground") | F.col("class").isin(2, 3)
    hit = corners.join(samples.select("id", bars.alias("bar")), "id", "left").groupBy("triangle").agg(F.max(F.coalesce("bar", F.lit(False))).alias("barrier"))
    return triangles.join(hit, "triangle")


