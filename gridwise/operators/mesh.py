"""Triangles, grids, hulls and polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def adjacent(triangles: DataFrame) -> DataFrame:
    """Pairs (first, second, edges) of triangles (id, a, b, c) that share edges."""
    edge = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    edges = triangles.select("id", F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("a", "c"))).alias("e")).select("id", "e.p", "e.q")
    other = edges.select(F.col("id").alias("second"), "p", "q")
    return edges.join(other, ["p", "q"]).filter("id < second").groupBy(F.col("id").alias("first"), "second").agg(F.count("*").alias("edges"))


def quads(grid: DataFrame, frame: str = "frame") -> DataFrame:
    """Cells of a depth grid (frame, row, col, depth, valid) with their four corners' depths d00, d01, d10, d11."""
    across, down = Window.partitionBy(frame, "row").orderBy("col"), Window.partitionBy(frame, "col").orderBy("row")
    g = grid.withColumn("next_col", F.lead("col").over(across)).withColumn("d01", F.lead("depth").over(across)).withColumn("v01", F.lead("valid").over(across))
    for k in ("row", "depth", "valid", "d01", "v01", "next_col"):
        g = g.withColumn(f"below_{k}", F.lead(k).over(down))
    g = g.filter("next_col = col + 1 and below_row = row + 1 and below_next_col = col + 1")
    valid = F.col("valid") & F.col("v01") & F.col("below_valid") & F.col("below_v01")
    return g.select(frame, "row", "col", F.col("depth").alias("d00"), "d01", F.col("below_depth").alias("d10"), F.col("below_d01").alias("d11"), valid.alias("complete"))


def judged_quads(cells: DataFrame, most_step: float, relative: float) -> DataFrame:
    """quads() with an outcome: the first that applies of missing, depth-step, degenerate, accepted."""
    d = [F.col(k) for k in ("d00", "d01", "d10", "d11")]
    near, far = F.least(*d), F.greatest(*d)
    outcome = F.when(~F.col("complete"), "missing").when(near <= 0, "degenerate").when(far - near > F.greatest(F.lit(most_step), near * relative), "depth-step").otherwise("accepted")
    return cells.withColumn("outcome", outcome)


def quad_triangles(cells: DataFrame, columns: int) -> DataFrame:
    """Two triangles of sample numbers for each accepted quad, cut along the diagonal with the smaller step."""
    i = F.col("row") * columns + F.col("col")
    a, b, c, d = i, i + 1, i + columns, i + columns + 1
    main = F.abs(F.col("d00") - F.col("d11")) <= F.abs(F.col("d01") - F.col("d10"))
    tri = lambda *p: F.struct(*(x.alias(n) for x, n in zip(p, "abc", strict=True)))
    both = F.when(main, F.array(tri(a, c, d), tri(a, d, b))).otherwise(F.array(tri(a, c, b), tri(b, c, d)))
    return cells.filter("outcome = 'accepted'").select("frame", F.explode(both).alias("t")).select("frame", "t.*")


def grid_normals(grid: DataFrame, frame: str = "frame", most: float = 0.25) -> DataFrame:
    """Unit normals of a grid of points (frame, row, col, x, y, z) from a neighbour across and one below: the next
    one where it is near enough in depth, else the one before; null where either is missing."""
    across, down = Window.partitionBy(frame, "row").orderBy("col"), Window.partitionBy(frame, "col").orderBy("row")
    p = F.struct("x", "y", "z", "row", "col")
    g = grid
    for name, w, key in (("u", across, "col"), ("v", down, "row")):
        after, before = F.lead(p).over(w), F.lag(p).over(w)
        fits = lambda q, k=key: q.isNotNull() & (F.abs(q[k] - F.col(k)) == 1) & (F.abs(q["z"] - F.col("z")) <= F.abs(F.col("z")) * most)
        step = lambda q, s: F.struct(*(((q[a] - F.col(a)) * s).alias(a) for a in "xyz"))
        g = g.withColumn(name, F.when(fits(after), step(after, 1.0)).when(fits(before), step(before, -1.0)))
    u, v = F.col("u"), F.col("v")
    n = (u["y"] * v["z"] - u["z"] * v["y"], u["z"] * v["x"] - u["x"] * v["z"], u["x"] * v["y"] - u["y"] * v["x"])
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return g.select(frame, "row", "col", *(F.when(size > 1e-9, x / size).alias(k) for x, k in zip(n, ("nx", "ny", "nz"), strict=True)))


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the smallest point, without points on its edges."""
    p = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list[np.ndarray] = []
        for q in rows:
            while len(out) > 1 and np.linalg.det([out[-1] - out[-2], q - out[-2]]) <= 1e-12:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def area(polygon: np.ndarray) -> float:
    x, y = polygon[:, 0], polygon[:, 1]
    return float(0.5 * (np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) if len(polygon) > 2 else 0.0


def clip(polygon: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    """The part of a polygon where a*u + b*v <= c."""
    out = []
    for p, q in zip(polygon, np.roll(polygon, -1, axis=0), strict=True):
        dp, dq = a * p[0] + b * p[1] - c, a * q[0] + b * q[1] - c
        if dp <= 0:
            out.append(p)
        if (dp < 0 < dq) or (dq < 0 < dp):
            out.append(p + (q - p) * (dp / (dp - dq)))
    return np.array(out).reshape(-1, 2)


def triangulate(polygon: np.ndarray) -> list[tuple[int, int, int]]:
    """Ear clipping of a simple counter-clockwise polygon."""
    left, out = list(range(len(polygon))), []
    turn = lambda i, j, k: np.linalg.det([polygon[j] - polygon[i], polygon[k] - polygon[i]])
    while len(left) > 3:
        for m in range(len(left)):
            i, j, k = left[m - 1], left[m], left[(m + 1) % len(left)]
            if turn(i, j, k) > 1e-12 and not any(turn(i, j, x) >= 0 and turn(j, k, x) >= 0 and turn(k, i, x) >= 0 for x in left if x not in (i, j, k)):
                out.append((i, j, k))
                del left[m]
                break
        else:
            return []
    return [*out, tuple(left)] if len(left) == 3 and turn(*left) > 0 else out


def hulls(points: DataFrame, key: str, directions: int = 256) -> DataFrame:
    """Convex hulls of points (key, u, v), with areas. Groups of any size: each task first reduces its part of a
    group to that part's hull, and hulls of hulls are the hull."""

    def part(batches):
        held = {}
        for pdf in batches:
            for k, g in pdf.groupby(key, sort=False):
                new = g[["u", "v"]].to_numpy()
                held[k] = hull(np.concatenate((held[k], new)) if k in held else new)
        for k, h in held.items():
            yield pd.DataFrame({key: k, "u": h[:, 0], "v": h[:, 1]})

    def whole(pdf):
        h = hull(pdf[["u", "v"]].to_numpy())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "corners": [len(h)], "area": [area(h)], "polygon": [[{"u": u, "v": v} for u, v in h.tolist()]]})

    kind = points.schema[key].dataType.simpleString()
    some = points.select(key, "u", "v").mapInPandas(part, f"{key} {kind}, u double, v double")
    return some.groupBy(key).applyInPandas(whole, f"{key} {kind}, corners long, area double, polygon array<struct<u:double,v:double>>")


def patches(polygons: DataFrame, constraints: DataFrame, key: str, least_area: float = 0.01) -> DataFrame:
    """Polygons clipped by their half-planes (key, confidence, a, b, c), surest first; a clip that leaves less than
    least_area is not made. With area and triangles; one row a patch."""
    lines = constraints.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "a", "b", "c"))).alias("lines"))

    def cut(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                p, used = np.array([[q["u"], q["v"]] for q in r.polygon]).reshape(-1, 2), 0
                for line in r.lines if r.lines is not None else ():
                    new = clip(p, line["a"], line["b"], line["c"])
                    if len(new) > 2 and area(new) >= least_area:
                        p, used = new, used + 1
                tri = triangulate(p)
                rows.append((getattr(r, key), used, area(p), len(tri), [{"u": u, "v": v} for u, v in p.tolist()]))
            yield pd.DataFrame(rows, columns=[key, "used", "area", "triangles", "polygon"])

    kind = polygons.schema[key].dataType.simpleString()
    return polygons.select(key, "polygon").join(lines, key, "left").mapInPandas(cut, f"{key} {kind}, used long, area double, triangles long, polygon array<struct<u:double,v:double>>")
