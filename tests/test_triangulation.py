"""Local triangulation against a brute-force test of every triple, on lattices full of ties, and growth against a plain search."""

import itertools
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gridwise.operators import triangulation as tri

SAMPLES = "id long, x double, y double, z double, nx double, ny double, nz double, barrier boolean"


def found(spark, rows):
    return {(r["a"], r["b"], r["c"]) for r in tri.triangles(spark.createDataFrame(rows, SAMPLES).repartition(3)).collect()}


def test_lattice_has_two_triangles_a_cell_whatever_the_ids(spark):
    places = [(0.03 * i, 0.03 * j) for i in range(7) for j in range(6)]
    shapes = set()
    for seed in range(3):
        ids = list(range(len(places)))
        random.Random(seed).shuffle(ids)
        at = dict(zip(ids, places, strict=True))
        got = found(spark, [(k, x, y, 0.0, 0.0, 0.0, 2.0, False) for k, (x, y) in at.items()])
        assert len(got) == 2 * 6 * 5
        shapes.add(frozenset(frozenset(at[k] for k in t) for t in got))
    assert len(shapes) == 1


def test_equals_every_triple(spark):
    """On a flat patch of eight samples at most, all are neighbours: a triangle is one whose circle is empty (and whose
    shape and edges the rules allow), seen from any of its corners."""
    rng = random.Random(3)
    for case in range(4):
        pts = {k: (rng.uniform(0, 0.06), rng.uniform(0, 0.06)) for k in range(8)}
        got = found(spark, [(k, x, y, 0.0, 0.0, 0.0, 1.0, False) for k, (x, y) in pts.items()])
        want = set()
        for t in itertools.combinations(sorted(pts), 3):
            for c, p, q in ((t[0], t[1], t[2]), (t[1], t[0], t[2]), (t[2], t[0], t[1])):
                others = [k for k in pts if k != c]
                d = {k: math.dist(pts[c], pts[k]) for k in others}
                limit = min(0.1, max(0.05, 2.5 * min(d.values())))
                near = [k for k in others if d[k] <= limit]
                if p not in near or q not in near or math.dist(pts[p], pts[q]) > limit or math.dist(pts[p], pts[q]) ** 2 <= 1e-6:
                    continue
                (ax, ay), (bx, by) = ((pts[k][0] - pts[c][0], pts[k][1] - pts[c][1]) for k in (p, q))
                det, dot = ax * by - ay * bx, ax * bx + ay * by
                if abs(det) <= 0.1 * d[p] * d[q] or dot < -0.5 * d[p] * d[q]:
                    continue
                cx, cy = (by * d[p] ** 2 - ay * d[q] ** 2) / (2 * det), (ax * d[q] ** 2 - bx * d[p] ** 2) / (2 * det)
                if all(math.dist((cx, cy), (pts[k][0] - pts[c][0], pts[k][1] - pts[c][1])) >= math.hypot(cx, cy) * (1 - 1e-9) for k in near if k not in (p, q)):
                    want.add(t)
        assert got == want and want


def test_layers_and_folds_stay_apart(spark):
    flat = [(k, 0.02 * (k % 4), 0.02 * (k // 4), 0.0, 0.0, 0.0, 1.0, False) for k in range(16)]
    above = [(100 + k, x, y, 0.03, *n) for k, x, y, _, *n in flat]
    turned = [(200 + k, x + 1, y, z, 0.0, 1.0, 0.0, b) for k, x, y, z, _, _, _, b in flat]
    got = found(spark, flat + above)
    assert len(got) == 36 and all(max(t) - min(t) < 50 for t in got)
    assert found(spark, turned) == set()  # a normal in the plane of its neighbours: they lie off its tangent plane
    assert found(spark, [(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False), *flat[2:]]) == found(spark, flat[2:])
    assert found(spark, flat[:2]) == set()


def test_growth_equals_plain_search(spark):
    rng = random.Random(9)
    rows = [(k, 0.025 * (k % 14) + scan * 5, 0.025 * (k // 14), 0.002 * rng.random() + (0.2 if k % 14 > 11 else 0.0), 0.0, 0.0, 1.0, rng.random() < 0.12) for scan in range(2) for k in range(scan * 1000, scan * 1000 + 154)]
    samples = spark.createDataFrame(rows, SAMPLES)
    cornered = tri.with_corners(tri.triangles(samples), samples).withColumn("scan", F.floor(F.col("a") / 1000)).withColumn("triangle", F.concat_ws("/", "a", "b", "c"))
    all_of = {r["triangle"]: r.asDict() for r in cornered.collect()}
    hits = {s: next(k for k in sorted(all_of) if all_of[k]["scan"] == s and not all_of[k]["barrier"]) for s in (0, 1)}
    surfaces = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0), (1, 0.0, 0.0, 1.0, 0.0)], "scan long, snx double, sny double, snz double, sk double")
    got = {r["triangle"]: r["step"] for r in tri.grown_from_hits(cornered, spark.createDataFrame(list(hits.items()), "scan long, triangle string"), surfaces).collect()}
    ok = {k for k, t in all_of.items() if not t["barrier"] and max(abs(t[f"{c}_z"]) for c in "abc") <= 0.12 and abs(t["nz"]) >= 0.55}
    want = {}
    for hit in hits.values():
        queue = deque([(hit, 0)] if hit in ok else [])
        while queue:
            k, step = queue.popleft()
            if k in want:
                continue
            want[k] = step
            t = all_of[k]
            queue += [(m, step + 1) for m in ok if m not in want and len({t[c] for c in "abc"} & {all_of[m][c] for c in "abc"}) == 2 and abs(sum(t[f"n{x}"] * all_of[m][f"n{x}"] for x in "xyz")) >= tri.HIT_DOT]
    assert got == want and len(want) > 40 and len(want) < len(all_of) - 20
    small = tri.grown_from_hits(cornered.withColumn("area", F.lit(1e-9)), spark.createDataFrame(list(hits.items()), "scan long, triangle string"), surfaces)
    assert small.collect() == []


def test_neighbourhoods_are_not_written(spark, monkeypatch):
    """Where rows lie loosely, only rows on their way to their cubes and triangles leave a task."""
    monkeypatch.setattr(tri, "settled", lambda df: pytest.fail("written"))
    monkeypatch.setattr(tri.near, "settled", lambda df: pytest.fail("written"))
    monkeypatch.setattr(tri, "BATCH", 5)
    rows = [(k, 0.03 * (k % 7), 0.03 * (k // 7), 0.0, 0.0, 0.0, 2.0, False) for k in range(42)]
    assert len(found(spark, rows)) == 2 * 6 * 5
