"""Patches against areas counted on a fine raster, with cuts in their order."""

import math
import random

from gridwise.operators import mesh


def inside(p, polygon):
    return all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in zip(polygon, polygon[1:] + polygon[:1], strict=True))


def test_patches_are_their_points_on_the_kept_sides(spark):
    """A cut that leaves under a hundredth is not made; of the others each takes what lies beyond it, surest first."""
    rng, polygons, cuts, n = random.Random(6), [], [], 250
    for k in range(12):
        at = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(4, 9)))
        polygons.append((k, [(0.5 + 0.5 * math.cos(t), 0.5 + 0.5 * math.sin(t)) for t in at]))
        cuts += [(k, round(rng.random(), 6), math.cos(t), math.sin(t), rng.uniform(-0.3, 0.9)) for t in (rng.uniform(0, 7) for _ in range(rng.randrange(0, 6)))]
    p = spark.createDataFrame(polygons, "scan long, polygon array<struct<u:double,v:double>>")
    c = spark.createDataFrame(cuts, "scan long, confidence double, a double, b double, c double").repartition(3)
    got = {r["scan"]: r for r in mesh.patches(p, c, "scan").collect()}
    grid = [((i + 0.5) / n, (j + 0.5) / n) for i in range(n) for j in range(n)]
    sign, used = None, set()
    for k, polygon in polygons:
        points = [q for q in grid if inside(q, polygon)]
        mine = [x[1:] for x in sorted(cuts, key=lambda x: -x[1]) if x[0] == k]
        if sign is None and mine:  # which side of a u + b v = c stays is the operator's; it is one for all
            one = mesh.clip(mesh.np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float), 1.0, 0.0, 0.25)
            sign = 1 if mesh.area(one) < 0.5 else -1
        count = 0
        for _, a, b, limit in mine:
            left = [q for q in points if sign * (a * q[0] + b * q[1] - limit) <= 0]
            if len(left) / n**2 >= 0.01:
                points, count = left, count + 1
        assert abs(got[k]["area"] - len(points) / n**2) < 0.006
        assert got[k]["triangles"] == max(0, len(got[k]["polygon"]) - 2)
        used.add((count, len(mine)))
        assert got[k]["used"] == count
    assert any(a < b for a, b in used) and any(a for a, _ in used)
