"""Layers, hulls and grid normals against plain versions."""

import math
import random

import numpy as np

from gridwise.operators import fusion, mesh


def test_layers_equal_a_plain_version(spark):
    rng = random.Random(4)
    turn = lambda: rng.choice([(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.6, 0.8, 0.0), (0.8, -0.6, 0.0)])
    rows = [(k % 2, k, k % 5, *(rng.random() * 0.1 for _ in range(3)), *turn()) for k in range(700)]
    df = spark.createDataFrame(rows, "scan long, id long, frame long, x double, y double, z double, nx double, ny double, nz double").repartition(4)
    want: dict = {}
    for scan, k, frame, *v in sorted(rows):
        p, n = np.array(v[:3]), np.array(v[3:])
        cell = want.setdefault((scan, *(math.floor(c / 0.05) for c in p)), {"heads": [], "in": []})
        scores = []
        for i, (q, m) in enumerate(cell["heads"]):
            off, agree = abs((p - q) @ m), abs(n @ m)
            along = math.sqrt(max(0.0, (p - q) @ (p - q) - off**2))
            if off <= 0.022 and along <= 0.046 and agree >= 0.9:
                scores.append((off / 0.022 + along / 0.046 + 1 - agree, i))
        place = min(scores)[1] if scores else len(cell["heads"]) if len(cell["heads"]) < 4 else None
        if place is not None and place == len(cell["heads"]):
            cell["heads"].append((p, n))
        cell["in"].append((place, frame))
    expected = {(*key, place): (sum(x == place for x, _ in c["in"]), len({f for x, f in c["in"] if x == place})) for key, c in want.items() for place in {x for x, _ in c["in"]}}
    got = {tuple(r)[:5]: tuple(r)[5:] for r in fusion.layered(df).collect()}
    assert got == expected and sum(n for n, _ in got.values()) == 700 and any(k[-1] is None for k in got)
    assert not any(r["layer"] is None for r in fusion.layered(df, layers=None).collect())


def plain_hull(points):
    """Corners by walking around: from each one, the point that has all others on its left."""
    points = sorted(set(points))
    at, out = points[0], []
    while True:
        out.append(at)
        nxt = next(p for p in points if p != at)
        for p in points:
            turn = (nxt[0] - at[0]) * (p[1] - at[1]) - (nxt[1] - at[1]) * (p[0] - at[0])
            if p != at and (turn < 0 or (turn == 0 and math.dist(at, p) > math.dist(at, nxt))):
                nxt = p
        at = nxt
        if at == out[0]:
            return out


def test_hulls_equal_a_plain_version(spark):
    rng = random.Random(2)
    groups = {g: [(float(rng.randrange(-40, 40)), float(rng.randrange(-30, 30))) for _ in range(n)] for g, n in enumerate([3, 10, 200, 900])}
    df = spark.createDataFrame([(g, u, v) for g, ps in groups.items() for u, v in ps], "g int, u double, v double").repartition(6)
    for r in mesh.hulls(df, "g").collect():
        want = plain_hull(groups[r["g"]])
        area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(want, want[1:] + want[:1], strict=True))) / 2
        assert r["corners"] == len(want) and abs(r["area"] - area) < 1e-9
