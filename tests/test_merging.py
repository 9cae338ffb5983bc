"""Merging of planes against a plain version that projects all points anew in every test."""

import math
import random

from pyspark.sql import functions as F

from gridwise.functions import vector as vm
from gridwise.operators import merging

PLANES = "scan long, plane long, nx double, ny double, nz double, k double, cx double, cy double, cz double, rms double, confidence double"


def scans(seed, count=14):
    """Walls in layers some centimetres apart, patches side by side, slightly turned ones, flipped normals, empty planes."""
    rng, planes, points = random.Random(seed), [], []
    for scan in range(count):
        for i in range(rng.randrange(1, 11)):
            plane = scan * 100 + i
            turn, flip = math.radians(rng.choice([0, 0, 2, 5, 8, 30])), rng.choice([1, 1, -1])
            n = [flip * math.cos(turn), 0.0, flip * math.sin(turn)]
            depth, start = rng.choice([0.0, 0.03, 0.08, 0.15, 0.2, 1.0]), rng.choice([0.0, 0.0, 0.3, 0.9])
            c = [depth * math.cos(turn) - (start + 0.5) * math.sin(turn), 0.5, depth * math.sin(turn) + (start + 0.5) * math.cos(turn)]
            planes.append((scan, plane, *n, sum(a * b for a, b in zip(n, c, strict=True)), *c, rng.choice([0.001, 0.01, 0.02]), rng.random()))
            for _ in range(rng.choice([0, 3, 40, 120, 120])):
                a, b = start + rng.random() * rng.choice([0.4, 1.0]), rng.random()
                points.append((scan, plane, depth * math.cos(turn) - a * math.sin(turn), b, depth * math.sin(turn) + a * math.cos(turn)))
    return planes, points


def plain(planes, points, basis):
    out = {}
    for scan in sorted({p[0] for p in planes}):
        P = {p[1]: p for p in planes if p[0] == scan}
        own = {k: [q[2:] for q in points if q[0] == scan and q[1] == k] for k in P}
        dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        N, K = {k: p[2:5] for k, p in P.items()}, {k: p[5] for k, p in P.items()}
        angle = lambda a, b: math.degrees(math.acos(min(1, abs(dot(N[a], N[b])))))
        toward = lambda a, b: K[a] if dot(N[a], N[b]) >= 0 else -K[a]
        apart = lambda a, b: abs(K[a] - toward(b, a))

        def uv(pts, r):
            d = [[x - y for x, y in zip(q, P[r][6:9], strict=True)] for q in pts]
            return [(dot(x, basis[r][0]), dot(x, basis[r][1])) for x in d]

        def cells(ids, r):
            return {(math.floor(u / 0.1), math.floor(v / 0.1)) for k in ids for u, v in uv(own[k], r)}

        def fit(a, b):
            if angle(a, b) > 7 or apart(a, b) > 0.1 or not own[a] or not own[b]:
                return False
            x, y = cells([a], a), cells([b], a)
            if len(x & y) / min(len(x), len(y)) >= 0.35:
                return True
            overlap, gap = [], []
            for i in (0, 1):
                (l1, h1), (l2, h2) = ((min(z[i] for z in uv(own[k], a)), max(z[i] for z in uv(own[k], a))) for k in (a, b))
                small = min(h1 - l1, h2 - l2)
                overlap.append(max(0, min(h1, h2) - max(l1, l2)) / small if small > 0 else 0)
                gap.append(max(0, max(l1, l2) - min(h1, h2)))
            return max(overlap) >= 0.05 and max(gap) <= 0.3

        def best(members, weight, sure):
            scores = []
            for m in members:
                others = [o for o in members if o is not m]
                total = sum(max(1, weight(o)) for o in others)
                bad = sum(max(1, weight(o)) * (apart(m["p"], o["p"]) + math.radians(angle(m["p"], o["p"])) * 0.05) for o in others)
                scores.append((bad / total if total else 0) + P[m["p"]][9] * 0.1 - weight(m) * 1e-5 - P[m["p"]][10] * sure)
            return members[scores.index(min(scores))]

        def run(groups, may, weight, sure):
            for _ in range(8):
                hit = next(((a, b) for i, a in enumerate(groups) for b in groups[i + 1 :] if may(a, b)), None)
                if hit is None:
                    break
                a, b = hit
                new = {"m": a["m"] + b["m"]}
                new["of"] = best(new["m"], weight, sure)
                groups[groups.index(a)] = new
                groups.remove(b)
            return groups

        def family(a, b):
            offs = [toward(m["p"], a["of"]["p"]) for m in a["m"] + b["m"]]
            return max(offs) - min(offs) <= 0.22 and any(fit(m["p"], n["p"]) for m in a["m"] for n in b["m"])

        families = run([{"m": [m], "of": m} for m in ({"p": k, "ids": [k]} for k in sorted(P))], family, lambda m: len(own[m["p"]]), 0)
        merged = []
        for f in families:
            offs = [toward(m["p"], f["of"]["p"]) for m in f["m"]]
            merged.append({"p": f["of"]["p"], "ids": [m["p"] for m in f["m"]], "range": (min(offs), max(offs))})
        span = lambda g, r: [o * (1 if dot(N[r], N[m["p"]]) >= 0 else -1) for m in g["m"] for o in m["range"]]

        def surface(a, b):
            r, ids = a["of"]["p"], lambda g: [k for m in g["m"] for k in m["ids"]]
            offs = span(a, r) + span(b, r)
            if angle(r, b["of"]["p"]) > 8 or min(apart(m["p"], n["p"]) for m in a["m"] for n in b["m"]) > 0.16 or max(offs) - min(offs) > 0.32:
                return False
            x, y = cells(ids(a), r), cells(ids(b), r)
            return bool(x and y) and len(x & y) / len(x | y) >= 0.35 and len(x & y) / max(len(x), len(y)) >= 0.55 and min(len(x), len(y)) / max(len(x), len(y)) >= 0.4

        surfaces = run([{"m": [m], "of": m} for m in merged], surface, lambda m: sum(len(own[k]) for k in m["ids"]), 0.001)
        for i, s in enumerate(surfaces, 1):
            offs = span(s, s["of"]["p"])
            for m in s["m"]:
                for k in m["ids"]:
                    area = len(cells([x for o in s["m"] for x in o["ids"]], s["of"]["p"])) * 0.01
                    out[k] = (1 + merged.index(m), m["p"], round(m["range"][1] - m["range"][0], 9), i, s["of"]["p"], round(max(offs) - min(offs), 9), round(area, 9))
    return out


def test_equals_plain(spark):
    shapes = set()
    for seed in (1, 2):
        planes, points = scans(seed)
        p, q = spark.createDataFrame(planes, PLANES), spark.createDataFrame(points, "scan long, plane long, x double, y double, z double")
        t, s = vm.tangent_basis(vm.v("n"))
        basis = {r["plane"]: (tuple(r["t"]), tuple(r["s"])) for r in p.select("plane", F.array(*t).alias("t"), F.array(*s).alias("s")).collect()}
        want = plain(planes, points, basis)
        got = {r["plane"]: (r["family"], r["family_plane"], round(r["family_thickness"], 9), r["surface"], r["surface_plane"], round(r["surface_thickness"], 9), round(r["area"], 9)) for r in merging.merged_planes(p.repartition(4), q.repartition(5)).collect()}
        assert got == want
        families = [x[:2] for x in want.values()]
        shapes |= {len(families) > len(set(families)), len({x[3:5] for x in want.values()}) < len(set(families)), "big" if max(families.count(f) for f in families) > 2 else ""}
    assert shapes >= {True, "big"}


def test_empty(spark):
    assert merging.merged_planes(spark.createDataFrame([], PLANES), spark.createDataFrame([], "scan long, plane long, x double, y double, z double")).collect() == []
