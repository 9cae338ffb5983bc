"""Folds and fits against small plain versions written on their own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.operators import fusion, gates, planes, structure


def plain_retention(rows, most):
    """The frames kept after each arrival, by sets of cells over whole lists."""
    kept, out = [], []
    turned = lambda a, b: min(abs(a["yaw"] - b["yaw"]) % 360, 360 - abs(a["yaw"] - b["yaw"]) % 360)
    own = lambda f, others: len(set(f["cells"]) - {c for g in others if g is not f for c in g["cells"]})
    for r in rows:
        gain, dropped, verdict = own(r, kept), None, "kept"
        near = [f for f in kept if abs(r["ms"] - f["ms"]) < 140 and math.dist((r["px"], r["py"], r["pz"]), (f["px"], f["py"], f["pz"])) < 0.025 and turned(r, f) < 2 and r["phase"] == f["phase"]]
        if near and gain == 0:
            verdict = "redundant"
        elif len(kept) >= most:
            worth = {}
            for i in range(1, len(kept) - 1):
                f, gap = kept[i], min(kept[i]["ms"] - kept[i - 1]["ms"], kept[i + 1]["ms"] - kept[i]["ms"])
                worth[i] = 100 * own(f, kept) + (20 if all(g is f or g["viewpoint"] != f["viewpoint"] for g in kept) else 0) + min(20, max(0, gap) / 100)
            mine = 100 * gain + (20 if all(g["viewpoint"] != r["viewpoint"] for g in kept) else 0) + min(20, max(0, r["ms"] - kept[-1]["ms"]) / 100)
            worst = min(worth, key=lambda i: (worth[i], i))
            if mine < worth[worst]:
                verdict = "less-useful"
            else:
                dropped = kept.pop(worst)["sequence"]
        if verdict == "kept":
            kept.append(r)
        out.append((verdict, dropped, len(kept)))
    return out, [f["sequence"] for f in kept]


@pytest.mark.parametrize("seed", range(6))
def test_retention_equals_a_plain_version(seed):
    rng = random.Random(seed)
    rows, ms = [], 0.0
    for k in range(300):
        ms += rng.choice([20, 20, 60, 400, 3000])
        rows.append({"sequence": k, "ms": ms, "px": rng.choice([0.0, 0.0, 0.01, 1.0]), "py": 0.0, "pz": 0.0, "yaw": rng.choice([0.0, 0.0, 1.0, 359.5, 40.0]), "phase": 0 if rng.random() < 0.8 else 1, "cells": [rng.randrange(12) for _ in range(rng.randrange(1, 4))], "viewpoint": rng.randrange(6)})
    keep = gates.Retention(8)
    got = [tuple(keep.step(r).values()) for r in rows]
    want, left = plain_retention(rows, 8)
    assert got == want and [f["sequence"] for f in keep.kept] == left and left[0] == 0
    assert {v for v, _, _ in got} == {"kept", "redundant", "less-useful"}


def test_retention_refuses_another_epoch():
    frame = {"ms": 0.0, "px": 0.0, "py": 0.0, "pz": 0.0, "yaw": 0.0, "phase": 0, "cells": [1], "viewpoint": 1}
    keep = gates.Retention()
    assert [keep.step(frame | {"sequence": k, "epoch": e, "cells": [k]})["outcome"] for k, e in enumerate([4, 4, 5, 4])] == ["kept", "kept", "refused", "kept"]


def test_gate_refuses_a_depth_without_bound():
    row = {"ms": 0, "px": 0.0, "py": 0.0, "pz": 0.0, "yaw": 0.0, "valid": 100, "valid_ratio": 0.9, "median": math.inf, "p95": 3.0, "outliers": 0.0, "steps": 0.0, "agreement": 0.0, "duplicates": 0.0, "established": 0, "gap": False, "reset": False}
    assert gates.FrameGate().step(row)["reason"] == gates.FrameGate().step(row | {"median": math.nan})["reason"] == "depth"


def test_trajectory_halves_its_trail():
    t = gates.Trajectory(most=8)
    out = [t.step({"ms": 300.0 * k, "px": 0.1 * k, "py": 0.0, "pz": 0.0, "yaw": 0.0}) for k in range(12)]
    assert [r["trail"] for r in out] == [1, 2, 3, 4, 5, 6, 7, 8, 5, 6, 7, 8] and all(r["kept"] for r in out)
    assert [p["ms"] / 300 for p in t.points] == [0, 2, 4, 6, 8, 9, 10, 11] and abs(out[-1]["walked"] - 1.1) < 1e-9


def plain_fit(p, w):
    m = np.average(p, axis=0, weights=w)
    c = ((p - m).T * w) @ (p - m) / w.sum()
    n = np.linalg.eigh(c)[1][:, 0]
    n = n * (1 if n[np.argmax(np.abs(n))] >= 0 else -1)
    return n, float(n @ m)


def test_robust_fit_equals_a_plain_version(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in range(6):
        n = 40 + 30 * key
        p = np.column_stack((rng.uniform(-1, 1, n), rng.uniform(-1, 1, n), rng.normal(0, 0.01, n)))
        p[: n // 5, 2] += rng.uniform(0.03, 0.4, n // 5)
        w = rng.integers(1, 4, n).astype(float)
        rows += [(key, *map(float, q), float(x)) for q, x in zip(p, w, strict=True)]
        normal, k = plain_fit(p, w)
        for _ in range(3):
            off = np.abs(p @ normal - k)
            med = np.median(off)
            limit = min(0.05, max(0.045, med + max(0.005, 3 * np.median(np.abs(off - med)))))
            p, w = p[off <= limit], w[off <= limit]
            normal, k = plain_fit(p, w)
        want[key] = (len(p), *normal, k)
    df = spark.createDataFrame(rows, "key int, x double, y double, z double, w double")
    got = {r["key"]: (r["n"], r["nx"], r["ny"], r["nz"], r["k"]) for r in planes.robust_fit(df, "key").collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == want[key][0] and np.allclose(got[key][1:], want[key][1:], atol=1e-9)


def test_hypotheses_are_scored_over_all_points(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(-1, 1, (3_000, 3))
    w = rng.integers(1, 4, 3_000).astype(float)
    normals = rng.normal(size=(20, 3))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    tries = np.column_stack((normals, rng.uniform(-0.5, 0.5, 20)))
    df = spark.createDataFrame([(*map(float, q), float(x)) for q, x in zip(p, w, strict=True)], "x double, y double, z double, w double").repartition(5)
    got = {r["h"]: r for r in planes.hypothesis_scores(df, tries, 0.04, 0.2).collect()}
    for h, (*n, k) in enumerate(tries):
        off = np.abs(p @ n - k)
        on = off <= 0.04
        rms = math.sqrt((w[on] * off[on] ** 2).sum() / w[on].sum())
        axis = np.cross([0, 1, 0] if abs(n[1]) < 0.9 else [1, 0, 0], n)
        axis /= np.linalg.norm(axis)
        area = np.ptp(p[on] @ axis) * np.ptp(p[on] @ np.cross(n, axis))
        score = w[on].sum() * (0.5 + 0.5 * min(1, area)) * (0.5 + 0.5 * (1 - min(1, rms / 0.04)))
        assert got[h]["inliers"] == on.sum() and abs(got[h]["score"] - score) < 1e-6 * score


def test_fusion_takes_normals_of_either_sign_once_a_frame():
    row = {"cx": 0.0, "cy": 0.0, "cz": 2.0, "x": 0.0, "y": 0.0, "z": 0.0, "nx": 0.0, "ny": 0.0, "nz": 1.0}
    state = fusion.Fusion()
    for k in range(20):
        state.step(row | {"id": k, "ms": k * 100.0, "frame": k, "nz": (-1.0) ** k, "z": 0.001 * (k % 2)})
    assert len(state.samples) == 1 and state.samples[0]["seen"] == 20 and state.samples[0]["n"] == (0.0, 0.0, 1.0)
    state.step(row | {"id": 99, "ms": 2_000.0, "frame": 19})
    assert len(state.samples) == 2 and state.samples[0]["seen"] == 20  # the sample has this frame's measurement already
    blend = fusion.Fusion()
    for k in range(41):
        blend.step(row | {"id": k, "ms": 10.0 * k, "frame": k, "x": 0.0 if k < 40 else 0.01})
    assert abs(blend.samples[0]["p"][0] - 0.01 / 41) < 1e-12


def plain_lanes(rows, limits):
    """Groups by direction and lanes, by growing partitions of row numbers."""
    angle = lambda i, j: math.degrees(math.acos(min(1, abs(sum(rows[i][c] * rows[j][c] for c in ("nx", "ny", "nz"))))))
    groups = []
    for i in range(len(rows)):
        mine = [g for g in groups if min(angle(i, j) for j in g) <= limits.group_angle and max([angle(a, b) for a in g for b in g] + [angle(i, a) for a in g]) <= limits.group_spread]
        if mine:
            merged = mine[0] + [i] + [x for g in mine[1:][::-1] for x in g]
            groups = [merged if g is mine[0] else g for g in groups if g is mine[0] or g not in mine]
        else:
            groups.append([i])
    return sorted(tuple(sorted(rows[i]["plane"] for i in g)) for g in groups)


def test_orientation_groups(spark):
    rng = random.Random(5)
    rows, final = [], []
    for scan in range(5):
        for p in range(14):
            a = math.radians(rng.choice([0, 6, 12, 20, 45, 90, 97]) + rng.random())
            k = rng.choice([0.0, 0.1, 0.3, 2.0])
            n = (math.cos(a), 0.0, math.sin(a))
            at = [k * c for c in n]
            rows.append((scan, scan * 100 + p, *n, k, *at, *(v for c in at for v in (c - 0.5, c + 0.5))))
            final.append((scan, scan * 100 + p, rng.choice(["wall", "wall", "floor", "other"]), rng.random()))
    planes_df = spark.createDataFrame(rows, "scan long, plane long, nx double, ny double, nz double, k double, cx double, cy double, cz double, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = structure.orientation_groups(planes_df, spark.createDataFrame(final, "scan long, plane long, role string, final double")).collect()
    by = {r[1]: dict(zip(["scan", "plane", "nx", "ny", "nz"], r, strict=False)) for r in rows}
    for scan in range(5):
        for role in ("wall", "floor"):
            mine = sorted([f for f in final if f[0] == scan and f[2] == role], key=lambda f: (-f[3], f[1]))
            have: dict = {}
            for r in got:
                if r["scan"] == scan and r["role"] == role:
                    have.setdefault(r["direction"], []).append(r["plane"])
            assert sorted(tuple(sorted(g)) for g in have.values()) == plain_lanes([by[f[1]] for f in mine], structure.LIMITS)
    k = {r[1]: r[5] for r in rows}
    lanes: dict = {}
    for r in got:
        assert r["role"] != "other"
        lanes.setdefault((r["scan"], r["role"], r["direction"], r["lane"]), []).append(k[r["plane"]])
    assert all(max(v) - min(v) <= structure.LIMITS.lane_span + 1e-9 for v in lanes.values()) and len(lanes) > 20
    assert structure.orientation_groups(planes_df.limit(0), spark.createDataFrame(final, "scan long, plane long, role string, final double")).filter(F.lit(True)).collect() == []
