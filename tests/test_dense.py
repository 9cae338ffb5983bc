"""Dense fusion: matches, colours, the ledger of views, stability, capacity and the snapshot."""

import math

from gridwise.operators import dense

SCHEMA = "scan long, id long, ms double, frame long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double, cx double, cy double, cz double, tracking double"


def row(k, x=0.0, z=0.0, n=(0.0, 0.0, 1.0), colour=(0.5, 0.5, 0.5), camera=(0.0, 0.0, 2.0), ms=None, frame=None, tracking=1.0, y=0.0):
    c, m = colour or (None,) * 3, camera or (None,) * 3
    return {"id": k, "ms": 100.0 * k if ms is None else ms, "frame": k if frame is None else frame, "x": x, "y": y, "z": z, "nx": n[0], "ny": n[1], "nz": n[2], "r": c[0], "g": c[1], "b": c[2], "cx": m[0], "cy": m[1], "cz": m[2], "tracking": tracking}


def fold(rows, **how):
    state = dense.DenseFusion(**how)
    return [state.step(r) for r in rows], state


def test_matches_and_layers():
    tilted = (math.sin(math.radians(41)), 0.0, math.cos(math.radians(41)))
    got, state = fold([row(0), row(1, x=0.033), row(2, x=0.2), row(3, z=0.015), row(4, n=tilted, x=0.001), row(5, n=(0.0, 0.0, -1.0))])
    assert got == ["created", "fused", "created", "created", "created", "fused"]
    assert state.samples[0]["seen"] == 3 and state.samples[0]["n"][2] > 0.99
    got, _ = fold([row(0, frame=7), row(1, frame=7, x=0.005), row(2, frame=7, x=0.02), row(3, frame=8)])
    assert got == ["created", "same-frame", "created", "fused"]


def test_positions_blend_by_count_and_colours_by_weight():
    _, state = fold([row(k, x=0.0 if k < 30 else 0.016) for k in range(31)])
    assert abs(state.samples[0]["p"][0] - 0.016 / 16) < 1e-12
    q = state.samples[0]
    assert q["weight"] == 16.0 and q["coloured"] == 31
    _, state = fold([row(k, colour=(0.5, 0.5, 0.5)) for k in range(4)] + [row(4, colour=(1.0, 1.0, 1.0))])
    assert state.samples[0]["c"][0] < 0.52 and state.samples[0]["coloured"] == 5  # an outlier has a tenth of its weight
    _, state = fold([row(0, colour=None), row(1, colour=None), row(2)])
    assert state.samples[0]["coloured"] == 1 and state.samples[0]["seen"] == 3 and abs(state.samples[0]["c"][0] - 0.5) < 1e-9


def test_view_ledger():
    assert dense.view_bits(1, 0.07, math.radians(2)) == 1 and dense.view_bits(1, 0.07, math.radians(3)) == 3
    assert dense.view_bits(1, 0.15, 0.0) == 3 and dense.view_bits(3, 0.3, math.radians(5)) == 7 and dense.view_bits(1, 0.3, math.radians(4)) == 3
    _, state = fold([row(k, camera=(0.1 * k, 0.0, 1.0)) for k in range(5)])
    assert state.samples[0]["bits"] == 7
    assert fold([row(k, camera=None) for k in range(3)])[1].samples[0]["bits"] == 0


def test_stability_and_duplicates():
    grid = [row(100 * k + i, x=0.1 * (i % 6), y=0.1 * (i // 6), ms=150.0 * k, frame=k) for k in range(4) for i in range(36)]
    _, state = fold(grid)
    assert state.stable == 36 and all(q["stable"] for q in state.samples.values())
    assert state.relation((0.0, 0.0, 0.01), (0.0, 0.0, 1.0)) == 1 and state.relation((0.0, 0.0, 0.05), (0.0, 0.0, 1.0)) == 2 and state.relation((5.0, 0.0, 0.0), (0.0, 0.0, 1.0)) == 0
    for k in range(4):
        state.step(row(900 + k, z=0.06, ms=1_000.0 + 150 * k, frame=50 + k))
    ghost = state.samples[36]
    assert ghost["duplicate"] and not ghost["stable"]
    for k in range(4):
        state.step(row(950 + k, z=0.06, ms=1_800.0 + 100 * k, frame=70 + k, camera=(0.2, 0.0, 2.0)))
    assert state.samples[36]["stable"]
    assert not fold([row(k, tracking=0.5) for k in range(6)])[1].samples[0]["stable"]


def test_capacity_reclaims_idle_samples():
    got, state = fold([row(0), row(1, x=1.0), row(2, x=2.0), row(3, x=3.0, ms=9_000.0), row(4, x=0.0, ms=9_100.0)], most=2)
    assert got == ["created", "created", "rejected", "created", "created"] and state.counts["reclaimed"] == 2 and len(state.samples) == 2


def test_snapshot(spark):
    rows = [(s, *(row(k, x=0.1 * (k % 3), frame=k // 3, ms=200.0 * (k // 3), camera=(0.1 * (k // 3), 0.0, 1.0), colour=None if k % 3 == 2 else (0.2, 0.4, 0.6))[c] for c in "id ms frame x y z nx ny nz r g b cx cy cz tracking".split())) for s in (1, 2) for k in range(9)]
    rows.append((2, *row(99, x=9.0, ms=999.0).values()))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = dense.dense_snapshot(dense.dense(df, ["ms", "id"])).collect()
    assert len(out) == 7 and sum(r["final"] for r in out) == 6 and sum(r["seen"] for r in out) == 19
    assert sorted(r["has_colour"] for r in out) == [False] * 2 + [True] * 5
    full = [r for r in out if r["seen"] == 3]
    assert all(r["views"] == 2 and abs(r["confidence"] - min(1, 0.45 * 3 / 5 + 0.25 * 2 / 2 + 0.2 + 0.1 * 400 / 2000)) < 1e-9 for r in full)


def test_views_count_before_the_move_and_for_repeats():
    """A ghost's second view comes with its last measurement, and with a repeated one of a frame: both make it stable."""
    floor = [row(100 * k + i, x=0.1 * (i % 6), y=0.1 * (i // 6), ms=150.0 * k, frame=k) for k in range(4) for i in range(36)]
    ghost = [row(900 + k, z=0.06, ms=1_000.0 + 250 * k, frame=50 + k) for k in range(4)]
    far = (0.6, 0.0, 2.0)
    _, state = fold([*floor, *ghost, row(904, z=0.06, ms=2_000.0, frame=54, camera=far)])
    assert state.samples[36]["duplicate"] and state.samples[36]["bits"] == 7 and state.samples[36]["stable"]
    got, state = fold([*floor, *ghost, row(904, z=0.06, ms=1_760.0, frame=53, camera=far)])
    assert got[-1] == "same-frame" and state.samples[36]["bits"] == 7 and state.samples[36]["seen"] == 4
    # a view is measured from where the sample lies before the measurement moves it
    _, state = fold([row(0, x=0.0, camera=(0.0, 0.0, 0.1)), row(1, x=0.03, camera=(0.07, 0.0, 0.1))])
    turn = math.acos(sum(a * b for a, b in zip((0.0, 0.0, 1.0), (0.07 / math.hypot(0.07, 0.1), 0.0, 0.1 / math.hypot(0.07, 0.1)), strict=True)))
    assert state.samples[0]["bits"] == dense.view_bits(1, 0.07, turn)


def test_colours_blend_as_linear(spark):
    rows = [(1, *row(k, colour=c).values()) for k, c in enumerate([(0.2, 0.2, 0.2), (0.9, 0.9, 0.9)])]
    got = dense.dense(spark.createDataFrame(rows, SCHEMA), ["ms", "id"]).first()
    linear = lambda v: ((v + 0.055) / 1.055) ** 2.4
    _, state = fold([row(k, colour=(linear(c),) * 3) for k, c in enumerate([0.2, 0.9])])
    assert abs(linear(got["r"]) - state.samples[0]["c"][0]) < 1e-9 and abs(got["r"] - 0.55) > 0.02
