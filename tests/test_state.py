import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.functions import camera, rules, vector as vm
from gridwise.operators import fusion, gates, mesh, planes, visibility
from gridwise.streaming import live


def frame(ms, x=0.0, yaw=0.0, **more):
    return {"ms": ms, "px": x, "py": 0.0, "pz": 0.0, "yaw": yaw, "valid": 100, "valid_ratio": 0.9, "median": 2.0, "p95": 3.0, "outliers": 0.0, "steps": 0.0, "agreement": 0.0, "duplicates": 0.0, "established": 0, "gap": False, "reset": False} | more


def reasons(frames):
    gate = gates.FrameGate()
    return [gate.step(f)["reason"] for f in frames], gate


def test_gate_quarantines_and_recovers():
    got, gate = reasons([frame(0), frame(100), frame(200, 2.0), frame(300, 0.1), frame(400, 0.1), frame(500, 0.1), frame(600, 0.1), frame(700, 0.1)])
    assert got[:3] == ["none", "none", "pose-discontinuity"] and gate.jumps == 2 and gate.invalid
    got, gate = reasons([frame(0), frame(100), frame(200, 2.0), *(frame(300 + 100 * k, 2.0) for k in range(5))])
    assert got == ["none", "none", "pose-discontinuity"] + ["tracking"] * 5
    got, _ = reasons([frame(0), frame(100), frame(200, 2.0), *(frame(300 + 100 * k, 2.0, agreement=0.5) for k in range(5))])
    assert got == ["none", "none", "pose-discontinuity", "tracking", "tracking", "none", "none", "none"]


@pytest.mark.parametrize("change, reason", [({"valid": 3}, "depth"), ({"valid_ratio": 0.01}, "depth"), ({"median": 0.0}, "depth"), ({"p95": 25.0}, "depth"), ({"outliers": 0.5}, "depth"), ({"established": 40, "duplicates": 0.9}, "consistency"), ({"reset": True}, "reference-space-reset"), ({"x": 0.4}, "motion"), ({"x": 0.9}, "pose-discontinuity"), ({"yaw": 60.0}, "motion"), ({"yaw": 80.0}, "pose-discontinuity")])
def test_gate_reasons(change, reason):
    assert reasons([frame(0), frame(100, **change)])[0] == ["none", reason]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, float(k * 100), (k % 7) * 0.02, 0.0, 0.0, float(k % 5)) for k in range(60)]
    schema = "scan long, id long, ms double, px double, py double, pz double, yaw double"
    df = spark.createDataFrame(rows, schema)
    batch = {r["id"]: r["processed"] for r in gates.folded(df, ["scan"], ["ms", "id"], gates.StationaryThrottle, gates.StationaryThrottle.SCHEMA).collect()}
    for part in range(3):
        df.filter(F.col("id").between(part * 20, part * 20 + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.folded_stream(stream, "scan", ["ms", "id"], gates.StationaryThrottle, gates.StationaryThrottle.SCHEMA)
    q = out.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: (r["processed"], r["late"]) for r in spark.table("folded").collect()}
    assert {i: p for i, (p, _) in got.items()} == batch and not any(late for _, late in got.values())


def test_fusion_merges_one_wall_and_keeps_two(spark):
    wall = [(1, k * 100 + i, k * 150.0, k * 0.2, 0.0, 2.0, i % 10 * 0.05 + k * 0.001, i // 10 * 0.05, z + k * 0.001, 0.0, 0.0, 1.0) for z in (0.0, 0.08) for k in range(4) for i in range(50)]
    df = spark.createDataFrame(wall, "scan long, id long, ms double, cx double, cy double, cz double, x double, y double, z double, nx double, ny double, nz double")
    got = fusion.fused(df, ["ms", "id", "z"]).collect()
    assert len(got) == 100 and all(r["seen"] == 4 and r["views"] >= 2 and r["promoted"] for r in got)
    assert len(fusion.fused(df, ["ms", "id", "z"], most=30).collect()) == 30


def test_visibility_removes_contradicted_samples(spark):
    matrix = lambda x: list(map(float, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, -x, 0, 0, 1]))
    projection = list(map(float, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, -1, -1, 0, 0, -0.2, 0]))
    frames = [(k, 100.0 * k, 0.1 * k, 0.0, 0.0, matrix(0.1 * k), projection, 20, 20, 0.025, 0.025, 0.05, 0.05, [2.0] * 400) for k in range(5)]
    fdf = spark.createDataFrame(frames, "frame int, ms double, cam_x double, cam_y double, cam_z double, view array<double>, projection array<double>, columns int, rows int, u0 double, v0 double, du double, dv double, depths array<double>")
    samples = spark.createDataFrame([(1, 0.0, 0.0, -2.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, -1.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, -3.0, 0.0, 0.0, 1.0), (4, 0.0, 0.0, -1.0, 1.0, 0.0, 0.0)], "id long, x double, y double, z double, nx double, ny double, nz double")
    assert sorted(r["id"] for r in visibility.visible(samples, fdf).collect()) == [1, 3, 4]
    assert visibility.visible(samples, fdf.limit(2)).count() == 4


def test_planes_of_a_box(spark):
    rng = np.random.default_rng(1)
    rows = []
    for axis, at in ((0, -2.0), (0, 2.0), (1, 0.0), (1, 2.5), (2, -3.0), (2, 3.0)):
        p = rng.uniform(-2, 2, (150, 3))
        p[:, axis] = at + rng.normal(0, 0.003, 150)
        rows += [(len(rows) + i, *map(float, q), 1.0) for i, q in enumerate(p)]
    out = planes.dominant_planes(spark.createDataFrame(rows, "id long, x double, y double, z double, w double"), enough=0.99).collect()
    found = {(int(np.argmax(np.abs([r["nx"], r["ny"], r["nz"]]))), round(r["k"], 1)) for r in out}
    assert found >= {(0, -2.0), (0, 2.0), (1, 0.0), (1, 2.5), (2, -3.0), (2, 3.0)} and len(out) == 6


def test_polygons():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert mesh.area(mesh.hull(np.concatenate((square, [(1, 1), (1, 0)])))) == 4 and len(mesh.hull(square)) == 4
    assert mesh.area(mesh.clip(square, 1, 0, 1)) == 2 and len(mesh.clip(square, 1, 0, -1)) == 0
    bent = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    assert len(mesh.triangulate(bent)) == 3


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None, 1.0)], "a double, b double").select(
        rules.visual_radius("b", "a").alias("radius"), vm.normalized(vm.vec("a", "b", "b"))[0].alias("x"), camera.same_matrices(F.lit(None).cast("array<double>"), F.array("b")).alias("same"),
    ).first()
    assert row["radius"] is not None and row["x"] is None and row["same"] is False
