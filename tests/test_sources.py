import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.sources import scan_files as sf


def surfel(i, **more):
    return {"id": i, "position": {"x": i * 0.1, "y": -0.2, "z": 1.0}, "normal": {"x": 0, "y": 0, "z": 1}, "radius": 0.0125, "color": {"r": 1.4, "g": 0.5, "b": -1}, "geometryConfidence": 2, "colorConfidence": 0.4, "colorObservationCount": 3, **more}


def test_json_exports(spark, tmp_path):
    rows = [surfel(1), surfel(2), {k: v for k, v in surfel(3).items() if k not in ("id", "color")}]
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "extra": {"large": ["x"] * 1000, "nested": '"}]'}, "reconstruction": {"scanId": "s", "surfels": rows, "other": [1, {"a": []}]}}))
    got = sf.read_exports(spark, str(tmp_path / "a.json")).orderBy("id").collect()
    assert [(r["id"], r["r"], r["b"], r["geometry_confidence"], r["seen"]) for r in got] == [(1, 1.0, 0.0, 1.0, 1), (2, 1.0, 0.0, 1.0, 1), (2, None, None, 1.0, 1)]
    for bad in ({"version": 2, "reconstruction": {"surfels": rows}}, {"version": 1}, {"version": 1, "reconstruction": {"surfels": [surfel(1, radius=0)]}}):
        (tmp_path / "b.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):
            sf.read_exports(spark, str(tmp_path / "b.json")).collect()
    with pytest.raises(Exception):
        sf.read_exports(spark, str(tmp_path / "a.json"), most=2).collect()


def test_captures(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for k in range(3):
        data = sf.encode_capture({"sequence": k, "ms": 250 * k, "epoch": 0, "columns": 3, "rows": 2}, {"depth": np.arange(6, dtype=np.float32) + k, "valid": np.array([1, 1, 0, 1, 1, 1], np.uint8)})
        (tmp_path / "c" / f"{k}.bin").write_bytes(data)
    cells = sf.read_captures(spark, str(tmp_path / "c"))
    assert cells.count() == 18 and cells.filter("valid").agg(F.sum("depth")).first()[0] == 3 * 13 + 15
    assert tuple(sf.captured_checks(cells).first()) == (3, True, True)
    for bad in (b"", b"SSCAN002" + data[8:], data[:11], data[:12] + data[20:], data[:-8]):
        with pytest.raises(ValueError):
            sf.decode_capture(bad)


def test_signature_ply_and_packing(spark, tmp_path):
    rows = [(1, i, float(i), 0.5, -1.0, 0.0, 0.0, 1.0, 0.5, 0.5, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "scan long, id long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double")
    one = sf.snapshot_signature(df, "id", "x").first()
    assert one == sf.snapshot_signature(df.repartition(5).sort(F.desc("id")), "id", "x").first()
    assert one != sf.snapshot_signature(df.withColumn("x", F.col("x") + (F.col("id") == 3).cast("double")), "id", "x").first()
    sf.write_ply(df, str(tmp_path / "p"))
    assert len(spark.read.text(str(tmp_path / "p/vertices")).collect()) == 10
    back = sf.unpacked_surface(sf.packed_surface(df, "scan", 4), "scan")
    assert back.count() == 10 and sorted(r["x"] for r in back.collect()) == [float(i) for i in range(10)]
