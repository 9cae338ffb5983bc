"""Scan files: JSON exports, binary captures, prepared surfaces and PLY.

JSON export, version 1: {"version": 1, "reconstruction": {"scanId", "referenceSpaceType", "surfels": [...]}}; read with an
explicit schema, so other members are skipped by the parser.

Binary capture: 8 bytes `SSCAN001`, a little-endian u32 length, that many bytes of JSON, then the buffers that the JSON's
{"$buffer": [type, offset, count]} places refer to, offsets counted from the end of the JSON.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwise.functions.numeric import clamp, finite

MAGIC, MOST_METADATA, MOST_CELLS, MOST_SAMPLES = b"SSCAN001", 2 << 20, 16_384, 180_000
_POINT = "struct<x: double, y: double, z: double>"
SAMPLE = f"struct<id: bigint, position: {_POINT}, normal: {_POINT}, radius: double, color: struct<r: double, g: double, b: double>, geometryConfidence: double, colorConfidence: double, colorObservationCount: int, geometryObservationCount: int, viewObservationCount: int, firstObservedAt: double, lastObservedAt: double>"
EXPORT = f"version int, reconstruction struct<scanId: string, referenceSpaceType: string, surfels: array<{SAMPLE}>>"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="gridwise-")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own in that of spark.checkpoint.dir; where it is unset, in a temporary one, on one machine only."""
    root, master = spark.sparkContext.getConf().get("spark.checkpoint.dir"), spark.sparkContext.master
    if not root and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: a cluster needs a shared folder")
    return f"{(root or 'file://' + _own_folder()).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _put(folder: str, name: str, data: bytes) -> None:
    """A file in a folder of the shared store; it appears whole, and again when a task is repeated."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))
    store.create_dir(base, recursive=True)
    part = f"{base}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, f"{base}/{name}")


def write_exports(samples: DataFrame, folder: str) -> None:
    """One JSON export for each scan_id of samples(scan_id, id, position, normal, radius, r, g, b, geometry_confidence,
    color_confidence, color_seen, seen, views, first_ms, last_ms). A scan's export is one row, as the format has it."""
    point = lambda names: F.struct(*(F.col(n).alias(k) for n, k in zip(names, "xyz", strict=True)))
    surfel = F.struct(
        "id", point(["x", "y", "z"]).alias("position"), point(["nx", "ny", "nz"]).alias("normal"), "radius", F.struct("r", "g", "b").alias("color"),
        *(F.col(a).alias(b) for a, b in (("geometry_confidence", "geometryConfidence"), ("color_confidence", "colorConfidence"), ("color_seen", "colorObservationCount"), ("seen", "geometryObservationCount"), ("views", "viewObservationCount"), ("first_ms", "firstObservedAt"), ("last_ms", "lastObservedAt"))),
    )
    scans = samples.groupBy("scan_id").agg(F.sort_array(F.collect_list(surfel)).alias("surfels"))
    body = F.struct(F.lit(1).alias("version"), F.struct(F.col("scan_id").alias("scanId"), F.lit("local-floor").alias("referenceSpaceType"), "surfels").alias("reconstruction"))
    scans.select(F.to_json(body).alias("value"), F.col("scan_id").alias("scan")).write.partitionBy("scan").text(folder)


def write_captures(grid: DataFrame, columns: int, rows: int, folder: str) -> DataFrame:
    """One capture file for each frame of grid(frame, row, col, depth, valid), missing cells invalid; returns (frame, bytes)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = int(pdf["frame"].iloc[0])
        depth, valid = np.zeros(columns * rows, np.float32), np.zeros(columns * rows, np.uint8)
        at = (pdf["row"] * columns + pdf["col"]).to_numpy()
        depth[at], valid[at] = pdf["depth"], pdf["valid"]
        data = encode_capture({"sequence": frame, "ms": 250 * frame, "epoch": 0, "columns": columns, "rows": rows}, {"depth": depth, "valid": valid})
        _put(folder, f"{frame}.bin", data)
        return pd.DataFrame({"frame": [frame], "bytes": [len(data)]})

    return grid.select(F.col("frame").cast("long").alias("frame"), "row", "col", "depth", "valid").groupBy("frame").applyInPandas(run, "frame long, bytes long")


def write_prepared(packed: DataFrame, key: str, folder: str) -> DataFrame:
    """One binary file for each chunk of packed_surface(): its positions, then its normals, as little-endian float32;
    returns (file, key, chunk, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, chunk, positions, normals in zip(pdf[key], pdf["chunk"], pdf["positions"], pdf["normals"], strict=True):
                name = f"{k}-{chunk:06d}.surface"
                _put(folder, name, np.concatenate((positions, normals)).astype("<f4").tobytes())
                out.append((name, k, chunk, len(positions) // 3))
            yield pd.DataFrame(out, columns=["file", "key", "chunk", "samples"])

    kind = dict(packed.dtypes)[key]
    return packed.select(key, "chunk", "positions", "normals").mapInPandas(run, f"file string, key {kind}, chunk long, samples long")


def read_prepared(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place, position, normal) of the samples in files of write_prepared()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                values = np.frombuffer(content, "<f4").astype(float).reshape(2, -1, 3)
                yield pd.DataFrame({"file": path.rsplit("/", 1)[-1], "place": np.arange(values.shape[1], dtype=np.int32), **{n: values[0, :, i] for i, n in enumerate("xyz")}, **{"n" + n: values[1, :, i] for i, n in enumerate("xyz")}})

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "file string, place int, x double, y double, z double, nx double, ny double, nz double")


def finalized_counts(samples: DataFrame, key: str) -> DataFrame:
    """What a finished scan holds of samples(seen): how many of each coverage state, and those seen twice or more, which
    alone go on as fused rows."""
    from gridwise.functions.rules import coverage_state

    state = samples.withColumn("state", coverage_state(F.col("seen")))
    return state.groupBy(key).agg(F.count("*").alias("cells"), *(F.count_if(F.col("state") == k).alias(k) for k in ("captured", "partial")), F.count_if(F.col("seen") >= 2).alias("fused"))


def normalized_samples(exported: DataFrame, most: int | None = MOST_SAMPLES) -> DataFrame:
    """Samples of exports (EXPORT columns, and file): required fields are checked, colours and confidences clamped,
    counts default to one, missing ids are places in the list. A bad row, version or size fails the query."""
    bad = lambda text: F.raise_error(F.concat(F.lit(text + ": "), F.col("file")))
    checked = exported.withColumn("version", F.when(F.col("version") == 1, 1).otherwise(bad("unsupported version").cast("int")))
    checked = checked.withColumn("rows", F.coalesce(F.col("reconstruction.surfels"), bad("no reconstruction").cast(f"array<{SAMPLE}>")))
    if most is not None:
        checked = checked.withColumn("rows", F.when(F.size("rows") <= most, F.col("rows")).otherwise(bad("too many samples").cast(f"array<{SAMPLE}>")))
    s = checked.filter("version = 1").select("file", F.col("reconstruction.scanId").alias("scan_id"), F.posexplode("rows").alias("place", "s"))
    numbers = [F.col(f"s.{v}.{a}") for v in ("position", "normal") for a in "xyz"] + [F.col("s.radius")]
    good = F.col("s.radius") > 0
    for n in numbers:
        good = good & finite(n)
    unit = lambda c: clamp(F.coalesce(F.col(c), F.lit(0.0)))
    return s.select(
        "file", "scan_id", F.coalesce(F.col("s.id"), F.col("place").cast("long")).alias("id"),
        *(F.when(F.coalesce(good, F.lit(False)), F.col(f"s.position.{a}")).otherwise(bad("invalid sample").cast("double")).alias(a) for a in "xyz"),
        *(F.col(f"s.normal.{a}").alias(f"n{a}") for a in "xyz"), F.col("s.radius").alias("radius"),
        *(F.when(F.col("s.color").isNotNull(), unit(f"s.color.{k}")).alias(k) for k in "rgb"),
        unit("s.geometryConfidence").alias("geometry_confidence"), unit("s.colorConfidence").alias("color_confidence"),
        *(F.greatest(F.lit(1), F.coalesce(f"s.{a}", F.lit(1))).alias(b) for a, b in (("colorObservationCount", "color_seen"), ("geometryObservationCount", "seen"), ("viewObservationCount", "views"))),
        F.col("s.firstObservedAt").alias("first_ms"), F.col("s.lastObservedAt").alias("last_ms"),
    )


def read_exports(spark: SparkSession, path: str, most: int | None = MOST_SAMPLES) -> DataFrame:
    """Samples of JSON exports, one file a scan."""
    raw = spark.read.schema(EXPORT).json(path, multiLine=True, mode="FAILFAST").withColumn("file", F.input_file_name())
    return normalized_samples(raw, most)


def encode_capture(meta: dict, buffers: dict[str, np.ndarray]) -> bytes:
    """A capture of metadata and named arrays (float32, uint8 or int32)."""
    at, places, raw = 0, {}, []
    for name, values in buffers.items():
        data = np.ascontiguousarray(values).tobytes()
        places[name] = {"$buffer": [values.dtype.name, at, int(values.size)]}
        raw.append(data + b"\0" * (-len(data) % 4))
        at += len(raw[-1])
    head = json.dumps(meta | places).encode()
    if len(head) > MOST_METADATA:
        raise ValueError("metadata too large")
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(raw)


def decode_capture(data: bytes) -> dict:
    """The metadata of a capture with its buffers as arrays; ValueError where the file is not one."""
    if data[:8] != MAGIC or len(data) < 12:
        raise ValueError("not a capture")
    (size,) = struct.unpack("<I", data[8:12])
    if size > MOST_METADATA or 12 + size > len(data):
        raise ValueError("bad metadata length")
    meta, body = json.loads(data[12 : 12 + size]), data[12 + size :]
    for name, value in meta.items():
        if isinstance(value, dict) and "$buffer" in value:
            kind, at, count = value["$buffer"]
            if kind not in ("float32", "uint8", "int32") or at < 0 or at + count * np.dtype(kind).itemsize > len(body):
                raise ValueError(f"bad buffer {name}")
            meta[name] = np.frombuffer(body, kind, count, at)
    return meta


#: A capture of one frame: sequence, ms, epoch, columns, rows, and arrays depth, valid (one value a cell).
FRAME_SAMPLES = "file string, sequence long, ms double, epoch int, columns int, rows int, grid_index int, valid boolean, depth double"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Cells of captured frames, one binary file a frame. Files decode where they are read; a scan's sequence numbers
    must be unique and its epoch one, which captured_checks() tells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                m = decode_capture(bytes(content))
                n = m["columns"] * m["rows"]
                if n > MOST_CELLS or len(m["depth"]) != n or len(m["valid"]) != n:
                    raise ValueError(f"{path}: counts disagree")
                yield pd.DataFrame({"file": path, "sequence": m["sequence"], "ms": float(m["ms"]), "epoch": m["epoch"], "columns": m["columns"], "rows": m["rows"], "grid_index": np.arange(n, dtype=np.int32), "valid": m["valid"] > 0, "depth": m["depth"].astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FRAME_SAMPLES)


def captured_checks(cells: DataFrame) -> DataFrame:
    """One row: frames, whether sequence numbers are unique, whether there is one epoch."""
    frames = cells.select("file", "sequence", "epoch").distinct()
    return frames.agg(F.count("*").alias("frames"), (F.count("*") == F.countDistinct("sequence")).alias("unique_sequences"), (F.countDistinct("epoch") <= 1).alias("one_epoch"))


def write_ply(samples: DataFrame, path: str) -> None:
    """ASCII PLY in parts: header.txt's text is one file, vertex lines are the others, in id order."""
    spark, n = samples.sparkSession, samples.count()
    fields = ["x", "y", "z", "nx", "ny", "nz"]
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *(f"property float {f}" for f in fields), *(f"property uchar {f}" for f in ("red", "green", "blue")), "end_header"]
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/header")
    byte = lambda k: F.floor(clamp(F.coalesce(F.col(k), F.lit(0.8))) * 255 + 0.5).cast("string")
    line = F.concat_ws(" ", *(F.format_string("%.6f", F.col(f)) for f in fields), *map(byte, "rgb"))
    samples.sort("id").select(line.alias("value")).write.mode("overwrite").text(path + "/vertices")


def snapshot_signature(samples: DataFrame, *columns: str) -> DataFrame:
    """One row (rows, signature) that depends on the content of rows and not on their order: the sum and the exclusive
    or of row hashes. Equal signatures of two snapshots mean, but for a chance of 2**-64, equal content."""
    h = F.xxhash64(*columns)
    return samples.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("/", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")), 256).alias("signature"))


def packed_surface(samples: DataFrame, key: str, chunk: int = 65_536) -> DataFrame:
    """Typed arrays of a scan's samples in id order, chunk by chunk: (key, chunk, first_id, positions, normals)."""
    from pyspark.sql import Window

    placed = samples.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("id")) - 1) / chunk))
    row = F.sort_array(F.collect_list(F.struct("id", *(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")))))
    packed = placed.groupBy(key, "chunk").agg(row.alias("rows"))
    flat = lambda names: F.flatten(F.transform("rows", lambda s: F.array(*(s[n] for n in names))))
    return packed.select(key, "chunk", F.get("rows", F.lit(0))["id"].alias("first_id"), flat(("x", "y", "z")).alias("positions"), flat(("nx", "ny", "nz")).alias("normals"))


def unpacked_surface(packed: DataFrame, key: str) -> DataFrame:
    """Samples of packed_surface(): key, chunk, place, position and normal."""
    at = lambda c, k: F.get(c, F.col("place") * 3 + k).cast("double")
    rows = packed.withColumn("place", F.explode(F.sequence(F.lit(0), (F.size("positions") / 3).cast("int") - 1)))
    return rows.select(key, "chunk", "place", *(at("positions", i).alias(n) for i, n in enumerate("xyz")), *(at("normals", i).alias("n" + n) for i, n in enumerate("xyz")))
