"""Corners of a room from the ends of the lines in which its planes meet.

clusters() gathers ends of different lines that lie together and share a plane: greedy in the order of ends, so only ends
that a chain of near ones connects are gathered in one task. solve() takes the point of three of a cluster's planes that its
lines and planes allow best, or else the weighted place of its ends. merged() makes one of corners of the same identity.
found() does all of it in the task that has a scan, after one shuffle of lines and planes; only scans of more than HELD rows
take the others' way, from table to table.
Lines with a null end or plane are left out; a plane that is not in planes gives no point and no residual.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gridwise.functions import vector as vm
from gridwise.functions.numeric import cells
from gridwise.operators import near
from gridwise.operators.graph import components, settled
from gridwise.operators.spatial import KEYS, around

#: How near ends lie, how far a corner may lie from its lines, beyond their ends, lines apart, off a plane.
TOLERANCE, AWAY, BEYOND, GAP, RESIDUAL, DETERMINANT, SAME = 0.12, 0.12, 0.12, 0.12, 0.1, 0.001, 0.12
#: Rows of a scan that found() holds in a task; rows handed to a step together; numbers in an array of a step at most.
HELD, ROWS, VALUES = 200_000, 20_000, 4_000_000


def ends(edges: DataFrame) -> DataFrame:
    """Both ends of edges(scan, edge, a, b, sx, sy, sz, ex, ey, ez, confidence), numbered in order: id = 2 edge, + 1."""
    end = lambda k, p: F.struct((F.col("edge") * 2 + k).alias("id"), *(F.col(p + a).cast("double").alias(a) for a in "xyz"))
    out = edges.select("scan", "edge", "a", "b", "confidence", F.explode(F.array(end(0, "s"), end(1, "e"))).alias("p")).select("scan", "edge", "a", "b", "confidence", "p.*")
    return out.na.drop(subset=["scan", "edge", "a", "b", "x", "y", "z"])


def _near(rows: DataFrame, tolerance: float) -> DataFrame:
    """Pairs (l_*, r_*) of rows of a scan, once each, at most tolerance apart."""
    side = lambda p: rows.select("scan", *(F.col(x).alias(f"{p}_{x}") for x in rows.columns if x != "scan"), *cells(tolerance))
    pairs = around(side("l")).join(side("r"), ["scan", *KEYS]).drop(*KEYS)
    return pairs.filter((F.col("l_id") < F.col("r_id")) & (vm.distance(vm.v("l_"), vm.v("r_")) <= tolerance))


def _connected(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    key = lambda x: F.struct("scan", F.col(x).alias("id"))
    return components(rows.select(key("id").alias("id")), pairs.select(key("l_id").alias("a"), key("r_id").alias("b"))).select("id.scan", "id.id", F.col("component.id").alias("component"))


def _join(found: list[dict], tolerance: float, id_: int, edge: int, planes: set, p: tuple) -> int:
    """The cluster of found that an end joins, by its first end: the first without an end of its line that shares a plane with
    it and all of whose ends are near, or else its own."""
    for c in found:
        if edge not in c["edges"] and c["planes"] & planes and all(math.dist(p, q) <= tolerance for q in c["at"]):
            break
    else:
        c = {"id": id_, "edges": set(), "planes": set(), "at": []}
        found.append(c)
    c["edges"].add(edge)
    c["planes"] |= planes
    c["at"].append(p)
    return c["id"]


def _gather(tolerance: float):
    """Clusters of rows in the order of scan, component, id; what is held is a component's clusters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found = None, []
        for pdf in batches:
            of = []
            for r in pdf.itertuples(index=False):
                if (r.scan, r.component) != at:
                    at, found = (r.scan, r.component), []
                of.append((r.scan, r.id, _join(found, tolerance, r.id, r.edge, {r.a, r.b}, (r.x, r.y, r.z))))
            yield pd.DataFrame(of, columns=["scan", "id", "cluster"])

    return run


def clusters(edges: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(scan, id, cluster: its first end): an end joins the first cluster without an end of its line that shares a plane
    with it and all of whose ends are near."""
    points = ends(edges)
    pairs = _near(points, tolerance).filter((F.col("l_edge") != F.col("r_edge")) & F.arrays_overlap(F.array("l_a", "l_b"), F.array("r_a", "r_b")))
    labels = _connected(points, pairs)
    ordered = points.join(labels, ["scan", "id"]).repartition("scan", "component").sortWithinPartitions("scan", "component", "id")
    return ordered.mapInPandas(_gather(tolerance), "scan long, id long, cluster long")


def _clamped(x: np.ndarray) -> np.ndarray:
    """clamp() of arrays; what is missing counts as 0, as there."""
    return np.where(np.isnan(x), 0.0, np.clip(x, 0.0, 1.0))


def _worst(x: np.ndarray) -> np.ndarray:
    """The largest of a row's values, 0 where there is none."""
    most = np.where(np.isnan(x), -np.inf, x).max(-1, initial=-np.inf)
    return np.where(most == -np.inf, 0.0, most)


def _mean(x: np.ndarray) -> np.ndarray:
    """Means of rows, summed in order; 0 where there is nothing."""
    return np.add.accumulate(x, axis=-1)[..., -1] / x.shape[-1] if x.shape[-1] else np.zeros(x.shape[:-1])


def _length(d: tuple) -> np.ndarray:
    return np.sqrt(vm.dot(d, d))


def _segment(p, a, b) -> tuple[np.ndarray, np.ndarray]:
    """vm.point_segment() of arrays: the distance, and how far the foot lies beyond an end."""
    d = vm.sub(b, a)
    size2 = vm.dot(d, d)
    t = np.where(size2 > 1e-12, vm.dot(vm.sub(p, a), d) / size2, 0.0)
    k = _clamped(t)
    return _length(vm.sub(p, tuple(x + y * k for x, y in zip(a, d, strict=True)))), np.maximum(0.0, np.maximum(-t, t - 1.0)) * np.sqrt(size2)


def _gap(a, b) -> np.ndarray:
    """The largest distance between two of a row's segments, as vm.segment_segment_distance()."""
    i, j = np.triu_indices(a[0].shape[-1], 1)
    a, b, p, q = tuple(x[..., i] for x in a), tuple(x[..., i] for x in b), tuple(x[..., j] for x in a), tuple(x[..., j] for x in b)
    u, w, r = vm.sub(b, a), vm.sub(q, p), vm.sub(a, p)
    uu, uw, ww, ur, wr = vm.dot(u, u), vm.dot(u, w), vm.dot(w, w), vm.dot(u, r), vm.dot(w, r)
    det = uu * ww - uw * uw
    s, t = (uw * wr - ww * ur) / det, (uu * wr - uw * ur) / det
    along = lambda o, d, k: tuple(x + y * k for x, y in zip(o, d, strict=True))
    inner = np.where((det > 1e-12) & (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1), _length(vm.sub(along(a, u, s), along(p, w, t))), np.nan)
    least = np.fmin.reduce([inner, _segment(a, p, q)[0], _segment(b, p, q)[0], _segment(p, a, b)[0], _segment(q, a, b)[0]])
    return _worst(least)


def _judged(p, gap, s, e, confidence, supported, n, k) -> dict[str, np.ndarray]:
    """How points (cluster, point) fit the lines (s, e) and known planes (n, k) of their cluster."""
    p, s, e, n = (tuple(x[..., None] for x in p), *(tuple(x[:, None] for x in v) for v in (s, e, n)))
    away, past = _segment(p, s, e)
    off = np.abs(vm.dot(n, p) - k[:, None])
    far, beyond, residual = _worst(away), _worst(past), _worst(off)
    quality = [_clamped(np.broadcast_to(1 - gap / GAP, far.shape[::-1]).T), _clamped(1 - far / AWAY), _clamped(1 - beyond / BEYOND), _mean(_clamped(1 - off / RESIDUAL))]
    whole = supported[:, None] & (quality[0] > 0) & (quality[1] > 0) & (quality[2] > 0) & (quality[3] > 0.25)
    score = _mean(confidence)[:, None] * 0.4 + quality[0] * 0.2 + quality[1] * 0.15 + quality[2] * 0.1 + quality[3] * 0.15
    return {"valid": (far <= AWAY) & (beyond <= BEYOND) & (residual <= RESIDUAL), "supported": whole, "confidence": _clamped(score), "extension": beyond, "residual": residual}


_FACTS = ["gap", "x", "y", "z", "confidence", "extension", "residual"]


def _corners(w: np.ndarray, line: dict[str, np.ndarray], plane: dict[str, np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(_FACTS in rows, status, reason) of clusters with equal numbers of lines and planes, in rows (w: x, y, z in rows), which
    all know the same of their planes."""
    s, e = (tuple(line[p + a] for a in "xyz") for p in "se")
    n, k = tuple(plane["n" + a] for a in "xyz"), plane["k"]
    rows = len(k)
    facts, status, reason = np.full((len(_FACTS), rows), np.nan), np.full(rows, None, object), np.full(rows, "rejected", object)
    facts[0] = gap = _gap(s, e)
    if k.shape[1] < 3 or s[0].shape[1] < 2:
        reason[:] = "few"
        return facts, status, reason
    i, j, m = np.array(list(itertools.combinations(range(k.shape[1]), 3))).T
    one, two, three = (tuple(x[:, at] for x in n) for at in (i, j, m))
    a, b, c = vm.cross(two, three), vm.cross(three, one), vm.cross(one, two)
    det = vm.dot(one, a)
    point = tuple((k[:, i] * x + k[:, j] * y + k[:, m] * z) / det for x, y, z in zip(a, b, c, strict=True))
    there = (np.abs(det) > DETERMINANT) & ~np.isnan(point[0])
    facts_of = (gap, s, e, line["confidence"], (line["supported"] == 1).all(1), tuple(x[:, known] for x in n), k[:, known])
    todo = np.ones(rows, bool)
    for place, fine, factor in ((point, there, 1.0), (tuple(x[:, None] for x in w), True, 0.85)):
        found = _judged(place, *facts_of)
        fine = found["valid"] & fine
        at = np.flatnonzero(todo & fine.any(1))
        best = np.where(fine, found["confidence"], -1.0)[at].argmax(1)  # the first of equal ones
        for name, x in zip(_FACTS[1:], (*place, found["confidence"] * factor, found["extension"], found["residual"]), strict=True):
            facts[_FACTS.index(name), at] = x[at, best]
        status[at] = np.where(found["supported"][at, best] & (factor == 1), "supported", "partial")
        reason[at] = "solved" if factor == 1 else "fallback"
        todo[at] = False
    return facts, status, reason


def _of_lists(w: np.ndarray, lines: np.ndarray, line: dict[str, np.ndarray], faces: np.ndarray, face: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_corners() of clusters whose lines and planes lie between the offsets lines and faces; like clusters are judged together."""
    rows = w.shape[1]
    facts, status, reason = np.full((len(_FACTS), rows), np.nan), np.full(rows, None, object), np.full(rows, None, object)
    known = ~np.isnan(face["nx"])
    kinds: dict[tuple, list[int]] = {}
    for r in range(rows):
        kinds.setdefault((lines[r + 1] - lines[r], known[faces[r] : faces[r + 1]].tobytes()), []).append(r)
    with np.errstate(all="ignore"):
        for (n, mask), all_of in kinds.items():
            m = len(mask)
            each = max(1, VALUES // max(1, math.comb(m, 3) * max(n, m), n * n))
            for begin in range(0, len(all_of), each):
                of = np.array(all_of[begin : begin + each])
                i, j = lines[of][:, None] + np.arange(n), faces[of][:, None] + np.arange(m)
                facts[:, of], status[of], reason[of] = _corners(w[:, of], {c: x[i] for c, x in line.items()}, {c: x[j] for c, x in face.items()}, np.frombuffer(mask, bool))
    return facts, status, reason


def _fact_columns(facts: np.ndarray, status: np.ndarray, reason: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    """Columns and their names; a corner without a place has only a gap and a reason."""
    none = np.array([s is None for s in status], bool)
    columns = [pa.array(x, pa.float64(), mask=none if n != "gap" else None) for n, x in zip(_FACTS, facts, strict=True)]
    return [*columns, pa.array(status, pa.string()), pa.array(reason, pa.string())], [*_FACTS, "status", "reason"]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def fields(array: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array]:
        flat = array.flatten()
        ids = flat.field(0)
        values = {f.name: pc.struct_field(flat, f.name).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in flat.type if f.name not in ("edge", "plane")}
        offsets = array.offsets.to_numpy()
        return offsets - offsets[0], values, pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), ids)

    for batch in batches:
        (lines, line, edge_ids), (faces, face, surfaces) = fields(batch.column("edges")), fields(batch.column("planes"))
        w = np.stack([batch.column("w" + a).to_numpy(zero_copy_only=False) for a in "xyz"])
        columns, names = _fact_columns(*_of_lists(w, lines, line, faces, face))
        names = ["scan", "corner", "edge_ids", "surfaces", *names]
        out = dict(zip(names, [batch.column("scan"), batch.column("cluster"), edge_ids, surfaces, *columns], strict=True))
        names = ["scan", "corner", "edge_ids", "surfaces", "gap", "x", "y", "z", "status", "confidence", "extension", "residual", "reason"]
        yield pa.RecordBatch.from_arrays([out[n] for n in names], names)


def solve(edges: DataFrame, planes: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each cluster of members(scan, id, cluster): corner (its cluster), edge_ids, surfaces, gap, place, status
    (supported, partial or null), confidence, extension, residual and reason: solved, fallback, few (under two lines or
    three planes) or rejected. planes: (scan, plane, nx, ny, nz, k), edges with `supported`. Of equal points the first three
    planes win. A cluster's triples are judged together, in the task that has its row."""
    line = ["edge", "sx", "sy", "sz", "ex", "ey", "ez", "confidence", "supported"]
    full = edges.select("scan", "a", "b", F.struct(*line).alias("_line"), "edge")
    members = settled(members)  # read for the lines and for the planes
    at = members.join(ends(edges).select("scan", "id", "edge", "x", "y", "z"), ["scan", "id"]).join(full, ["scan", "edge"])
    w = F.greatest(F.lit(0.1), F.col("_line.confidence"))
    per = at.groupBy("scan", "cluster").agg(F.sort_array(F.collect_set("_line")).alias("edges"), *((F.sum(F.col(a) * w) / F.sum(w)).alias(f"w{a}") for a in "xyz"))
    faces = at.select("scan", "cluster", F.explode(F.array("a", "b")).alias("plane")).distinct().join(planes.select("scan", "plane", "nx", "ny", "nz", "k"), ["scan", "plane"], "left")
    faces = faces.groupBy("scan", "cluster").agg(F.sort_array(F.collect_list(F.struct("plane", "nx", "ny", "nz", "k"))).alias("planes"))
    rows = per.join(faces, ["scan", "cluster"]).select("scan", "cluster", "edges", "wx", "wy", "wz", "planes")
    kind = rows.schema
    ids = lambda c: kind[c].dataType.elementType.fields[0].dataType.simpleString()
    schema = f"scan {kind['scan'].dataType.simpleString()}, corner {kind['cluster'].dataType.simpleString()}, edge_ids array<{ids('edges')}>, surfaces array<{ids('planes')}>, gap double, x double, y double, z double, status string, confidence double, extension double, residual double, reason string"
    return rows.mapInArrow(_solved, schema)


def merged(corners: DataFrame, tolerance: float = SAME) -> DataFrame:
    """One row for each group of corners(scan, corner, x, y, z, status, confidence, extension, surfaces, edge_ids) that chains
    of pairs connect: near, with the same planes, or with two thirds of the smaller set and two lines shared, half of the
    smaller set. The supported, surest, least extended, first one stands for it, with the planes and lines of all."""
    rows = settled(corners.filter("x is not null and y is not null and z is not null").withColumn("id", F.col("corner")))
    pairs = _near(rows.select("scan", "id", "x", "y", "z", F.array_sort(F.array_distinct("surfaces")).alias("s"), F.array_distinct("edge_ids").alias("e")), tolerance)
    both = lambda x: F.size(F.array_intersect(f"l_{x}", f"r_{x}"))
    fewer = lambda x: F.greatest(F.lit(1), F.least(F.size(f"l_{x}"), F.size(f"r_{x}")))
    pairs = pairs.filter((F.col("l_s") == F.col("r_s")) | ((both("s") / fewer("s") >= 0.67) & (both("e") >= 2) & (both("e") / fewer("e") >= 0.5)))
    grouped = rows.join(_connected(rows, pairs), ["scan", "id"])
    first = F.struct((F.col("status") != "supported").alias("s"), -F.col("confidence"), "extension", "corner")
    union = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x)
    out = grouped.groupBy("scan", "component").agg(F.min_by(F.struct("corner", "x", "y", "z", "confidence", "extension"), first).alias("_c"), F.count("*").alias("corners"), union("surfaces"), union("edge_ids"), F.bool_or(F.col("status") == "supported").alias("_s"))
    return out.select("scan", "_c.*", "corners", "surfaces", "edge_ids", F.when(F.col("_s"), "supported").otherwise("partial").alias("status"))


def _solved_scans(table: pa.Table, tolerance: float) -> pa.RecordBatch | None:
    """solve() of the clusters() of whole scans, whose rows come as found() has them: planes (no a), then lines by id."""
    values = {n: table.column(n).to_numpy() for n in ("scan", "id", "w", "confidence", "supported", *(f"p{i}" for i in range(6)))}
    is_line = table.column("a").is_valid().to_numpy()
    rows, faces = np.flatnonzero(is_line), np.flatnonzero(~is_line)
    a, b = (pc.fill_null(table.column(c), 0).to_numpy()[rows] for c in "ab")
    # ends in the order of scan and id
    at = np.stack([np.stack([values[f"p{i + 3 * k}"][rows] for k in (0, 1)], 1).ravel() for i in range(3)])
    line = np.repeat(np.arange(len(rows)), 2)
    ends_ = np.flatnonzero(~np.isnan(at).any(0))
    at, line = at[:, ends_], line[ends_]
    if not len(ends_):
        return None
    id_ = values["id"][rows][line] * 2 + ends_ % 2
    scan = values["scan"][rows][line]
    label = np.arange(len(line))
    for u, v in near.close(scan, at, tolerance):
        i, j = line[u], line[v]
        fine = (i != j) & ((a[i] == a[j]) | (a[i] == b[j]) | (b[i] == a[j]) | (b[i] == b[j]))
        near.tied(label, u[fine], v[fine])
    first = np.arange(len(line))  # each end's cluster, as its first end
    for group in near.members(label):
        found: list[dict] = []
        for r, p in zip(group.tolist(), at[:, group].T.tolist(), strict=True):
            i = line[r]
            first[r] = _join(found, tolerance, r, int(i), {int(a[i]), int(b[i])}, tuple(p))
    # clusters in the order of their first ends, with their lines and planes in order
    heads, cluster = np.unique(first, return_inverse=True)
    order = np.lexsort((line, cluster))
    lines = np.concatenate(([0], np.cumsum(np.bincount(cluster, minlength=len(heads)))))
    mine = line[order]
    line_values = {"s" + x: values[f"p{i}"][rows][mine] for i, x in enumerate("xyz")} | {"e" + x: values[f"p{i + 3}"][rows][mine] for i, x in enumerate("xyz")}
    line_values |= {c: values[c][rows][mine] for c in ("confidence", "supported")}
    weight = values["w"][rows][line]
    total = np.bincount(cluster, weight, len(heads))
    with np.errstate(all="ignore"):
        w = np.stack([np.bincount(cluster, x * weight, len(heads)) / total for x in at])
    names, where = np.unique(np.concatenate([a[line], b[line], values["id"][faces]]), return_inverse=True)
    pairs = np.divmod(np.unique(np.tile(cluster, 2) * len(names) + where[: 2 * len(line)]), len(names))  # cluster, plane
    offsets = np.concatenate(([0], np.cumsum(np.bincount(pairs[0], minlength=len(heads)))))
    scans, number = np.unique(np.concatenate([scan, values["scan"][faces]]), return_inverse=True)
    have = number[len(scan) :] * len(names) + where[2 * len(line) :]
    sorted_, wanted = np.argsort(have, kind="stable"), number[heads][pairs[0]] * len(names) + pairs[1]
    spot = np.minimum(np.searchsorted(have[sorted_], wanted), max(0, len(have) - 1))
    got = have[sorted_][spot] == wanted if len(have) else np.zeros(len(wanted), bool)
    face = {n: np.where(got, values[f"p{i}"][faces][sorted_][spot], np.nan) if len(have) else np.full(len(wanted), np.nan) for i, n in enumerate(("nx", "ny", "nz", "k"))}
    columns, kinds = _fact_columns(*_of_lists(w, lines, line_values, offsets, face))
    lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(scan[heads]), pa.array(id_[heads]), lists(lines, values["id"][rows][mine]), lists(offsets, names[pairs[1]]), *columns], ["scan", "corner", "edge_ids", "surfaces", *kinds])


def _alike(s: list, e: list, t: list, f: list) -> bool:
    """Whether corners of planes s, t and lines e, f may be one, as in merged()."""
    if s == t:
        return True
    both, lines = len({*s} & {*t}), len({*e} & {*f})
    return both / max(1, min(len(s), len(t))) >= 0.67 and lines >= 2 and lines / max(1, min(len(e), len(f))) >= 0.5


def _merged_scans(batch: pa.RecordBatch, tolerance: float) -> pa.RecordBatch:
    """merged() of solve()'s rows of whole scans."""
    batch = batch.filter(batch.column("status").is_valid())
    scan, p = batch.column("scan").to_numpy(), np.stack([batch.column(a).to_numpy() for a in "xyz"])
    surfaces, lines, status = (batch.column(c).to_pylist() for c in ("surfaces", "edge_ids", "status"))
    label = np.arange(batch.num_rows)
    for u, v in near.close(scan, p, tolerance):
        fine = np.array([_alike(surfaces[i], lines[i], surfaces[j], lines[j]) for i, j in zip(u.tolist(), v.tolist(), strict=True)], bool)
        near.tied(label, u[fine], v[fine])
    confidence, extension, corner = (batch.column(c).to_numpy() for c in ("confidence", "extension", "corner"))
    count = np.bincount(label, minlength=batch.num_rows)
    first = np.arange(batch.num_rows)
    for group in near.members(label):
        head = group[0]
        first[head] = min(group.tolist(), key=lambda r: (status[r] != "supported", -confidence[r], extension[r], corner[r]))
        surfaces[head], lines[head] = (sorted(set().union(*(x[r] for r in group))) for x in (surfaces, lines))
        status[head] = "supported" if any(status[r] == "supported" for r in group) else "partial"
    heads = np.flatnonzero(label == np.arange(batch.num_rows))
    best = batch.take(pa.array(first[heads]))
    of = lambda x, kind: pa.array([x[r] for r in heads], kind)
    kept = ["scan", "corner", "x", "y", "z", "confidence", "extension"]
    columns = [*(best.column(c) for c in kept), pa.array(count[heads], pa.int64()), of(surfaces, pa.list_(pa.int64())), of(lines, pa.list_(pa.int64())), of(status, pa.string())]
    return pa.RecordBatch.from_arrays(columns, [*kept, "corners", "surfaces", "edge_ids", "status"])


def found(edges: DataFrame, planes: DataFrame, tolerance: float = TOLERANCE, same: float | None = None) -> DataFrame:
    """solve() of the clusters() of edges, or, with a tolerance same, merged() of that. ids are longs."""
    line = ["scan", F.col("edge").alias("id"), "a", "b", *(F.col(f"{p}{x}").cast("double").alias(f"p{i}") for i, (p, x) in enumerate(itertools.product("se", "xyz"))), "confidence", F.greatest(F.lit(0.1), "confidence").alias("w"), F.col("supported").cast("double").alias("supported")]
    none = lambda names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
    face = ["scan", F.col("plane").alias("id"), *none("ab", "long"), *(F.col(n).cast("double").alias(f"p{i}") for i, n in enumerate(("nx", "ny", "nz", "k"))), *none(("p4", "p5", "confidence", "w", "supported"), "double")]
    rows = edges.na.drop(subset=["scan", "edge", "a", "b"]).select(*line).unionByName(planes.na.drop(subset=["scan", "plane"]).select(*face))
    facts = "scan long, corner long, edge_ids array<long>, surfaces array<long>, gap double, x double, y double, z double, status string, confidence double, extension double, residual double, reason string"
    schema = facts if same is None else "scan long, corner long, x double, y double, z double, confidence double, extension double, corners long, surfaces array<long>, edge_ids array<long>, status string"
    as_arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    schema += ", _large boolean"
    kinds = pa.schema([(name, as_arrow[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, large in near.scans(batches, ROWS, HELD):
            if table is None:
                yield pa.RecordBatch.from_pylist([{"scan": large, "_large": True}], kinds)
                continue
            out = _solved_scans(table, tolerance)
            if out is None:
                continue
            out = out if same is None else _merged_scans(out, same)
            yield pa.RecordBatch.from_arrays([*(out.column(n) for n in kinds.names[:-1]), pa.array(np.zeros(out.num_rows, bool))], schema=kinds)

    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make much work: partitions are not to be merged
    done = settled(rows.repartition(n, "scan").sortWithinPartitions("scan", F.col("a").isNotNull(), "id").mapInArrow(run, schema))
    large = [r["scan"] for r in done.filter("_large").select("scan").collect()]  # more than HELD rows each
    done = done.filter("not _large").drop("_large")
    if not large:
        return done
    edges, planes = (x.filter(F.col("scan").isin(large)) for x in (edges, planes))
    more = solve(edges, planes, clusters(edges, tolerance))
    return done.unionByName(more if same is None else merged(more, same))
