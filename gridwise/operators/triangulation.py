"""Local triangulation of oriented samples, and growth over its triangles from a hit.

A sample's neighbours are its nearest compatible ones; on its tangent plane, two of them make a triangle with it where no
other neighbour lies in their circle. Neighbours are an array of NEIGHBOURS at most, so that the circle's test is one of a
row, made in the task that finds them, cube by cube; the only join is one of triangles by edge. On a tie,
four samples on a circle, the diagonal between the smaller positions is kept. A triangle that several of its samples make
counts once. Samples without neighbours, or without a normal, are in no triangle. growth() does all of it in the task that has
a scan, after one shuffle of samples; only scans of more than HELD samples go from table to table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from gridwise.functions import vector as vm
from gridwise.operators import near
from gridwise.operators.graph import grow, settled

#: Metres: reach of neighbours, longest and least edge limit; residual of either plane; edge limit in spacings.
REACH, LONGEST, SHORTEST, RESIDUAL, SPACINGS = 0.12, 0.1, 0.05, 0.028, 2.5
NEIGHBOURS, BATCH, LEAST_DOT, TINY, SINE2 = 8, 5_000, math.cos(math.radians(42)), 1e-6, 0.01
#: Growth from a hit: adjacent normals, normal and residual of the surface, least area in square metres.
HIT_DOT, SURFACE_DOT, SURFACE_RESIDUAL, LEAST_AREA = math.cos(math.radians(58)), 0.55, 0.12, 0.003
#: Samples of a scan that growth() holds in a task; samples handed to a step together; pairs kept before the nearest are chosen.
HELD, ROWS, KEPT = 20_000, 20_000, 2_000_000


def compatible(p: vm.Vec, n: vm.Vec, q: vm.Vec, m: vm.Vec, absolute=F.abs) -> Column:
    """Two samples may share an edge: apart, within reach, of similar normals, each near the other's plane."""
    d = vm.sub(q, p)
    d2 = vm.dot(d, d)
    return (d2 > TINY) & (d2 <= REACH**2) & (vm.dot(n, m) >= LEAST_DOT) & (absolute(vm.dot(n, d)) <= RESIDUAL) & (absolute(vm.dot(m, d)) <= RESIDUAL)


def _fits(left: near.Rows, right: near.Rows) -> np.ndarray:
    """compatible() of pairs in arrays."""
    of = lambda rows, n: tuple(rows(n + a) for a in "xyz")
    return compatible(of(left, ""), of(left, "n"), of(right, ""), of(right, "n"), np.abs)


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _sub(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def _tangents(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """vm.tangent_basis() of arrays."""
    ax, ay, az = abs(n)
    first, second = (ax <= ay) & (ax <= az), (ay < ax) & (ay <= az)
    axis = np.stack([first, second & ~first, ~(first | second)]).astype(float)
    u = np.stack(vm.cross(axis, n))
    u /= np.sqrt(_dot(u, u))
    return u, np.stack(vm.cross(n, u))


def _least(p: np.ndarray) -> np.ndarray:
    """Of places (3, rows, slots), the number of others in a row that come before each, by x, y, z."""
    x, y, z = (c[:, :, None] for c in p)
    u, v, w = (c[:, None, :] for c in p)
    return ((u < x) | ((u == x) & ((v < y) | ((v == y) & (w < z))))).sum(2)


def _found(ids: np.ndarray, p: np.ndarray, n: np.ndarray, d2: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, a, b, c, against) of the triangles that rows make with two of their neighbours. Arrays are (rows, 1 + NEIGHBOURS)
    with the row itself first; p and n have the coordinates before that; there: whether there is such a neighbour."""
    limit = np.minimum(LONGEST, np.maximum(SHORTEST, np.sqrt(d2[:, 1]) * SPACINGS))
    limit2 = limit * limit
    with np.errstate(all="ignore"):
        there = there & (d2 <= limit2[:, None])
        t, s = _tangents(n[:, :, 0])
        off = p - p[:, :, :1]
        u, v = _dot(off, t[:, :, None]), _dot(off, s[:, :, None])
        u[:, 0] = v[:, 0] = 0.0
        before = _least(np.where(there | (np.arange(ids.shape[1]) == 0), p, np.inf))
        size2 = u * u + v * v
        out = []
        for i in range(1, ids.shape[1]):
            for j in range(i + 1, ids.shape[1]):
                k = np.flatnonzero(there[:, i] & there[:, j])
                # p and q by ascending id, as they come in the expressions of the SQL
                turn = ids[k, i] > ids[k, j]
                a, b = np.where(turn, j, i), np.where(turn, i, j)
                au, av, bu, bv, a2, b2 = u[k, a], v[k, a], u[k, b], v[k, b], size2[k, a], size2[k, b]
                det = au * bv - av * bu
                fine = (det * det > a2 * b2 * SINE2) & (a2 * b2 > 1e-16) & (au * bu + av * bv >= -0.5 * np.sqrt(a2 * b2))
                at, bt = p[:, k, a], p[:, k, b]
                across = _sub(bt, at)
                fine &= compatible(at, n[:, k, a], bt, n[:, k, b], np.abs) & (_dot(across, across) <= limit2[k])
                e, f = _sub(at, p[:, k, 0]), _sub(bt, p[:, k, 0])
                cross = vm.cross(e, f)
                fine &= _dot(cross, cross) > _dot(e, e) * _dot(f, f) * SINE2
                k, a, b, au, av, bu, bv, a2, b2, det = (x[fine] for x in (k, a, b, au, av, bu, bv, a2, b2, det))
                against = _dot(cross, n[:, :, 0][:, np.flatnonzero(there[:, i] & there[:, j])])[fine] < 0
                cu, cv = (a2 * bv - b2 * av) / (2 * det), (au * b2 - bu * a2) / (2 * det)
                r2 = cu * cu + cv * cv
                slack = np.maximum(1e-14, r2 * 1e-8)
                taken = np.zeros(len(k), bool)
                zero, first, pa, pb = np.zeros(len(k)), before[k, 0], before[k, a], before[k, b]
                corners = ((zero, zero, first), (au, av, pa), (bu, bv, pb))
                for o in range(1, ids.shape[1]):
                    ou, ov, po = u[k, o], v[k, o], before[k, o]
                    away = (ou - cu) * (ou - cu) + (ov - cv) * (ov - cv) - r2
                    loses = np.zeros(len(k), bool)
                    for m in range(3):
                        (pu, pv, pp), (qu, qv, qq), (ru, rv, rr) = corners[m], corners[(m + 1) % 3], corners[(m + 2) % 3]
                        mine, theirs = np.minimum(pp, qq) * 64 + np.maximum(pp, qq), np.minimum(rr, po) * 64 + np.maximum(rr, po)
                        side = lambda x, y, pu=pu, pv=pv, qu=qu, qv=qv: (qu - pu) * (y - pv) - (qv - pv) * (x - pu)
                        loses |= (side(ru, rv) * side(ou, ov) < 0) & (mine > theirs)
                    taken |= there[k, o] & (o != a) & (o != b) & ((away < -slack) | ((abs(away) <= slack) & loses))
                k, a, b, against = (x[~taken] for x in (k, a, b, against))
                three = np.stack([ids[k, 0], ids[k, a], ids[k, b]], 1)
                # the order (centre, p, q) turned into ascending ids: an odd number of swaps reverses it
                swaps = (three[:, 0] > three[:, 1]).astype(int) + (three[:, 0] > three[:, 2]) + (three[:, 1] > three[:, 2])
                out.append((ids[k, 0], *np.sort(three, 1).T, against != (swaps % 2 == 1)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, BATCH):
            part = batch.slice(begin, BATCH)
            near_, rows = part.column("near"), part.num_rows
            count = np.diff(near_.offsets.to_numpy())
            row = np.repeat(np.arange(rows), count)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1
            flat = near_.flatten()

            def table(name, missing, part=part, flat=flat, rows=rows, row=row, slot=slot, own=True):
                out = np.full((rows, 1 + NEIGHBOURS), missing)
                if own:
                    out[:, 0] = part.column("l_" + name).to_numpy()
                out[row, slot] = flat.field(name).to_numpy()
                return out

            there = np.zeros((rows, 1 + NEIGHBOURS), bool)
            there[row, slot] = True
            found = _found(table("id", -1), np.stack([table(a, np.nan) for a in "xyz"]), np.stack([table("n" + a, np.nan) for a in "xyz"]), table("d2", np.inf, own=False), there)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["id", "a", "b", "c", "against"])


def triangles(samples: DataFrame) -> DataFrame:
    """(a, b, c, turned): triangles of samples(id, position, normal) by ascending id; turned, if their order runs against
    the normal of the smallest sample that makes them."""
    # unit normals are computed once a sample, not in each pair
    rows = samples.filter(vm.length(vm.v("n")) > TINY).select(F.col("id").cast("long"), "x", "y", "z", *vm.columns(vm.normalized(vm.v("n")), "n"))
    hoods = near.nearest(rows, rows, REACH, NEIGHBOURS, _fits).filter(F.size("near") >= 2)
    found = hoods.mapInArrow(_made, "id long, a long, b long, c long, against boolean")
    return found.groupBy("a", "b", "c").agg(F.min_by("against", "id").alias("turned"))


def with_corners(found: DataFrame, samples: DataFrame) -> DataFrame:
    """triangles() with their unit normal (n), area, centroid, and whether any sample is a barrier."""
    for k in "abc":
        found = found.join(samples.select(F.col("id").alias(k), *(F.col(x).alias(f"{k}_{x}") for x in "xyz"), F.col("barrier").alias(f"{k}_barrier")), k)
    cross = vm.cross(vm.sub(vm.v("b_"), vm.v("a_")), vm.sub(vm.v("c_"), vm.v("a_")))
    found = found.select("*", *vm.columns(vm.normalized(cross), "n"), (vm.length(cross) / 2).alias("area"))
    return found.withColumn("barrier", F.col("a_barrier") | F.col("b_barrier") | F.col("c_barrier"))


def grown_from_hits(cornered: DataFrame, hits: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(scan, triangle, step): triangles that hits(scan, triangle) reach over shared edges on their surface(scan, snx, sny, snz,
    sk). Triangles have an id `triangle` and a scan. A hit or neighbour with a barrier, off the surface or turned away from
    it takes no part, and neighbours may differ by 58 degrees. Scans whose area is below LEAST_AREA give nothing."""
    on = cornered.join(surfaces, "scan").filter(~F.col("barrier") & F.col("nx").isNotNull())
    far = F.greatest(*(F.abs(F.col("snx") * F.col(f"{k}_x") + F.col("sny") * F.col(f"{k}_y") + F.col("snz") * F.col(f"{k}_z") - F.col("sk")) for k in "abc"))
    on = settled(on.filter((far <= SURFACE_RESIDUAL) & (F.abs(vm.dot(vm.v("n"), vm.v("sn"))) >= SURFACE_DOT)).select("scan", "triangle", "a", "b", "c", "nx", "ny", "nz", "area"))
    edge = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    edges = on.select("scan", "triangle", "nx", "ny", "nz", F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("a", "c"))).alias("e")).select("*", "e.p", "e.q")
    other = edges.select("p", "q", F.col("triangle").alias("next"), *(F.col(x).alias(f"o{x}") for x in ("nx", "ny", "nz")))
    steps = edges.join(other, ["p", "q"]).filter(F.col("triangle") != F.col("next")).filter(F.abs(vm.dot(vm.v("n"), vm.v("on"))) >= HIT_DOT)
    steps = settled(steps.select(F.col("triangle").alias("a"), F.col("next").alias("b")).distinct())
    seeds = hits.join(on.select("triangle"), "triangle", "left_semi").select(F.col("triangle").alias("id"), F.col("triangle").alias("seed"))
    reached = grow(seeds, steps).join(on.select("scan", F.col("triangle").alias("id"), "area"), "id")
    enough = reached.groupBy("scan").agg(F.sum("area").alias("total")).filter(F.col("total") >= LEAST_AREA)
    return reached.join(enough, "scan").select("scan", F.col("id").alias("triangle"), "step")


def first_hits(cornered: DataFrame) -> DataFrame:
    """(scan, triangle): each scan's first triangle without a barrier."""
    return cornered.filter("not barrier").groupBy("scan").agg(F.min_by("triangle", F.struct("a", "b", "c")).alias("triangle"))


def _named(found: DataFrame) -> DataFrame:
    return found.withColumn("triangle", F.concat_ws("/", *(F.col(k).cast("string") for k in "abc")))


def _hoods(scan: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour, d2): the NEIGHBOURS nearest compatible rows of each, in order, as near.nearest() with _fits."""

    def chosen(parts):
        a, b, d2 = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((b, p[2][b], p[1][b], p[0][b], d2, a))
        order = order[near._firsts(a[order]) < NEIGHBOURS]
        return a[order], b[order], d2[order]

    none = np.zeros(0, np.int64)
    kept, count = [(none, none, np.zeros(0))], 0
    for u, v in near.close(scan, p, REACH * 1.000001):
        for a, b in ((u, v), (v, u)):
            at, to = (tuple(x[:, r]) for x, r in ((p, a), (p, b)))
            fine = compatible(at, tuple(n[:, a]), to, tuple(n[:, b]), np.abs)
            a, b = a[fine], b[fine]
            d2 = np.zeros(len(a))
            for x in p:
                d = x[b] - x[a]
                d2 += d * d
            kept.append((a, b, d2))
            count += len(a)
        if count > KEPT:
            kept, count = [chosen(kept)], 0
    return chosen(kept)


def _grown_scans(table: pa.Table) -> pa.RecordBatch:
    """(scan, triangle, step) of whole scans, sorted by scan and id."""
    values = {c: table.column(c).to_numpy() for c in ("scan", "id", *"xyz", "nx", "ny", "nz", "snx", "sny", "snz", "sk")}
    scan, ids, p, n = values["scan"], values["id"], np.stack([values[c] for c in "xyz"]), np.stack([values["n" + c] for c in "xyz"])
    barrier = table.column("barrier").to_numpy(zero_copy_only=False).astype(bool)
    row, other, d2 = _hoods(scan, p, n)
    several = np.bincount(row, minlength=len(ids))[row] >= 2
    row, other, d2 = row[several], other[several], d2[several]
    centres, at = np.unique(row, return_inverse=True)
    slot, three = near._firsts(row) + 1, [np.zeros((3, 0), np.int64)]
    for begin in range(0, len(centres), BATCH):
        part = slice(*np.searchsorted(at, (begin, begin + BATCH)))
        size, spot = min(BATCH, len(centres) - begin), (at[part] - begin, slot[part])
        id_, far = np.full((size, 1 + NEIGHBOURS), -1), np.full((size, 1 + NEIGHBOURS), np.inf)
        id_[:, 0], id_[spot], far[spot] = centres[begin : begin + size], other[part], d2[part]
        there = np.zeros(id_.shape, bool)
        there[spot] = True
        used = id_ >= 0
        place, normal = (np.where(used, x[:, id_], np.nan) for x in (p, n))
        three.append(np.stack(_found(id_, place, normal, far, there)[1:4]))  # rows serve as ids: they are in the same order
    a, b, c = np.unique(np.concatenate(three, 1), axis=1)
    with np.errstate(all="ignore"):
        cross = np.stack(vm.cross(_sub(p[:, b], p[:, a]), _sub(p[:, c], p[:, a])))
        length = np.sqrt(_dot(cross, cross))
        flat = cross / length
    blocked = barrier[a] | barrier[b] | barrier[c]
    of, open_ = scan[a], np.flatnonzero(~blocked)
    hits = open_[np.unique(of[open_], return_index=True)[1]]  # triangles are in order of their corners, so of scans too
    sn, sk = np.stack([values["sn" + x][a] for x in "xyz"]), values["sk"][a]
    far = np.max([np.abs(sn[0] * p[0][k] + sn[1] * p[1][k] + sn[2] * p[2][k] - sk) for k in (a, b, c)], axis=0, initial=0.0)
    on = ~blocked & (length > TINY) & (far <= SURFACE_RESIDUAL) & (np.abs(_dot(flat, sn)) >= SURFACE_DOT)
    # triangles of one edge meet each other
    edges = np.concatenate([x[on] * len(ids) + y[on] for x, y in ((a, b), (b, c), (a, c))])
    mine = np.tile(np.flatnonzero(on), 3)
    order = np.argsort(edges, kind="stable")
    edges, mine = edges[order], mine[order]
    begins = np.flatnonzero(np.concatenate(([len(edges) > 0], edges[1:] != edges[:-1])))
    size = np.diff(np.append(begins, len(edges)))
    each = np.repeat(size, size)
    u = np.repeat(np.arange(len(edges)), each)
    v = np.repeat(np.repeat(begins, size), each) + np.arange(len(u)) - np.repeat(np.cumsum(each) - each, each)
    u, v = mine[u], mine[v]
    fine = (u != v) & (np.abs(_dot(flat[:, u], flat[:, v])) >= HIT_DOT)
    u, v = u[fine], v[fine]
    step = np.full(len(a), -1, np.int32)
    step[hits[on[hits]]] = 0
    last = 0
    while True:
        new = v[(step[u] == last) & (step[v] < 0)]
        if not len(new):
            break
        last += 1
        step[new] = last
    reached = np.flatnonzero(step >= 0)
    scans, number = np.unique(of[reached], return_inverse=True)
    reached = reached[(np.bincount(number, length[reached] / 2, len(scans)) >= LEAST_AREA)[number]]
    names = [f"{x}/{y}/{z}" for x, y, z in zip(*(ids[k[reached]].tolist() for k in (a, b, c)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(of[reached]), pa.array(names, pa.string()), pa.array(step[reached]), pa.array(np.zeros(len(names), bool))], schema=_GROWN)


_GROWN = pa.schema([("scan", pa.int64()), ("triangle", pa.string()), ("step", pa.int32()), ("_large", pa.bool_())])


def growth(samples: DataFrame) -> DataFrame:
    """grown_from_hits() of the triangles() of samples(id, scan, position, normal, barrier, and their scan's snx, sny, snz, sk),
    from each scan's first triangle without a barrier. Triangles are of samples of one scan. ids and scans are longs."""
    whole = near._whole(samples.filter(vm.length(vm.v("n")) > TINY))
    rows = whole.select("scan", F.col("id").cast("long").alias("id"), "x", "y", "z", *vm.columns(vm.normalized(vm.v("n")), "n"), F.coalesce("barrier", F.lit(True)).alias("barrier"), "snx", "sny", "snz", "sk").na.drop(subset=["scan", "id"])
    # a count by scan asks for a scan in one task, without a shuffle where that is so
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("scan")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, large in near.scans(batches, ROWS, HELD):
            yield _grown_scans(table) if table is not None else pa.RecordBatch.from_pylist([{"scan": large, "_large": True}], _GROWN)

    done = settled(rows.sortWithinPartitions("scan", "id").mapInArrow(run, "scan long, triangle string, step int, _large boolean"))
    large = [r["scan"] for r in done.filter("_large").select("scan").collect()]  # more than HELD samples each
    done = done.filter("not _large").drop("_large")
    for scan in large:  # one by one, so that what lies together is of one scan
        of = settled(samples.filter(F.col("scan") == scan))
        found = settled(_named(triangles(of)).withColumn("scan", F.lit(scan)))
        cornered = settled(with_corners(found, of))
        done = done.unionByName(grown_from_hits(cornered, first_hits(cornered), of.select("scan", "snx", "sny", "snz", "sk").distinct()))
    return done
