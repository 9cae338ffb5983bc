"""Rows near rows, block by block: nearest ones, best ones, and links enough to connect what lies together.

Space is cut into cubes. A row is looked up in its own cube, to which the rows within the margin around it are copied, so a
row travels about twice where cubes are wide against the margin, and its pairs never leave the task that forms them. Within
a task, rows lie in cells as wide as the margin and pairs are formed some at a time. nearest() looks at a small margin
first where rows lie close, so that neither cubes nor candidates grow with the density; only rows with too few neighbours
there go on to twice the margin. The others look at all within the radius, which is what they count or compare, but for
joined(): it forms pairs of what is not connected yet only, cell by cell, so that it does not grow with the square of density.
Rows with a null or NaN coordinate are near nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from gridwise.operators.graph import settled

BLOCK, SIDE = ["_bx", "_by", "_bz"], "_side"
#: Rows that a cube should hold (or EACH for each neighbour sought, if more), halvings of the margin at most, rows handed to a
#: step together, pairs formed at once; cubes listed to a task at most.
MOST, EACH, HALVINGS, ROWS, PAIRS, CUBES = 2_000, 500, 10, 50_000, 1_000_000, 100_000
#: Rows of a key that a cube of joined() should hold.
HELD = 200_000
#: Where cubes begin, in widths: not at 0, where floors and walls tend to lie, whose rows would all be copied across.
SHIFT = 0.37

Rows = Callable[[str], np.ndarray]
Fits = Callable[[Rows, Rows], np.ndarray]


def _whole(rows: DataFrame) -> DataFrame:
    return rows.filter(" and ".join(f"{a} is not null and not isnan({a})" for a in "xyz"))


def _margin(radius: float) -> float:
    return radius * 1.000001


def _blocked(left: DataFrame, right: DataFrame, width: float, radius: float, listed: bool = False, shift: float = SHIFT, key: str | None = None) -> DataFrame:
    """left rows (side 0) in their cubes, right rows (side 1) in all whose rows they may be near, cube by cube. Where both are
    the same rows, a row in its own cube is sent once (side 2). listed: left is few rows, and right rows go only to cubes
    that hold any of them, if these are few enough to be listed to each task. key: a column whose values are cubes of their own."""
    by = BLOCK if key is None else [*BLOCK, key]
    at = lambda a, m=0.0: F.floor((F.col(a) + m) / width + shift)
    own = [at(a).alias(b) for a, b in zip("xyz", BLOCK, strict=True)]
    points = _whole(right).select(*left.columns)
    for a, b in zip("xyz", BLOCK, strict=True):
        points = points.withColumn(b, F.explode(F.sequence(at(a, -_margin(radius)), at(a, _margin(radius)))))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes make many pairs: partitions are not to be merged
    if left is right:
        home = [F.col(b) == at(a) for a, b in zip("xyz", BLOCK, strict=True)]
        rows = points.withColumn(SIDE, F.when(home[0] & home[1] & home[2], 2).otherwise(1))
    else:
        queries = _whole(left).select("*", *own, F.lit(0).alias(SIDE))
        if listed:
            cubes = settled(queries.select(*BLOCK).distinct())
            if cubes.limit(CUBES + 1).count() <= CUBES:
                points = points.join(F.broadcast(cubes), BLOCK, "left_semi").select(*left.columns, *BLOCK)
        rows = queries.unionByName(points.withColumn(SIDE, F.lit(1)))
    return rows.repartition(n, *by).sortWithinPartitions(*by)


def _groups(batches: Iterator[pa.RecordBatch], by: list[str] = BLOCK) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cubes, about ROWS rows each or one cube, with the number of each row's cube."""

    def numbered(table):
        at = np.stack([table.column(b).to_numpy() for b in by])
        return np.concatenate(([0], np.cumsum((at[:, 1:] != at[:, :-1]).any(0)))) if table.num_rows else np.zeros(0, np.int64)

    held, n, want = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= want:
            table = pa.Table.from_batches(held)
            cube = numbered(table)
            end = int(np.searchsorted(cube, cube[-1]))  # the last cube may go on
            if end:
                yield table.slice(0, end).combine_chunks(), cube[:end]
                held, n, want = table.slice(end).to_batches(), table.num_rows - end, ROWS
            else:
                want = 2 * n
    if n:
        table = pa.Table.from_batches(held)
        yield table.combine_chunks(), numbered(table)


def _pairs(table: pa.Table, cube: np.ndarray, width: float, radius: float, cells: tuple[float, int] | None, self_join: bool, most: float | None = None, shift: float = SHIFT):
    """(queries, pairs' query, pairs' point, d2): row numbers of some queries, and of all pairs of these within the radius (or
    `most`, where the cells of this radius bound them), in the order of the queries."""
    side = table.column(SIDE).to_numpy()
    q, p = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    xyz = [table.column(a).to_numpy() for a in "xyz"]
    ids = table.column("id").to_numpy()
    cell, n = _margin(radius), int(width / radius) + 5
    key = cube.astype(np.int64)
    for x, b in zip(xyz, BLOCK, strict=True):
        key = key * n + np.clip(np.floor((x - (table.column(b).to_numpy() - shift) * width) / cell).astype(np.int64) + 2, 0, n - 1)
    coarse = [np.floor(x / cells[0]) for x in xyz] if cells else []
    p = p[np.argsort(key[p], kind="stable")]
    ordered = key[p]
    middle = key[q][:, None] + np.array([i * n * n + j * n for i in (-1, 0, 1) for j in (-1, 0, 1)])
    low, high = np.searchsorted(ordered, middle - 1, "left"), np.searchsorted(ordered, middle + 1, "right")
    total = np.cumsum((high - low).sum(1))
    begin = 0
    while begin < len(q):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
        lo, size = low[begin:end].ravel(), (high[begin:end] - low[begin:end])
        each = size.ravel()
        one = np.repeat(q[begin:end], size.sum(1))
        other = p[np.arange(each.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(each)[:-1])), each)]
        d2 = np.zeros(len(one))
        for x in xyz:
            d = x[other] - x[one]
            d2 += d * d
        fine = d2 <= (most or radius) ** 2
        if self_join:
            fine &= ids[one] != ids[other]
        for c in coarse:
            fine &= np.abs(c[other] - c[one]) <= cells[1]
        yield q[begin:end], one[fine], other[fine], d2[fine]
        begin = end


def _reader(table: pa.Table, at: np.ndarray) -> Rows:
    return lambda name: table.column(name).to_numpy()[at]


def _firsts(groups: np.ndarray) -> np.ndarray:
    """The place of each row within its group of equal neighbours."""
    begins = np.flatnonzero(np.concatenate(([len(groups) > 0], groups[1:] != groups[:-1])))
    return np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))


def _columns(table: pa.Table, names: list[str], at: np.ndarray) -> list[pa.Array]:
    take = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks != 1 else c.chunk(0)
    return [take(table.column(n).take(pa.array(at, pa.int64()))) for n in names]


def _named(prefix: str, rows: DataFrame) -> list[StructField]:
    return [StructField(prefix + f.name, f.dataType, True) for f in rows.schema.fields]


def _halvings(right: DataFrame, radius: float, k: int) -> int:
    """How often the radius is halved until no cube of eight such margins holds more rows than it should for k neighbours."""
    right = _whole(right)
    for t in range(HALVINGS):
        width = 8 * radius / 2**t
        most = right.groupBy(*(F.floor(F.col(a) / width + SHIFT) for a in "xyz")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= max(MOST, EACH * k):
            return t
    return HALVINGS


def nearest(left: DataFrame, right: DataFrame, radius: float, k: int, fits: Fits | None = None, cells: tuple[float, int] | None = None, self_join: bool = True, keep: list[str] | None = None, made: dict[str, Callable[[Rows, Rows], np.ndarray]] | None = None) -> DataFrame:
    """left's columns as l_*, and near: the k nearest right rows within radius, as structs of right's columns and d2, in order of
    d2, x, y, z, id. fits(l, r) takes two functions from a column's name to its values in pairs. cells (width, reach): only
    rows in grid cells of that width at most reach apart. Both sides have the same columns, id among them.
    keep: of right's columns and d2 only these, and made: doubles made of the pairs, as fits does; what near holds is written
    once to the checkpoint folder where rows lie close."""
    names = left.columns
    keep, made = [*names, "d2"] if keep is None else keep, made or {}
    fields = [left.schema[n] if n != "d2" else StructField("d2", DoubleType()) for n in keep]
    one = StructType([*(StructField(f.name, f.dataType, True) for f in fields), *(StructField(n, DoubleType()) for n in made)])
    schema = StructType([*_named("l_", left), StructField("near", ArrayType(one)), StructField("_done", BooleanType())])
    halvings = _halvings(right, radius, k)

    def step(width: float, reach: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, cube in _groups(batches):
                for queries, a, b, d2 in _pairs(table, cube, width, reach, cells, self_join):
                    if fits is not None and len(a):
                        fine = fits(_reader(table, a), _reader(table, b))
                        a, b, d2 = a[fine], b[fine], d2[fine]
                    count = np.bincount(a, minlength=table.num_rows)
                    done = (count >= k) | (reach >= radius)
                    fine = done[a]  # rows that go on to a wider margin leave nothing here
                    a, b, d2 = a[fine], b[fine], d2[fine]
                    order = np.lexsort((d2, a))
                    a, b, d2 = a[order], b[order], d2[order]
                    place = _firsts(a)
                    last = np.full(table.num_rows, np.inf)
                    last[a[place == k - 1]] = d2[place == k - 1]
                    fine = d2 <= last[a]
                    a, b, d2 = a[fine], b[fine], d2[fine]
                    order = np.lexsort((*(table.column(c).to_numpy()[b] for c in ("id", "z", "y", "x")), d2, a))
                    order = order[_firsts(a[order]) < k]
                    a, b, d2 = a[order], b[order], d2[order]
                    found = np.bincount(a, minlength=table.num_rows)[queries]
                    values = {n: pa.array(d2) if n == "d2" else _columns(table, [n], b)[0] for n in keep}
                    values |= {n: pa.array(np.asarray(f(_reader(table, a), _reader(table, b)), np.float64)) for n, f in made.items()}
                    structs = pa.StructArray.from_arrays(list(values.values()), list(values))
                    near = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(found))), pa.int32()), structs)
                    yield pa.RecordBatch.from_arrays([*_columns(table, names, queries), near, pa.array(done[queries])], schema.names)

        return run

    todo, out = left, None
    for t in range(halvings, -1, -1):
        reach, width = radius / 2**t, max(8 * radius / 2**halvings, radius / 2**t)
        found = _blocked(todo, right, width, reach, t < halvings).mapInArrow(step(width, reach), schema)
        if t:
            found = settled(found)
            todo = found.filter("not _done").select(*(F.col(f"l_{n}").alias(n) for n in names))
        done = found.filter("_done").drop("_done")
        out = done if out is None else out.unionByName(done)
    return out


def best(left: DataFrame, right: DataFrame, radius: float, judge: Callable[[Rows, Rows, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], cells: tuple[float, int] | None = None) -> DataFrame:
    """(l_id, r_id, score, candidates, flagged): for each left row the right row of lowest score, then id, among those within
    the radius that judge(l, r, d2) -> (fine, score, flag) finds fine; the number of all within it, and of the flagged."""
    schema = StructType([StructField("l_id", left.schema["id"].dataType), StructField("r_id", right.schema["id"].dataType), *(StructField(n, k) for n, k in (("score", DoubleType()), ("candidates", LongType()), ("flagged", LongType())))])

    # cells that far apart bound the margin; rows that have to share a cell need none
    margin = min(radius, cells[0] * (cells[1] + 1)) if cells else radius
    alone = bool(cells) and not cells[1]
    shift = 0.0 if alone else SHIFT  # then cubes are cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cube in _groups(batches):
            n = table.num_rows
            for queries, a, b, d2 in _pairs(table, cube, margin, margin, cells, False, radius, shift):
                fine, score, flag = judge(_reader(table, a), _reader(table, b), d2)
                candidates, flagged = np.bincount(a, minlength=n)[queries], np.bincount(a[flag], minlength=n)[queries]
                a, b, score = a[fine], b[fine], score[fine]
                least = np.full(n, np.inf)
                np.minimum.at(least, a, score)
                top = score == least[a]
                a, b, score = a[top], b[top], score[top]
                order = np.lexsort((table.column("id").to_numpy()[b], a))
                order = order[_firsts(a[order]) == 0]
                where = np.full(n, -1)
                where[a[order]] = b[order]
                at, none = where[queries], where[queries] < 0
                ids, others = _columns(table, ["id"], queries)[0], _columns(table, ["id"], np.maximum(at, 0))[0]
                others = pa.array(others.to_numpy(zero_copy_only=False), mask=none)
                yield pa.RecordBatch.from_arrays([ids, others, pa.array(np.where(none, 0.0, least[queries]), mask=none), pa.array(candidates, pa.int64()), pa.array(flagged, pa.int64())], schema.names)

    return _blocked(left, right, margin, 0.0 if alone else margin, shift=shift).mapInArrow(run, schema)


def links(rows: DataFrame, radius: float, fits: Fits | None = None, counted: str | None = None) -> DataFrame:
    """(a, b, n): pairs of rows within the radius that fit (fits is symmetric), as many as it takes to connect within each
    cube whatever all such pairs connect; and, for each row of the cube, (id, null, the number of its linked rows whose
    column `counted` is true), if there is one."""
    kind = rows.schema["id"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cube in _groups(batches):
            ids, side = table.column("id").to_numpy(), table.column(SIDE).to_numpy()
            n = table.num_rows
            _, spot = np.unique(np.stack([cube, ids]), axis=1, return_inverse=True)  # a row of a cube, as query and as point
            spot = spot.ravel()
            label = np.arange(n)
            mark = table.column(counted).to_numpy(zero_copy_only=False).astype(bool) if counted else None
            for queries, a, b, _ in _pairs(table, cube, radius, radius, None, True):
                if fits is not None and len(a):
                    fine = fits(_reader(table, a), _reader(table, b))
                    a, b = a[fine], b[fine]
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[queries]).cast(schema_arrow), pa.nulls(len(queries), schema_arrow), pa.array(np.bincount(a[mark[b]], minlength=n)[queries], pa.int64())], schema.names)
                u, v = spot[a], spot[b]
                while True:
                    x, y = label[u], label[v]
                    apart = x != y
                    if not apart.any():
                        break
                    u, v, x, y = u[apart], v[apart], x[apart], y[apart]
                    np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                    while (label[label] != label).any():
                        label = label[label]
            first = np.zeros(n, ids.dtype)
            first[spot] = ids
            tied = np.flatnonzero((label[spot] != spot))
            ends = np.unique(np.stack([ids[tied], first[label[spot[tied]]]]), axis=1) if len(tied) else np.zeros((2, 0), ids.dtype)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]).cast(schema_arrow), pa.array(ends[1]).cast(schema_arrow), pa.nulls(ends.shape[1], pa.int64())], schema.names)

    schema_arrow = pa.int64() if kind == LongType() else pa.int32()
    return _blocked(rows, rows, radius, radius).mapInArrow(run, schema)


def _unite(read: Callable[[str], np.ndarray], n: int, radius: float, fits: Fits, alike: list[str], reach: float) -> np.ndarray:
    """Labels of n rows: the first row of those that pairs within the radius that fit connect. Pairs of rows that already have
    one label are not formed, and others only of cells whose bounds allow a pair."""
    dims = np.stack([read(c) for c in (*"xyz", *alike)])
    limits = [(slice(0, 3), radius), (slice(3, None), reach)]
    label = np.arange(n)
    fine = np.flatnonzero(np.isfinite(dims).all(0))  # others fit nothing

    def tie(a: np.ndarray, b: np.ndarray) -> None:
        for begin in range(0, len(a), PAIRS):
            u, v = a[begin : begin + PAIRS], b[begin : begin + PAIRS]
            apart = label[u] != label[v]
            u, v = u[apart], v[apart]
            if not len(u):
                continue
            d2 = np.zeros(len(u))
            for x in dims[:3]:
                d = x[v] - x[u]
                d2 += d * d
            near = d2 <= radius**2
            u, v = u[near], v[near]
            good = fits(lambda c: read(c)[u], lambda c: read(c)[v])  # noqa: B023
            tied(label, u[good], v[good])

    # cells in which most pairs fit
    cell = np.zeros(len(fine), np.int64)
    ranks = []
    for part, most in limits:
        for x in dims[part][:, fine]:
            ranks.append(np.unique(np.floor(x / (most / np.sqrt(len(dims[part])))), return_inverse=True)[1])
            cell = np.unique(cell * (ranks[-1].max(initial=0) + 1) + ranks[-1], return_inverse=True)[1]
    order = np.argsort(cell, kind="stable")
    begins = np.searchsorted(cell[order], np.arange(cell.max(initial=-1) + 1))
    tie(fine, fine[order[begins]][cell])
    for last in range(len(ranks)):  # rows that follow each other in one direction
        along = fine[np.lexsort((dims[last][fine], *(r for i, r in enumerate(ranks) if i != last)))]
        for k in (1, 2, 3):
            tie(along[:-k], along[k:])
    # groups: rows of one cell and label, and their bounds
    if not len(fine):
        return label
    roots = np.unique(label[fine], return_inverse=True)[1]
    group = np.unique(cell * (roots.max() + 1) + roots, return_inverse=True)[1]
    order = fine[np.argsort(group, kind="stable")]
    size = np.bincount(group)
    begins = np.cumsum(size) - size
    low, high = np.minimum.reduceat(dims[:, order], begins, axis=1), np.maximum.reduceat(dims[:, order], begins, axis=1)
    head = order[begins]
    largest = np.bincount(label[order]).argmax()
    odd = np.flatnonzero(label[head] != largest)
    odd = odd[np.argsort(size[odd], kind="stable")]
    begin, each = 0, max(1, PAIRS // len(head))
    while begin < len(odd):
        mine = odd[begin : begin + each]
        begin += each
        mine = mine[label[head[mine]] != largest]
        a, b = np.nonzero(label[head[mine]][:, None] != label[head][None, :])
        a = mine[a]
        for part, most in limits:
            gap2 = np.zeros(len(a))
            for x, y in zip(low[part], high[part], strict=True):
                d = np.maximum(0.0, np.maximum(x[a] - y[b], x[b] - y[a]))
                gap2 += d * d
            near = gap2 <= (most * 1.000001) ** 2
            a, b = a[near], b[near]
        many = size[a] * size[b]
        total, done = np.cumsum(many), 0
        while done < len(a):
            end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
            i, j = a[done:end], b[done:end]
            done = end
            apart = label[head[i]] != label[head[j]]
            i, j = i[apart], j[apart]
            if len(i) == 1 and size[i[0]] * size[j[0]] > PAIRS:  # two large groups: by rows of one
                for r in order[begins[i[0]] : begins[i[0]] + size[i[0]]]:
                    tie(np.full(size[j[0]], r), order[begins[j[0]] : begins[j[0]] + size[j[0]]])
                continue
            count = size[i] * size[j]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = np.repeat(i, count), np.repeat(j, count)
            tie(order[begins[i] + place // size[j]], order[begins[j] + place % size[j]])
    return label


def joined(rows: DataFrame, radius: float, fits: Fits, key: str, alike: list[str], reach: float) -> DataFrame:
    """(a, b): pairs of rows of one key (an integer) within the radius that fit, or rows that such pairs connect, as many as it
    takes to connect whatever all such pairs connect. Rows that fit differ by at most reach in the columns alike, taken as a
    point, and a row in which any of these is null or not finite fits none. Cubes are as wide as eight radii, but for those
    of more than HELD rows."""
    kind = rows.schema["id"].dataType
    schema_arrow = pa.int64() if kind == LongType() else pa.int32()
    rows = _whole(rows).filter(F.col(key).isNotNull())
    for t in range(4):
        width = 8 * radius / 2**t
        most = rows.groupBy(key, *(F.floor(F.col(a) / width + SHIFT) for a in "xyz")).count().agg(F.max("count")).first()[0]
        if (most or 0) <= HELD:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cube in _groups(batches, [*BLOCK, key]):
            values = {c: table.column(c).to_numpy() for c in table.column_names}
            begins = np.append(np.flatnonzero(np.diff(cube, prepend=-1)), len(cube))
            for begin, end in zip(begins, begins[1:], strict=False):
                if end - begin < 2:
                    continue
                label = _unite(lambda c: values[c][begin:end], end - begin, radius, fits, alike, reach)  # noqa: B023
                ids = values["id"][begin:end]
                linked = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked], schema_arrow), pa.array(ids[label[linked]], schema_arrow)], ["a", "b"])

    return _blocked(rows, rows, width, radius, key=key).mapInArrow(run, StructType([StructField("a", kind), StructField("b", kind)]))


def scans(batches: Iterator[pa.RecordBatch], least: int, most: int) -> Iterator[tuple[pa.Table | None, int | None]]:
    """Tables of whole scans, about `least` rows each or one scan; of a scan that proves larger than `most` rows its number only."""
    held, n, want, past = [], 0, least, None
    for batch in batches:
        if past is not None:
            batch = batch.slice(int(np.searchsorted(batch.column("scan").to_numpy(), past, "right")))
        held.append(batch)
        n += batch.num_rows
        if n < want:
            continue
        table = pa.Table.from_batches(held)
        scan = table.column("scan").to_numpy()
        end = int(np.searchsorted(scan, scan[-1]))  # the last scan may go on
        if end:
            yield table.slice(0, end).combine_chunks(), None
        held, n, want = table.slice(end).to_batches(), table.num_rows - end, max(least, 2 * (table.num_rows - end))
        if n > most:
            past = int(scan[-1])
            yield None, past
            held, n, want = [], 0, least
    if n:
        yield pa.Table.from_batches(held).combine_chunks(), None


def close(scan: np.ndarray, p: np.ndarray, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, later row) of a scan at most tolerance apart, some at a time, each once. Cells are found by a hash; those that
    share one cost time only."""
    fine = np.flatnonzero(np.isfinite(p).all(0))
    cell = np.clip(np.floor(p[:, fine] / (tolerance * 1.000001)), -(2.0**50), 2.0**50).astype(np.int64)
    mixed = lambda d: (((scan[fine] * 1_000_003 + cell[0] + d[0]) * 1_000_003 + cell[1] + d[1]) * 1_000_003 + cell[2] + d[2]) * -7_046_029_254_386_353_131
    with np.errstate(over="ignore"):
        own = mixed((0, 0, 0))
        order = np.argsort(own, kind="stable")
        ordered = own[order]
        for d in itertools.product((-1, 0, 1), repeat=3):
            if d < (0, 0, 0):
                continue
            there = mixed(d)
            low, count = np.searchsorted(ordered, there, "left"), np.searchsorted(ordered, there, "right")
            count -= low
            begin, total = 0, np.cumsum(count)
            while begin < len(fine):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
                each = count[begin:end]
                a = np.repeat(np.arange(begin, end), each)
                b = order[np.arange(each.sum()) + np.repeat(low[begin:end] - np.concatenate(([0], np.cumsum(each)[:-1])), each)]
                a, b = fine[a], fine[b]
                at = tuple(x[a] - x[b] for x in p)
                fine_ = (a < b if d == (0, 0, 0) else a != b) & (scan[a] == scan[b]) & (np.sqrt(at[0] * at[0] + at[1] * at[1] + at[2] * at[2]) <= tolerance)
                yield np.minimum(a, b)[fine_], np.maximum(a, b)[fine_]
                begin = end


def tied(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Gives rows that u and v connect the least label of any of them."""
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            return
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def members(label: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each label that has several, in order."""
    order = np.argsort(label, kind="stable")
    begins = np.flatnonzero(np.concatenate(([len(label) > 0], label[order][1:] != label[order][:-1])))
    for begin, end in zip(begins, np.append(begins, len(label))[1:], strict=True):
        if end - begin > 1:
            yield order[begin:end]
