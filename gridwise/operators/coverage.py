"""Coverage mapping: which surface a scan has seen, from how many distinct viewpoints.

A tick is a frame's observations. Ticks less than CADENCE after the last one are skipped. Of observations in one grid
place the last counts, of those in one cell of 5 cm the first. Each then finds the nearest compatible cell around it, or
makes one, which joins the nearest compatible region or founds one. A region is counted once a tick and only from a
viewpoint that moved or turned since the last time it was counted; its count makes it observed, partial, captured.

What a tick does depends on all before it, so a scan is a fold; scans run in parallel. The map's cells and regions are
lists by their bucket in space, so that a tick touches the buckets around its points only: in a batch they are held in
memory, in a stream (streaming.coverage) in the state store, bucket by bucket. Limits of a device's memory are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, MutableMapping
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

CADENCE_MS, CELL, REGION = 140.0, 0.05, 0.1
#: Compatible: this near, this near to the plane of the other, normals at most 50 degrees apart.
REACH, PLANE, LEAST_DOT = 0.1, 0.06, math.cos(math.radians(50))
#: A new viewpoint: moved or turned by this much.
MOVED, TURNED = 0.03, math.radians(10)
#: Normals from neighbours in the grid: steps in depth and spans at most.
STEP, SPAN, TINY = 0.4, 0.8, 1e-6
STATES = {1: "observed", 2: "partial", 3: "captured"}

#: What a row of observations has besides its scan, ms and order.
OBSERVATION = ["u", "v", "depth", "x", "y", "z", "cam_x", "cam_y", "cam_z", "dir_x", "dir_y", "dir_z"]
SCHEMA = "outcome string, region string, seen int, transition string"

Vec = tuple[float, float, float]
Bucket = tuple[int, int, int]


def _sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def _dot(a: Vec, b: Vec) -> float:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _unit(a: Vec) -> Vec | None:
    size = math.sqrt(_dot(a, a))
    return (a[0] / size, a[1] / size, a[2] / size) if math.isfinite(size) and size > TINY else None


def _bucket(p: Vec, size: float) -> Bucket:
    return math.floor(p[0] / size), math.floor(p[1] / size), math.floor(p[2] / size)


def _finite(row: dict, names: tuple[str, ...]) -> Vec | None:
    values = tuple(row[n] for n in names)
    return values if all(v is not None and math.isfinite(v) for v in values) else None


def _merged(old: Vec | None, new: Vec | None) -> Vec | None:
    if new is None or old is None:
        return old or new
    sign = -1 if _dot(old, new) < 0 else 1
    return _unit((old[0] + sign * new[0], old[1] + sign * new[1], old[2] + sign * new[2])) or old


def _towards(old: Vec, new: Vec, weight: float) -> Vec:
    d = _sub(new, old)
    return old[0] + d[0] * weight, old[1] + d[1] * weight, old[2] + d[2] * weight


class CoverageMap:
    """The fold. cells and regions map a bucket to a list; a changed list is put back."""

    def __init__(self, cells: MutableMapping[Bucket, list] | None = None, regions: MutableMapping[Bucket, list] | None = None, columns: int = 16, rows: int = 9, last: float | None = None):
        self.cells, self.regions = {} if cells is None else cells, {} if regions is None else regions
        self.columns, self.rows, self.last = columns, rows, last

    def place(self, row: dict) -> int:
        """The grid place of an observation, halves upwards."""
        at = lambda value, n: min(n - 1, max(0, math.floor(value * (n - 1) + 0.5)))
        return at(row["v"], self.rows) * self.columns + at(row["u"], self.columns)

    def tick(self, rows: list[dict]) -> list[dict]:
        """The outcomes of a frame's observations, in their order."""
        out = [dict.fromkeys(("outcome", "region", "seen", "transition")) for _ in rows]
        say = lambda which, outcome: [out[i].update(outcome=outcome) for i in which]
        ms = rows[0]["ms"]
        if self.last is not None and ms - self.last < CADENCE_MS:
            say(range(len(rows)), "between ticks")
            return out
        self.last = ms
        camera = _finite(rows[0], ("cam_x", "cam_y", "cam_z"))
        if camera is None:
            say(range(len(rows)), "no camera")
            return out
        direction = _finite(rows[0], ("dir_x", "dir_y", "dir_z"))
        grid: dict[int, int] = {}
        for i, row in enumerate(rows):
            numbers = _finite(row, ("u", "v", "depth")) and _finite(row, ("x", "y", "z"))
            if not numbers or not (0 <= row["u"] <= 1 and 0 <= row["v"] <= 1 and row["depth"] > 0):
                say([i], "invalid")
                continue
            place = self.place(row)
            if place in grid:
                say([grid[place]], "replaced")
            grid[place] = i
        seen_cells, seen_keys, seen_regions = set(), set(), set()
        for place, i in grid.items():
            point = (rows[i]["x"], rows[i]["y"], rows[i]["z"])
            bucket = _bucket(point, CELL)
            if bucket in seen_cells:
                say([i], "same cell")
                continue
            seen_cells.add(bucket)
            out[i].update(self.observe(point, self.normal(place, grid, rows, camera), camera, direction, seen_keys, seen_regions))
        return out

    def normal(self, place: int, grid: dict[int, int], rows: list[dict], camera: Vec) -> Vec | None:
        """Across the four neighbours in the grid, towards the camera; none at borders, gaps and steps in depth."""
        v, u = divmod(place, self.columns)
        if not (0 < u < self.columns - 1 and 0 < v < self.rows - 1):
            return None
        around = [grid.get(place + d) for d in (-1, 1, -self.columns, self.columns)]
        if None in around:
            return None
        center = rows[grid[place]]
        left, right, up, down = ((rows[i]["x"], rows[i]["y"], rows[i]["z"]) for i in around)
        across, along = _sub(right, left), _sub(down, up)
        if any(abs(rows[i]["depth"] - center["depth"]) > STEP for i in around) or max(_dot(across, across), _dot(along, along)) > SPAN**2:
            return None
        n = _unit((across[1] * along[2] - across[2] * along[1], across[2] * along[0] - across[0] * along[2], across[0] * along[1] - across[1] * along[0]))
        facing = n and _dot(n, _sub(camera, (center["x"], center["y"], center["z"])))
        return (-n[0], -n[1], -n[2]) if n and facing < 0 else n

    @staticmethod
    def nearest(buckets: MutableMapping[Bucket, list], size: float, point: Vec, normal: Vec | None) -> tuple[Bucket, int] | None:
        """The nearest compatible entry of the 27 buckets around a point."""
        x, y, z = _bucket(point, size)
        best, least = None, REACH**2
        for b in ((x + i, y + j, z + k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)):
            for n, entry in enumerate(buckets.get(b, ())):
                delta = _sub(entry["p"], point)
                far = _dot(delta, delta)
                if far >= least:
                    continue
                if entry["n"] is not None and ((normal is not None and _dot(normal, entry["n"]) < LEAST_DOT) or abs(_dot(delta, entry["n"])) > PLANE):
                    continue
                best, least = (b, n), far
        return best

    def observe(self, point: Vec, normal: Vec | None, camera: Vec, direction: Vec | None, seen_keys: set, seen_regions: set) -> dict:
        key = self.nearest(self.cells, CELL, point, normal)
        new = key is None
        founded = False
        if new:
            at = self.nearest(self.regions, REGION, point, normal)
            founded = at is None
            if founded:
                at = self._add(self.regions, _bucket(point, REGION), {"p": point, "n": normal, "count": 1, "cam": camera, "dir": direction})
            key = self._add(self.cells, _bucket(point, CELL), {"p": point, "n": normal, "region": at})
        again = key in seen_keys
        seen_keys.add(key)
        cells = self.cells[key[0]]
        at = cells[key[1]]["region"]
        regions = self.regions[at[0]]
        region = regions[at[1]]
        told = lambda outcome, transition=None: {"outcome": outcome, "region": "{}:{}:{}#{}".format(*at[0], at[1]), "seen": region["count"], "transition": transition}
        if founded:
            seen_regions.add(at)
            return told("founded", "observed")
        if again:
            return told("same surface")
        if at in seen_regions:
            return told("same region")
        seen_regions.add(at)
        before, now = region["dir"] and _unit(region["dir"]), direction and _unit(direction)
        d = _sub(camera, region["cam"])
        turned = before is not None and now is not None and math.acos(max(-1.0, min(1.0, _dot(before, now)))) >= TURNED
        if _dot(d, d) < MOVED**2 and not turned:
            return told("same viewpoint")
        state = STATES[min(3, region["count"])]
        count = region["count"] + 1
        region = {"p": _towards(region["p"], point, 1 / count), "n": _merged(region["n"], normal), "count": count, "cam": camera, "dir": direction}
        regions[at[1]] = region
        self.regions[at[0]] = regions
        cell = cells[key[1]]
        cells[key[1]] = {"p": _towards(cell["p"], point, 1 / count), "n": _merged(cell["n"], normal), "region": at}
        self.cells[key[0]] = cells
        after = STATES[min(3, count)]
        return told("counted in a new cell" if new else "counted", after if after != state else None)

    @staticmethod
    def _add(buckets: MutableMapping[Bucket, list], bucket: Bucket, entry: dict) -> tuple[Bucket, int]:
        entries = buckets.get(bucket) or []
        entries.append(entry)
        buckets[bucket] = entries
        return bucket, len(entries) - 1


def mapped(rows: DataFrame, order: list[str], columns: int = 16, height: int = 9) -> DataFrame:
    """rows(scan, ms, observation) with what became of each, its region, the region's count and a transition of its state.
    Rows of equal scan and ms are a tick; order, a total one within it, is their order."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [*rows.columns, *(c.split()[0] for c in SCHEMA.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for pdf in batches for r in plain(pdf))
        out: list[dict] = []
        for _, scan in groupby(stream, key=lambda r: r["scan"]):
            fold = CoverageMap(columns=columns, rows=height)
            for _, tick in groupby(scan, key=lambda r: r["ms"]):
                tick = list(tick)
                out += [{**r, **o} for r, o in zip(tick, fold.tick(tick), strict=True)]
                if len(out) >= 5000:
                    yield framed(out, names)
                    out = []
        if out:
            yield framed(out, names)

    return rows.repartition("scan").sortWithinPartitions("scan", "ms", *order).mapInPandas(run, f"{kept}, {SCHEMA}")


def plain(pdf: pd.DataFrame) -> list[dict]:
    """Rows with None for what is missing."""
    return pdf.astype(object).where(pdf.notna(), None).to_dict("records")


def framed(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def regions_of(outcomes: DataFrame) -> DataFrame:
    """(scan, region, seen, state, first_ms, last_ms) of all regions, from the rows that founded or counted them."""
    from pyspark.sql import functions as F

    known = outcomes.filter("outcome in ('founded', 'counted', 'counted in a new cell')")
    out = known.groupBy("scan", "region").agg(F.max("seen").alias("seen"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"))
    state = F.element_at(F.create_map(*(F.lit(x) for item in STATES.items() for x in item)), F.least("seen", F.lit(3)))
    return out.withColumn("state", state)
