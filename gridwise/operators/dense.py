"""Dense live fusion: measurements of frames fused into samples with colours and a ledger of views.

An ordered fold for each scan, as in fusion.py: where a measurement goes depends on where samples lie by then. A scan is
one task that holds its samples; scans are independent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gridwise.functions.colour import linear_to_srgb, srgb_to_linear
from gridwise.functions.rules import dense_confidence
from gridwise.operators.fusion import Vector, _around, _cell, _dot, _less, _unit

#: Match, colours, views, stability, established neighbours.
MERGE, PLANE, DOT, AGAIN, RECLAIM_MS = 0.034, 0.014, math.cos(math.radians(40)), 0.010, 8_000.0
MOST_WEIGHT, OUTLIER_SEEN, OUTLIER = 16.0, 3, 0.5
NEW_VIEW, STRONG_VIEW, WIDE_VIEW, TURN = 0.06, 0.15, 0.30, math.radians(2.5)
STABLE_CELL, STABLE_LEAST = 0.10, 32
DENSE = "scan long, sample long, x double, y double, z double, nx double, ny double, nz double, r double, g double, b double, colour_weight double, coloured int, seen int, views int, first_ms double, last_ms double, tracking double, stable boolean, duplicate boolean"


def view_bits(bits: int, baseline: float, angle: float) -> int:
    """The ledger of views after one at this distance and angle from the first (which is bit 1)."""
    if (baseline >= NEW_VIEW and angle >= TURN) or baseline >= STRONG_VIEW:
        bits |= 2
    return bits | 4 if baseline >= WIDE_VIEW and angle >= 2 * TURN else bits


class DenseFusion:
    """The samples of one scan. Rows have id, ms, frame, position, normal, linear colour r, g, b (null: none), camera cx, cy,
    cz and tracking. A sample takes a measurement of a frame once. most limits the samples; where it is reached, one that was
    seen once and idle for RECLAIM_MS makes room, else the measurement is rejected."""

    def __init__(self, most: int | None = None):
        self.samples: dict[int, dict] = {}
        self.grid: dict = {}
        self.firm: dict = {}
        self.most, self.made, self.stable = most, 0, 0
        self.counts = {"created": 0, "fused": 0, "same-frame": 0, "rejected": 0, "reclaimed": 0}

    def _link(self, i: int) -> None:
        q = self.samples[i]
        q["cell"] = _cell(q["p"], MERGE)
        self.grid.setdefault(q["cell"], []).append(i)

    def _unlink(self, i: int) -> None:
        here = self.grid[self.samples[i]["cell"]]
        here.remove(i)
        if not here:
            del self.grid[self.samples[i]["cell"]]

    def relation(self, p: Vector, n: Vector) -> int:
        """Of a point to stable samples: 1 consistent, 2 beside a parallel one, 0 unknown."""
        if self.stable < STABLE_LEAST:
            return 0
        found = 0
        for i in _around(self.firm, _cell(p, STABLE_CELL), 2):
            q = self.samples.get(i)
            if q is None or not q["stable"]:
                continue
            d = _less(p, q["p"])
            far, dot = math.hypot(*d), abs(_dot(n, q["n"]))
            if far <= 0.035 and dot >= 0.8:
                return 1
            if far <= 0.12 and abs(_dot(d, q["n"])) >= 0.028 and dot >= 0.94:
                found = 2
        return found

    def _saw(self, q: dict, camera: Vector | None) -> None:
        if camera is None:
            return
        ray = _less(camera, q["p"])
        if math.hypot(*ray) <= 1e-9:
            return
        if not q["bits"]:  # the first view is kept in centimetres and 127ths
            q["camera"], q["view"], q["bits"] = tuple(round(c * 100) / 100 for c in camera), tuple(round(v * 127) / 127 for v in _unit(ray)), 1
            return
        baseline = math.dist(camera, q["camera"])
        q["bits"] = view_bits(q["bits"], baseline, math.acos(max(-1.0, min(1.0, _dot(_unit(ray), q["view"])))))

    def _fuse(self, i: int, far: float, p: Vector, n: Vector, colour: Vector | None, camera: Vector | None, r: dict) -> None:
        q = self.samples[i]
        weight = max(0.4, min(1.0, 1 - far / MERGE))
        if camera is not None:
            weight *= 0.35 + 0.65 * min(1.0, abs(_dot(q["n"], _unit(_less(camera, q["p"])))))
        if colour is not None and q["coloured"] >= OUTLIER_SEEN and q["weight"] > 0:
            off = math.dist(colour, q["c"])
            weight = (weight * 0.1 if weight * 0.1 >= 0.08 else 0.0) if off > OUTLIER else weight * max(0.7, min(1.0, 1 - off * 0.45))
        if colour is None:
            weight = 0.0
        bounded = max(0.05, weight)
        blend = bounded / (q["weight"] + bounded)
        n = n if _dot(n, q["n"]) >= 0 else (-n[0], -n[1], -n[2])
        d = _less(p, q["p"])
        q["far2"] += far * far
        q["off2"] += _dot(d, q["n"]) ** 2
        q["turn2"] += (1 - max(-1.0, min(1.0, _dot(n, q["n"])))) ** 2
        q["tracking"] += r["tracking"]
        self._unlink(i)
        w = 1 / min(16, q["seen"] + 1)
        q["p"] = tuple(a + (b - a) * w for a, b in zip(q["p"], p, strict=True))
        q["n"] = _unit(tuple(a + (b - a) * w for a, b in zip(q["n"], n, strict=True)))
        self._link(i)
        if weight > 0:
            q["c"] = tuple(a + (b - a) * blend for a, b in zip(q["c"], colour, strict=True))
            q["weight"], q["coloured"] = min(MOST_WEIGHT, q["weight"] + bounded), q["coloured"] + 1
        q["seen"], q["last"] = q["seen"] + 1, r["ms"]
        self._settle(i)

    def _settle(self, i: int) -> None:
        q = self.samples[i]
        n, span = max(1, q["seen"] - 1), q["last"] - q["first"]
        steady = q["seen"] >= 3 and span >= 250 and q["tracking"] / q["seen"] >= 0.55 and math.sqrt(q["far2"] / n) <= 0.018 and math.sqrt(q["off2"] / n) <= 0.012 and math.sqrt(q["turn2"] / n) <= 0.18
        now = steady and (not q["duplicate"] or (q["bits"].bit_count() >= 2 and span >= 600))
        if now and not q["stable"]:
            key = _cell(q["p"], STABLE_CELL)
            if i not in self.firm.get(key, ()):
                self.firm.setdefault(key, []).append(i)
        self.stable += now - q["stable"]
        q["stable"] = now

    def step(self, r: dict) -> str:
        """What became of a measurement: fused, same-frame, created or rejected."""
        outcome = self._step(r)
        self.counts[outcome] += 1
        return outcome

    def _step(self, r: dict) -> str:
        p, n = (r["x"], r["y"], r["z"]), (r["nx"], r["ny"], r["nz"])
        colour = None if r["r"] is None or r["r"] != r["r"] else (r["r"], r["g"], r["b"])
        camera = None if r["cx"] is None or r["cx"] != r["cx"] else (r["cx"], r["cy"], r["cz"])
        best, nearest = None, (math.inf, 0)
        for i in _around(self.grid, _cell(p, MERGE), 1):
            q = self.samples[i]
            d = _less(p, q["p"])
            d2 = _dot(d, d)
            if d2 > MERGE * MERGE or (q["frame"] == r["frame"] and d2 > AGAIN * AGAIN) or abs(_dot(n, q["n"])) < DOT or abs(_dot(d, q["n"])) > PLANE:
                continue
            if (math.sqrt(d2), i) < nearest:
                best, nearest = i, (math.sqrt(d2), i)
        if best is not None:
            q = self.samples[best]
            self._saw(q, camera)  # from where the sample lies so far, also by a repeated measurement of a frame
            if q["frame"] == r["frame"]:
                return "same-frame"
            q["frame"] = r["frame"]
            self._fuse(best, nearest[0], p, n, colour, camera, r)
            return "fused"
        if self.most is not None and len(self.samples) >= self.most:
            idle = next((i for i, q in self.samples.items() if q["seen"] < 2 and r["ms"] - q["last"] > RECLAIM_MS), None)
            if idle is None:
                return "rejected"
            self._unlink(idle)
            del self.samples[idle]
            self.counts["reclaimed"] += 1
        i, self.made = self.made, self.made + 1
        self.samples[i] = {
            "p": p, "n": n, "c": colour or (0.0, 0.0, 0.0), "weight": 1.0 if colour else 0.0, "coloured": 1 if colour else 0, "seen": 1, "bits": 0, "frame": r["frame"], "first": r["ms"], "last": r["ms"],
            "tracking": r["tracking"], "far2": 0.0, "off2": 0.0, "turn2": 0.0, "stable": False, "duplicate": self.relation(p, n) == 2,
        }
        self._link(i)
        self._saw(self.samples[i], camera)
        return "created"

    def rows(self, scan) -> Iterator[tuple]:
        for i, q in self.samples.items():
            yield (scan, i, *q["p"], *q["n"], *q["c"], q["weight"], q["coloured"], q["seen"], q["bits"].bit_count(), float(q["first"]), float(q["last"]), q["tracking"] / q["seen"], q["stable"], q["duplicate"])


def dense(measurements: DataFrame, order: list[str], most: int | None = None) -> DataFrame:
    """The samples (DENSE) of measurements(scan, id, ms, frame, position, normal, r, g, b, cx, cy, cz, tracking), fused scan by
    scan in order. Colours are sRGB in and out, and compared and blended as linear ones."""
    names = [c.split()[0] for c in DENSE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for pdf in batches for r in pdf.to_dict("records"))
        for scan, group in groupby(stream, key=lambda r: r["scan"]):
            state, out = DenseFusion(most), []
            for r in group:
                state.step(r)
            for row in state.rows(scan):
                out.append(row)
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    linear = measurements.withColumns({c: srgb_to_linear(c) for c in "rgb"})
    fused = linear.repartition("scan").sortWithinPartitions("scan", *order).mapInPandas(run, DENSE)
    return fused.withColumns({c: linear_to_srgb(c) for c in "rgb"})


def dense_snapshot(samples: DataFrame) -> DataFrame:
    """dense() samples with what a finished scan says of them: all are raw, those seen twice or more are final, with their
    confidence, and coloured ones have a colour."""
    colour: Column = F.col("coloured") > 0
    confidence = dense_confidence(F.col("seen"), F.col("views"), F.col("tracking"), F.col("last_ms") - F.col("first_ms"))
    return samples.withColumns({"final": F.col("seen") >= 2, "has_colour": colour, "confidence": confidence})
