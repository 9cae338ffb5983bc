"""Gates, throttles and retention: ordered folds whose verdict depends on earlier verdicts.

Each fold is a small class with step(row) -> dict; folded() runs one for each key over its rows in order, as a
stream over sorted partitions, so a key of any length needs no more memory than its state. The streaming
module runs the same classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[], object], schema: str) -> DataFrame:
    """rows with the columns of schema that fold().step(row) gives, key by key in order (a total one)."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for pdf in batches for r in pdf.to_dict("records"))
        out: list[dict] = []
        for _, group in groupby(stream, key=lambda r: tuple(r[k] for k in keys)):
            state = fold()
            for r in group:
                out.append({**r, **state.step(r)})
                if len(out) >= 5000:
                    yield pd.DataFrame(out)
                    out = []
        if out:
            yield pd.DataFrame(out)

    columns = [*rows.columns, *names]
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(lambda it: (p[columns] for p in run(it)), f"{kept}, {schema}")


def _moved(a: dict, b: dict) -> float:
    """The root of the plain sum, as SQL has it: math.dist() rounds once, and is an ulp away at a limit."""
    return math.sqrt((a["px"] - b["px"]) ** 2 + (a["py"] - b["py"]) ** 2 + (a["pz"] - b["pz"]) ** 2)


def _turned(a: dict, b: dict) -> float:
    d = abs(a["yaw"] - b["yaw"]) % 360
    return min(d, 360 - d)


class FrameGate:
    """Accepts or rejects posed frames (ms, px, py, pz, yaw, valid, valid_ratio, median, p95, outliers, steps,
    agreement, duplicates, established, gap, reset). After a jump nothing passes until three steady frames have come and
    the pose is back or agrees with what is established; two jumps or a reset end the scan."""

    SCHEMA = "accepted boolean, reason string, quality double, health string"
    #: Fixed limits: jump and motion as (seconds, metres, m/s, degrees, degrees/s), recovery, depth.
    JUMP, MOTION = (0.75, 0.45, 1.0, 75.0, 180.0), (0.5, 0.35, 2.8, 48.0, 220.0)
    STEADY_FRAMES, STEADY_MOVE, STEADY_TURN, BACK, AGREE, JUMPS = 3, 0.12, 15.0, 0.3, 0.32, 2
    VALID, RATIO, FAR, OUTLIERS, STEPS = 24, 0.08, 20.0, 0.28, 0.72

    def __init__(self):
        self.seen = self.accepted = None
        self.gap = self.quarantine = self.invalid = self.was_reset = False
        self.steady = self.jumps = 0

    def step(self, r: dict) -> dict:
        if r.get("reset"):
            self.invalid = self.quarantine = self.was_reset = True
            self.steady = 0
        before = self.seen
        self.gap = self.gap or bool(r.get("gap"))
        dt = max(0.001, (r["ms"] - before["ms"]) / 1000) if before else 1.0
        move, turn = (_moved(r, before), _turned(r, before)) if before else (0.0, 0.0)
        speed, spin = move / dt, turn / dt
        self.seen = r

        def beyond(limits, timed=True):
            s, m, v, d, w = limits
            return before is not None and (not timed or dt < s) and ((move > m and (speed > v or not timed)) or (turn > d and (spin > w or not timed)))

        lost = self.gap and beyond(self.JUMP, timed=False)
        self.gap = self.gap and not lost
        reason = "none"
        if self.invalid:
            reason = "reference-space-reset" if self.was_reset else "tracking"
        elif lost or beyond(self.JUMP):
            reason, self.quarantine, self.steady, self.jumps = "pose-discontinuity", True, 0, self.jumps + 1
            self.invalid = self.jumps >= self.JUMPS
        elif beyond(self.MOTION):
            reason = "motion"
        elif r["valid"] < self.VALID or r["valid_ratio"] < self.RATIO or not 0 < r["median"] < math.inf or r["p95"] > self.FAR or r["outliers"] > self.OUTLIERS or r["steps"] > self.STEPS:
            reason = "depth"
        elif self.quarantine:
            self.steady = self.steady + 1 if move < self.STEADY_MOVE and turn < self.STEADY_TURN else 0
            back = self.accepted is None or _moved(r, self.accepted) < self.BACK
            if self.steady >= self.STEADY_FRAMES and (back or r["agreement"] >= self.AGREE):
                self.quarantine = False
            else:
                reason = "tracking"
        if reason == "none" and r["established"] >= 32 and r["duplicates"] > 0.58 and r["agreement"] < 0.12:
            reason = "consistency"
        ok = reason == "none"
        if ok:
            self.accepted, self.gap = r, False
        quality = max(0.5, 1 - 0.3 * min(1, speed / 3) - 0.2 * min(1, spin / 240)) if ok else 0.0
        return {"accepted": ok, "reason": reason, "quality": quality, "health": "invalid" if self.invalid else "recovering" if self.quarantine else "healthy"}


class StationaryThrottle:
    """After eight processed rows, skips poses within 12 mm, 1 degree and 700 ms of the last processed one."""

    SCHEMA = "processed boolean"

    def __init__(self, warm: int = 8, move: float = 0.012, turn: float = 1.0, ms: float = 700):
        self.last, self.ticks, self.limits = None, 0, (warm, move, turn, ms)

    def step(self, r: dict) -> dict:
        warm, move, turn, ms = self.limits
        if self.last and self.ticks >= warm and _moved(r, self.last) < move and _turned(r, self.last) < turn and r["ms"] - self.last["ms"] < ms:
            return {"processed": False}
        self.last, self.ticks = r, self.ticks + 1
        return {"processed": True}


class Trajectory:
    """Keeps a pose when 250 ms have passed and it moved 4 cm or turned; distance walked so far, and the points of the
    trail, every second of which goes when there are more than `most`."""

    SCHEMA = "kept boolean, walked double, trail int"

    def __init__(self, ms: float = 250, move: float = 0.04, turn: float = 7.25, most: int = 1024):
        self.points, self.walked, self.limits, self.most = [], 0.0, (ms, move, turn), most

    def step(self, r: dict) -> dict:
        ms, move, turn = self.limits
        last = self.points[-1] if self.points else None
        d = _moved(r, last) if last else 0.0
        kept = last is None or (r["ms"] - last["ms"] >= ms and (d >= move or _turned(r, last) >= turn))
        if kept:
            self.walked += d
            self.points.append(r)
            if len(self.points) > self.most:
                self.points = self.points[::2]
        return {"kept": kept, "walked": self.walked, "trail": len(self.points)}


class TierControl:
    """Sampling tier 0-2: up after 24 fast ticks, down after two slow ones or when the frame interval's moving
    average passes 38 ms. Rows have work_ms and interval_ms."""

    SCHEMA = "tier int, interval_mean double"

    def __init__(self):
        self.tier = self.fast = self.slow = 0
        self.mean = None

    def step(self, r: dict) -> dict:
        dt = r["interval_ms"]
        self.mean = (dt if self.mean is None else self.mean) * 0.9 + min(200.0, dt) * 0.1
        if self.mean > 38:
            self.tier, self.fast = max(0, self.tier - 1), 0
        self.fast = self.fast + 1 if r["work_ms"] < 12 and self.mean < 26 else 0
        self.slow = self.slow + 1 if r["work_ms"] > 26 else 0
        if self.slow >= 2:
            self.tier, self.slow = max(0, self.tier - 1), 0
        if self.fast >= 24:
            self.tier, self.fast = min(2, self.tier + 1), 0
        return {"tier": self.tier, "interval_mean": self.mean}


class Novelty:
    """Accepts a viewpoint 3 cm or 10 degrees away from the last accepted one."""

    SCHEMA = "novel boolean"

    def __init__(self, move: float = 0.03, turn: float = 10.0):
        self.last, self.move, self.turn = None, move, turn

    def step(self, r: dict) -> dict:
        novel = self.last is None or _moved(r, self.last) >= self.move or _turned(r, self.last) >= self.turn
        if novel:
            self.last = r
        return {"novel": novel}


class Retention:
    """Keeps at most `most` frames of a scan. Rows have sequence, ms, position, yaw, phase, cells (array), viewpoint and,
    where tracking has epochs, epoch.

    A frame of another epoch than the first is refused, and one that is redundant: close in time, place and turn to a
    kept frame of its phase, with no cell of its own. A full store gives up its least valuable frame between the first
    and the last, the earliest of equal ones, unless the new one is worth less. A frame is worth 100 for each cell
    that no other kept frame has, 20 for a viewpoint of its own, and up to 20 for its distance in time from its
    neighbours (the new one: from the last). outcome is kept, redundant, refused or less-useful; dropped is what gave way."""

    SCHEMA = "outcome string, dropped long, stored int"

    def __init__(self, most: int = 96, ms: float = 140.0, move: float = 0.025, turn: float = 2.0):
        self.most, self.limits, self.kept, self.epoch = most, (ms, move, turn), [], None
        self.held: dict = {}  # cell -> how many kept frames have it
        self.views: dict = {}

    def _count(self, r: dict, by: int) -> None:
        for counts, keys in ((self.held, set(r["cells"])), (self.views, {r["viewpoint"]})):
            for k in keys:
                counts[k] = counts.get(k, 0) + by
                if not counts[k]:
                    del counts[k]

    def _worth(self, own_cells: int, own_view: bool, gap: float) -> float:
        return 100 * own_cells + 20 * own_view + min(20.0, max(0.0, gap) / 100)

    def value(self, i: int) -> float:
        f = self.kept[i]
        gap = min(f["ms"] - self.kept[i - 1]["ms"], self.kept[i + 1]["ms"] - f["ms"])
        return self._worth(sum(self.held[c] == 1 for c in set(f["cells"])), self.views[f["viewpoint"]] == 1, gap)

    def step(self, r: dict) -> dict:
        said = lambda outcome, dropped=None: {"outcome": outcome, "dropped": dropped, "stored": len(self.kept)}
        self.epoch = r.get("epoch") if self.epoch is None else self.epoch
        if r.get("epoch") != self.epoch:
            return said("refused")
        ms, move, turn = self.limits
        gain = sum(c not in self.held for c in set(r["cells"]))
        if not gain and any(abs(r["ms"] - f["ms"]) < ms and _moved(r, f) < move and _turned(r, f) < turn and r["phase"] == f["phase"] for f in self.kept):
            return said("redundant")
        dropped = None
        if len(self.kept) >= self.most:
            worst = min(range(1, max(2, len(self.kept) - 1)), key=lambda i: (self.value(i), i)) if len(self.kept) > 2 else None
            mine = self._worth(gain, r["viewpoint"] not in self.views, r["ms"] - self.kept[-1]["ms"])
            if worst is None or mine < self.value(worst):
                return said("less-useful")
            gone = self.kept.pop(worst)
            self._count(gone, -1)
            dropped = gone["sequence"]
        self.kept.append(r)
        self._count(r, 1)
        return said("kept", dropped)


class LatestOnly:
    """A queue of one running and one waiting item: a newer one replaces the one that waits. Rows have arrival (ms)
    and work_ms; outcome is run or replaced, known when a later row arrives, so it is that of the row before."""

    SCHEMA = "started_ms double, replaced boolean"

    def __init__(self):
        self.free_at = -math.inf
        self.waiting = None

    def step(self, r: dict) -> dict:
        replaced = False
        if self.waiting is not None and self.free_at <= r["ms"]:
            self.free_at, self.waiting = self.free_at + self.waiting, None
        if self.free_at <= r["ms"]:
            self.free_at = r["ms"] + r["work_ms"]
            return {"started_ms": r["ms"], "replaced": False}
        replaced, self.waiting = self.waiting is not None, r["work_ms"]
        return {"started_ms": self.free_at, "replaced": replaced}
