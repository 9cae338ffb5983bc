"""Coverage mapping as a stream: transformWithState, the map's buckets as map state.

The state of a scan is a map of buckets to cells, one of buckets to regions, and a clock with the rows of the newest
tick. A tick is open until a later one comes, or until a timer (CADENCE_MS, or wait_ms where rows of one tick may come
further apart) without rows closes it: rows of one tick may come in several micro-batches. Rows older than the open tick are late: they are reported as such and change nothing.
Only buckets around a tick's points are read, and only changed ones written. The state store has to be RocksDB.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gridwise.operators.coverage import CADENCE_MS, SCHEMA, Bucket, CoverageMap, framed, plain


class _Stored(MutableMapping):
    """Buckets of a map state, read once and written when flushed."""

    def __init__(self, state):
        self.state, self.known, self.changed = state, {}, set()

    def __getitem__(self, bucket: Bucket) -> list:
        if bucket not in self.known:
            stored = self.state.getValue(bucket) if self.state.containsKey(bucket) else None
            self.known[bucket] = stored and pickle.loads(stored[0])
        if self.known[bucket] is None:
            raise KeyError(bucket)
        return self.known[bucket]

    def __setitem__(self, bucket: Bucket, entries: list) -> None:
        self.known[bucket] = entries
        self.changed.add(bucket)

    def __delitem__(self, bucket: Bucket) -> None:
        raise TypeError("buckets stay")

    def __iter__(self):
        return self.state.keys()

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())

    def flush(self) -> None:
        for bucket in self.changed:
            self.state.updateValue(bucket, (pickle.dumps(self.known[bucket]),))


class CoverageProcessor(StatefulProcessor):
    def __init__(self, order: list[str], names: list[str], columns: int, height: int, wait_ms: int):
        self.order, self.names, self.columns, self.height, self.wait_ms = order, names, columns, height, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "x int, y int, z int", "entries binary")
        self.regions = handle.getMapState("regions", "x int, y int, z int", "entries binary")
        self.clock = handle.getValueState("clock", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, open_ms, closed_ms, held = self._load()
        new = pd.concat(list(rows)).sort_values(["ms", *self.order], kind="stable")
        fold, out = self._fold(last), []
        for ms, part in new.groupby("ms", sort=True):
            part = plain(part)
            if (open_ms is not None and ms < open_ms) or (closed_ms is not None and ms <= closed_ms):
                out += [{**r, "outcome": "late"} for r in part]
                continue
            if open_ms is not None and ms > open_ms:
                out += self._close(fold, held)
                closed_ms, held = open_ms, []
            open_ms, held = ms, held + part
        if open_ms is not None:
            self._set_timer(timerValues)
        self._store(fold, open_ms, closed_ms, held)
        yield framed(out, self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, open_ms, closed_ms, held = self._load()
        out = []
        if open_ms is not None:
            fold = self._fold(last)
            out = self._close(fold, held)
            self._store(fold, None, open_ms, [])
        yield framed(out, self.names)

    def close(self) -> None:
        pass

    def _load(self):
        return pickle.loads(self.clock.get()[0]) if self.clock.exists() else (None, None, None, [])

    def _fold(self, last: float | None) -> CoverageMap:
        return CoverageMap(_Stored(self.cells), _Stored(self.regions), self.columns, self.height, last)

    def _close(self, fold: CoverageMap, held: list[dict]) -> list[dict]:
        held = sorted(held, key=lambda r: tuple(r[c] for c in self.order))
        return [{**r, **o} for r, o in zip(held, fold.tick(held), strict=True)]

    def _store(self, fold: CoverageMap, open_ms, closed_ms, held: list[dict]) -> None:
        fold.cells.flush()
        fold.regions.flush()
        self.clock.update((pickle.dumps((fold.last, open_ms, closed_ms, held)),))

    def _set_timer(self, timerValues) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)


def mapped_stream(rows: DataFrame, order: list[str], columns: int = 16, height: int = 9, wait_ms: int = int(CADENCE_MS)) -> DataFrame:
    """coverage.mapped() of a stream; the outcome of a late row is `late`."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [*rows.columns, *(c.split()[0] for c in SCHEMA.split(", "))]
    return rows.groupBy("scan").transformWithStateInPandas(CoverageProcessor(order, names, columns, height, wait_ms), f"{kept}, {SCHEMA}", "Append", "ProcessingTime")
