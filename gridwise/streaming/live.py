"""Live capture as Structured Streaming: the batch folds as stateful processors.

Each key's state is one fold object, kept with the stream's checkpoint. Rows of a micro-batch are taken in order of
their time and number; a row older than the key's last one is late and reported as such, not folded.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def folded_stream(rows: DataFrame, key: str, order: list[str], fold: Callable[[], object], schema: str, idle_ms: int | None = None) -> DataFrame:
    """A stream's rows with the fold's columns and `late`. With idle_ms, a key's state goes after that long without rows."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [x.split()[0] for x in schema.split(", ")]
    columns = [*rows.columns, *names, "late"]

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        inner, last = pickle.loads(state.get[0]) if state.exists else (fold(), None)
        pdf = pd.concat(list(batches)).sort_values(order)
        out = []
        for r in pdf.to_dict("records"):
            at = tuple(r[c] for c in order)
            late = last is not None and at < last
            out.append({**r, **(dict.fromkeys(names) if late else inner.step(r)), "late": late})
            last = last if late else at
        state.update((pickle.dumps((inner, last)),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, f"{kept}, {schema}, late boolean", "fold binary", "append", timeout)


def latest_coverage(samples: DataFrame, size: float, time: str, delay: str) -> DataFrame:
    """Counts of a stream's samples by scan, cell and tumbling ten-second window; rows later than `delay` are left out.
    An extension: the workload itself has no event-time windows."""
    from gridwise.functions.numeric import cells

    placed = samples.withWatermark(time, delay).select("scan", time, *cells(size))
    return placed.groupBy("scan", F.window(time, "10 seconds"), "cx", "cy", "cz").agg(F.count("*").alias("samples"))
