"""Streams over the same transforms as batches, and keyed state with a time to live."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.job_watcher import DAY_MS, cleanup


def metric_rollup(events: DataFrame, time: str, keys: list[str], value: str, *, window: str = "1 hour", late: str = "10 seconds") -> DataFrame:
    """sum, min, max, count by window and keys; rows later than the watermark are dropped."""
    rows = events.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("window"), *keys).agg(F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))


def job_signals(raw: DataFrame) -> DataFrame:
    """Raw topics to cleaned signals; stateless, so it streams as it is."""
    return cleanup(raw)


def _timeout(ttl_ms: int | None) -> str:
    """Without a time to live, a drained stream ends; with one, Spark goes on with empty micro-batches to let states go."""
    return GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def latest_by_key(rows: DataFrame, key: str, time: str, value: str, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """key, last_updated, value, n: a state for each key, dropped when not updated for ttl_ms of processing time."""

    def update(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held, n = state.get if state.exists else (None, None, 0)
        for frame in frames:
            top = frame.sort_values(time, kind="stable").iloc[-1]
            n += len(frame)
            if last is None or top[time] >= last:
                last, held = int(top[time]), str(top[value])
        state.update((last, held, n))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [own[0]], "last_updated": [last], "value": [held], "n": [n]})

    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(time).cast("long").alias(time), F.col(value).cast("string").alias(value))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, last_updated long, value string, n long", "last_updated long, value string, n long", "update", _timeout(ttl_ms))


#: The values of an application's state.
SIGNALS = ("cluster", "job_id", "job_name", "user")


def app_states(signals: DataFrame, ttl_ms: int | None = DAY_MS) -> DataFrame:
    """app, the first known value of each signal by (timestamp, id), last_updated: the rules of job_watcher.app_state as
    keyed state, which goes when it is not updated for ttl_ms of processing time."""
    held = "last long, " + ", ".join(f"{c} string, {c}_at long, {c}_id long" for c in SIGNALS)

    def update(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else (None,) * (1 + 3 * len(SIGNALS))
        last, best = old[0], {c: old[1 + 3 * i : 4 + 3 * i] for i, c in enumerate(SIGNALS)}
        for frame in frames:
            for t, n, *values in zip(frame["timestamp"].tolist(), frame["id"].tolist(), *(frame[c].tolist() for c in SIGNALS), strict=True):
                last = t if last is None else max(last, t)
                for c, v in zip(SIGNALS, values, strict=True):
                    if v is not None and (best[c][1] is None or (t, n) < tuple(best[c][1:])):
                        best[c] = (v, t, n)
        state.update((last, *(x for c in SIGNALS for x in best[c])))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"app": [own[0]], **{c: [best[c][0]] for c in SIGNALS}, "last_updated": [last]})

    rows = signals.select(F.lower("app").alias("app"), "timestamp", "id", *SIGNALS)
    out = "app string, " + ", ".join(f"{c} string" for c in SIGNALS) + ", last_updated long"
    return rows.groupBy("app").applyInPandasWithState(update, out, held, "update", _timeout(ttl_ms))


def line_buffer(lines: DataFrame, group: str, line: str, size: int = 250) -> DataFrame:
    """key, lines, n: `size` lines at a time, joined by newlines; fewer wait in checkpointed state for the next micro-batch."""

    def update(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(state.get[0]) if state.exists else []
        for frame in frames:
            waiting += frame["line"].tolist()
            full = len(waiting) // size * size
            if full:
                yield pd.DataFrame({"key": [own[0]] * (full // size), "lines": ["\n".join(waiting[i : i + size]) for i in range(0, full, size)], "n": [size] * (full // size)})
            waiting = waiting[full:]
        state.update((waiting,))

    rows = lines.select(F.col(group).cast("string").alias("key"), F.col(line).alias("line"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, lines string, n long", "waiting array<string>", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Processes what there is now in micro-batches, with the sink called for each, and stops."""
    return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rows_per_second(query: StreamingQuery) -> list[float]:
    return [p["processedRowsPerSecond"] for p in query.recentProgress if p.get("processedRowsPerSecond")]
