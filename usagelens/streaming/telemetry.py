"""Daily totals and activity spans as Structured Streaming, and candidates for an audit as JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000


def daily_totals_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Cost and count per UTC day; rows later than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", "1 day")).agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("cost"), F.count(F.lit(1)).alias("steps")).select(F.col("window.start").alias("day"), "cost", "steps")


#: A span that isn't closed: first and last event, number of events, active time, cost in millionths.
FIRST, LAST, STEPS, ACTIVE, COST = range(5)


def advanced(pending: np.ndarray, span: list[int] | None, upto: int, gap: int) -> tuple[np.ndarray, list[int] | None, list[list[int]]]:
    """(rows still to wait for, the open span, closed spans) once all rows up to ``upto`` are known.

    ``pending`` has rows (time, cost). A gap of ``gap`` or more parts two spans; a shorter one is active time.
    """
    ready = pending[pending[:, 0] <= upto]
    ready = ready[np.argsort(ready[:, 0], kind="stable")]
    closed: list[list[int]] = []
    if len(ready):
        at = ready[:, 0]
        before = np.append(span[LAST] if span else at[0] - gap, at[:-1])
        cuts = np.flatnonzero(at - before >= gap)
        edges = np.unique(np.concatenate([[0], cuts, [len(at)]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if at[a] - before[a] >= gap:
                if span:
                    closed.append(span)
                span = [int(at[a]), int(at[a]), 0, 0, 0]
            span = [span[FIRST], int(at[b - 1]), span[STEPS] + b - a, span[ACTIVE] + int(at[b - 1]) - span[LAST], span[COST] + int(ready[a:b, 1].sum())]
    if span and upto - span[LAST] >= gap:  # whatever comes is later than upto
        closed.append(span)
        span = None
    return pending[pending[:, 0] > upto], span, closed


def activity_spans_stream(events: DataFrame, key: str = "user_id", cost: str = "value", gap_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, steps, active_micros, cost) of each span once it is closed; spans of a key add up to its active time in a batch.

    Gaps under ``gap_seconds`` are active time, one of exactly so long isn't. Rows wait in the state until the watermark passes them, so
    their order of arrival doesn't matter; later ones are dropped by Spark. A timer closes the span of a key that falls silent.
    """
    kind = events.schema[key].dataType.simpleString()
    e = events.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce((F.col(cost).cast("decimal(18,6)") * MICROS).cast("long"), F.lit(0)).alias("cost")).withWatermark("ts", late)
    e = e.withColumn("at", F.unix_micros("ts")).where("key is not null and ts is not null")
    gap = gap_seconds * MICROS

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, span = np.zeros((0, 2), np.int64), None
        if state.exists:
            held, opened = state.get
            pending, span = np.frombuffer(held, np.int64).reshape(-1, 2), np.frombuffer(opened, np.int64).tolist() or None
        pending = np.concatenate([pending, *(f[["at", "cost"]].to_numpy(np.int64) for f in frames)])
        passed = state.getCurrentWatermarkMs()
        pending, span, closed = advanced(pending, span, passed * 1000, gap)
        if len(pending) or span:
            state.update((pending.tobytes(), np.array(span or [], np.int64).tobytes()))
            due = min([*pending[:, 0].tolist(), *([span[LAST] + gap] if span else [])])
            state.setTimeoutTimestamp(max(passed + 1, -(-due // 1000)))
        else:
            state.remove()
        if closed:
            c = np.array(closed, np.int64)
            yield pd.DataFrame({"key": [keys[0]] * len(c), "first": c[:, FIRST], "last": c[:, LAST], "steps": c[:, STEPS], "active_micros": c[:, ACTIVE], "cost": c[:, COST]})

    out = e.groupBy("key").applyInPandasWithState(run, f"key {kind}, first long, last long, steps long, active_micros long, cost long", "pending binary, span binary", "append", GroupStateTimeout.EventTimeTimeout)
    money = (F.col("cost") / MICROS).cast("decimal(18,6)")
    return out.select(F.col("key").alias(key), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "steps", "active_micros", money.alias("cost"))


def candidates_stream(spans: DataFrame, folder: str, checkpoint: str, key: str = "user_id", least_per_minute: float = 0.5, **trigger: object) -> StreamingQuery:
    """Spans dearer than ``least_per_minute`` as JSON lines, a folder for each batch, so that a batch run again after a failure replaces its own lines."""
    minutes = F.col("active_micros") / (60 * MICROS)
    rate = F.round(F.try_divide(F.col("cost").cast("double"), minutes), 6)

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("cost_per_active_minute", rate).where(F.col("cost_per_active_minute") > least_per_minute)
        lines.select(key, "first", "last", "steps", "cost", "cost_per_active_minute").write.mode("overwrite").json(f"{folder}/batch={number}")

    return spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
