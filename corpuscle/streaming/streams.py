"""Structured Streaming: windowed counts, sessions, admission in line, and tables kept up to date by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def window_counts(events: DataFrame, by: Sequence[str], every: str, late: str, ts: str = "ts") -> DataFrame:
    """Rows in each window of time; rows later than ``late`` behind the newest may be left out, so state stays bounded."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), *by).agg(F.count("*").alias("n")).select(F.unix_seconds("window.start").alias("starts"), *by, "n")


def session_counts(events: DataFrame, key: str, gap: str, late: str, ts: str = "ts") -> DataFrame:
    """Rows in each session of a key; a session ends after ``gap`` without a row."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, key: str, within: str, ts: str = "ts") -> DataFrame:
    """Rows without repeats of a key that come within the given time."""
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def admitted(calls: DataFrame, key: str, calls_most: int, seconds: int) -> DataFrame:
    """When each call (key, event_id, t in microseconds) may start: the state of a key is its last ``calls_most`` starts."""
    period = seconds * 1_000_000

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"], kind="stable")
        out = []
        for at in rows["t"].tolist():
            out.append(max(at, starts[0] + period) if len(starts) == calls_most else at)
            starts = [*starts, out[-1]][-calls_most:]
        state.update((starts,))
        yield rows.assign(**{key: k[0], "starts": out})[[key, "event_id", "t", "starts"]]

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, t long, starts long", "starts array<long>", "update", GroupStateTimeout.NoTimeout)


class _Tail(StatefulProcessor):
    """The last rows of a key, in a list; a key that has been idle for its time to live loses them."""

    def __init__(self, key: str, most: int, idle: int | None):
        self.key, self.most, self.idle = key, most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "t long, event_id long, event_type string")
        self.shown = handle.getValueState("shown", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.rows.get()]
        for frame in rows:  # a batch may be of any length: what is not among the last rows goes frame by frame
            own = frame[["t", "event_id", "event_type"]].itertuples(index=False, name=None)
            kept = sorted([*kept, *own], key=lambda r: (r[0], r[1], r[2] or ""))[-self.most :]
        self.rows.put(kept)
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer((kept[-1][0] + self.idle) // 1_000 + 1)
        yield self._shown(key, kept)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield self._shown(key, [])
        self.shown.clear()

    def _shown(self, key: tuple, kept: list[tuple]) -> pd.DataFrame:
        """One row for each slot that holds a row or held one, so that a table kept up by slot shows no stale one."""
        held = self.shown.get()[0] if self.shown.exists() else 0
        if self.idle is not None:
            pauses = [i for i in range(1, len(kept)) if kept[i][0] - kept[i - 1][0] > self.idle]
            kept = kept[pauses[-1] :] if pauses else kept
        self.shown.update((len(kept),))
        slots = [(i, *row) for i, row in enumerate(kept)] + [(i, None, None, None) for i in range(len(kept), held)]
        out = pd.DataFrame(slots, columns=["slot", "t", "event_id", "event_type"]).astype({"slot": "int32", "t": "Int64", "event_id": "Int64"})
        out.insert(0, self.key, key[0])
        return out

    def close(self) -> None:
        pass


def tail(rows: DataFrame, key: str, most: int, idle_seconds: int | None = None) -> DataFrame:
    """``(key, slot, t, event_id, event_type)``: the last ``most`` rows of each key (key, t in microseconds, event_id, event_type).

    The state of a key is a list of at most so many rows. With ``idle_seconds`` the rows are those since the last pause longer
    than that, and the list goes when event time (the column ts, under a watermark) has passed so far beyond its last row.
    A slot that no longer holds a row is given with nulls. Rows may come in any order, in one batch or in many; those without
    time or event_id take no part, and a null key is a key. Needs :func:`with_state`.
    """
    micros = None if idle_seconds is None else idle_seconds * 1_000_000
    kind = rows.schema[key].dataType.simpleString()
    mode = "None" if micros is None else "EventTime"
    return rows.dropna(subset=["t", "event_id"]).groupBy(key).transformWithStateInPandas(_Tail(key, most, micros), f"{key} {kind}, slot int, t long, event_id long, event_type string", "Update", mode)


@contextmanager
def with_state(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that lists and timers need, and as it was afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def keep_up(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write each batch of changed rows to its own part of a table and stop at the end of the input.

    A batch that runs again after a failure overwrites its own part, so nothing is doubled. :func:`current` reads the table.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The latest row of each key of a table that :func:`keep_up` wrote."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    order = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "batch")
