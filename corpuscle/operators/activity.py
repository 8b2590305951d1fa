"""Logs of calls, tasks and sessions as batch queries: admission times, sessions, last states, tails, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def admitted(calls: DataFrame, key: str, calls_most: int, seconds: int, at: str = "t", order: str = "event_id") -> DataFrame:
    """When each call may start if at most ``calls_most`` may start in any ``seconds``: callers wait in line.

    Call n starts at its own time or a period after call n - calls_most, whichever is later. Unrolled over every
    calls_most-th call, that is a running maximum, so a window does it without going call by call.
    """
    period, line = seconds * 1_000_000, Window.partitionBy(key).orderBy(at, order)
    numbered = calls.withColumn("__n", F.row_number().over(line) - 1).withColumn("__turn", F.floor(F.col("__n") / calls_most)).withColumn("__lane", F.col("__n") % calls_most)
    so_far = Window.partitionBy(key, "__lane").orderBy("__turn").rowsBetween(Window.unboundedPreceding, 0)
    start = F.max(F.col(at) - F.col("__turn") * period).over(so_far) + F.col("__turn") * period
    return numbered.withColumn("starts", start.cast("long")).drop("__n", "__turn", "__lane")


def sessions(rows: DataFrame, key: str, ttl_seconds: int, at: str = "t") -> DataFrame:
    """Runs of a key's rows with no gap longer than the time to live; ``evicted`` if the key came back in a new one."""
    line = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(line) > ttl_seconds * 1_000_000).cast("int"), F.lit(0))
    runs = rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(line.rangeBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "session").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return out.withColumn("evicted", F.lead("session").over(Window.partitionBy(key).orderBy("session")).isNotNull())


def last_states(rows: DataFrame, key: str, state: str, at: str = "t", order: str = "event_id") -> DataFrame:
    """The last state of each task and the number of its changes."""
    return rows.groupBy(key).agg(F.max_by(state, F.struct(at, order)).alias(state), F.max(at).alias("last"), F.count("*").alias("n"))


def lifecycle(rows: DataFrame, key: str, state: str, now: int, ttl_seconds: int, restarted: int | None = None, running: Sequence[str] = ("running", "pending"), at: str = "t", order: str = "event_id") -> DataFrame:
    """Tasks as a registry shows them: the last state of each that changed within its time to live.

    What was running when the process restarted is interrupted. Times are in microseconds.
    """
    last = last_states(rows, key, state, at, order)
    cut = F.lit(False) if restarted is None else F.col(state).isin(*running) & (F.col("last") < restarted)
    return last.where(F.col("last") >= now - ttl_seconds * 1_000_000).withColumn(state, F.when(cut, "interrupted").otherwise(F.col(state)))


def tail(rows: DataFrame, key: str, most: int, at: str = "t", order: str = "event_id") -> DataFrame:
    """The last rows of each key, as a bounded log keeps them."""
    line = Window.partitionBy(key).orderBy(F.desc(at), F.desc(order))
    return rows.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= most).drop("__n")


def counters(rows: DataFrame, by: str, flag: Column) -> DataFrame:
    """Number of rows, of those with the flag, and their share."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.round(F.count_if(flag) / F.count("*"), 6).alias("ratio"))


def histogram(rows: DataFrame, by: str, value: str, bounds: Sequence[int]) -> DataFrame:
    """For each bound the number of values up to it."""
    wide = rows.groupBy(by).agg(*(F.count_if(F.col(value) <= b).alias(str(b)) for b in bounds))
    return wide.unpivot([by], [str(b) for b in bounds], "bound", "n")


def percentiles(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """The value below which a share of each group's values lies, interpolated."""
    return rows.groupBy(by).agg(F.round(F.percentile(value, share), 6).alias("breakpoint"))


def outcomes(rows: DataFrame, by: str) -> DataFrame:
    """Number of files that went well and that failed, and the first failure."""
    failed = F.col("error").isNotNull()
    return rows.groupBy(by).agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"), F.min_by("error", F.when(failed, F.col("pos"))).alias("first_failure"))
