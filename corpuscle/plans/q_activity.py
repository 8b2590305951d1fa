"""Queries over logs of events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import activity
from corpuscle.sources import chunks as store
from corpuscle.sources.chunks import CHUNKS_SQL as C
from corpuscle.sources.shared import new_folder
from corpuscle.streaming import streams

from .registry import query, table

CALLS, PERIOD, TTL = 2, 3600, 1800
#: Seconds that events may come late.
LATE = 3600


def calls(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "value", activity.micros().alias("t"))


_AT = "(SELECT *, epoch_us(ts) AS t FROM events)"
_RATE = f"""WITH n AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM {_AT})
 SELECT user_id, event_id, t, CAST(max(t - (i // {CALLS}) * {PERIOD}000000) OVER (PARTITION BY user_id, i % {CALLS} ORDER BY i) + (i // {CALLS}) * {PERIOD}000000 AS BIGINT) AS starts FROM n"""


@query("rate_limit", _RATE)
def rate_limit(spark, d):
    return activity.admitted(calls(spark, d), "user_id", CALLS, PERIOD).select("user_id", "event_id", "t", "starts")


@query("session_ttl", f"SELECT user_id, CAST(session AS BIGINT) AS session, min(t) AS first, max(t) AS last, count(*) AS n, lead(session) OVER (PARTITION BY user_id ORDER BY session) IS NOT NULL AS evicted FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) session FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {TTL}000000, false)::INTEGER new FROM {_AT})) GROUP BY user_id, session")
def session_ttl(spark, d):
    return activity.sessions(calls(spark, d), "user_id", TTL)


@query("task_state", f"SELECT user_id, event_type, t AS last, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) k, count(*) OVER (PARTITION BY user_id) n FROM {_AT}) WHERE k = 1")
def task_state(spark, d):
    return activity.last_states(calls(spark, d), "user_id", "event_type")


@query("task_lifecycle", f"WITH b AS (SELECT max(t) hi, min(t) lo FROM {_AT}) SELECT user_id, CASE WHEN event_type IN ('click', 'view') AND t < (hi + lo) // 2 + (hi - lo) // 4 THEN 'interrupted' ELSE event_type END AS event_type, t AS last, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) k, count(*) OVER (PARTITION BY user_id) n FROM {_AT}), b WHERE k = 1 AND t >= hi - 10 * 86400000000")
def task_lifecycle(spark, d):
    own = calls(spark, d)
    ends = own.agg(F.max("t").alias("hi"), F.min("t").alias("lo")).first()
    restarted = (ends["hi"] + ends["lo"]) // 2 + (ends["hi"] - ends["lo"]) // 4
    return activity.lifecycle(own, "user_id", "event_type", ends["hi"], 10 * 86_400, restarted, ("click", "view"))


@query("log_tail", f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) k FROM {_AT}) WHERE k <= 5")
def log_tail(spark, d):
    return activity.tail(calls(spark, d), "user_id", 5).select("user_id", "event_id", "event_type")


@query("router_metrics", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS flagged, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS ratio FROM events GROUP BY event_type")
def router_metrics(spark, d):
    return activity.counters(calls(spark, d), "event_type", F.col("value") > 50)


@query("latency_histogram", " UNION ALL ".join(f"SELECT event_type, '{b}' AS bound, count(*) FILTER (WHERE value <= {b}) AS n FROM events GROUP BY event_type" for b in (5, 10, 50, 100)))
def latency_histogram(spark, d):
    return activity.histogram(calls(spark, d), "event_type", "value", (5, 10, 50, 100))


@query("breakpoint_pct", "SELECT event_type, round(quantile_cont(value, 0.85), 6) AS breakpoint FROM events GROUP BY event_type")
def breakpoint_pct(spark, d):
    return activity.percentiles(calls(spark, d), "event_type", "value", 0.85)


@query("ingest_summary", "SELECT user_id AS task_id, count(*) FILTER (WHERE NOT coalesce(value < 20, false)) AS ok, count(*) FILTER (WHERE value < 20) AS failed, arg_min(event_type || ' failed', event_id) FILTER (WHERE value < 20) AS first_failure FROM events GROUP BY user_id")
def ingest_summary(spark, d):
    """Events as files of a user's task: one with a small value has failed."""
    error = F.when(F.col("value") < 20, F.concat("event_type", F.lit(" failed")))
    return activity.outcomes(calls(spark, d).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("pos"), error.alias("error")), "task_id")


def streamed(spark, d, name: str):
    """A driver table as a stream; the pattern in the path lets a single file be one."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}?.parquet")


def finished(spark, stream, name: str, keys: list[str], mode: str = "update"):
    """Run a stream to the end of its input and read what it has kept up."""
    folder = new_folder(spark, name)
    streams.keep_up(stream, f"{folder}/table", f"{folder}/checkpoint", mode).awaitTermination()
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    return streams.current(spark, f"{folder}/table", columns, keys)


@query("stream_window_counts", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS starts, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    events = streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return finished(spark, streams.window_counts(events, ["event_type"], "1 hour", "30 days"), "windows", ["starts", "event_type"])


@query("stream_rate_limit", _RATE)
def stream_rate_limit(spark, d):
    events = streamed(spark, d, "events").select("user_id", "event_id", activity.micros().alias("t"))
    return finished(spark, streams.admitted(events, "user_id", CALLS, PERIOD), "admitted", ["user_id", "event_id"])


@query("stream_upsert_chunks", f"WITH {C} SELECT pk, doc_id, type, content FROM chunks")
def stream_upsert_chunks(spark, d):
    return finished(spark, store.from_documents(streamed(spark, d, "documents")).select("pk", "doc_id", "type", "content"), "chunks", ["pk"])


@query("stream_log_tail", f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) k FROM {_AT}) WHERE k <= 5")
def stream_log_tail(spark, d):
    events = streamed(spark, d, "events").select("user_id", "event_id", "event_type", activity.micros().alias("t"))
    with streams.with_state(spark):
        kept = finished(spark, streams.tail(events, "user_id", 5), "tail", ["user_id", "slot"])
    return kept.where("t IS NOT NULL").select("user_id", "event_id", "event_type")


@query("stream_idle_tail", f"WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) session FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {TTL}000000, false)::INTEGER new FROM {_AT})), l AS (SELECT *, max(session) OVER (PARTITION BY user_id) AS newest, max(t) OVER () AS hi FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) k, max(t) OVER (PARTITION BY user_id) last FROM l WHERE session = newest) SELECT user_id, event_id, event_type FROM k WHERE k <= 5 AND last + {TTL}000000 >= hi - {LATE}000000")
def stream_idle_tail(spark, d):
    events = streamed(spark, d, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), activity.micros().alias("t"))
    with streams.with_state(spark):
        kept = finished(spark, streams.tail(events.withWatermark("ts", f"{LATE} seconds"), "user_id", 5, TTL), "idle", ["user_id", "slot"])
    return kept.where("t IS NOT NULL").select("user_id", "event_id", "event_type")


@query("stream_sessions", f"WITH s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) session FROM (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {TTL}000000, false)::INTEGER new FROM {_AT})) SELECT user_id, min(t) AS first, count(*) AS n FROM s GROUP BY user_id, session HAVING max(t) + {TTL}000000 < (SELECT max(t) FROM {_AT}) - {LATE}000000")
def stream_sessions(spark, d):
    """Sessions that have ended: a later event of the key can no longer come."""
    events = streamed(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    ended = streams.session_counts(events, "user_id", f"{TTL} seconds 1 microsecond", f"{LATE} seconds").select("user_id", F.unix_micros("session_window.start").alias("first"), "n")
    return finished(spark, ended, "sessions", ["user_id", "first"], "append")
