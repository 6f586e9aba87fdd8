"""The streaming forms, run over the given tables as one arriving file.

A finished stream is drained by one more row, far beyond all others in time, so that the watermark
passes them all; what is told of that row itself is left out.
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkbrief.plans.reliability import (
    _TIMELINE_SQL,
    DAILY_LIMIT,
    RATE_LIMIT_ADMIT_SQL,
    RATE_LIMIT_WINDOWS_SQL,
    RULE,
    TTL_DEDUP_SQL,
    TTL_SECONDS,
)
from sparkbrief.plans.threads import THREAD_STATE_ACCUMULATE_SQL, _flat, _worker
from sparkbrief.plans.traces import _STATUS_SQL, LATEST_JOB_STATUS_SQL
from sparkbrief.sources.tables import table
from sparkbrief.staging import stage_path
from sparkbrief.streaming.admission import admit_stream
from sparkbrief.streaming.folds import breaker_stream, fan_in_stream, ttl_stream
from sparkbrief.streaming.tables import (
    job_status_table,
    rate_limit_stream,
    thread_state_table,
    upsert_job_status,
    upsert_thread_state,
    written,
)

_DELAY = "60 seconds"


def _arriving(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a stream; it may be one file or a folder of files."""
    schema = table(spark, sf, name).schema
    # A pattern, as a stream takes one file only as the match of one.
    rows = spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/{name}.parque[t]")
    if "ts" in rows.columns:
        rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows


#: Key and time of the row that drains a stream.
_DRAIN, _FAR = -(2**62), datetime(2250, 1, 1, tzinfo=timezone.utc)


def _drained(rows: DataFrame, key: str) -> DataFrame:
    """A stream followed by the row that drains it; its ``key`` is ``_DRAIN``."""
    spark = rows.sparkSession
    last = {key: _DRAIN, "ts": _FAR}
    kind = StructType([rows.schema[c] for c in (key, "ts")])
    folder = stage_path(spark, "drain")
    spark.createDataFrame([tuple(last[f.name] for f in kind)], kind).write.parquet(folder)
    return rows.unionByName(spark.readStream.schema(kind).parquet(folder), allowMissingColumns=True)


def stream_breaker(spark: SparkSession, sf: str) -> DataFrame:
    calls = _arriving(spark, sf, "events").select(
        F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_type") != "error").alias("ok")
    )
    calls = _drained(calls, "event_id")
    line = written(breaker_stream(calls, RULE, _DELAY), "stream-breaker").filter(F.col("event_id") != _DRAIN)
    return line.select(
        F.col("key").alias("user_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
        "ok", "admitted", "state", F.col("opened_at").cast("timestamp_ntz").alias("opened_at"),
    )


STREAM_BREAKER_SQL = f"""
WITH RECURSIVE {_TIMELINE_SQL}
SELECT user_id, event_id, ts, ok, admitted, state, CASE WHEN state = 'open' THEN last END AS opened_at
FROM line WHERE n > 0
"""


def stream_ttl_dedup(spark: SparkSession, sf: str) -> DataFrame:
    lookups = _arriving(spark, sf, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("query"),
        F.lit(5).alias("num_results"), "ts", F.col("event_id").alias("lookup_id"),
    )
    lookups = _drained(lookups, "lookup_id")
    seen = written(ttl_stream(lookups, TTL_SECONDS, _DELAY), "stream-ttl").filter(F.col("lookup_id") != _DRAIN)
    return seen.select(
        F.col("lookup_id").alias("event_id"), "query", "hit",
        F.col("stored_at").cast("timestamp_ntz").alias("stored_at"),
    )


def stream_rate_windows(spark: SparkSession, sf: str) -> DataFrame:
    accesses = _arriving(spark, sf, "events").select(F.col("user_id").alias("client"), "ts")
    accesses = _drained(accesses, "client")
    counted = written(rate_limit_stream(accesses, DAILY_LIMIT, "1 day", _DELAY), "stream-rates")
    counted = counted.filter(~F.col("client").eqNullSafe(F.lit(_DRAIN)))
    return counted.select(
        F.col("client").alias("user_id"),
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "requests",
        "over_limit",
    )


def stream_rate_admit(spark: SparkSession, sf: str) -> DataFrame:
    accesses = _arriving(spark, sf, "events").select(F.col("user_id").alias("client"), "ts", F.col("event_id").alias("request_key"))
    accesses = _drained(accesses, "request_key")
    judged = written(admit_stream(accesses, DAILY_LIMIT, "1 day", _DELAY), "stream-admit").filter(F.col("request_key") != _DRAIN)
    return judged.select(
        F.col("request_key").alias("event_id"),
        F.col("client").alias("user_id"),
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "admitted",
    )


def stream_job_status(spark: SparkSession, sf: str) -> DataFrame:
    changes = _arriving(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"),
        F.expr(_STATUS_SQL).alias("status"),
        "ts",
        F.col("event_id").alias("seq"),
        F.expr("CASE WHEN event_type = 'error' THEN props END").alias("error_detail"),
    )
    folder = stage_path(spark, "stream-jobs")
    upsert_job_status(changes, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return job_status_table(spark, f"{folder}/rows").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_thread_state(spark: SparkSession, sf: str) -> DataFrame:
    said = _arriving(spark, sf, "conversations").withColumn("worker", _worker())
    turn = F.col("turn")
    updates = said.select(
        F.col("conv_id").alias("thread_id"),
        turn.alias("step"),
        F.when(turn == 0, F.col("text")).alias("user_input"),
        F.array("worker").alias("completed_agents"),
        F.create_map("worker", F.char_length("text").cast("string")).alias("agent_outputs"),
        F.when(F.char_length("text") % 5 == 0, F.array(F.concat(F.lit("e"), turn.cast("string")))).alias("errors"),
        (turn + 1).cast("int").alias("step_count"),
        F.when(turn == 3, F.col("text")).alias("final_answer"),
        F.when(turn % 2 == 0, F.col("worker")).alias("next_agent"),
    )
    folder = stage_path(spark, "stream-threads")
    upsert_thread_state(updates, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return _flat(thread_state_table(spark, f"{folder}/rows"))


def stream_fan_in(spark: SparkSession, sf: str) -> DataFrame:
    """Three events in a row are the results of one request."""
    results = _arriving(spark, sf, "events").select(
        F.expr("event_id DIV 3").alias("request_id"), "ts", (F.col("event_id") % 3).cast("int").alias("pos"),
        F.lit(3).alias("expected"), F.col("event_type").alias("result"),
    )
    results = _drained(results, "request_id")
    come = written(fan_in_stream(results, 3600, _DELAY), "stream-fan-in").filter(F.col("request_id") != _DRAIN)
    return come.select("request_id", F.concat_ws(",", "results").alias("results"), "complete")


STREAM_FAN_IN_SQL = """
WITH results AS (
  SELECT event_id // 3 AS request_id, event_id, ts, event_type,
    coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_id // 3 ORDER BY ts)) >= 3600000000, true) AS starts
  FROM events),
sessions AS (SELECT *, sum(starts::INT) OVER (PARTITION BY request_id ORDER BY ts) AS nth FROM results)
SELECT request_id, string_agg(event_type, ',' ORDER BY event_id) AS results, count(*) = 3 AS complete
FROM sessions GROUP BY request_id, nth
"""

QUERIES = {
    "stream_breaker": (stream_breaker, STREAM_BREAKER_SQL),
    "stream_ttl_dedup": (stream_ttl_dedup, TTL_DEDUP_SQL),
    "stream_rate_windows": (stream_rate_windows, RATE_LIMIT_WINDOWS_SQL),
    "stream_rate_admit": (stream_rate_admit, RATE_LIMIT_ADMIT_SQL),
    "stream_job_status": (stream_job_status, LATEST_JOB_STATUS_SQL),
    "stream_thread_state": (stream_thread_state, THREAD_STATE_ACCUMULATE_SQL),
    "stream_fan_in": (stream_fan_in, STREAM_FAN_IN_SQL),
}
