"""Runs of consecutive failures per key."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.operators.ordered import HOT_ROWS, scan


def failure_streaks(calls: DataFrame, threshold: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per run of failures: ``key, streak``, its length and times, and whether it trips.

    ``calls`` has ``key, ts, event_id, ok``. ``streak`` is the number of successes before the run.
    """
    counted = scan(
        calls.select("key", "ts", "event_id", "ok"),
        ["key"],
        ["ts", "event_id"],
        total={"streak": F.col("ok").cast("long")},
        hot_rows=hot_rows,
    )
    return (
        counted.filter(~F.col("ok"))
        .groupBy("key", "streak")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
        .withColumn("trips", F.col("failures") >= threshold)
    )
