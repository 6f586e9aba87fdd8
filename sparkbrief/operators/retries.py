"""Audit of an attempt log: how each retried call ended, and how long it waited."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.functions import backoff_bounds, is_retryable
from sparkbrief.functions.retry import MAX_ATTEMPTS, WAIT_MAX, WAIT_MIN


def retry_audit(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    wait_min: float = WAIT_MIN,
    wait_max: float = WAIT_MAX,
) -> DataFrame:
    """One row per call from ``call_id, attempt, ok, error``.

    Outcome: ``success``, ``not_retryable`` (stops at once), ``exhausted``, or
    ``pending`` if another attempt is due. The waits are bounds of the backoff.
    """
    again = ~F.col("ok") & is_retryable(F.col("error")) & (F.col("attempt") < max_attempts)
    least, most = backoff_bounds(F.col("attempt"), wait_min, wait_max)
    nothing = F.lit(0.0)
    calls = attempts.groupBy("call_id").agg(
        F.max("attempt").alias("attempts"),
        F.max_by(F.struct("ok", "error"), "attempt").alias("end"),
        F.sum(F.when(again, least).otherwise(nothing)).alias("least_wait"),
        F.sum(F.when(again, most).otherwise(nothing)).alias("most_wait"),
    )
    return calls.select(
        "call_id",
        "attempts",
        F.when(F.col("end.ok"), "success")
        .when(~is_retryable(F.col("end.error")), "not_retryable")
        .when(F.col("attempts") >= max_attempts, "exhausted")
        .otherwise("pending")
        .alias("outcome"),
        F.when(~F.col("end.ok"), F.col("end.error")).alias("last_error"),
        "least_wait",
        "most_wait",
    )
