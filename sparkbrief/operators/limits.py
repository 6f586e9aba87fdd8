"""Requests per client and time window, and which of them a limit admits."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LIMIT = 30
WINDOW = "1 minute"


def _windowed(accesses: DataFrame, window: str) -> DataFrame:
    return accesses.withColumn("window_start", F.window("ts", window)["start"])


def window_counts(accesses: DataFrame, limit: int = LIMIT, window: str = WINDOW) -> DataFrame:
    """Requests per ``client`` and window, and whether there are more than the limit."""
    return (
        _windowed(accesses, window)
        .groupBy("client", "window_start")
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("over_limit", F.col("requests") > limit)
    )


def admit(
    accesses: DataFrame, limit: int = LIMIT, window: str = WINDOW, request: str = "request_key"
) -> DataFrame:
    """Add ``admitted`` (a null client is a client like any other): the first ``limit`` requests of a client in each window, by (ts, request).

    Only the last admitted request of a full window is looked for, which takes
    ``limit`` rows a window; all rows then compare themselves with it, so no task
    has to order a crowded window.
    """
    windowed = _windowed(accesses, window)
    if limit < 1:
        return windowed.withColumn("admitted", F.lit(False))
    first = Window.partitionBy("client", "window_start").orderBy("ts", request)
    full = (
        windowed.select("client", "window_start", "ts", request)
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= limit)
        .filter(F.col("nth") == limit)
        .select(F.col("client").alias("_client"), F.col("window_start").alias("_start"), F.struct("ts", request).alias("last_admitted"))
    )
    admitted = F.coalesce(F.struct("ts", request) <= F.col("last_admitted"), F.lit(True))
    return (
        windowed.join(full, F.col("client").eqNullSafe(F.col("_client")) & (F.col("window_start") == F.col("_start")), "left")
        .withColumn("admitted", admitted)
        .drop("last_admitted", "_client", "_start")
    )
