"""Readers. Each names its columns, so that a scan reads no more than it needs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkbrief.operators.logs import parse_lines
from sparkbrief.schemas import JOB_CHANGE, OUTCOME, REQUEST


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer parts than cores, dealt out evenly; larger scans stay as they are.

    For work that costs much per row. Looks at the plan only, so pass a plain scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Requests under their fixed schema; ``operators.requests`` splits accepted from rejected."""
    return spark.read.schema(REQUEST).format(fmt).load(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def read_job_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_CHANGE).parquet(path)


def read_outcomes(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Call outcomes, as a table or as a stream of arriving files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(OUTCOME).parquet(path)


def corpus(documents: DataFrame) -> DataFrame:
    """Documents as search hits: first line as title, whole text as body, no address."""
    return documents.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.lit(None).cast("string").alias("href"),
        F.col("text").alias("body"),
    )


def outcomes_of_events(events: DataFrame) -> DataFrame:
    """Events as call outcomes: a user's calls, of which the errors failed."""
    return events.select(
        F.col("user_id").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (F.col("event_type") != "error").alias("ok"),
    )
