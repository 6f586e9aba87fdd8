"""Writers: job change log, JSON log lines. Thread states have a module of their own, ``states``."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkbrief.operators.logs import format_lines
from sparkbrief.schemas import JOB_CHANGE


def queued(requests: DataFrame) -> DataFrame:
    """First change of each accepted request (``job_id, thread_id``)."""
    return _change(requests, "queued", 0)


def running(jobs: DataFrame) -> DataFrame:
    return _change(jobs, "running", 1)


def finished(jobs: DataFrame) -> DataFrame:
    """Last change: ``error`` where ``error_detail`` is set, else ``done``."""
    status = F.when(F.col("error_detail").isNotNull(), "error").otherwise("done")
    return _change(jobs, status, 2)


def _change(jobs: DataFrame, status, seq: int) -> DataFrame:
    status = F.lit(status) if isinstance(status, str) else status
    known = jobs.withColumns({"status": status, "ts": F.current_timestamp(), "seq": F.lit(seq).cast("long")})
    for field in JOB_CHANGE.fields:
        if field.name not in known.columns:
            known = known.withColumn(field.name, F.lit(None).cast(field.dataType))
    return known.select(*JOB_CHANGE.names)


def append_job_changes(changes: DataFrame, path: str) -> None:
    """Append to the change log; ``operators.jobs.latest_status`` reads the newest of each job."""
    changes.select(*JOB_CHANGE.names).write.mode("append").parquet(path)


def write_log_lines(logs: DataFrame, path: str, mode: str = "append") -> None:
    format_lines(logs).write.mode(mode).text(path)
