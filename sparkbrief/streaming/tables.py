"""Streams into tables: rate-limit windows, gathered results, latest job status, thread state."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkbrief.operators.jobs import latest_status
from sparkbrief.operators.limits import LIMIT, WINDOW
from sparkbrief.operators.state import FIELDS, assembled_state, merge_entries, reduce_entries, state_entries
from sparkbrief.staging import stage_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Merge = Callable[[DataFrame], DataFrame]


def rate_limit_stream(
    accesses: DataFrame, limit: int = LIMIT, window: str = WINDOW, delay: str = "1 minute"
) -> DataFrame:
    """Streaming form of ``window_counts``: a window is told once the watermark has passed its end."""
    counted = (
        accesses.withWatermark("ts", delay)
        .groupBy("client", F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    return counted.select(
        "client",
        F.col("w.start").alias("window_start"),
        "requests",
        (F.col("requests") > limit).alias("over_limit"),
    )


def upsert_job_status(changes: DataFrame, path: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Keep the newest change of each job; ``job_status_table`` reads the result.

    A micro-batch writes its own newest changes under ``deltas``. Every ``every``-th one also writes
    the newest change of all jobs so far under ``bases``, so a reader meets one base and few deltas.
    A replayed batch writes the same folders again.
    """
    return _keep_newest(changes, path, checkpoint, every, latest_status, latest_status)


def _keep_newest(
    stream: DataFrame, path: str, checkpoint: str, every: int, told: Merge, merge: Merge, mode: str = "append"
) -> StreamingQuery:
    """Write ``told`` of each micro-batch as a delta and, every ``every``-th time, ``merge`` of all so far as a base."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        told(batch).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")
        if number % every == every - 1:
            # An earlier try of this batch may have left its base: only older ones are read.
            whole = _newest(spark, path, merge, before=number)
            whole.write.mode("overwrite").parquet(f"{path}/bases/base={number}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _newest(spark: SparkSession, path: str, merge: Merge, before: int | None = None) -> DataFrame:
    deltas = spark.read.parquet(f"{path}/deltas")
    newest = None
    try:
        bases = spark.read.parquet(f"{path}/bases")
        older = bases if before is None else bases.filter(F.col("base") < before)
        newest = older.agg(F.max("base")).first()[0]
    except AnalysisException:
        pass  # no base has been written yet
    if newest is None:
        return merge(deltas.drop("batch"))
    held = bases.filter(F.col("base") == newest).drop("base")
    return merge(held.unionByName(deltas.filter(F.col("batch") > newest).drop("batch")))


def job_status_table(spark: SparkSession, path: str) -> DataFrame:
    return _newest(spark, path, latest_status)


def upsert_thread_state(
    updates: DataFrame, path: str, checkpoint: str, mode: str = "accumulate", every: int = 16
) -> StreamingQuery:
    """Keep the state of each thread; ``thread_state_table`` reads it, ``mode`` is as in ``thread_state``.

    The state store holds a value per thread and agent, per thread and field, and per error. An update changes
    the values it tells of, and only these are written, as a delta of the micro-batch; every ``every``-th batch
    also writes a base of all. So an update costs what it holds, however long its thread is, and a reader meets
    what the threads hold and few deltas. A replayed batch writes the same folders again.
    """
    fields = {c: updates.schema[c].dataType.simpleString() for c in FIELDS if c in updates.columns}
    told = reduce_entries(state_entries(updates, mode))
    # What the reader needs to know of the fields: written before the first batch is, the same on every start.
    spark = updates.sparkSession
    about = [(place, name, kind, mode) for place, (name, kind) in enumerate(fields.items())]
    spark.createDataFrame(about, "place int, name string, type string, mode string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/fields"
    )
    return _keep_newest(told, path, checkpoint, every, lambda batch: batch, merge_entries, "update")


def thread_state_table(spark: SparkSession, path: str) -> DataFrame:
    about = sorted(spark.read.parquet(f"{path}/fields").collect())
    held = _newest(spark, path, merge_entries)
    return assembled_state(held, {r["name"]: r["type"] for r in about}, about[0]["mode"])


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that run inside keep their state in RocksDB; the session's own setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def written(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, and read back the table it wrote."""
    spark = stream.sparkSession
    root = stage_path(spark, name)
    with _rocksdb(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{root}/rows")
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
