"""A table of thread states in versions: readers see the version before a write or the one after it, whole.

A write puts the buckets it changes into new folders and then adds one small file, the version's list of folders. A
version is there once that file is. A driver lost before leaves folders that no version lists; the next write removes
them, together with versions that are no longer kept.

    path/versions/<number>/part-*.parquet           one row: buckets, schema, folders
    path/states/bucket=<bucket>/write=<name>/...    states, listed by the versions that hold them
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkbrief.staging import discard, staged

KEEP = 2  # versions whose folders stay, so that a reader of the one before a write can end

_VERSION = "buckets int, schema string, folders array<struct<bucket: int, write: string>>"


def _bucket(thread_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(thread_id.cast("string")), F.lit(buckets)).cast("int")


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths like ``pattern``, here at most a few for each bucket or version."""
    like = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = like.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(like)
    return [str(f.getPath()) for f in found or []]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are there, the newest last."""
    return sorted({int(f.split("/")[-2]) for f in _listed(spark, f"{path}/versions/*/*.parquet")})


def _version(spark: SparkSession, path: str, number: int) -> Row:
    return spark.read.schema(_VERSION).parquet(f"{path}/versions/{number}").first()


def _states(spark: SparkSession, path: str, version: Row, only: set[int] | None = None) -> DataFrame:
    """States of a version with their ``bucket``; of the buckets ``only``, if given."""
    schema = T.StructType.fromJson(json.loads(version["schema"]))
    folders = [f for f in version["folders"] if only is None or f["bucket"] in only]
    if not folders:
        return spark.createDataFrame([], schema.add("bucket", T.IntegerType()))
    paths = [f"{path}/states/bucket={f['bucket']}/write={f['write']}" for f in folders]
    return spark.read.schema(schema).option("basePath", f"{path}/states").parquet(*paths).drop("write")


def write_thread_states(states: DataFrame, path: str, buckets: int = 64, keep: int = KEEP) -> None:
    """Add a version in which the threads of ``states`` have their new state and all others the one they had.

    Threads are dealt to ``buckets`` folders by a hash of their id; the first write fixes the number. Only buckets
    with a new state are written anew. A null id is a thread like any other; columns that only some writes have are
    null in the others. One writer at a time: of two with the same version number the later one fails and changes nothing.
    """
    spark, path = states.sparkSession, path.rstrip("/")
    there = _versions(spark, path)
    before = _version(spark, path, there[-1]) if there else None
    buckets = before["buckets"] if before else buckets
    placed = staged(states.withColumn("bucket", _bucket(F.col("thread_id"), buckets)), "new-states")
    touched = {r["bucket"] for r in placed.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
    merged, folders = placed, []
    if before:
        held = _states(spark, path, before, touched)
        same = held["thread_id"].eqNullSafe(placed["thread_id"])
        merged = placed.unionByName(held.join(placed, same, "left_anti"), allowMissingColumns=True)
        folders = [(f["bucket"], f["write"]) for f in before["folders"] if f["bucket"] not in touched]
    name = f"w{uuid.uuid4().hex}"
    if touched:
        named = merged.withColumn("write", F.lit(name)).hint("rebalance", "bucket")
        named.write.mode("append").partitionBy("bucket", "write").parquet(f"{path}/states")
    schema = T.StructType([f for f in merged.schema.fields if f.name != "bucket"]).json()
    row = (buckets, schema, sorted(folders + [(b, name) for b in touched]))
    # A driver lost while writing a version leaves a number without a file; it isn't used again.
    number = max([int(f.split("/")[-1]) for f in _listed(spark, f"{path}/versions/*")], default=0) + 1
    spark.createDataFrame([row], _VERSION).coalesce(1).write.mode("error").parquet(f"{path}/versions/{number}")
    discard(placed)
    _remove_old(spark, path, keep)


def _remove_old(spark: SparkSession, path: str, keep: int) -> None:
    """Remove versions but the newest ``keep``, and the folders of states that none of these lists."""
    kept = _versions(spark, path)[-max(keep, 1) :]
    used = {(f["bucket"], f["write"]) for n in kept for f in _version(spark, path, n)["folders"]}
    for folder in _listed(spark, f"{path}/states/bucket=*/write=*"):
        bucket, write = (part.split("=", 1)[1] for part in folder.split("/")[-2:])
        if (int(bucket), write) not in used:
            _remove(spark, folder)
    for folder in _listed(spark, f"{path}/versions/*"):
        if int(folder.split("/")[-1]) < kept[0]:
            _remove(spark, folder)


def thread_states(spark: SparkSession, path: str) -> DataFrame:
    """All states of the newest version. It stays readable until ``keep`` further versions are there."""
    path = path.rstrip("/")
    return _states(spark, path, _newest(spark, path)).drop("bucket")


def read_thread_state(spark: SparkSession, path: str, thread_id: str | None) -> DataFrame:
    """The newest state of one thread; only the folder of its bucket is read."""
    path = path.rstrip("/")
    version = _newest(spark, path)
    bucket = spark.range(1).select(_bucket(F.lit(thread_id), version["buckets"])).first()[0]
    states = _states(spark, path, version, {bucket}).drop("bucket")
    return states.filter(F.col("thread_id").eqNullSafe(F.lit(thread_id).cast("string")))


def _newest(spark: SparkSession, path: str) -> Row:
    there = _versions(spark, path)
    if not there:
        raise FileNotFoundError(f"no version of thread states at {path}")
    return _version(spark, path, there[-1])
