"""Write a DataFrame once to the shared checkpoint folder and read it back.

Multi-pass operators stage what several passes read. The written table cuts the
lineage, outlives lost executors, and gives the planner real file sizes, so
that it broadcasts a side only when that side is small enough.
"""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # One process: its temporary folder is shared by all there is. Session settings stay as they are.
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="sparkbrief-")
    return _LOCAL[application]


def stage_folder(spark: SparkSession) -> str:
    """The one folder that holds all an application stages."""
    return f"{stage_root(spark).rstrip('/')}/sparkbrief-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all the application has staged. For when results that read it have been written or fetched."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(stage_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held._staged_at = path
    return held


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` gave, once all that reads them has been written."""
    for held in tables:
        jvm = held.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(held._staged_at)
        folder.getFileSystem(held.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
