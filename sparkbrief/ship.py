"""Send the package to the executors of a session, which need not have it installed."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip file, once per application; the driver serves it to executors."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="sparkbrief-"), "sparkbrief.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(PACKAGE)))
    context.addPyFile(path)
    _SENT.add(context.applicationId)
    return spark
