"""Versioned folders: written whole, then published by one small file, so that readers see all of a version or the one before.

``root/v-…`` holds a version; ``root/published`` is a log of ``(seq, version)`` rows, one file per publication,
which Spark's committer puts in place at once.  A writer that stops midway leaves a folder that no row names.
Only Spark and Hadoop file systems are used, so ``root`` may be any store that Spark writes to."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LOG = "published"
_SCHEMA = "seq long, version string, at timestamp"


def _log(spark: SparkSession, root: str):
    try:
        return spark.read.schema(_SCHEMA).json(f"{root.rstrip('/')}/{LOG}").orderBy(F.col("seq").desc(), "version").limit(1).collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the version published last, or None."""
    last = _log(spark, root)
    return f"{root.rstrip('/')}/{last[0]['version']}" if last else None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def commit(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Have ``write`` fill a new folder and publish it; if it raises, the folder goes and nothing is published.

    Returns the folder.  Of two writers at the same time both versions are whole, and readers agree on one."""
    version = f"v-{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{version}"
    try:
        write(path)
    except BaseException:
        remove(spark, path)
        raise
    last = _log(spark, root)
    row = spark.createDataFrame([(last[0]["seq"] + 1 if last else 1, version)], "seq long, version string").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/{LOG}")
    return path
