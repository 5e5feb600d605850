"""Spark session helpers.

Cluster settings (shuffle partitions, memory, checkpoint directory) belong to
the deployment; the helpers here only fill in values that are unset, so the
same code runs in tests on ``local[*]`` and on a cluster.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is checked to be small; the library decides
    # explicitly with size checks, the automatic threshold stays modest.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None, app_name: str = "vetolex",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (set a local one only if unset)."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Only local mode gets a folder of its own; a cluster must name one that all machines share."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder shared by all machines of {sc.master}")
        configured = tempfile.mkdtemp(prefix="vetolex-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING = threading.Lock(), []  # the writes that run, of all threads, with what the session had set before the first


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files behind when they end; without it these stay until the driver's garbage is collected.

    Only for queries that no one runs again from the same plan, like a write."""
    lock, held = _FREEING
    with lock:
        held.append(spark.conf.get(_FREE, None) if not held else held[0])
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with lock:
            before = held.pop()
            if not held:
                spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def cut(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, by ``schema`` if that is given: computed once, and safe from lost executors.

    What was shuffled on the way is freed with the write."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/vetolex/cut-{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
