"""Sinks and model persistence (§2.1): parquet tables, weights + params, MLlib round trip, JSON report.

Paths live under the shared folder the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import uuid
from dataclasses import asdict, fields

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root
from . import versions
from .model import SUPPORTED, LinearTextModel, TextSettings, model_from_weights


def scratch_path(spark: SparkSession, name: str) -> str:
    root = checkpoint_root(spark)
    return os.path.join(root, "vetolex", f"{name}-{uuid.uuid4().hex[:8]}")


def sink_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # quote every field and escape quotes by doubling them, the form the reader expects
        # a reader takes a quoted file whole, so files are bounded
        w = (w.option("header", True).option("maxRecordsPerFile", 100_000).option("quoteAll", True).option("escape", '"')
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    w.save(path)
    return path


def sink_bucketed(df: DataFrame, buckets: int, by: str = "id", name: str | None = None) -> DataFrame:
    """Rows stored as a table of ``buckets`` hash buckets of ``by``, each sorted by it; the returned table is read from there.

    The rows are shuffled this once.  Groupings and joins on ``by`` (and on keys that contain it) then need no exchange
    of the table, so texts that are featurised or scored again and again stay where they are.  One file per bucket:
    ``buckets`` is chosen so that a bucket fits a task."""
    name = name or f"vetolex_{uuid.uuid4().hex}"
    path = scratch_path(df.sparkSession, name)
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def save_model(model: LinearTextModel, path: str) -> str:
    """Weights ``(term, idx, idf, coef)`` as parquet plus a one-row params table, as a new version under ``path``.

    The version is published when both are written, so a reader never pairs old weights with new params.
    Returns the version's folder, which :func:`load_model` takes too."""
    spark = model.weights.sparkSession

    def write(folder: str) -> None:
        model.weights.write.parquet(f"{folder}/weights")
        params = spark.createDataFrame([Row(intercept=model.intercept, n_text=model.n_text, **asdict(model.settings))])
        params.coalesce(1).write.json(f"{folder}/params")

    return versions.commit(spark, path, write)


def load_model(spark: SparkSession, path: str) -> LinearTextModel:
    """The version published last under ``path``, or the version whose folder ``path`` is.

    Raises if params are missing, sizes disagree, or the settings are not what the scorer reproduces."""
    path = versions.current(spark, path) or path
    weights = spark.read.parquet(os.path.join(path, "weights"))
    params = spark.read.json(os.path.join(path, "params")).first()
    names = [f.name for f in fields(TextSettings)]
    if params is None or not {"intercept", "n_text", *names} <= set(params.__fields__):
        raise FileNotFoundError(f"model params missing under {path}")
    settings = TextSettings(**{n: type(getattr(SUPPORTED, n))(params[n]) for n in names})
    model = model_from_weights(weights, params["intercept"], settings.ngram_max, settings)
    if model.n_text != int(params["n_text"]):
        raise ValueError(f"vocabulary size {model.n_text} != recorded {params['n_text']}")
    return model


def estimator_roundtrip(lr_model: LogisticRegressionModel, vectors: DataFrame, path: str) -> DataFrame:
    """Save, reload, and compare predictions row by row (anti-join must be empty)."""
    lr_model.write().overwrite().save(path)
    again = LogisticRegressionModel.load(path)
    a = lr_model.transform(vectors).select("id", "prediction")
    b = again.transform(vectors).select("id", "prediction")
    diff = a.exceptAll(b)
    return diff.agg(F.count(F.lit(1)).cast("bigint").alias("differences")).withColumn("passed", F.col("differences") == 0)


def sink_report_json(report: DataFrame, path: str) -> DataFrame:
    report.coalesce(1).write.mode("overwrite").json(path)
    return report.sparkSession.read.schema(report.schema).json(path)
