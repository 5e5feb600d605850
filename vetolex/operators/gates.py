"""Gates that stop a run (§2.3): a check table in, the same table out, an error if a row failed."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import SUPPORTED, LinearTextModel, TextSettings, unsupported_settings


class GateFailed(RuntimeError):
    pass


def enforce(checks: DataFrame, name: str) -> DataFrame:
    """Raise with the failed rows (a gate has a handful) unless all ``passed``; a null counts as failed."""
    failed = checks.where(~F.coalesce(F.col("passed"), F.lit(False))).limit(20).collect()
    if failed:
        raise GateFailed(f"{name}: " + "; ".join(str(r.asDict()) for r in failed))
    return checks


def metric_gate(metrics: DataFrame, benchmark: float, metric: str = "f1") -> DataFrame:
    """The rounded metric against the benchmark."""
    value = F.round(metric, 4)
    return metrics.select(F.lit(metric).alias("metric"), value.alias("value"), F.lit(benchmark).alias("benchmark"),
                          (value >= benchmark).alias("passed"))


RUNS = "seq long, metric string, value double, benchmark double, accepted boolean, at timestamp"


def runs(spark: SparkSession, history: str) -> DataFrame:
    """The metrics history at ``history``: a row per gated run, empty before the first."""
    try:
        return spark.read.schema(RUNS).json(history)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], RUNS)
        raise


def gate_against_history(metrics: DataFrame, history: str, metric: str = "f1", tolerance: float = 0.0) -> DataFrame:
    """The rounded metric against that of the last accepted run, less ``tolerance``; the run is recorded, then a failed one raises.

    A run without a metric fails; the first run that has one sets the benchmark."""
    spark = metrics.sparkSession
    held = runs(spark, history).where(F.col("metric") == metric)
    last = held.where("accepted").orderBy(F.col("seq").desc()).limit(1).collect()
    seq = held.agg(F.max("seq")).first()[0] or 0
    value = metrics.select(F.round(metric, 4)).first()[0]
    benchmark = last[0]["value"] if last else None
    passed = value is not None and (benchmark is None or value >= benchmark - tolerance)
    row = spark.createDataFrame([(seq + 1, metric, value, benchmark, passed)], "seq long, metric string, value double, benchmark double, accepted boolean")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(history)
    return enforce(row.select("metric", "value", "benchmark", F.col("accepted").alias("passed")), metric)


def sign_gate(weights: DataFrame) -> DataFrame:
    """Positive emoji weigh towards the positive class, negative ones against it."""
    w = weights.where(F.col("term").isin("emoji_pos_count", "emoji_neg_count"))
    return w.select("term", "coef", F.when(F.col("term") == "emoji_pos_count", F.col("coef") > 0)
                    .otherwise(F.col("coef") < 0).alias("passed"))


def config_gate(spark: SparkSession, settings: TextSettings, n_classes: int, width: int, n_text: int, n_numeric: int) -> DataFrame:
    """One row per setting of a fitted model: as the scorer reproduces it, or not."""
    bad = set(unsupported_settings(settings))
    rows = [(k, str(v), str(getattr(SUPPORTED, k)), k not in bad) for k, v in asdict(settings).items() if k != "n_classes"]
    rows += [("n_classes", str(n_classes), "2", n_classes == 2), ("width", str(width), str(n_text + n_numeric), width == n_text + n_numeric)]
    return spark.createDataFrame(rows, "check string, value string, expected string, passed boolean")


def model_config_gate(model: LinearTextModel, n_classes: int, width: int) -> DataFrame:
    return config_gate(model.weights.sparkSession, model.settings, n_classes, width, model.n_text, len(model.numeric_coef))
