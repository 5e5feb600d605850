"""Polarity feature operators (DataFrame -> DataFrame)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from . import versions


def add_polarity_features(df: DataFrame, text_col: str = "text", boost=L.EMOJI_BOOST,
                          extended_words: bool = False) -> DataFrame:
    """Append ``emoji_pos_count, emoji_neg_count, word_pos_count, word_neg_count``.

    One projection; all rules are codegen'd string expressions (no shuffle, no UDF)."""
    # shared inputs are materialised once as columns (each is read by many rules)
    prep = df.withColumns({"_vx_t": S.safe_text(text_col)})
    prep = prep.withColumns({"_vx_low": F.lower("_vx_t"), "_vx_hi": S.high_plane("_vx_t")})
    return prep.withColumns(_feature_columns(boost, extended_words)).drop("_vx_t", "_vx_low", "_vx_hi")


_FEATURE_COLUMNS: dict = {}


def _feature_columns(boost, extended_words: bool) -> dict:
    """The four rule expressions over the helper columns, built once per configuration
    (they only reference columns by name, so the same expressions serve every frame)."""
    if not isinstance(boost, int):
        return _build_feature_columns(boost, extended_words)
    key = (boost, extended_words)
    if key not in _FEATURE_COLUMNS:
        _FEATURE_COLUMNS[key] = _build_feature_columns(boost, extended_words)
    return _FEATURE_COLUMNS[key]


def _build_feature_columns(boost, extended_words: bool) -> dict:
    pos_words = L.word_list(L.POSITIVE_WORDS, L.POSITIVE_WORDS_EXTRA) if extended_words else L.POSITIVE_WORDS
    neg_words = L.word_list(L.NEGATIVE_WORDS, L.NEGATIVE_WORDS_EXTRA) if extended_words else L.NEGATIVE_WORDS
    return {
        "emoji_pos_count": (S.emoji_polarity_count("_vx_hi", L.POSITIVE_EMOJIS, boost, stripped=True)
                            + S.emoticon_count("_vx_t", L.POSITIVE_EMOTICONS, boost)).cast("int"),
        "emoji_neg_count": (S.emoji_polarity_count("_vx_hi", L.NEGATIVE_EMOJIS, boost, stripped=True)
                            + S.emoticon_count("_vx_t", L.NEGATIVE_EMOTICONS, boost)).cast("int"),
        "word_pos_count": S.word_presence_count("_vx_low", pos_words, lowered=True),
        "word_neg_count": S.word_presence_count("_vx_low", neg_words, lowered=True),
    }


def validate_features(df: DataFrame, required=("label", "text") + L.NUMERIC_FEATURES) -> DataFrame:
    """Violations table: one row per check with (check, violations, passed)."""
    from .quality import checks_frame
    missing = [c for c in required if c not in df.columns]
    aggs = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"null_{c}") for c in df.columns]
    aggs += [F.sum(F.when(F.col(c) < 0, 1).otherwise(0)).alias(f"neg_{c}") for c in L.NUMERIC_FEATURES if c in df.columns]
    row = df.agg(*aggs)
    checks = [("required_columns", F.lit(len(missing)))]
    checks.append(("no_nulls", sum((F.coalesce(F.col(f"null_{c}"), F.lit(0)) for c in df.columns), F.lit(0))))
    checks.append(("non_negative_counts", sum((F.coalesce(F.col(f"neg_{c}"), F.lit(0)) for c in L.NUMERIC_FEATURES if c in df.columns), F.lit(0))))
    return checks_frame(row, checks)


def build_feature_table(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Features added to a clean corpus; :func:`write_feature_table` also validates and stores them."""
    return add_polarity_features(df, text_col)


class InvalidFeatures(ValueError):
    """Rows that a feature table must not have; the message names the checks that they fail."""


def write_feature_table(df: DataFrame, path: str, text_col: str = "text",
                        required=("label", "text") + L.NUMERIC_FEATURES) -> DataFrame:
    """Build, validate and store the feature table in one pass, as a new version under ``path``.

    The checks of :func:`validate_features` are counted by ``observe`` while the rows are written, and the version is
    published only if all pass.  Otherwise its files go, the version before stays, and
    :class:`InvalidFeatures` is raised.  An empty table is valid.  Returns the checks, one row each, with the
    number of rows written."""
    feats = build_feature_table(df, text_col)
    missing = [c for c in required if c not in feats.columns]
    if missing:
        raise InvalidFeatures(f"required_columns: {missing}")
    counts = {"no_nulls": sum((F.count_if(F.col(c).isNull()) for c in feats.columns), F.lit(0)),
              "non_negative_counts": sum((F.count_if(F.col(c) < 0) for c in L.NUMERIC_FEATURES), F.lit(0)),
              "binary_labels": F.count_if(~F.col("label").isin(0, 1)) if "label" in required else F.lit(0)}
    seen = Observation(f"features-{uuid.uuid4().hex}")
    observed = feats.observe(seen, F.count(F.lit(1)).alias("rows"), *[e.cast("long").alias(n) for n, e in counts.items()])

    def write(folder: str) -> None:
        observed.write.parquet(folder)
        bad = {n: seen.get[n] for n in counts if seen.get[n]}
        if bad:
            raise InvalidFeatures(", ".join(f"{n}: {v} violations" for n, v in bad.items()))

    versions.commit(df.sparkSession, path, write)
    return df.sparkSession.createDataFrame([(n, int(seen.get[n]), True, int(seen.get["rows"])) for n in counts],
                                           "check string, violations long, passed boolean, rows long")


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """The feature table published last under ``path``."""
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no feature table is published under {path}")
    return spark.read.parquet(folder)
