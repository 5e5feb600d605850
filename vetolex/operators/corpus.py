"""Corpus statistics, lexicon joins and set operations (§2.6, §2.7, §2.9).

Lexicons are fixed tables of at most a few hundred rows, so joins against them
are explicit broadcast joins (a proven size bound); everything that grows with
the corpus is aggregated with partial (map-side) aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S


# ---------------------------------------------------------------- lexicon tables

def lexicon_frame(spark: SparkSession) -> DataFrame:
    """``(token, kind, polarity)`` for every lexicon entry (emoji, emoticon, word), distinct."""
    rows = []
    for kind, pol, vals in (("emoji", "positive", L.POSITIVE_EMOJIS), ("emoji", "negative", L.NEGATIVE_EMOJIS),
                            ("emoticon", "positive", L.POSITIVE_EMOTICONS), ("emoticon", "negative", L.NEGATIVE_EMOTICONS),
                            ("word", "positive", L.POSITIVE_WORDS), ("word", "negative", L.NEGATIVE_WORDS)):
        rows += [(v, kind, pol) for v in L.distinct(vals)]
    return spark.createDataFrame(rows, "token string, kind string, polarity string")


def emoji_lexicon(spark: SparkSession, which: str = "expanded") -> DataFrame:
    if which == "early":
        vals = L.distinct(L.EARLY_POSITIVE_EMOJIS + L.EARLY_NEGATIVE_EMOJIS)
    elif which == "reference":
        vals = tuple(e for e, _, _ in L.EMOJI_REFERENCE)
    else:
        vals = L.distinct(L.POSITIVE_EMOJIS + L.NEGATIVE_EMOJIS)
    return spark.createDataFrame([(v,) for v in vals], "emoji string")


# ---------------------------------------------------------------- occurrences

def emoji_occurrences(df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    """One row per reference-emoji occurrence (rows without any are dropped)."""
    return S.explode_nonempty(df, S.extract_known_emojis(text), "emoji", id_col)


def symbol_occurrences(df: DataFrame, text: str = "text", id_col: str = "id") -> DataFrame:
    return S.explode_nonempty(df, S.extract_symbols(text), "symbol", id_col)


def emoji_frequency(df: DataFrame, text: str = "text") -> DataFrame:
    return emoji_occurrences(df, text).groupBy("emoji").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- aggregates

def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and share per label.  The total comes from the per-label counts themselves
    (a tiny second aggregation over at most a handful of rows)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the per-label counts (one row per label), not over the rows
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def describe_column(df: DataFrame, col: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear interpolation), max.

    Quartiles come from counts per distinct value: ranks over the sorted values (range partitioned,
    no single-task sort) locate the two values around each quartile."""
    from .clean import running_total
    c = F.col(col).cast("double")
    row = df.agg(F.count(c).alias("count"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"),
                 F.min(c).alias("min"), F.max(c).alias("max"))
    per_value = running_total(df.where(c.isNotNull()).groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "_v", "_n", "_before")
    total = F.max(F.col("_before") + F.col("_n"))
    n = per_value.agg(total).first()[0] or 0
    at = {q: (n - 1) * f for q, f in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))}
    held = lambda k: F.max(F.when((F.col("_before") <= k) & (F.col("_before") + F.col("_n") > k), F.col("_v")))
    quartiles = per_value.agg(*[x for q, p in at.items() for x in (held(int(p)).alias(f"{q}_lo"), held(min(int(p) + 1, n - 1)).alias(f"{q}_hi"))])
    out = row.join(F.broadcast(quartiles))  # one row each
    return out.select("count", "mean", "std", "min", *[F.round(F.col(f"{q}_lo") + (F.col(f"{q}_hi") - F.col(f"{q}_lo")) * F.lit(p - int(p)), 6).alias(q)
                                                       for q, p in at.items()], "max")


def rate_by(df: DataFrame, flag, by=None, name: str = "rate") -> DataFrame:
    f = S._col(flag).cast("int")
    g = df.groupBy(by) if by else df
    return g.agg(F.round(F.avg(f), 6).alias(name))


def equal_width_histogram(df: DataFrame, col: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """``bins`` equal-width bins between the (per-group) min and max, last bin closed,
    empty bins kept.  Min/max come from a one-row-per-group aggregate joined back on the
    group key (broadcast: one row per group); empty bins come from exploding a bin
    sequence on that small table, not from a cross join."""
    x = F.col(col).cast("double")
    keys = [by] if by else []
    stats = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.min(x).alias("_lo0"), F.max(x).alias("_hi0"))
    stats = stats.select(*keys,
                         F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                         F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    if keys:
        j = df.join(F.broadcast(stats), keys)
    else:
        stats = stats.where("_lo is not null")
        j = df.join(F.broadcast(stats))  # one row, part of the plan
    idx = F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int")
    binned = j.where(x.isNotNull()).withColumn("bin", F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1)) + 1)
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    all_bins = stats.select(*keys, "_lo", "_hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    all_bins = all_bins.select(*keys, "bin", F.round(F.col("_lo") + (F.col("bin") - 1) * width, 6).alias("bin_lo"),
                               F.round(F.col("_lo") + F.col("bin") * width, 6).alias("bin_hi"))
    return (all_bins.join(counts, keys + ["bin"], "left")
            .select(*keys, "bin", "bin_lo", "bin_hi", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


def coverage_rate(freq: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Share of emoji occurrences whose emoji is in the lexicon."""
    lex = F.broadcast(lexicon.select(F.col("emoji").alias("_e")).distinct().withColumn("_in", F.lit(1)))
    j = freq.join(lex, freq["emoji"] == F.col("_e"), "left")
    return j.agg(F.round(F.sum(F.when(F.col("_in").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"))


def feature_summary(df: DataFrame, cols=L.NUMERIC_FEATURES) -> DataFrame:
    """Mean and max per feature, one row per feature (single pass, then unpivot)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.max(c).alias(f"{c}__max")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("feature"), F.round(F.col(f"{c}__mean"), 6).alias("mean"),
                        F.col(f"{c}__max").cast("bigint").alias("max")) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def null_count(df: DataFrame) -> DataFrame:
    total = None
    for c in df.columns:
        e = F.sum(F.when(F.col(c).isNull(), 1).otherwise(0))
        total = e if total is None else total + e
    return df.agg(F.coalesce(total, F.lit(0)).cast("bigint").alias("null_count"))


def inspect_dataset(df: DataFrame) -> DataFrame:
    """Per column: position, name, non-null count and type, from one aggregation."""
    row = df.agg(*[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                        F.col(f"_nn{i}").cast("bigint").alias("non_null"), F.lit(t).alias("dtype"))
               for i, (c, t) in enumerate(df.dtypes)]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
