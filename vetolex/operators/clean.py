"""Cleaning of the labelled corpus and of the emoji reference table (§2.2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import lexicons as L
from ..session import cut

TEXT_ALIASES = ("post", "tweet", "text")
LABEL_ALIASES = ("sentiment", "label")
INDEX_COLUMNS = ("Unnamed: 0", "_c0")


def _resolve(df: DataFrame, aliases, target: str) -> str:
    present = [c for c in aliases if c in df.columns]
    if len(present) != 1:
        raise ValueError(f"expected exactly one of {aliases} for {target!r}, found {present}")
    return present[0]


def clean_posts(df: DataFrame, id_col: str | None = "index", text: str = "text",
                target: str = "label") -> DataFrame:
    """Drop index columns, map aliases to ``label``/``text``, drop nulls, then cast.

    The raw ``index`` column is kept as the row identity ``id`` (Spark has no row order)."""
    src_text = _resolve(df, TEXT_ALIASES, text)
    src_label = _resolve(df, LABEL_ALIASES, target)
    cols = []
    if id_col and id_col in df.columns:
        cols.append(F.col(id_col).cast("bigint").alias("id"))
    cols += [F.col(src_label).alias(target), F.col(src_text).alias(text)]
    out = df.drop(*[c for c in INDEX_COLUMNS if c in df.columns]).select(*cols)
    out = out.dropna(subset=[text, target])
    return out.withColumn(target, F.col(target).cast("int")).withColumn(text, F.col(text).cast("string"))


def clean_emoji_reference(df: DataFrame) -> DataFrame:
    """Snake-case names, every column as string."""
    renamed = df.drop(*[c for c in INDEX_COLUMNS + ("index",) if c in df.columns]).withColumnsRenamed({
        "Emoji": "emoji", "Unicode codepoint": "unicode_codepoint", "Unicode name": "unicode_name"})
    return renamed.select(*[F.col(c).cast("string").alias(c) for c in renamed.columns])


def emoji_reference(spark) -> DataFrame:
    """The 16-row emoji reference as a DataFrame (a fixed parameter table)."""
    return spark.createDataFrame(list(L.EMOJI_REFERENCE), "emoji string, unicode_codepoint string, unicode_name string")


def text_length_cap(df: DataFrame, text: str = "text", max_len: int = L.MAX_TEXT_LEN) -> DataFrame:
    """Route rows longer than ``max_len`` characters to a reject reason (never truncate)."""
    too_long = F.length(text) > max_len
    return df.withColumns({"accepted": ~too_long,
                           "reject_reason": F.when(too_long, F.lit("text_too_long"))})


def blank_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep rows whose text has a non-whitespace character."""
    return df.where(F.col(text).rlike("\\S"))


def running_total(df: DataFrame, order_col: str, weight_col: str | None, out_col: str) -> DataFrame:
    """Add the sum of ``weight_col`` (None: the count) over all rows before, by ``order_col``.

    Range-partition and sort, total inside each partition, and add the partition's offset (a prefix sum
    over one row per partition).  The totalled frame is written to the shared folder, so both passes
    see one partitioning even if executors are lost."""
    w = F.col(weight_col) if weight_col else F.lit(1).cast("long")
    ordered = df.repartitionByRange(order_col).sortWithinPartitions(order_col)
    tagged = ordered.withColumns({"_pid": F.spark_partition_id(), "_w": w.cast("long")})
    if weight_col:
        upto = Window.partitionBy("_pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
        tagged = tagged.withColumn("_local", F.coalesce(F.sum("_w").over(upto), F.lit(0)))
    else:
        tagged = tagged.withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    tagged = cut(tagged)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_pid").agg(F.sum("_w").alias("_n"))
               .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    # one row per partition: a proven-small broadcast side
    return (tagged.join(F.broadcast(offsets), "_pid").withColumn(out_col, F.col("_off") + F.col("_local"))
            .drop("_pid", "_w", "_local", "_off"))


def reset_index(df: DataFrame, order_col: str = "id", out_col: str = "row_index") -> DataFrame:
    """Contiguous 0..n-1 positions by ``order_col`` without a single-partition window."""
    return running_total(df, order_col, None, out_col)
