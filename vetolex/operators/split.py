"""Deterministic stratified 80/20 split (§2.10 ``stratified_split``).

Rows are ordered inside each label by ``md5(seed:id)``; the first ``round(0.2 n)``
of every label form the validation set.  The exact per-label rank is found
without a per-label window over all rows: a 65,536-bucket histogram of the hash
prefix (bounded, broadcast) decides every bucket but one per label, and only the
rows of that boundary bucket are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SEED = 42
VAL_FRACTION = 0.2
BUCKET_HEX = 4  # 16**4 = 65,536 buckets per label


def split_hash(id_col: str = "id", seed: int = SEED):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id", seed: int = SEED,
                     val_fraction: float = VAL_FRACTION, split_col: str = "split") -> DataFrame:
    """Adds the split; rows are compared with their label's last validation key, in one pass and without a join.

    One query over the key column and the label finds the last key of each label: a histogram of the hash
    prefixes (at most 65,536 rows a label) has the bucket in which a label's validation part ends, and only the
    rows of those buckets, about one in 65,536, are ranked."""
    keys = df.select(F.col(label).alias("_l"), F.col(id_col).alias("_i"), split_hash(id_col, seed).alias("_h")).withColumn(
        "_b", F.substring("_h", 1, BUCKET_HEX))
    hist = keys.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    per_label = Window.partitionBy("_l")
    running = per_label.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = hist.select(F.col("_l").alias("_el"), F.col("_b").alias("_eb"), "_cnt", F.coalesce(F.sum("_cnt").over(running), F.lit(0)).alias("_before"),
                       F.round(F.sum("_cnt").over(per_label) * F.lit(val_fraction)).cast("bigint").alias("_nval"))
    ends = ends.where((F.col("_before") < F.col("_nval")) & (F.col("_before") + F.col("_cnt") >= F.col("_nval")))  # one row a label
    bucket = keys.join(F.broadcast(ends), F.col("_l").eqNullSafe(F.col("_el")) & (F.col("_b") == F.col("_eb")))
    place = F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_i"))
    last = bucket.withColumn("_p", place).where(F.col("_p") == F.col("_nval") - F.col("_before")).select("_l", "_h", "_i").collect()
    inside = F.lit(False)
    h = split_hash(id_col, seed)
    for r in last:
        upto = (h < r["_h"]) | ((h == r["_h"]) & (F.col(id_col) <= F.lit(r["_i"])))
        inside = inside | (F.col(label).eqNullSafe(F.lit(r["_l"])) & upto)
    return df.withColumn(split_col, F.when(inside, "val").otherwise("train"))


def split_sql(source: str, label: str = "label", id_col: str = "id", seed: int = SEED,
              val_fraction: float = VAL_FRACTION) -> str:
    """The same split as plain SQL (oracle)."""
    return (f"(SELECT *, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)), {id_col}) "
            f"<= CAST(round(count(*) OVER (PARTITION BY {label}) * {val_fraction}) AS BIGINT) THEN 'val' ELSE 'train' END AS split "
            f"FROM {source})")
