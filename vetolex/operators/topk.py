"""Top-k per group without funnelling a hot group into one task.

A row's rank inside its group is first computed inside ``(group, salt)`` sub-groups
(``salt`` = hash of the row key), which keeps at most ``k`` rows per sub-group; a second
window then ranks the survivors (at most ``k * salt_buckets`` per group).  Exact, and
every sort is over a bounded slice of the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 64


def top_k_per_group(df: DataFrame, keys, order_cols, k: int, salt_col: str = "id",
                    rank_col: str = "rank", salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_col), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order_cols)
    pre = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order_cols)
    return pre.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k).drop("_salt", "_r1")
