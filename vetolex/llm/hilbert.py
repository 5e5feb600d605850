"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``bits`` bits each, a row's cell is placed on the
Hilbert curve through that grid, rows are ranked by curve index, and the ranking is cut into
runs.  Rows of a run are close in every dimension at once, so a manifest of each shard's
minimum and maximum cells prunes files for filters on any of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each column of ``axes`` (dimensions x rows, each in [0, 2**bits)).

    Gray-code form of the curve: undo the excess reflections and rotations from the top bit
    down, Gray-encode, then interleave the bits of all dimensions."""
    x = np.array(axes, dtype=np.int64)
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flips ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flips
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_column(cells: list[F.Column], bits: int) -> F.Column:
    """Spark column of the curve index; the cells are small integers, sent in Arrow batches."""
    @F.pandas_udf(T.LongType())
    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a.to_numpy() for a in axes]), bits))
    return index(*cells)


def _below(value: F.Column):
    """A test of one argument: ``F.filter`` would pass a second one the position."""
    return lambda v: v < value


def quantised(df: DataFrame, dims: list[str], bits: int) -> list[F.Column]:
    """One cell column per dimension.

    Numbers: equal-depth cuts over all rows, from one bounded quantile sketch per dimension.
    Other types: a hash cell, so a filter on equality prunes and new values move no old one.
    Nulls lie in cell 0."""
    kinds = dict(df.dtypes)
    numeric = [c for c in dims if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    size = 1 << bits
    cuts = {}
    if numeric:
        at = F.array(*[F.lit(i / size) for i in range(1, size)])
        row = df.agg(*[F.percentile_approx(c, at, 10_000).alias(f"q{i}") for i, c in enumerate(numeric)]).first()
        cuts = {c: sorted(set(row[i] or [])) for i, c in enumerate(numeric)}
    out = []
    for c in dims:
        if c in cuts:
            arr = F.array(*[F.lit(v) for v in cuts[c]]) if cuts[c] else F.array().cast("array<double>")
            cell = F.size(F.filter(arr, _below(F.col(c))))
        else:
            cell = F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(size)).cast("int")
        out.append(F.when(F.col(c).isNull(), 0).otherwise(cell).cast("long"))
    return out


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int, ties: list[str], bits: int = 5) -> DataFrame:
    """Add ``cell_<i>`` (one per dimension), ``curve``, ``shard`` and ``slot`` to the rows of ``df``.

    Rows with equal curve index are ordered by ``ties``; shards are runs of the ranking whose
    row counts differ by at most one, and slots count from 0 without a gap.  A hot cell is simply
    a long run that several shards share.  Pass only the columns to be sorted: texts need not
    move.  Repeated rows take neighbouring slots; null dimensions lie in cell 0; an empty table
    gives an empty result."""
    cells = [f"cell_{i}" for i in range(len(dims))]
    base = df.select("*", *[c.alias(n) for c, n in zip(quantised(df, dims, bits), cells)])
    base = base.withColumn("curve", curve_column([F.col(c) for c in cells], bits))
    out = ranked(base, ["curve", *ties], "__rank")
    return cut_runs(out, "__rank", F.lit(out.count()), n_shards).drop("__rank")


def cut_runs(df: DataFrame, rank: str, total: F.Column, n_shards: int) -> DataFrame:
    """``shard`` = rank * n div total and the slot within it, in integer arithmetic."""
    return (df.withColumn("__total", total.cast("long"))
            .withColumn("shard", F.expr(f"cast(({rank} * {n_shards}) div __total as int)"))
            .withColumn("slot", F.expr(f"{rank} - (shard * __total + {n_shards - 1}) div {n_shards}"))
            .drop("__total"))


def manifest(sharded: DataFrame, n_dims: int) -> DataFrame:
    """Per shard: rows and the range of cells in every dimension, for pruning before a file is opened."""
    cells = [f"cell_{i}" for i in range(n_dims)]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in cells
                                                                           for f, n in ((F.min, "min"), (F.max, "max"))])


def write_shards(sharded: DataFrame, path: str, shard: str = "shard", slot: str = "slot", placed: bool = False) -> None:
    """One folder per shard, rows in slot order within each file.

    ``placed`` rows lie in runs of the ranking already, as ``hilbert_shards`` leaves them, and are not shuffled again."""
    rows = sharded if placed else sharded.repartitionByRange(shard, slot)
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
