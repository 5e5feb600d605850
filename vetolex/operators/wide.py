"""Logistic fits over more text columns than one machine should hold vectors of.

MLlib's solver keeps about 26 vectors as long as the vocabulary on the driver.  Here the text block is stored by column
and no vector of that length exists anywhere: the weights of the objective ``Σ logloss + ½λ‖w‖²`` are sums of training
rows, ``w = Xᵀα``, so a fit keeps vectors with an entry per training row, and the steps are taken between them.  One pass over the stored
columns turns a row vector γ into ``X·Xᵀγ``; a task has whole columns, so it needs γ alone and hands back one row vector.

Each step minimises the objective over the span of the gradient and the last directions, the numeric columns and the
intercept.  The products of all of these with the rows are known, so the search takes no pass.  For γ = residuals + λα the
entries of ``Xᵀγ`` are the gradient, and the pass hands back the largest.  Coefficients are made at the end, as rows of a table.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import MatrixUDT, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..session import cut, shuffles_freed
from .persist import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed copy

#: Entries in a block of columns that one task sorts, in a stored row of whole columns, in a task of a pass.
BLOCK, CHUNK, TASK = 750_000, 500_000, 4_000_000
#: Entries that make a core worth while in a pass.
PER_CORE = 500_000
#: Rows in a piece of a row vector, and bytes of all tasks' row vectors that the driver adds itself.
SLICE, DIRECT = 1 << 16, 16 << 20
#: Rows that a step's search takes at a time.
RUN = 1 << 14
#: Directions that a step keeps; each is two row vectors on the driver.
KEPT = 10
#: A fit goes on until no partial derivative of the mean loss is above this.
GRADIENT = 1e-9


@dataclass
class TextBlocks:
    """The text entries of rows, stored by column; an entry is its value times its column's scale and its row's."""
    stored: DataFrame        # (idx, n, scale, row, value): columns, how many entries each has and its scale, then row and value of every entry
    keys: np.ndarray         # of the rows, sorted; a row's place in a row vector is its key's place here
    scale: np.ndarray        # of every row
    kind: str                # of the values
    n_entries: int
    n_columns: int

    @property
    def n_rows(self) -> int:
        return len(self.scale)

    def tasks(self) -> int:
        """How many tasks make a pass."""
        cores = min(self.stored.sparkSession.sparkContext.defaultParallelism, -(-self.n_entries // PER_CORE))
        return max(cores, -(-self.n_entries // TASK), 1)

    def _sums(self, by_chunk, sent: np.ndarray | None = None) -> tuple[np.ndarray, float]:
        """The sum of the row vectors that ``by_chunk`` makes of each stored row, and the largest of the numbers beside them."""
        spark, n, size, kind = self.stored.sparkSession, self.n_rows, SLICE, self.kind
        sent = spark.sparkContext.broadcast(sent)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, worst = np.zeros(n), 0.0
            for batch in batches:
                for chunk in _chunks(batch, kind):
                    own, most = by_chunk(sent.value, *chunk[1:])
                    out += np.bincount(chunk[3], own, n)
                    worst = max(worst, most)
            for at in range(0, n, size):
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([out[at:at + size].tobytes()], pa.binary()), pa.array([worst])], ["at", "sums", "worst"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer()) for x in table.column("sums"))
            return pa.table({"at": table.column("at").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary()), "worst": pa.array([pc.max(table.column("worst")).as_py()])})

        schema = "at long, sums binary, worst double"
        parts = self.stored.coalesce(self.tasks()).mapInArrow(add_up, schema)
        if self.tasks() * n * 8 > DIRECT:
            parts = parts.groupBy("at").applyInArrow(add, schema)
        out, worst = np.zeros(n), 0.0
        with shuffles_freed(spark):
            for at, sums, most in parts.collect():
                own = np.frombuffer(sums)
                out[at:at + len(own)] += own
                worst = max(worst, most)
        sent.destroy()
        return out, worst

    def normalised(self) -> TextBlocks:
        """The same with rows of length 1."""
        squares = self._sums(lambda _, many, scale, row, value: ((value * np.repeat(scale, many)) ** 2, 0.0))[0]
        return replace(self, scale=np.divide(1.0, np.sqrt(squares), out=np.zeros(len(squares)), where=squares > 0))

    def product(self, vector: np.ndarray) -> tuple[np.ndarray, float]:
        """``X·Xᵀv``, and the largest entry of ``Xᵀv``."""
        def multiply(v, many, scale, row, value):
            u = scale * np.add.reduceat(value * v[row], np.cumsum(many) - many)
            return value * np.repeat(scale * u, many), float(np.abs(u).max())

        out, worst = self._sums(multiply, vector * self.scale)
        return out * self.scale, worst

    def weights(self, vector: np.ndarray) -> DataFrame:
        """``(idx, coef)``: the entries of ``Xᵀv`` by column, stored."""
        sent, kind = self.stored.sparkSession.sparkContext.broadcast(vector * self.scale), self.kind

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for idx, many, scale, row, value in _chunks(batch, kind):
                    u = scale * np.add.reduceat(value * sent.value[row], np.cumsum(many) - many)
                    yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(u)], ["idx", "coef"])

        return cut(self.stored.coalesce(self.tasks()).mapInArrow(multiply, "idx long, coef double"))


def _chunks(batch: pa.RecordBatch, kind: str) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in enumerate(("<i8", "<i4", "<f8", "<i4", kind)))


def _release() -> None:
    """Give freed memory back to the machine, where the C library can: a reused worker would keep its last task's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(keys: DataFrame, entries: DataFrame, total: int, columns: DataFrame | None = None) -> TextBlocks:
    """``keys``: (key) of every row, once; ``entries``: (key, idx, value), at most one of a row and column, ``total`` of them.

    ``columns``: (idx, scale), for every column of the entries; without it no column has a factor.  Values are whole numbers or doubles."""
    kind = {"int": "<i4", "double": "<f8"}[entries.schema["value"].dataType.simpleString()]
    key = np.sort(keys.toArrow().column("key").to_numpy())
    spark = keys.sparkSession
    n_blocks, most, whole = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK)), BLOCK, CHUNK
    known_keys = spark.sparkContext.broadcast(key)

    def pieces(held: list) -> pa.RecordBatch:
        """What a task has read, a row per block."""
        key, idx, value = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        row, block = np.searchsorted(known_keys.value, key).astype("<i4"), (idx % n_blocks).astype(np.int32)
        order = np.argsort(block, kind="stable")
        at = np.searchsorted(block[order], np.arange(n_blocks + 1))
        full = np.flatnonzero(np.diff(at))
        parts = [[x[order[at[k]:at[k + 1]]].tobytes() for k in full] for x in (idx.astype("<i4"), row, value.astype(kind))]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(x, pa.binary()) for x in parts]], ["block", "idx", "row", "value"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield pieces(held)
                held, n = [], 0
        if n:
            yield pieces(held)
        held = None
        _release()

    def merge(table: pa.Table, scales: pa.Table | None = None) -> pa.Table:
        idx, row, value = (np.concatenate([np.zeros(0, t), *[np.frombuffer(x.as_buffer(), t) for x in table.column(c)]])
                           for c, t in (("idx", "<i4"), ("row", "<i4"), ("value", kind)))
        order = np.lexsort((row, idx))
        idx, row, value = idx[order], row[order], value[order]
        first = np.flatnonzero(np.diff(idx, prepend=-1))
        many, idx = np.diff(np.r_[first, len(idx)]).astype("<i4"), idx[first].astype("<i8")
        factor = np.ones(len(idx), "<f8")
        if scales is not None:
            known = scales.column("idx").to_numpy()
            by = np.argsort(known)
            factor = scales.column("scale").to_numpy()[by[np.searchsorted(known, idx, sorter=by)]].astype("<f8")
        cuts = np.flatnonzero(np.diff(first // whole, prepend=-1))  # columns that begin a stored row
        out = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(first)]):
            lo, hi = first[a], first[b] if b < len(first) else len(row)
            out.append([idx[a:b].tobytes(), many[a:b].tobytes(), factor[a:b].tobytes(), row[lo:hi].tobytes(), value[lo:hi].tobytes()])
        del order, idx, row, value
        _release()
        return pa.table({c: pa.array([x[k] for x in out], pa.binary()) for k, c in enumerate(("idx", "n", "scale", "row", "value"))})

    dealt = entries.select("key", F.col("idx").cast("int"), "value").mapInArrow(deal, "block int, idx binary, row binary, value binary").groupBy("block")
    schema = "idx binary, n binary, scale binary, row binary, value binary"
    if columns is None:
        stored = cut(dealt.applyInArrow(lambda table: merge(table), schema))
    else:
        scales = columns.select((F.col("idx") % n_blocks).cast("int").alias("block"), "idx", "scale").groupBy("block")
        stored = cut(dealt.cogroup(scales).applyInArrow(lambda table, scales: merge(table, scales), schema))
    n_columns = stored.agg(F.coalesce(F.sum(F.octet_length("idx")), F.lit(0))).first()[0] // 8
    known_keys.unpersist()
    return TextBlocks(stored, key, np.ones(len(key)), kind, total, n_columns)


@dataclass
class WideModel:
    """A fitted model whose coefficients are the rows of a table; ``mllib`` is the same as MLlib's model."""
    coefficients: DataFrame  # (idx, coef) of every column (stored)
    intercept: float
    numFeatures: int
    params: dict
    numClasses: int = 2
    _held: list = field(default_factory=list, repr=False, compare=False)

    def mllib(self) -> LogisticRegressionModel:
        """MLlib's model, written by a task in its stored form and loaded: the driver then holds the coefficients, once."""
        if not self._held:
            spark, width, intercept = self.coefficients.sparkSession, self.numFeatures, self.intercept
            path = scratch_path(spark, "logistic")
            vector = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
            matrix = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"

            def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                coef = np.zeros(width)
                for batch in batches:
                    coef[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
                one = lambda x, t: pa.array([x], t)
                none, real = one(None, pa.list_(pa.int32())), lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                b = pa.StructArray.from_arrays([one(1, pa.int8()), one(None, pa.int32()), none, real(np.array([intercept]))], ["type", "size", "indices", "values"])
                w = pa.StructArray.from_arrays([one(1, pa.int8()), one(1, pa.int32()), one(width, pa.int32()), none, none, real(coef), one(True, pa.bool_())],
                                               ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])
                yield pa.RecordBatch.from_arrays([one(2, pa.int32()), one(width, pa.int32()), b, w, one(False, pa.bool_())],
                                                 ["numClasses", "numFeatures", "interceptVector", "coefficientMatrix", "isMultinomial"])

            row = self.coefficients.select("idx", "coef").coalesce(1).mapInArrow(
                whole, f"numClasses int, numFeatures int, interceptVector {vector}, coefficientMatrix {matrix}, isMultinomial boolean")
            kinds = [ST.IntegerType(), ST.IntegerType(), VectorUDT(), MatrixUDT(), ST.BooleanType()]
            cut(row, ST.StructType([ST.StructField(n, t) for n, t in zip(row.columns, kinds)])).write.parquet(os.path.join(path, "data"))
            about = {"class": "org.apache.spark.ml.classification.LogisticRegressionModel", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
                     "uid": f"LogisticRegression_{uuid.uuid4().hex[:12]}", "paramMap": self.params, "defaultParamMap": {
                         "aggregationDepth": 2, "elasticNetParam": 0.0, "family": "auto", "featuresCol": "features", "fitIntercept": True, "labelCol": "label",
                         "maxBlockSizeInMB": 0.0, "maxIter": 100, "predictionCol": "prediction", "probabilityCol": "probability", "rawPredictionCol": "rawPrediction",
                         "regParam": 0.0, "standardization": True, "threshold": 0.5, "tol": 1e-6}}
            spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(os.path.join(path, "metadata"))
            self._held.append(LogisticRegressionModel.load(path))
        return self._held[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0, e) / (1 + e)


class _Search:
    """The objective over a few directions from where a fit stands, by runs of rows."""

    def __init__(self, y, margin, text, moves, numerics, lam, slope0, gram):
        # text: each row's place in the row vectors, of which the last is 0 (no text); moves: X·direction by place
        self.y, self.margin, self.text, self.moves, self.numerics = y, margin, text, moves, numerics
        self.lam, self.slope0, self.gram = lam, slope0, gram  # of the penalty: its slope and curvature along the directions

    def columns(self, at: slice) -> np.ndarray:
        out = np.empty((len(self.moves) + len(self.numerics) + 1, len(self.y[at])))
        for k, m in enumerate(self.moves):
            out[k] = m[self.text[at]]
        for k, x in enumerate(self.numerics):
            out[len(self.moves) + k] = x[at]
        out[-1] = 1.0
        return out

    def runs(self) -> Iterator[slice]:
        return (slice(a, a + RUN) for a in range(0, len(self.y), RUN))

    def value(self, step: np.ndarray) -> float:
        total = self.lam * (self.slope0 @ step + 0.5 * step @ self.gram @ step)
        for at in self.runs():
            m = self.margin[at] + step @ self.columns(at)
            total += float(np.sum(np.logaddexp(0, np.where(self.y[at] > 0, -m, m))))
        return total

    def slopes(self, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = self.lam * (self.slope0 + self.gram @ step), self.lam * self.gram
        for at in self.runs():
            j = self.columns(at)
            p = _sigmoid(self.margin[at] + step @ j)
            g = g + j @ (p - self.y[at])
            h = h + (j * (p * (1 - p))) @ j.T
        return g, h

    def least(self, steps: int = 12) -> np.ndarray:
        """Newton steps, halved while the objective grows, until the slopes are as small as rounding lets them be."""
        step = np.zeros(len(self.slope0))
        held, first = self.value(step), None
        for _ in range(steps):
            g, h = self.slopes(step)
            scale = 1 / np.sqrt(np.maximum(np.diag(h), 1e-300))
            size = float(np.abs(g * scale).max())
            first = size if first is None else first
            if size <= 1e-6 * first:
                break
            values, vectors = np.linalg.eigh(h * scale[:, None] * scale)
            inverse = np.where(values > 1e-13 * values[-1], 1 / np.maximum(values, 1e-300), 0.0)
            move = -scale * (vectors @ (inverse * (vectors.T @ (g * scale))))
            for _ in range(30):
                now = self.value(step + move)
                if now <= held + 1e-4 * float(g @ move) or now <= held and float(-g @ move) <= 1e-9 * abs(held):
                    break
                move = move / 2
            else:
                break
            step, held = step + move, now
        return step


def fit(blocks: TextBlocks, labelled: DataFrame, n_train: int, n_text: int, max_iter: int) -> tuple[WideModel, int, float]:
    """The model, the steps it took and the largest partial derivative of the mean loss at its end.

    ``labelled``: (key, label, numerics ...) by the keys of the text rows; a row of another key or of none has no text."""
    spark = blocks.stored.sparkSession
    got = labelled.toArrow()
    names = got.column_names[2:]
    key = got.column("key")
    at = np.searchsorted(blocks.keys, pc.fill_null(key, 0).to_numpy())
    found = pc.is_valid(key).to_numpy() & (np.append(blocks.keys, 0)[at] == pc.fill_null(key, 0).to_numpy()) & (at < blocks.n_rows)
    text = np.where(found, at, blocks.n_rows)
    y, numerics = got.column("label").to_numpy().astype(float), [got.column(c).to_numpy().astype(float) for c in names]
    del got, key, at, found
    order = np.lexsort((*numerics, y, text))  # the same sums, however the rows came
    text, y, numerics = text[order], y[order], [x[order] for x in numerics]
    n, size, k = len(y), blocks.n_rows, len(names)
    lam = n / n_train

    def product(vector: np.ndarray) -> tuple[np.ndarray, float]:
        moved, most = blocks.product(vector[:size])
        return np.append(moved, 0.0), most

    def margins() -> np.ndarray:
        out = z[text] + b
        for w, x in zip(c, numerics):
            out += w * x
        return out

    alpha, z, c, b = np.zeros(size + 1), np.zeros(size + 1), np.zeros(k), 0.0  # row vectors end with a 0 for rows without text
    margin, kept, steps, worst = np.zeros(n), [], 0, np.inf

    def gradient() -> tuple[np.ndarray, np.ndarray, float]:
        r = _sigmoid(margin) - y
        gamma = np.bincount(text, r, size + 1) + lam * alpha
        gamma[-1] = 0.0
        moved, most = product(gamma)
        return gamma, moved, max([most, abs(r.sum()), *[abs(x @ r + lam * w) for x, w in zip(numerics, c)]]) / n

    while True:
        gamma, moved, worst = gradient()
        length = np.sqrt(max(float(gamma @ moved), 0.0))
        if worst <= GRADIENT or steps >= max_iter:
            break
        steps += 1
        basis = [(gamma / length, moved / length), *kept] if length > 0 else kept or [(gamma, moved)]
        m = len(basis)
        gram, slope0 = np.zeros((m + k + 1, m + k + 1)), np.zeros(m + k + 1)
        for i, (d, _) in enumerate(basis):
            slope0[i] = d @ z
            for j, (_, kd) in enumerate(basis):
                gram[i, j] = d @ kd
        gram = (gram + gram.T) / 2
        gram[m:m + k, m:m + k], slope0[m:m + k] = np.eye(k), c
        step = _Search(y, margin, text, [kd for _, kd in basis], numerics, lam, slope0, gram).least()
        if not step.any():
            break  # no direction goes down any more, to the last digit
        d, kd = (sum(t * v[i] for t, v in zip(step, basis)) for i in (0, 1))
        alpha, z, c, b = alpha + d, z + kd, c + step[m:m + k], b + step[-1]
        margin = margins()
        length = np.sqrt(max(float(d @ kd), 0.0))
        kept = ([(d / length, kd / length)] if length > 0 else []) + kept[:KEPT - 1]
    # what the coefficients themselves give, without the rounding of the steps
    z = product(alpha)[0]
    margin = margins()
    worst = gradient()[2]
    own = blocks.weights(alpha[:-1])
    del alpha, z, margin, kept, text, y, numerics, order
    _release()
    if blocks.n_columns < n_text:
        own = spark.range(n_text).select(F.col("id").alias("idx")).join(own, "idx", "left").select("idx", F.coalesce("coef", F.lit(0.0)).alias("coef"))
    nums = spark.createDataFrame([(n_text + i, float(w)) for i, w in enumerate(c)], "idx long, coef double")
    params = {"regParam": 1.0 / n_train, "standardization": False, "maxIter": max_iter, "tol": GRADIENT}
    return WideModel(own.unionByName(nums), float(b), n_text + k, params), steps, float(worst)
