"""Scoring of a row where it lies: its tokens against weights that every task holds.

A model whose weights are small enough, by their measured bytes, is sent to the tasks once.  Rows keep
their place: only their token lists go to an Arrow function, batch by batch, and come back as a logit and the few
strongest terms.  Nothing is shuffled, grouped or joined, so the plan fits batches and streams alike.
Larger models are scored by the shuffled join in :mod:`.model`.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed copy

TEXT_SCORE = "struct<text_logit:double,text_drivers:array<struct<idx:bigint,token:string,weight:double>>>"
_DRIVER = pa.struct([("idx", pa.int64()), ("token", pa.string()), ("weight", pa.float64())])
#: Tokens that are looked up at once, about 200 bytes of arrays each; a batch of rows has any number.
TOKENS_AT_ONCE = 200_000
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def byte_limit(spark) -> int:
    """The session's bound on what is broadcast; not above 0: nothing is."""
    value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", value).groups()
    return int(number) * _UNITS[unit]


class PackedWeights:
    """Arrays of a model's terms: tokens, and for each term its entry by one token or by a pair of tokens."""

    def __init__(self, terms: pa.Table):
        self.term = terms.column("term").combine_chunks()
        self.idx, self.idf, self.coef, self.shown = (terms.column(c).to_numpy() for c in ("idx", "idf", "coef", "shown"))
        parts = [t.split(" ") for t in self.term.to_pylist()]
        names = sorted({w for p in parts for w in p})
        place = {w: i for i, w in enumerate(names)}
        self.tokens = pa.array(names, pa.string())
        self.single = np.full(len(names) + 1, -1, np.int64)   # the last one answers for unknown tokens
        pairs = []
        for e, p in enumerate(parts):
            if len(p) == 1:
                self.single[place[p[0]]] = e
            else:
                pairs.append((place[p[0]] * len(names) + place[p[1]], e))
        pairs.sort()
        self.pair = np.array([k for k, _ in pairs], np.int64)
        self.pair_entry = np.array([e for _, e in pairs], np.int64)

    def entries(self, tokens: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and entry of every known unigram and bigram of the rows' tokens."""
        t = pc.fill_null(pc.index_in(tokens, value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        one = self.single[t]
        known = one >= 0
        if not len(self.pair):
            return row[known], one[known]
        near = np.flatnonzero((row[1:] == row[:-1]) & (t[1:] >= 0) & (t[:-1] >= 0))
        key = t[near] * len(self.tokens) + t[near + 1]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.r_[row[known], row[near[hit]]], np.r_[one[known], self.pair_entry[at[hit]]]

    def score(self, lists: pa.Array, drivers: int | None) -> pa.Array:
        """Normalised text logit of each token list and its strongest terms, by rounded weight, ties by index.

        Lists are taken in runs of about TOKENS_AT_ONCE tokens, so memory does not follow the size of a batch."""
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        starts = np.r_[0, np.flatnonzero(np.diff(ends // TOKENS_AT_ONCE)) + 1, len(lists)]
        runs = [self._score(lists.slice(a, b - a), drivers) for a, b in zip(starts[:-1], starts[1:])]
        return runs[0] if len(runs) == 1 else pa.concat_arrays(runs)

    def _score(self, lists: pa.Array, drivers: int | None) -> pa.Array:
        n = len(lists)
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        row, entry = self.entries(lists.flatten(), row)
        cell, tf = np.unique(row * (len(self.idx) + 1) + entry, return_counts=True)
        row, entry = cell // (len(self.idx) + 1), cell % (len(self.idx) + 1)
        x = tf * self.idf[entry]
        dot, square = np.bincount(row, x * self.coef[entry], n), np.bincount(row, x * x, n)
        logit = np.divide(dot, np.sqrt(square), out=np.zeros(n), where=square > 0)
        order = np.lexsort((self.idx[entry], -np.abs(self.shown[entry]), row))
        row, entry = row[order], entry[order]
        if drivers is not None:
            first = np.searchsorted(row, np.arange(n))
            keep = np.arange(len(row)) - first[row] < drivers
            row, entry = row[keep], entry[keep]
        ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(self.idx[entry]), self.term.take(pa.array(entry)), pa.array(self.shown[entry])],
                                           fields=list(_DRIVER))
        return pa.StructArray.from_arrays([pa.array(logit), pa.ListArray.from_arrays(pa.array(ends), items)], ["text_logit", "text_drivers"])


def packed(text_weights: DataFrame) -> Broadcast | None:
    """The weights ``(term, idx, idf, coef)`` for the tasks, or None if their bytes pass the session's bound."""
    spark = text_weights.sparkSession
    size = text_weights.agg(F.sum(F.octet_length("term") + F.lit(32))).first()[0] or 0
    if size > byte_limit(spark):
        return None
    terms = text_weights.select("term", F.col("idx").cast("long").alias("idx"), F.col("idf").cast("double").alias("idf"),
                                F.col("coef").cast("double").alias("coef"), F.round("coef", 4).alias("shown")).toArrow()
    return spark.sparkContext.broadcast(PackedWeights(terms))


def text_score(tokens: Column, weights: Broadcast, drivers: int | None) -> Column:
    """``(text_logit, text_drivers)`` of a column of token lists.

    Declared non-deterministic so that the optimizer keeps the one call: a filter on what is computed from it would
    otherwise be pushed below the projection, with the call and every feature expression written out again in it."""
    def score(lists: pa.Array) -> pa.Array:
        return weights.value.score(lists, drivers)

    score.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, TEXT_SCORE).asNondeterministic()(tokens)
