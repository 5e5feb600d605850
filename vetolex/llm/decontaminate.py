"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is a set of windows of ``WINDOW`` consecutive words (all its words, if it has
fewer).  A window's tokens are its shingles of up to five words.  A document can contain a window
only if it contains every shingle of it, so for exact containment one necessary token is enough:
the shingle that is rarest in the documents.  Documents are probed for these prefix tokens only;
the join on the token is bounded by position (the window must begin and end inside the document)
and each candidate is verified word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bit_filter, in_filter, plain_words, row_key, shingles, stash, text_bytes

WINDOW, SHINGLE = 10, 5


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(item_id, window, n, k, shingles)``: one row per window of each item; items without a word have none."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, raw in zip(batch.column(0), batch.column(1)):
                words = plain_words(raw.as_py())
                n = min(len(words), WINDOW)
                if not n:
                    continue
                k = min(n, SHINGLE)
                h = shingles(hashes.array(words), k).view(np.int64)
                count = len(words) - n + 1
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([item.as_py()] * count, pa.string()),
                    "window": pa.array([b" ".join(words[i:i + n]).decode("utf-8", "replace") for i in range(count)], pa.string()),
                    "n": pa.array([n] * count, pa.int32()), "k": pa.array([k] * count, pa.int32()),
                    "shingles": pa.array([h[i:i + n - k + 1].tolist() for i in range(count)], pa.list_(pa.int64()))})

    return (benchmark.select(F.col("item_id").cast("string"), text_bytes().alias("text"))
            .mapInArrow(cut, "item_id string, window string, n int, k int, shingles array<long>"))


def token_counts(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """``(h, k, c)``: occurrences over all documents of shingles that pass the filter."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 2 MB, whatever the benchmark's size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = {k: [] for k in lengths}
            for raw in batch.column(0):
                h = hashes.array(plain_words(raw.as_py()))
                for k in lengths:
                    g = shingles(h, k)
                    found[k].append(g[in_filter(held.value, g)])
            for k, parts in found.items():
                values, c = np.unique(np.concatenate(parts), return_counts=True) if parts else ([], [])
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.asarray(values, np.uint64).view(np.int64)),
                                                  "k": pa.array(np.full(len(c), k, np.int32)), "c": pa.array(np.asarray(c, np.int64))})

    return docs.select(text_bytes().alias("text")).mapInArrow(count, "h long, k int, c long").groupBy("h", "k").agg(F.sum("c").alias("c"))


def probes(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """``(doc_id, row, n_words, hits)`` per document; a hit is a place of a possible prefix token with the words around it."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    hit = pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int32()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n_words, hits = [], []
            for raw in batch.column(2):
                words = plain_words(raw.as_py())
                h, own = hashes.array(words), []
                for k in lengths:
                    g = shingles(h, k)
                    for p in in_filter(held.value, g).tolist():
                        a = max(0, p - (WINDOW - k))
                        own.append({"h": int(g[p].view(np.int64)), "k": k, "at": p, "before": p - a,
                                    "around": b" ".join(words[a:p + WINDOW]).decode("utf-8", "replace")})
                n_words.append(len(words))
                hits.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(hits, hit)],
                                             ["doc_id", "row", "n_words", "hits"])

    schema = "doc_id long, row string, n_words long, hits array<struct<h:long,k:int,at:int,before:int,around:string>>"
    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), text_bytes().alias("text")).mapInArrow(probe, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, row, n_words, n_hit, item_ids)`` per document.

    ``n_hit``: words inside any occurrence of a window of any item; ``item_ids``: items with an
    occurring window, sorted as strings.  Null and empty texts have no words; equal rows get equal
    results; without documents or items the result has no rows or no hits.  Texts are read twice
    (token counts, probes) and never shuffled; what moves is one row per hit of a prefix token.  A
    passage that very many documents share makes one hit per occurrence and token, all verified."""
    windows = stash(item_windows(benchmark), "windows")
    lengths = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most SHINGLE values
    tokens = windows.select("k", "window", "n", F.posexplode("shingles").alias("offset", "h"))
    counts = token_counts(docs, lengths, bit_filter(tokens))
    rarest = F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.col("h"), F.col("offset"))).alias("t")
    prefix = (tokens.distinct().join(counts, ["h", "k"], "left").groupBy("window", "n", "k").agg(rarest)
              .select("window", "n", "k", "t.h", "t.offset"))
    prefix = stash(prefix.join(windows.select("window", "n", "item_id").distinct(), ["window", "n"]), "prefix")
    seen = stash(probes(docs, lengths, bit_filter(prefix)), "probes")
    hits = seen.where(F.size("hits") > 0).select("row", "n_words", F.explode("hits").alias("x")).select("row", "n_words", "x.*").distinct()
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window")
    # the slice is looked at only where the bounds hold
    matched = hits.join(prefix, ["h", "k"]).where(F.when(inside & (F.col("before") >= F.col("offset")), same).otherwise(False))
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct(
        (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x["end"]).alias("end")))
    per_row = (matched.groupBy("row").agg(
        F.collect_set(F.struct(start.cast("int").alias("start"), (start + F.col("n")).cast("int").alias("end"))).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"))
        .select("row", covered["n"].cast("long").alias("n_hit"), "item_ids"))
    return seen.select("doc_id", "row", "n_words").join(per_row, "row", "left").select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
