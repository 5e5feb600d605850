"""Removal of long repeated substrings by interval expansion on a Burrows-Wheeler transform.

In a block, the transform is extended backward breadth first: level by level, the interval of each
string found so far is split by the byte before it.  New interval ends give the positions whose
common prefix has just that level's length, so common prefixes come in increasing order, and the
expansion stops at the minimum length: what is undecided then starts a repeat.

Over a corpus, equal windows must meet in one block.  A window (``length`` bytes) is dealt by its anchor,
the k-gram of least hash in it, at its place; equal windows have equal anchors.  Neighbouring windows with
the same anchor form a run, and a run's bytes are its context.  Anchors seen once need no
comparison; equal contexts are one text with a count; the distinct contexts that share an anchor are
compared in blocks of bounded size.  Where very many do (a line that a third of the documents
hold), their windows are dealt once more by two anchors, one in each half, which tells most apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, documents_named, mix64, prefix_sums, row_key, stash, text_bytes

LENGTH = 400           # bytes of a repeat
GRAM = 64              # bytes of an anchor
BLOCK_BYTES = 1 << 19  # of contexts in a block
GROUP_CONTEXTS = 256   # contexts with the same anchor that stay in one block; more are dealt anew


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    low, have = values, 1
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    return np.minimum(low[:len(values) - width + 1], low[width - have:]) if have < width else low


def runs_of(raw: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM, halves: bool = False) -> tuple[np.ndarray, ...]:
    """``(anchors, context, first, last)`` of each run of window starts; empty for short texts.

    With ``halves``, the anchor is the pair of least grams in a window's first and second half."""
    n = len(raw) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    q, up = prefix_sums(raw, powers)
    grams = len(raw) - gram + 1
    h = mix64((q[gram:] - q[:-gram]) * up[:grams])
    in_window = length - gram + 1
    width = (in_window + 1) // 2 if halves else in_window
    # ties go to the leftmost gram, which is the same one in equal windows
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    low = (sliding_least(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    left, right = low[:n], low[in_window - width:][:n]
    change = np.flatnonzero((left[1:] != left[:-1]) | (right[1:] != right[:-1])) + 1
    first, last = np.r_[0, change], np.r_[change - 1, n - 1]
    a, b = left[first], right[first]
    anchors = mix64(h[a] + mix64(h[b] + (b - a).astype(np.uint64)))
    context = (q[last + length] - q[first]) * up[first]
    context = mix64(context + mix64((a - first).astype(np.uint64) * np.uint64(0x100000001B3) + (last - first).astype(np.uint64)))
    return anchors.view(np.int64), context.view(np.int64), first.astype(np.int32), last.astype(np.int32)


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by prefix doubling to at least ``depth`` symbols.

    Each round sorts (rank, rank further on, place) as one integer.  Suffixes that agree on as many
    symbols stand together, in the order of their places."""
    n = len(symbols)
    bits = max(int(n).bit_length(), 1)
    at, low = np.arange(n, dtype=np.uint64), np.uint64((1 << bits) - 1)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    have = 1
    while True:
        second = np.zeros(n, np.uint64)
        second[:n - have] = rank[have:]
        if 3 * bits <= 64:
            done = np.sort((rank << np.uint64(2 * bits)) | (second << np.uint64(bits)) | at)
            order, pair = (done & low).astype(np.int64), done >> np.uint64(bits)
        else:
            pair = (rank << np.uint64(32)) | second
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
        new = np.empty(n, np.uint64)
        new[order] = np.r_[0, np.cumsum(pair[1:] != pair[:-1])].astype(np.uint64) + np.uint64(1)
        rank, have = new, 2 * have
        if have >= depth or rank[order[-1]] == n:
            inverse = np.empty(n, np.int64)
            inverse[order] = np.arange(n)
            return order, inverse


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, the starts of its ``length``-byte strings that also start elsewhere in the block."""
    m = len(contexts)
    sizes = np.array([len(c) + 1 for c in contexts])
    symbols = np.concatenate([np.r_[np.frombuffer(c, np.uint8).astype(np.int64) + m, i] for i, c in enumerate(contexts)])
    n = len(symbols)
    # strings of up to length + 1 symbols are intervals of this order; separators are unique, so none spans two contexts
    order, rank = suffix_array(symbols, length + 2)
    step = rank[order - 1]           # where a suffix goes when the symbol before it is put in front
    head = symbols[order]            # first symbol of the suffix at each rank
    bits = np.int64(int(n).bit_length())
    decided = np.zeros(n + 1, bool)  # the common prefix with the suffix above is shorter than the level
    decided[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        count = high - low
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - count), count)
        owner = np.repeat(np.arange(len(low)), count)
        # within an interval, suffixes with the same symbol in front go to neighbouring ranks
        both = np.sort((owner << bits) | step[at])
        to, owner = both & ((1 << bits) - 1), both >> bits
        symbol = head[to]
        starts = np.flatnonzero(np.r_[True, (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1])])
        new_low, new_high = to[starts], to[np.r_[starts[1:], len(to)] - 1] + 1
        fresh = ~decided[new_high]
        decided[new_high[fresh]] = True
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
    again = ~decided[:n] | ~decided[1:]
    hits = np.sort(order[again])
    ends = np.cumsum(sizes)
    owner = np.searchsorted(ends, hits, side="right")
    offset = hits - (ends - sizes)[owner]
    return np.split(offset, np.searchsorted(owner, np.arange(1, m)))


def _intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()))


RUNS = "row string, anchors long, context long, first int, last int"
MARKS = "row string, first int, last int"


def corpus_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows, found = [], []
                for row, raw in zip(batch.column(0)[i:i + 512], batch.column(1)[i:i + 512]):
                    own = runs_of(raw.as_py(), powers, length, gram)
                    found.append(own)
                    rows.append(len(own[0]))
                names = batch.column(0)[i:i + 512].take(pa.array(np.repeat(np.arange(len(rows)), rows)))
                yield pa.RecordBatch.from_arrays([names, *[pa.array(np.concatenate([f[j] for f in found])) for j in range(4)]],
                                                 ["row", "anchors", "context", "first", "last"])

    return docs.select(row_key().alias("row"), text_bytes().alias("text")).mapInArrow(cut, RUNS)


def context_bytes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``(row, anchors, d, first, last, bytes)`` of the runs in ``wanted``, from the texts they lie in."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("anchors", "d", "first", "last")).alias("runs"))
    texts = documents_named(docs, wanted.select("row"))
    return (asked.join(texts, "row").select("row", "text", F.explode("runs").alias("x"))
            .select("row", "x.*", F.expr(f"substring(text, x.first + 1, x.last - x.first + {length})").alias("bytes")))


def block_marks(contexts: DataFrame, length: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Marks of the repeats among ``(row, anchors, first, last, bytes)``; equal anchors share a block."""
    total = contexts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def expand(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        row, first = table.column("row").to_pylist(), table.column("first").to_pylist()
        found = repeated_starts(table.column("bytes").to_pylist(), length)
        marks = [(row[i], first[i] + a, first[i] + b) for i, own in enumerate(found) for a, b in _intervals(own)]
        return pa.table({"row": pa.array([m[0] for m in marks], pa.string()), "first": pa.array([m[1] for m in marks], pa.int32()),
                         "last": pa.array([m[2] for m in marks], pa.int32())})

    dealt = contexts.withColumn("block", F.pmod(F.xxhash64("anchors"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(expand, MARKS)


def window_marks(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many distinct contexts (a short line that a third of the
    documents hold): every window is dealt by a hash of all its bytes, which no group can overload
    before it is counted."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row, anchors, first, raw in zip(*[batch.column(i) for i in range(4)]):
                q, up = prefix_sums(raw.as_py(), powers)
                n = len(q) - length
                h = mix64((q[length:] - q[:n]) * up[:n])
                yield pa.RecordBatch.from_arrays([
                    pa.array([row.as_py()] * n, pa.string()), pa.array(np.full(n, anchors.as_py(), np.int64)), pa.array(h.view(np.int64)),
                    pa.array(np.arange(n, dtype=np.int32) + np.int32(first.as_py()))], ["row", "anchors", "h", "at"])

    single = contexts.select("row", "anchors", "first", "bytes").mapInArrow(windows, "row string, anchors long, h long, at int")
    twice = single.groupBy("anchors", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return single.join(twice, ["anchors", "h"]).select("row", F.col("at").alias("first"), F.col("at").alias("last"))


def halved(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """``(row, anchors, context, first, last, bytes)``: the windows of (row, anchors, first, bytes) dealt by two anchors."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for row, start, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                anchors, context, first, last = runs_of(raw, powers, length, gram, halves=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row] * len(first), pa.string()), pa.array(anchors), pa.array(context), pa.array(first + np.int32(start)),
                    pa.array(last + np.int32(start)), pa.array([raw[a:b + length] for a, b in zip(first.tolist(), last.tolist())], pa.binary())],
                    ["row", "anchors", "context", "first", "last", "bytes"])

    return contexts.select("row", "first", "bytes").mapInArrow(cut, RUNS + ", bytes binary")


def group_marks(runs: DataFrame, with_bytes, length: int, gram: int, group: int, again: bool = True) -> DataFrame:
    """Marks from runs (row, anchors, context, first, last).

    ``with_bytes`` gives the bytes of chosen runs as (row, anchors, d, first, last, bytes)."""
    key = F.min(F.struct("row", "first", "last")).alias("at")
    distinct = stash(runs.groupBy("anchors", "context").agg(F.count(F.lit(1)).alias("c"), key), "contexts")
    shared = distinct.groupBy("anchors").agg(F.count(F.lit(1)).alias("d"), F.sum("c").alias("all"), F.min("c").alias("least")).where("all > 1")
    met = stash(distinct.join(shared, "anchors"), "shared")
    whole = runs.join(met.where("c > 1").select("anchors", "context"), ["anchors", "context"]).select("row", "first", "last")
    # all contexts of an anchor are compared, if one of them occurs once and still needs an answer
    asked = met.where("d > 1 and least = 1").select("anchors", "d", "at.*")
    contexts = stash(with_bytes(asked), "bytes")
    small = block_marks(contexts.where(F.col("d") <= group), length)
    large = contexts.where(F.col("d") > group)
    if large.isEmpty():
        return whole.union(small)
    if not again:
        return whole.union(small).union(window_marks(large, length))
    parts = stash(halved(large, length, gram), "halves")
    # a text counts once here; what is equal as a whole has its marks already
    pick = lambda asked: parts.join(asked, ["row", "anchors", "first", "last"]).select("row", "anchors", "d", "first", "last", "bytes")
    return whole.union(small).union(group_marks(parts.drop("bytes"), pick, length, gram, group, again=False))


def marks_of(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP_CONTEXTS) -> DataFrame:
    """``(row, first, last)``: ranges of starts of strings that also start elsewhere in the corpus."""
    runs = stash(corpus_runs(docs, length, gram), "runs")
    fetch = lambda asked: context_bytes(docs, asked, length)
    return stash(group_marks(runs, fetch, length, gram, group), "marks")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP_CONTEXTS) -> DataFrame:
    """``(doc_id, row, n_bytes, n_removed, n_spans, kept_sha256)`` per document.

    A byte goes if a ``length``-byte string that covers it also starts at another place, in the same
    document or another.  Null texts are empty; repeated rows are repeats of each other; texts
    shorter than ``length`` stay; an empty table gives an empty result.  Texts move only where a
    document shares anchors with another place."""
    marks = marks_of(docs, length, gram, group)
    per_row = marks.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("marks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for raw, found in zip(batch.column(1), batch.column(2)):
                raw, at, out = raw.as_py(), 0, []
                r = s = 0
                for m in sorted((x["first"], x["last"]) for x in found.as_py()):
                    a, b = max(m[0], at), m[1] + length
                    if b > at:
                        s += not out or m[0] > at
                        out.append(raw[at:a])
                        r += b - a
                        at = b
                removed.append(r)
                spans.append(s)
                kept.append(hashlib.sha256(b"".join(out) + raw[at:]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
                                             ["row", "n_removed", "n_spans", "kept_sha256"])

    done = per_row.join(documents_named(docs, marks.select("row")), "row").select("row", "text", "marks").mapInArrow(
        cut, "row string, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["row"])
    base = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.length(text_bytes()).cast("long").alias("n_bytes"),
                       F.sha2(text_bytes(), 256).alias("whole"))
    none = F.lit(0).cast("long")
    return base.join(done, "row", "left").select("doc_id", "row", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"),
                                                 F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
