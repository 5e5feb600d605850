"""N-gram Jaccard join by a blocked sparse matrix product.

Documents are the rows of a 0/1 matrix and their distinct word n-grams its columns; the product of
the matrix with its transpose holds every pair's overlap.  It is formed in blocks of rows that may
link: a block's columns are taken in chunks, overlaps accumulate chunk by chunk, and a pair is
discarded as soon as its overlap so far and what both rows have left cannot reach the bound that
their sizes set.  Which rows share a block follows from the same bound, by exact prefix filters:

* equal sets are one row;
* a set of ``n`` linked to any other shares at least ``need(n) = ceil(0.85 n)`` columns with it, so among
  the first ``n - need(n) + m`` columns in any common order both have at least ``m`` of the same;
* hence a row with too few shared columns, in a prefix by hash and then in its whole set, is alone, and
  the others meet in one of the ``n - need(n) + 1`` rarest columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, documents_named, row_key, shingles, stash, text_bytes
from .components import components

SHINGLE = 4
PERCENT = 85               # least 100 * intersection / union of a link
SPARE = 15                 # percent of a set by which the first prefix is longer than it must be
CHUNK = 2048               # columns of the product at a time
ROWS, ENTRIES = 256, 1_000_000   # of a block: rows, and entries of its matrix
PIVOTS = 4                 # rows of a large cluster that every slice of it meets
BAND = math.log(100 / PERCENT) * 1.001   # linked sizes are in equal or neighbouring bands


def ngrams(raw: bytes, hashes: WordHashes, k: int) -> np.ndarray:
    """Sorted distinct k-gram hashes of a text; fewer than k words count as one, none as none."""
    words = raw.translate(LOWER).split()
    return np.unique(shingles(hashes.array(words), min(k, len(words)))).view(np.int64) if words else np.zeros(0, np.int64)


def need(n: int) -> int:
    """Columns that a set of ``n`` shares with any set it is linked to."""
    return -(-PERCENT * n // 100)


def spare(n: int) -> int:
    return max(1, SPARE * n // 100)


def rows_of(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, row, n_shingles, node, prefix)``: node is a 128-bit hash of the set, null for an empty one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = [ngrams(x.as_py(), hashes, k) for x in part.column(2)]
                node = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                prefix = [s[:len(s) - need(len(s)) + spare(len(s))] for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), node, _lists(prefix)],
                                                 ["doc_id", "row", "n_shingles", "node", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), text_bytes().alias("text")).mapInArrow(
        cut, "doc_id long, row string, n_shingles long, node binary, prefix array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)), pa.array(flat, pa.int64()))


def shared_columns(entries: DataFrame) -> DataFrame:
    """``(gram, ref, c)`` of the entries ``(gram, ref)`` in columns of more than one row.

    The rows of one column stream past its count, so a column in very many rows is in no task's memory."""
    counts = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return entries.join(counts, "gram")


def not_alone(rows: DataFrame) -> DataFrame:
    """The rows ``(ref, row, n, prefix)`` of which enough prefix columns are in another row's prefix too."""
    met = shared_columns(rows.select("ref", F.explode("prefix").alias("gram"))).groupBy("ref").agg(F.count(F.lit(1)).alias("k"))
    least = F.expr(f"greatest(1, {SPARE} * (({PERCENT} * n + 99) div 100) div 100)")
    return rows.drop("prefix").join(met, "ref").where(F.col("k") >= least).drop("k")


def with_sets(rows: DataFrame, docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(ref, n, grams)`` of the rows ``(ref, row, n)``, from their texts."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [ngrams(x.as_py(), hashes, k) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["ref", "n", "grams"])

    # a repeated row comes once: its texts are equal
    met = documents_named(docs, rows).join(rows.select("row", "ref"), "row").dropDuplicates(["row"])
    return met.select("ref", "text").mapInArrow(cut, "ref long, n long, grams array<long>")


def meeting_columns(sets: DataFrame) -> DataFrame:
    """``(gram, ref)``: of each row, the rarest columns, in one of which it shares a column with any row it is linked to.

    Columns of a single row come first in the order and meet nobody, so they only count; a row with more of
    them than a link allows is dropped."""
    shared = shared_columns(sets.select("ref", "n", F.explode("grams").alias("gram")))
    rows = shared.groupBy("ref", "n").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("order"))
    places = (F.size("order") - F.expr(f"({PERCENT} * n + 99) div 100") + 1).cast("int")
    kept = rows.withColumn("places", places).where("places > 0")
    return kept.select("ref", F.explode(F.slice("order", 1, F.col("places"))).alias("x")).select("x.gram", "ref")


def clusters_of(meeting: DataFrame) -> DataFrame:
    """``(node, label)``: rows connected through the columns they meet in."""
    low = meeting.groupBy("gram").agg(F.min("ref").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    edges = meeting.join(low, "gram").where("ref <> b").select(F.col("ref").alias("a"), "b").distinct()
    return components(edges)


def product_links(sets: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the linked pairs of rows with different labels, from the rows' matrix product."""
    n = np.array([len(s) for s in sets], np.int64)
    at_least = -(-PERCENT * (n[:, None] + n[None, :]) // (100 + PERCENT))
    open_ = (100 * np.minimum.outer(n, n) >= PERCENT * np.maximum.outer(n, n)) & (label[:, None] != label[None, :])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    met = times[column] > 1
    row, column = row[met], (np.cumsum(times > 1) - 1)[column[met]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left = np.bincount(row, minlength=len(sets))
    open_ &= np.minimum.outer(left, left) >= at_least
    overlap = np.zeros(open_.shape, np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, CHUNK):
        live = np.flatnonzero(open_.any(axis=1))
        if not len(live):
            return []
        i, j = np.searchsorted(column, (start, start + CHUNK))
        place = np.full(len(sets), -1)
        place[live] = np.arange(len(live))
        r, c = place[row[i:j]], column[i:j] - start
        block = np.zeros((len(live), min(CHUNK, width - start)), np.float32)
        block[r[r >= 0], c[r >= 0]] = 1
        overlap[np.ix_(live, live)] += (block @ block.T).astype(np.int64)
        left[live] -= block.sum(axis=1).astype(np.int64)
        open_ &= overlap + np.minimum.outer(left, left) >= at_least
    linked = open_ & (overlap >= at_least)
    edges, seen = [], np.zeros(len(sets), bool)
    for first in np.flatnonzero(linked.any(axis=1)).tolist():
        if seen[first]:
            continue
        seen[first], queue = True, [first]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & ~seen).tolist()
            seen[new] = True
            edges += [(x, y) for y in new]
            queue += new
    return edges


def _block_links(ref: np.ndarray, label: np.ndarray, grams: pa.Array) -> list[tuple[int, int]]:
    """Links of one block as pairs of refs; a row that comes twice counts once."""
    _, keep = np.unique(ref, return_index=True)
    if len(keep) < 2:
        return []
    ends, flat = np.asarray(grams.offsets), grams.values.to_numpy()
    sets = [flat[ends[i]:ends[i + 1]] for i in keep.tolist()]
    return [(int(ref[keep[x]]), int(ref[keep[y]])) for x, y in product_links(sets, label[keep])]


def small_clusters(members: DataFrame) -> DataFrame:
    """``(a, b)``: links in each cluster of (cluster, ref, grams), clusters one after the other as rows stream past."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = (pa.concat_tables([held, table]) if held is not None and held.num_rows else table).combine_chunks()
            cluster = held.column("cluster").to_numpy()
            cuts = np.r_[0, np.flatnonzero(cluster[1:] != cluster[:-1]) + 1]
            yield _links(held, cuts)
            held = held.slice(int(cuts[-1]))  # the last cluster may go on
        if held is not None and held.num_rows:
            yield _links(held.combine_chunks(), np.array([0, held.num_rows]))

    def _links(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        ref, grams = table.column("ref").to_numpy(), table.column("grams").combine_chunks()
        edges = []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if j - i > 1:
                edges += _block_links(ref[i:j], ref[i:j], grams.slice(i, j - i))
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return members.select("cluster", "ref", "grams").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(settle, "a long, b long")


def block_links(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``(a, b)``: links between rows of different labels in each block of (keys, ref, label, grams)."""
    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        grams = table.column("grams")
        grams = grams.combine_chunks() if isinstance(grams, pa.ChunkedArray) else grams
        edges = _block_links(table.column("ref").to_numpy(), table.column("label").to_numpy(), grams)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return blocks.select(*keys, "ref", "label", "grams").groupBy(*keys).applyInArrow(settle, "a long, b long")


def large_clusters(members: DataFrame, rows: int = ROWS, entries: int = ENTRIES) -> DataFrame:
    """``(a, b)``: links that connect all that is linked in each cluster of (cluster, ref, n, grams).

    Rows of like size share a window, and a window is cut into slices.  A slice is multiplied with itself and
    with a few pivots of its window, which joins a group of near copies at once; what is then outside the
    cluster's largest component meets every slice of its windows, in blocks."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(BAND)).cast("int")
    wide = members.select("cluster", "ref", "n", "grams", F.explode(F.array(band, band - 1)).alias("window"))
    sizes = wide.groupBy("cluster", "window").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum("n") / entries)).cast("int").alias("slices"),
        *[F.min(F.struct(F.xxhash64("ref", F.lit(i)).alias("h"), "ref")).alias(f"p{i}") for i in range(PIVOTS)])
    sizes = sizes.select("cluster", "window", "slices", F.array_distinct(F.array(*[F.col(f"p{i}.ref") for i in range(PIVOTS)])).alias("pivots"))
    sliced = wide.join(sizes, ["cluster", "window"]).withColumn("slice", F.pmod(F.xxhash64("ref"), F.col("slices")).cast("int"))
    sliced = stash(sliced.withColumn("label", F.col("ref")), "slices")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    pivots = sliced.where(F.array_contains("pivots", F.col("ref"))).withColumn("slice", everywhere)
    first = stash(block_links(sliced.unionByName(pivots), ["cluster", "window", "slice"]), "links")
    labels = members.select("cluster", "ref").join(components(first).withColumnRenamed("node", "ref"), "ref", "left").select(
        "cluster", "ref", F.coalesce("label", "ref").alias("label"))
    labels = stash(labels, "labels")
    tally = labels.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m"))
    main = tally.groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    outside = stash(labels.join(main, "cluster").withColumn("outside", F.col("label") != F.col("main")).drop("main"), "outside")
    again = sliced.drop("label", "pivots").join(outside, ["cluster", "ref"])
    parts = again.where("outside").groupBy("cluster", "window").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum("n") / entries)).cast("int").alias("parts"))
    again = stash(again.join(parts, ["cluster", "window"]), "again")
    blocks = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = again.where("outside").withColumn("part", F.pmod(F.xxhash64("ref", F.lit(1)), F.col("parts")).cast("int")).withColumn("slice", everywhere)
    return first.union(block_links(blocks.unionByName(rest), ["cluster", "window", "slice", "part"]))


def links(members: DataFrame, rows: int = ROWS, entries: int = ENTRIES) -> DataFrame:
    """``(a, b)``: links that connect all that is linked in each cluster of (cluster, ref, n, grams)."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("entries"))
    sizes = stash(sizes.withColumn("large", (F.col("c") > rows) | (F.col("entries") > entries)), "cluster-sizes")
    found = small_clusters(members.join(sizes.where("not large").select("cluster"), "cluster"))
    big = sizes.where("large").select("cluster")
    return found if big.isEmpty() else found.union(large_clusters(stash(members.join(big, "cluster"), "large"), rows, entries))


def ngram_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, row, n_shingles, component_id)`` per document.

    Documents whose sets have 100 * intersection >= 85 * union are linked; ``component_id`` is the smallest
    doc_id that links reach.  Null and empty texts have no set and no links; a row without doc_id is linked
    with nothing and has a null component; repeated rows share their component.  Long texts are read whole.
    An empty table gives no rows; other columns are not read."""
    slim = stash(rows_of(docs, k), "rows")
    named = slim.where("node is not null and doc_id is not null")
    distinct = named.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"))
    reps = stash(distinct.select(F.monotonically_increasing_id().alias("ref"), "node", F.col("first.doc_id").alias("low"),
                                 F.col("first.row").alias("row"), "n", "prefix"), "distinct")
    sets = stash(with_sets(stash(not_alone(reps.select("ref", "row", "n", "prefix")), "candidates"), docs, k), "sets")
    clusters = stash(clusters_of(stash(meeting_columns(sets), "meeting")), "clusters")
    members = sets.join(clusters.select(F.col("node").alias("ref"), F.col("label").alias("cluster")), "ref")
    found = components(links(members)).withColumnRenamed("node", "ref")
    low = found.join(reps.select("ref", "low", "node"), "ref")
    least = low.groupBy("label").agg(F.min("low").alias("component_id"))
    linked = low.join(least, "label").select("node", "component_id")
    alone = reps.join(found.select("ref"), "ref", "left_anti").select("node", F.col("low").alias("component_id"))
    classes = stash(linked.unionByName(alone), "classes")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return slim.select("doc_id", "row", "n_shingles", "node").join(classes, "node", "left").select(
        "doc_id", "row", "n_shingles", component.alias("component_id"))
