"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles.  Equal sets collapse to one node.  Each of
``trees`` independent trees branches the nodes: at every tree node a few MinHash coordinates are
chosen (by a hash of the path, so all sets there choose alike) and sets with the same value go
down the same branch.  On average 1/similarity branches continue, so a pair at the threshold
keeps meeting while unlike sets part; trees are repeated to reach the target recall.  Branches
with few sets are compared exhaustively, larger ones branch further.  Comparisons of signatures
only propose clusters; links are confirmed on the full sets, inside clusters, and no link
between different sets of a cluster is left out, while equal or already connected sets cost
nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, documents_named, mix64, row_key, shingles, stash, text_bytes
from .components import components

SHINGLE = 4
PERCENT = 80           # least 100 * intersection / union of a link
COORDINATES = 64       # MinHash values in a signature
TREES = 16             # a pair at the threshold meets in a first branch of nearly every tree; see README for deep ones
LEAF = 128             # sets in a branch that is compared exhaustively
DEPTH = 8              # levels after which a branch that is still large goes to exact comparison as a whole
SKETCH = 0.5           # least share of equal signature values of a proposed pair: six deviations below the threshold
PIVOTS = 8             # of a large branch
CLUSTER = 256          # sets that one task compares exactly; larger clusters are cut into blocks

_MULTIPLIERS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_set(raw: bytes, hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; fewer than k words count as one shingle, none as none."""
    words = raw.translate(LOWER).split()
    return np.unique(shingles(hashes.array(words), min(k, len(words)))) if words else np.zeros(0, np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """MinHash values of a set: the least high half of its products with each multiplier."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        low = np.minimum(low, np.multiply.outer(_MULTIPLIERS, values[i:i + 2048]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(doc_id, row, n_shingles, node, signature)``; node is a 128-bit hash of the set, null for an empty one."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = (word_set(x.as_py(), hashes, k) for x in batch.column(2))
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (0, None, None) for s in sets]
            n, node, sig = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()),
                                              pa.array(sig, pa.binary())], ["doc_id", "row", "n_shingles", "node", "signature"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), text_bytes().alias("text")).mapInArrow(
        sketch, "doc_id long, row string, n_shingles long, node binary, signature binary")


def branch(rows: DataFrame) -> DataFrame:
    """``(path, node)`` of the children from ``(path, node, signature)``.

    One coordinate is always chosen and a second in a quarter of the paths: 1.25 = 1 / 0.8 on average."""
    extra = 100 / PERCENT - 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sig = _signatures(batch.column(2))
            at = np.arange(len(path))
            chosen = mix64(path ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            first = (chosen % np.uint64(COORDINATES)).astype(np.int64)
            jump = ((chosen >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64) + 1
            both = np.flatnonzero((chosen >> np.uint64(40)).astype(np.float64) / (1 << 24) < extra)
            rows_ = np.r_[at, both]
            which = np.r_[first, (first[both] + jump[both]) % COORDINATES]
            child = mix64(path[rows_] * np.uint64(0x100000001B3) + (which.astype(np.uint64) << np.uint64(32)) + sig[rows_, which])
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column(1).take(pa.array(rows_))], ["path", "node"])

    return rows.select("path", "node", "signature").mapInArrow(step, "path long, node binary")


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def proposals(leaves: DataFrame) -> DataFrame:
    """``(a, b)``: edges of a spanning forest of each leaf's like pairs, from ``members`` arrays of (node, n, signature).

    Like: as many equal signature values as a linked pair surely has, and sizes that allow a link."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for cell in batch.column(0):
                members = cell.as_py()
                sig = np.frombuffer(b"".join(m["signature"] for m in members), "<u4").reshape(-1, COORDINATES)
                n = np.array([m["n"] for m in members], np.int64)
                up = list(range(len(members)))
                for i in range(len(members) - 1):
                    for j in (np.flatnonzero(_alike(sig[i + 1:], sig[i], n[i + 1:], n[i])) + i + 1).tolist():
                        x, y = _root(up, i), _root(up, j)
                        if x != y:
                            up[y] = x
                            a.append(members[i]["node"])
                            b.append(members[j]["node"])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return leaves.select("members").mapInArrow(compare, "a binary, b binary")


def judged_branches(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For large branches (path, c, node, n, signature): the same rows with ``mask``, a bit for each of the branch's
    pivots that the set is like, and ``pivot``, the first of these; and per branch ``(path, main, rest, a, b)``.

    A few sets of a branch, by hash, are its pivots.  Sets like a pivot, and pivots connected through a set
    that is like both, are in one cluster; ``main`` has the pivots of the largest such group and ``rest``
    counts the sets outside it.  ``a`` and ``b`` are the edges between pivots."""
    # the sets with the least hashes, the same ones in every branch that holds them; about 32 a branch are looked at
    place = F.pmod(F.xxhash64("node"), F.lit(1_000_003))
    drawn = signed.where(place * F.col("c") < 4 * PIVOTS * 1_000_003)
    pivots = stash(drawn.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct(place.alias("u"), "node", "n", "signature"))), 1, PIVOTS)
                                             .alias("pivots")), "pivots")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own, lists = batch.column(3).to_numpy(), _signatures(batch.column(4)), batch.column(5)
            ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            flat = lists.flatten()
            node, m, sig = flat.field(1).to_pylist(), flat.field(2).to_numpy(), _signatures(flat.field(3))
            mask, first = np.zeros(len(n), np.int32), [None] * len(n)
            for j in range(PIVOTS):
                at = np.flatnonzero(ends[:-1] + j < ends[1:])
                to = ends[:-1][at] + j
                like = _alike(own[at], sig[to], n[at], m[to])
                mask[at[like]] |= 1 << j
                for i, t in zip(at[like].tolist(), to[like].tolist()):
                    first[i] = first[i] or node[t]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(5)], pa.array(mask), pa.array(first, pa.binary())],
                                             ["path", "c", "node", "n", "signature", "mask", "pivot"])

    judged = stash(signed.join(pivots, "path").select("path", "c", "node", "n", "signature", "pivots")
                   .mapInArrow(judge, "path long, c long, node binary, n long, signature binary, mask int, pivot binary"), "judged")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, rest, a, b = [], [], [], []
            for masks, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                up, joined = list(range(len(nodes))), []
                for m in masks:
                    bits = [j for j in range(len(nodes)) if m["mask"] >> j & 1]
                    for j in bits[1:]:
                        x, y = _root(up, bits[0]), _root(up, j)
                        if x != y:
                            up[y] = x
                            joined.append((nodes[bits[0]], nodes[j]))
                groups = [sum(1 << j for j in range(len(nodes)) if _root(up, j) == r) for r in {_root(up, j) for j in range(len(nodes))}]
                held = {g: sum(m["k"] for m in masks if m["mask"] & g) for g in groups}
                main.append(max(held, key=lambda g: (held[g], g)))
                rest.append(sum(m["k"] for m in masks) - held[main[-1]])
                a.append([x for x, _ in joined])
                b.append([y for _, y in joined])
            kind = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(main, pa.int32()), pa.array(rest, pa.int64()), pa.array(a, kind), pa.array(b, kind)],
                                             ["path", "main", "rest", "a", "b"])

    masks = (judged.groupBy("path", "mask").agg(F.count(F.lit(1)).alias("k")).groupBy("path")
             .agg(F.collect_list(F.struct("mask", "k")).alias("masks")))  # at most 2 ** PIVOTS values
    return judged, stash(masks.join(pivots.select("path", F.col("pivots.node").alias("nodes")), "path").select("path", "masks", "nodes")
                         .mapInArrow(settle, "path long, main int, rest long, a array<binary>, b array<binary>"), "settled")


def _alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """As many equal signature values as a linked pair surely has, and sizes that allow a link."""
    return ((a == b).sum(axis=-1) >= SKETCH * COORDINATES) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


def rest_against_all(rows: DataFrame, size: int = 512) -> DataFrame:
    """``(a, b)``: edges between the few sets outside a branch's main group and all its sets, in slices of the branch."""
    sliced = rows.withColumn("outside", F.col("mask").bitwiseAND(F.col("main")) == 0).withColumn("slices", F.ceil(F.col("c") / size).cast("int"))
    spread = F.when(F.col("outside"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")))

    def compare(table: pa.Table) -> pa.Table:
        node, sig, n = table.column("node").to_pylist(), _signatures(table.column("signature").combine_chunks()), table.column("n").to_numpy()
        outside = table.column("outside").to_numpy()
        inside = np.flatnonzero(~outside)
        up, edges = list(range(len(node))), []
        for i in inside[1:].tolist():
            up[i] = int(inside[0])
        for i in np.flatnonzero(outside).tolist():
            for j in np.flatnonzero(_alike(sig, sig[i], n, n[i])).tolist():
                x, y = _root(up, i), _root(up, j)
                if x != y:
                    up[y] = x
                    edges.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in edges], pa.binary()), "b": pa.array([y for _, y in edges], pa.binary())})

    return (sliced.select("path", "node", "n", "signature", "outside", F.explode(spread).alias("slice")).groupBy("path", "slice")
            .applyInArrow(compare, "a binary, b binary"))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def candidate_edges(nodes: DataFrame, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """``(a, b)``: edges that connect every pair of nodes which some tree brings together and whose signatures are alike.

    ``nodes``: (node, n, signature).  Level by level; after each, branches of one set end."""
    seeds = F.array(*[F.lit(int(x)) for x in mix64(np.arange(1, trees + 1, dtype=np.uint64)).view(np.int64)])
    rows = branch(nodes.withColumn("path", F.explode(seeds)))
    leaves, edges = [], []
    for level in range(1, depth + 1):
        rows = stash(rows.distinct() if level > 1 else rows, "branches")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        met = rows.join(sizes, "path")
        lists = met.where(F.col("c") <= leaf).groupBy("path").agg(F.array_sort(F.collect_list("node")).alias("list"))
        leaves.append(lists.select("list"))
        signed = stash(met.where(F.col("c") > leaf).join(nodes, "node").select("path", "c", "node", "n", "signature"), "signed")
        if signed.isEmpty():
            break
        judged, settled = judged_branches(signed)
        edges.append(judged.where("pivot is not null").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        edges.append(settled.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b"))
        few = settled.where((F.col("rest") > 0) & (F.col("rest") <= leaf)).select("path", "main")
        edges.append(rest_against_all(judged.join(few, "path")))
        # these branches are done: their main groups are connected, and what is outside has met all of their sets
        many = settled.where(F.col("rest") > leaf).select("path")
        if level == depth:  # what is still together is one cluster, told apart on the full sets
            first = signed.groupBy("path").agg(F.min("node").alias("b"))
            edges.append(signed.join(first, "path").join(many, "path", "left_semi").select(F.col("node").alias("a"), "b"))
        rows = branch(signed.join(many, "path", "left_semi"))
    lists = leaves[0]
    for more in leaves[1:]:
        lists = lists.union(more)
    numbered = lists.distinct().withColumn("leaf", F.xxhash64("list")).select("leaf", F.explode("list").alias("node"))
    members = numbered.join(nodes, "node").groupBy("leaf").agg(F.collect_list(F.struct("node", "n", "signature")).alias("members"))
    out = proposals(members)
    for more in edges:
        out = out.union(more)
    return out


def linked(sizes: np.ndarray, sets: list[np.ndarray], labels: list) -> list[tuple[int, int]]:
    """Links that connect what is connected by links of the given sets, and not yet by ``labels``.

    Every pair across the components is settled: by an exact intersection, by the bound on sizes, or
    by the triangle inequality of the Jaccard distance to a set compared with both."""
    n = len(sets)
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    up = list(range(n))
    first: dict = {}
    for i, label in enumerate(labels):
        if label is not None:
            up[i] = first.setdefault(label, i)
    edges: list[tuple[int, int]] = []
    distances: list[np.ndarray] = []
    open_ = np.ones(n, bool)
    done = np.zeros(n, bool)
    roots = lambda: np.array([_root(up, i) for i in range(n)])
    comp = roots()
    while True:
        live = np.flatnonzero(open_ & ~done)
        if not len(live) or (comp[open_] == comp[open_][0]).all():
            return edges
        # the next set is of the smallest open component, so that large ones are seldom walked
        tally = np.bincount(comp[open_], minlength=n)
        x = int(live[np.argmin(tally[comp[live]])])
        done[x] = True
        other = open_ & (comp != comp[x])
        other &= 100 * np.minimum(sizes, sizes[x]) >= PERCENT * np.maximum(sizes, sizes[x])
        for d in distances:
            other &= np.abs(d - d[x]) <= 1 - PERCENT / 100 + 1e-9
        if other.any():
            mine = sets[x]
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.add.reduceat(mine[at] == flat, starts)
            union = sizes + sizes[x] - both
            if len(distances) < 64:
                distances.append(1 - both / union)
            for y in np.flatnonzero(open_ & (100 * both >= PERCENT * union)).tolist():
                a, b = _root(up, x), _root(up, y)
                if a != b:
                    up[max(a, b)] = min(a, b)
                    edges.append((x, y))
            comp = roots()
        own = comp == comp[x]
        if done[own].all():  # each of its sets has met, or can't link, every set outside
            open_ &= ~own


def confirm(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``(a, b)`` links inside each block of (keys, node, label, set)."""
    def settle(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, label = table.column("node").to_pylist(), table.column("label").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        order = sorted(range(len(node)), key=node.__getitem__)
        keep = [i for j, i in enumerate(order) if not j or node[order[j - 1]] != node[i]]
        sets = [sets[i] for i in keep]
        found = linked(np.array([len(s) for s in sets], np.int64), sets, [label[i] for i in keep]) if len(keep) > 1 else []
        return pa.table({"a": pa.array([node[keep[x]] for x, _ in found], pa.binary()), "b": pa.array([node[keep[y]] for _, y in found], pa.binary())})

    return blocks.select(*keys, "node", "label", "set").groupBy(*keys).applyInArrow(settle, "a binary, b binary")


def with_sets(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``(cluster, node, set)`` from (cluster, node, text)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = pa.array([word_set(x.as_py(), hashes, k).tobytes() for x in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], ["cluster", "node", "set"])

    return texts.select("cluster", "node", "text").mapInArrow(cut, "cluster binary, node binary, set binary")


def confirmed_links(members: DataFrame, cluster_size: int = CLUSTER) -> DataFrame:
    """``(a, b)``: exact links that connect all that is linked within each cluster of (cluster, node, set).

    Small clusters go to one task each.  A larger one is cut into slices: each slice is settled
    together with a few pivots of the cluster, which joins a group of near copies across slices at
    once; what then lies outside the cluster's largest component meets every slice, in blocks."""
    counted = members.join(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot")), "cluster")
    counted = stash(counted.withColumn("label", F.lit(None).cast("binary")), "clusters")
    small = confirm(counted.where(F.col("c") <= cluster_size), ["cluster"])
    large = counted.where(F.col("c") > cluster_size)
    if large.isEmpty():
        return small
    half = cluster_size // 2
    sliced = large.withColumn("slices", F.ceil(F.col("c") / half).cast("int")).withColumn(
        "slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    everywhere = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    pivots = sliced.where("node = pivot").withColumn("slice", everywhere)
    one = stash(confirm(sliced.unionByName(pivots), ["cluster", "slice"]), "links")
    named = sliced.drop("label").join(components(one).withColumnRenamed("label", "found"), "node", "left").withColumn(
        "label", F.coalesce("found", "node")).drop("found")
    tally = named.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m"))
    main = tally.groupBy("cluster").agg(F.max(F.struct("m", "label")).alias("t"), F.sum("m").alias("all")).select(
        "cluster", F.col("t.label").alias("main"), (F.col("all") - F.col("t.m")).alias("rest")).where("rest > 0")
    again = stash(named.join(main, "cluster").withColumn("parts", F.ceil(F.col("rest") / half).cast("int")), "rest")
    blocks = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = again.where("label <> main").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("slice", everywhere)
    return small.union(one).union(confirm(blocks.unionByName(rest), ["cluster", "slice", "part"]))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """``(doc_id, row, n_shingles, component_id, kept)`` per document.

    Documents whose sets have 100 * intersection >= 80 * union are linked; ``component_id`` is the
    smallest doc_id that links reach, and one document of each component is kept.  Null and empty
    texts have no set and no links; a row without doc_id is linked with nothing, has a null
    component and is kept; repeated rows share their component.  Texts are read twice and never
    shuffled; only the sets of documents that have a candidate partner move."""
    slim = stash(sketches(docs, k), "sketches")
    named = slim.where("node is not null and doc_id is not null")
    reps = named.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    reps = stash(reps.select("node", F.col("first.doc_id").alias("low"), F.col("first.row").alias("row"), "n", "signature"), "nodes")
    clusters = stash(components(candidate_edges(reps.select("node", "n", "signature"), trees)).withColumnRenamed("label", "cluster"), "clusters")
    wanted = stash(clusters.join(reps.select("node", "row"), "node"), "wanted")
    members = with_sets(wanted.join(documents_named(docs, wanted), "row"), k)
    found = components(confirmed_links(members))
    low = found.join(reps.select("node", "low"), "node")
    least = low.groupBy("label").agg(F.min("low").alias("component_id"))
    by_node = stash(reps.select("node", "low").join(found.join(least, "label").select("node", "component_id"), "node", "left").select(
        "node", F.coalesce("component_id", "low").alias("component_id")), "classes")
    out = slim.select("doc_id", "row", "n_shingles", "node").join(by_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "row", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
