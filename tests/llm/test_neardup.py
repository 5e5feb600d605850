import random

import numpy as np
import pytest

from vetolex.llm import components as components_module
from vetolex.llm import neardup
from vetolex.llm.common import WordHashes
from vetolex.llm.components import components
from vetolex.llm.queries import op10


def shingle_set(text, k=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k=4):
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        comp = None if doc_id is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and root(j) == root(i))
        out.append((doc_id, len(sets[i]), comp, doc_id is None or comp == doc_id))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def corpus(n_groups=25, seed=3):
    """Groups of texts around the threshold, chains, a large group of near copies and a passage that many share."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(400))
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(n_groups):
        base = [word() for _ in range(rnd.randrange(5, 120))]
        for _ in range(rnd.randrange(1, 6)):
            base = list(base)
            for _ in range(max(1, int(len(base) * rnd.choice([0, 0.01, 0.03, 0.06])))):
                base[rnd.randrange(len(base))] = word()
            rows.append((len(rows), " ".join(base)))
    hot = [word() for _ in range(150)]
    for i in range(320):
        t = list(hot)
        t[rnd.randrange(150)] = f"n{i}"
        rows.append((len(rows), " ".join(t).upper()))
    for _ in range(150):
        rows.append((len(rows), " ".join(passage + [word() for _ in range(30)])))
    rnd.shuffle(rows)
    return rows


def test_few_edges_are_settled_without_shuffles(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "a long, b long")
    near = components_module.stash(edges).where("a <> b").coalesce(1)
    step = components_module._star(components_module._star(near, True, True), False, True)
    assert "hashpartitioning" not in step._jdf.queryExecution().executedPlan().toString()
    few = sorted(map(tuple, components(edges).collect()))
    monkeypatch.setattr(components_module, "FEW_EDGES", 0)
    assert few == sorted(map(tuple, components(edges).collect()))


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, {x})
        if label[a] is not label[b]:
            both = label[a] | label[b]
            for x in both:
                label[x] = both
    want = {x: min(s) for x, s in label.items() if len(s) > 1}
    out = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in out.collect()} == want


def test_exact_links_of_sets():
    rng = np.random.default_rng(0)
    for _ in range(40):
        pool = rng.integers(0, 1 << 62, 60).astype(np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(20, 60)))) for _ in range(25)]
        sizes = np.array([len(s) for s in sets])
        up, mine = list(range(25)), list(range(25))
        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                    a, b = neardup._root(up, i), neardup._root(up, j)
                    up[max(a, b)] = min(a, b)
        for x, y in neardup.linked(sizes, sets, [None] * 25):
            a, b = neardup._root(mine, x), neardup._root(mine, y)
            mine[max(a, b)] = min(a, b)
        assert [neardup._root(up, i) for i in range(25)] == [neardup._root(mine, i) for i in range(25)]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    shares = []
    for _ in range(200):
        rng.shuffle(pool)
        a, b = pool[:180], np.r_[pool[20:180], pool[500:520]]
        shares.append((neardup.signature(a) == neardup.signature(b)).mean())
    assert abs(np.mean(shares) - 0.8) < 0.02 and min(shares) >= neardup.SKETCH


@pytest.mark.parametrize("cluster", [256, 32])
def test_corpus_against_brute_force(spark, make_docs, monkeypatch, cluster):
    monkeypatch.setattr(neardup, "CLUSTER", cluster)
    monkeypatch.setattr(neardup.confirmed_links, "__defaults__", (cluster,))
    rows = corpus()
    want = brute(rows)
    assert got(neardup.near_duplicates(make_docs(rows))) == want
    assert len({r[2] for r in want}) < len(rows)


def test_large_cluster_of_far_sets_keeps_all_links(spark):
    """A cluster in which nothing links with the pivots: blocks must still find every link."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(60):
        base = rng.integers(0, 1 << 62, 50).astype(np.uint64)
        for v in range(2):
            s = np.unique(np.r_[base[:-2], rng.integers(0, 1 << 62, 2).astype(np.uint64)])
            rows.append((b"c", f"{g:03d}-{v}".encode(), s.tobytes()))
    df = spark.createDataFrame([(bytearray(a), bytearray(b), bytearray(c)) for a, b, c in rows], "cluster binary, node binary, set binary")
    out = components(neardup.confirmed_links(df, 16)).collect()
    assert {(bytes(r["node"]), bytes(r["label"])) for r in out} == {(f"{g:03d}-{v}".encode(), f"{g:03d}-0".encode()) for g in range(60) for v in range(2)}


def test_query_against_brute_force(spark, small_dir):
    import duckdb
    rows = duckdb.sql(f"select doc_id, text from '{small_dir}/documents.parquet'").fetchall()
    assert got(op10(spark, small_dir)) == brute(rows)


def test_edges(spark, write_sf):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d"), (6, "b a"), (7, long), (8, long + " x"), (9, "q r s t u"), (9, "q r s t u"),
            (None, "a b"), (None, "a b")]
    assert got(op10(spark, write_sf(rows))) == brute(rows)
    assert op10(spark, write_sf([])).count() == 0
    assert len(WordHashes(2).array([b"a", b"b", b"c", b"a"])) == 4
