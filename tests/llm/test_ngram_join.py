import random

import duckdb
import numpy as np
import pytest

from vetolex.llm import ngram_join
from vetolex.llm.components import components
from vetolex.llm.queries import op12


def gram_set(text, k=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def forest(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in pairs:
        up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def similar(a, b):
    both = len(a & b)
    return both and 100 * both >= 85 * (len(a) + len(b) - both)


def brute(rows):
    sets = [gram_set(t) for _, t in rows]
    named = [i for i, r in enumerate(rows) if r[0] is not None]
    roots = forest(len(rows), [(i, j) for x, i in enumerate(named) for j in named[:x] if similar(sets[i], sets[j])])
    low = {}
    for i in named:
        low[roots[i]] = min(low.get(roots[i], rows[i][0]), rows[i][0])
    return sorted([(d, len(sets[i]), None if d is None else low[roots[i]]) for i, (d, _) in enumerate(rows)], key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def corpus(seed=3):
    """Edits around the threshold, chains, a large group of near copies and a passage that many share."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(300))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rnd.randrange(4, 150))]
        for _ in range(rnd.randrange(1, 6)):
            base = list(base)
            for _ in range(max(1, int(len(base) * rnd.choice([0, 0.01, 0.02, 0.04])))):
                base[rnd.randrange(len(base))] = word()
            rows.append((len(rows), " ".join(base)))
    hot, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    for i in range(330):
        t = list(hot)
        for _ in range(rnd.randrange(1, 5)):
            t[rnd.randrange(200)] = f"n{i}"
        rows.append((len(rows), " ".join(t).upper()))
    for i in range(200):
        rows.append((len(rows), " ".join(passage + [word() for _ in range(rnd.choice([2, 4, 12, 30]))])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows,entries", [(256, 1_000_000), (24, 1_000_000), (256, 900)])
def test_corpus_against_brute_force(spark, make_docs, monkeypatch, rows, entries):
    monkeypatch.setattr(ngram_join.links, "__defaults__", (rows, entries))
    docs = corpus()
    want = brute(docs)
    assert got(ngram_join.ngram_components(make_docs(docs))) == want
    assert len({r[2] for r in want}) < len(docs) - 300


@pytest.mark.parametrize("chunk", [1, 7, 2048])
def test_product_against_intersections(monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    for _ in range(40):
        pool = rng.integers(-(1 << 62), 1 << 62, 70)
        sets = [np.unique(rng.choice(pool, int(rng.integers(40, 200)))) for _ in range(20)]
        label = rng.integers(0, 15, 20)
        want = [(i, j) for i in range(20) for j in range(i) if label[i] != label[j] and similar(set(sets[i].tolist()), set(sets[j].tolist()))]
        edges = ngram_join.product_links(sets, label)
        assert forest(20, edges) == forest(20, want)
        assert set(map(frozenset, edges)) <= set(map(frozenset, want))


def test_prefixes_hold_enough_common_columns():
    """The bound that the first filter rests on, for sets that are linked by as little as allowed."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        pool = rng.permutation(10_000)
        both = ngram_join.need(n)
        m = int(rng.integers(both, int(both / 0.85) + 1))
        while 100 * both < 85 * (n + m - both):
            both += 1
        if both > min(n, m):
            continue
        x, y = np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n:n + m - both]])
        cut = lambda s: set(s[:len(s) - ngram_join.need(len(s)) + ngram_join.spare(len(s))].tolist())
        assert len(cut(x) & cut(y)) >= max(ngram_join.spare(ngram_join.need(n)), ngram_join.spare(ngram_join.need(m)))


def test_a_large_cluster_without_a_main_group_keeps_all_links(spark):
    """Many linked pairs in one cluster, in several bands of size, none linked with a pivot."""
    rng = np.random.default_rng(2)
    rows = []
    for g in range(120):
        base = rng.integers(0, 1 << 62, int(rng.integers(40, 90)))
        for v in range(2):
            s = np.unique(np.r_[base[:-1], rng.integers(0, 1 << 62, 1)])
            rows.append((7, 2 * g + v, len(s), s.tolist()))
    members = spark.createDataFrame(rows, "cluster long, ref long, n long, grams array<long>")
    out = components(ngram_join.large_clusters(members, 16, 700)).collect()
    assert {(r["node"], r["label"]) for r in out} == {(x, x // 2 * 2) for x in range(240)}


def test_templated_texts_meet_nobody(spark, make_docs):
    """Half of each text is common to all: every text has more columns of its own than a link allows."""
    common = " ".join(f"c{i}" for i in range(100))
    docs = [(i, common + " " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(150)]
    slim = ngram_join.rows_of(make_docs(docs)).selectExpr("doc_id AS ref", "row", "n_shingles AS n", "prefix")
    sets = ngram_join.with_sets(slim.drop("prefix"), make_docs(docs))
    assert sets.count() == 150 and ngram_join.meeting_columns(sets).count() == 0


def test_query_against_brute_force(spark, small_dir):
    rows = duckdb.sql(f"select doc_id, text from '{small_dir}/documents.parquet'").fetchall()
    assert got(op12(spark, small_dir)) == brute(rows)


def test_edges(spark, write_sf):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A  b"), (5, "a b c d"), (6, "b a"), (7, long), (8, long + " x"), (9, "q r s t u"), (9, "q r s t u"),
            (None, "a b"), (None, "a b"), (10, long + " y"), (10, long + " y"), (11, "  É"), (12, "  é")]
    assert got(op12(spark, write_sf(rows))) == brute(rows)
    assert op12(spark, write_sf([])).count() == 0
