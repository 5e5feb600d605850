import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vetolex.llm import mixing_lm
from vetolex.llm.queries import op4


def tokens(text):
    out, word = [], b""
    for b in (text or "").encode() + b" ":
        if b == 32 or 9 <= b <= 13:
            out += [word] * bool(word)
            word = b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    return [*out, None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(t for (_, text), h in zip(rows, held) if not h for t in tokens(text))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, text), h in zip(rows, held):
        own = tokens(text)
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        out.append((i, h, len(own), sum(c[t] > 0 for t in own), n, base))
    return out


def same(rows, out):
    want = sorted(brute(rows), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    got = sorted((tuple(r)[:6] for r in out), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_query_base_counts_and_better_scores(spark):
    import duckdb
    d = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    out = op4(spark, d).collect()
    same(rows, out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in out)


def test_spelling_is_a_probability():
    """Over all one-byte continuations, the spelled probabilities of a trained model sum to at most one."""
    words = [b"abc", b"abd", b"abcabc", b"xyz", b"", b"xy"] * 50
    tables = [np.zeros((1 << b, 2), np.uint32) for b in mixing_lm.TABLE_BITS]
    mixing_lm.count_bits(words, tables)
    model = mixing_lm.Mixer.new(tables)
    model.learn(words, step=8)
    one = [bytes([b]) for b in range(256) if b != 32] + [b""]
    model = model.frozen()
    p = np.exp2(-model.bits_of(one).astype(float))
    assert p.sum() <= 1 + 1e-6
    two = [b"a" + bytes([b]) for b in range(256) if b != 32]
    assert np.exp2(-model.bits_of(two).astype(float)).sum() + np.exp2(-model.bits_of([b"a"]).astype(float)).sum() <= 1 + 1e-6
    assert model.bits_of([b"abc"])[0] < model.bits_of([b"qqq"])[0]


def test_online_learning_improves_on_equal_weights():
    rng = np.random.default_rng(0)
    parts = [b"the", b"ing", b"on", b"er", b"ti", b"sh"]
    make = lambda n: [b"".join(parts[i] for i in rng.integers(0, 6, int(rng.integers(1, 4)))) for _ in range(n)]
    types = sorted(set(make(4000)))
    train, test = types[::2], types[1::2]  # what is spelled is mostly new
    tables = [np.zeros((1 << b, 2), np.uint32) for b in mixing_lm.TABLE_BITS]
    mixing_lm.count_bits(train, tables)
    plain, tuned = mixing_lm.Mixer.new(tables), mixing_lm.Mixer.new(tables)
    tuned.learn(train * 20, step=64)
    assert tuned.frozen().bits_of(test).sum() < plain.frozen().bits_of(test).sum()


@pytest.mark.parametrize("seed", range(3))
def test_repeat_bit_against_a_loop(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(0, 3 + 4 * seed, n) for n in (300, 1, 2, 3, 150)]
    cost, hit = mixing_lm.repeat_bits(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
    offset = 0
    for a in parts:
        last, counts, run = {}, mixing_lm.PRIOR.copy(), 0
        for t in range(len(a)):
            want, h = 0.0, False
            if t > 1 and (at := last.get((a[t - 2], a[t - 1]))) is not None:
                h = a[at] == a[t]
                g = min(run, 3)
                p = counts[g, 0] / counts[g].sum()
                want = math.log(p if h else 1 - p)
                counts[g, 0 if h else 1] += 1
            assert hit[offset + t] == h and math.isclose(cost[offset + t], want, abs_tol=1e-12)
            run = run + 1 if h else 0
            if t > 1:
                last[a[t - 2], a[t - 1]] = t
        offset += len(a)


def test_a_document_is_never_its_own_source(spark, make_docs):
    long = [" ".join(f"{k}{i}" for i in range(400)) for k in "abc"]
    rows = [(2, long[0]), (3, long[0] + " tail"), (4, long[1]), (5, "short"), (6, long[0] + " end")]
    rows = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    docs = make_docs(rows)
    from pyspark.sql import functions as F
    from vetolex.llm.common import row_key
    key = {r["h"]: r["doc_id"] for r in docs.select("doc_id", F.xxhash64(row_key()).alias("h")).collect()}
    found = {key[r["h"]]: key[r["source"]] for r in mixing_lm.sources(docs).collect()}
    copies = {i for i, t in rows if t.startswith(long[0])}
    assert set(found) == copies and all(a != b and b in copies for a, b in found.items())


def test_edges(spark, write_sf):
    rows = [(1, None), (2, ""), (3, "A a  b\vB"), (4, "é" * 5000), (5, "w " * 20_000), (6, "x y z"), (6, "x y z"), (None, "only here"), (7, "new words")]
    out = op4(spark, write_sf(rows)).collect()
    same(rows, out)
    assert op4(spark, write_sf([])).count() == 0
    # 1, 11 and so on may be held out; with nothing to learn from, scores are still defined
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = op4(spark, write_sf([(alone, "a b")])).first()
    assert r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] <= 0


def test_long_unseen_words_have_finite_scores(spark, write_sf):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    train = [(i, "some plain words to learn from") for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:5]
    rows = [(i, "plain " + "x9/Q" * (n // 4)) for i, n in zip(held, (100, 1000, 10_000, 20_000))]
    out = {r["doc_id"]: r for r in op4(spark, write_sf(train + rows)).collect()}
    scores = [out[i]["score"] for i in held]
    assert all(math.isfinite(out[i]["score"]) and math.isfinite(out[i]["bits_per_byte"]) for i in held)
    # no cap: twice the letters cost about twice as much
    assert scores[0] > scores[1] > scores[2] and 1.8 < scores[3] / scores[2] < 2.2


def test_own_costs_against_exact_logs():
    c, bits = np.array([0, 0, 3, 5]), np.array([12.0, 80_000.0, 9.0, 70_000.0], np.float32)
    got = mixing_lm.own_costs(c, bits, 0.25, 8)
    want = [math.log(0.25 * 2 ** -12), math.log(0.25) - 80_000 * math.log(2), math.log(0.25 * 2 ** -9 + 0.75 * 3 / 8), math.log(0.75 * 5 / 8)]
    assert np.allclose(got, want, rtol=1e-12)


def test_weights_learn_from_every_training_token(spark, monkeypatch):
    """More than one task, tokens of any length, and more than 40,000 of them: all bits are used, and the mean is of all tasks."""
    words = [f"w{i:x}".encode() for i in range(67_500) if i % 3] + [b"long" * 50]
    known = spark.createDataFrame([(w, 1) for w in words], "token binary, c long")
    monkeypatch.setattr(mixing_lm, "LEARN_TOKENS", 20_000)
    tables = [np.zeros((1 << b, 2), np.uint32) for b in mixing_lm.TABLE_BITS]
    mixing_lm.count_bits(words, tables)
    start = mixing_lm.Mixer.new(tables)
    got = mixing_lm.learned(start, known, len(words))
    assert got.used.sum() == 8 * sum(len(w) + 1 for w in words)
    again = mixing_lm.learned(start, known, len(words))
    assert (got.weights == again.weights).all() and (got.refined == again.refined).all()
    tests = [f"w{i:x}".encode() for i in range(0, 67_500, 3)]
    assert got.frozen().bits_of(tests).sum() < start.frozen().bits_of(tests).sum()


def test_average_is_weighted_by_use():
    m = mixing_lm.Mixer.new([])
    one, two = np.zeros_like(m.used), np.zeros_like(m.used)
    one[0, 3], two[0, 3], two[1, 5] = 10, 30, 7
    got = m.averaged([(m.weights + 1, m.refined * 0 + 0.2, one), (m.weights + 5, m.refined * 0 + 0.6, two)])
    assert np.allclose(got.weights[0], m.weights[0] + 4) and np.allclose(got.weights[1], m.weights[1] + 5) and np.allclose(got.weights[2:], m.weights[2:])
    assert math.isclose(got.refined[0, 3], 0.5) and math.isclose(got.refined[1, 5], 0.6) and got.refined[0, 4] == m.refined[0, 4]
