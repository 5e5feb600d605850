import hashlib

import numpy as np
import pytest

from vetolex.llm import repeats
from vetolex.llm.queries import op7


def naive(rows, length):
    """Every start of every string, through one dictionary."""
    places = {}
    raws = [(r[1] or "").encode() for r in rows]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            places.setdefault(raw[i:i + length], []).append((d, i))
    cover = [np.zeros(len(raw), bool) for raw in raws]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                cover[d][i:i + length] = True
    out = []
    for row, raw, c in zip(rows, raws, cover):
        kept = bytes(np.frombuffer(raw, np.uint8)[~c])
        spans = int((np.diff(np.r_[0, c.astype(int)]) == 1).sum())
        out.append((row[0], len(raw), int(c.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, length, n=60):
    rng = np.random.default_rng(seed)
    letters = list("abcdeé \n")
    text = lambda k: "".join(rng.choice(letters, k))
    passages = [text(int(length * f)) for f in (0.5, 0.9, 1.0, 1.3, 3)]
    rows = []
    for i in range(n):
        t = text(int(rng.integers(0, 3 * length)))
        for _ in range(int(rng.integers(0, 4))):
            t += passages[int(rng.integers(len(passages)))] + text(int(rng.integers(0, length)))
        rows.append((i, t))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1][:-7] + "z"), (n + 2, "ab" * (2 * length)), (n + 3, "a" * (length + 3)), (n + 4, "a" * length)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_block_expansion_against_dictionary(seed):
    rng = np.random.default_rng(seed)
    for length in (1, 2, 5, 12):
        texts = [bytes(rng.integers(97, 97 + 1 + seed, int(rng.integers(1, 60))).astype(np.uint8)) for _ in range(8)]
        texts += [texts[0], texts[1][1:] + b"xy"]
        texts = [t for t in texts if t]
        seen = {}
        for d, t in enumerate(texts):
            for i in range(len(t) - length + 1):
                seen.setdefault(t[i:i + length], []).append((d, i))
        want = [sorted(i for v in seen.values() if len(v) > 1 for e, i in v if e == d) for d in range(len(texts))]
        assert [g.tolist() for g in repeats.repeated_starts(texts, length)] == want


@pytest.mark.parametrize("halves", [False, True])
def test_equal_windows_have_equal_anchors(halves):
    powers = repeats.Powers()
    rng = np.random.default_rng(1)
    core = bytes(rng.integers(97, 123, 150).astype(np.uint8))
    found = []
    for head in (b"", b"q" * 17, bytes(rng.integers(97, 123, 93).astype(np.uint8))):
        raw = head + core + bytes(rng.integers(97, 123, 60).astype(np.uint8))
        a, _, first, last = repeats.runs_of(raw, powers, 100, 16, halves)
        assert (np.diff(np.r_[first, last[-1] + 1]) > 0).all() and first[0] == 0 and last[-1] == len(raw) - 100
        per = np.repeat(a, last - first + 1)
        found.append(per[len(head):len(head) + 51].tolist())
    assert found[0] == found[1] == found[2]


def result(spark, make_docs, rows, **kw):
    return sorted((tuple(r) for r in repeats.remove_repeats(make_docs(rows), **kw).drop("row").collect()), key=repr)


@pytest.mark.parametrize("group", [256, 3, 1])
def test_corpus_against_dictionary(spark, make_docs, group):
    rows = corpus(5, 40)
    assert result(spark, make_docs, rows, length=40, gram=8, group=group) == naive(rows, 40)


def test_query_against_dictionary(spark, small_dir):
    import duckdb
    rows = duckdb.sql(f"select doc_id, text from '{small_dir}/documents.parquet'").fetchall()
    want = naive(rows, 400)
    assert sorted((tuple(r) for r in op7(spark, small_dir).collect()), key=repr) == want
    assert any(r[2] for r in want)


def test_edges(spark, make_docs, write_sf):
    long = "".join(chr(97 + i * i * 7 % 26) + str(i) for i in range(9000))
    rows = [(1, None), (2, ""), (3, "x" * 399), (4, long), (5, long[1000:1400]), (6, "y" * 450), (7, "ü" * 300), (7, "ü" * 300), (None, "k" * 10)]
    assert sorted((tuple(r) for r in op7(spark, write_sf(rows)).collect()), key=repr) == naive(rows, 400)
    assert op7(spark, write_sf([])).count() == 0
