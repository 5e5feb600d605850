import random
import re
from collections import Counter, defaultdict

import pytest

from tests.oracle_compare import compare, duck
from vetolex.llm import divergence
from vetolex.llm.queries import op11

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows):
    """(lang, source, part, item, value, rank) with whole-number Python arithmetic, term by term."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs = [((r[3] if len(r) > 3 else "en") or "", (r[2] if len(r) > 2 else "s") or "", TERM.findall(lower(r[1]))) for r in rows]
    df, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        groups[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, c in df[lang].items() if c >= 3]
        mine = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in mine.items()}
        q = share({t: sum(c[t] for c in mine.values()) for t in kept})
        f = lambda a, b: (a - b) ** 2 // b
        for s in mine:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed=5):
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghijklmnop" for b in ("é", "x", "yy", "Z", "世")] + ["ünï"]
    rows = []
    for i in range(260):
        lang = rnd.choice(["en", "de", None, ""])
        text = " ".join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.randrange(0, 90)))
        rows.append((i, text, rnd.choice(["a", "b", "c", "d", None, ""]), lang))
    rows += [(1000 + i, "1 2 3 --", "hollow", "en") for i in range(2)] + [(1100, "lonely words", "x", "xx"), (1101, "other", "y", "xx"), (1102, None, "z", "xx")]
    rows += [(1200, " ".join(words) * 400, "long", "en"), (1200, " ".join(words) * 400, "long", "en"), (None, "aé[bx`cyy{", None, None)]
    return rows


def got(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_corpus_against_brute_force(spark, make_docs):
    rows = corpus()
    want = brute(rows)
    assert got(divergence.audit(make_docs(rows))) == want
    assert any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in want) and any(r[1] == "hollow" for r in want)


def test_tiles_and_bitmap_blocks_do_not_change_the_result(spark, make_docs, monkeypatch):
    """Many sources over several tiles, terms over several blocks, and counts handed on early."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randrange(1, 4)))
    rows = [(i, " ".join(word() for _ in range(60)), f"s{i % 11}", "en") for i in range(90)]
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK", 128)
    monkeypatch.setattr(divergence.bitmaps, "__defaults__", (128,))
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "CELLS", 64)
    assert got(divergence.audit(make_docs(rows))) == brute(rows)


def test_bitmaps_hold_the_terms_of_a_count(spark):
    kept = spark.createDataFrame([("en", "a", 5, 0), ("en", "a", 5, 63), ("en", "a", 5, 64), ("en", "a", 7, 511), ("en", "a", 5, 512), ("en", "b", 5, 0)],
                                 "lang string, source string, n long, number long")
    rows = {(r["source"], r["block"], r["n"], r["word"]): r["bits"] % (1 << 64) for r in divergence.bitmaps(kept).collect()}
    assert rows == {("a", 0, 5, 0): 1 | 1 << 63, ("a", 0, 5, 1): 1, ("a", 0, 7, 7): 1 << 63, ("a", 1, 5, 0): 1, ("b", 0, 5, 0): 1}


def test_shares_of_huge_counts_are_exact(spark):
    df = spark.createDataFrame([(5 * 10**13, 9 * 10**13, 10**6)], "c long, n long, v long")
    assert df.select(divergence.share("c", "n", "v")).first()[0] == 1 + 10**9 * (5 * 10**13 + 1) // (9 * 10**13 + 10**6)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", "a", "en"), (2, "", "b", "en")]])
def test_edges(spark, write_sf, rows):
    assert got(op11(spark, write_sf(rows))) == brute(rows)


def test_query_against_sql(spark, small_dir):
    problems, n = compare(op11(spark, small_dir), duck(small_dir), divergence.ORACLE)
    assert not problems and n
