import hashlib
import re

from vetolex.llm import decontaminate
from vetolex.llm.common import bit_filter
from vetolex.llm.queries import op6

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i:i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        said = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), said, bool(hit)))
    return out


def run(spark, d):
    return sorted((tuple(r) for r in op6(spark, d).collect()), key=repr)


def test_query_against_brute_force(spark, small_dir):
    import duckdb
    get = lambda q: duckdb.sql(q).fetchall()
    docs = get(f"select doc_id, text from '{small_dir}/documents.parquet'")
    items = get(f"select item_id, text from '{small_dir}/benchmark.parquet'")
    want = sorted(brute(docs, items), key=repr)
    assert run(spark, small_dir) == want and any(r[5] for r in want)


def test_edges(spark, write_sf):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, "Alpha beta, GAMMA"), (3, None), (4, ""), (5, "!!"), (10, " ".join(f"w{i}" for i in range(5, 25))), (6, "é ü"), (None, "zz"),
             (7, "a a a a a a a a a a a a")]
    docs = [(1, None), (2, ""), (3, f"x {long} y"), (4, "alpha-beta gamma alpha beta"), (5, " ".join(f"w{i}" for i in range(3, 14))),
            (6, "É ü é Ü"), (7, "a " * 30), (7, "a " * 30), (8, "w1 w2 w3"), (9, f"{long} {long}".upper()), (None, "zz top"), (11, "q " * 30_000 + long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = run(spark, write_sf(docs, benchmark=bench))
    # an item without an id has no name to report, its words are hit all the same
    want = brute(docs, [(i, t) for i, t in items if i is not None])
    assert [r for r in got if r[0] is not None] == sorted((r for r in want if r[0] is not None), key=repr)
    assert [r[2:4] for r in got if r[0] is None] == [(1, 0)]
    assert op6(spark, write_sf([], benchmark=bench)).count() == 0
    assert not any(r[5] for r in run(spark, write_sf(docs, benchmark=bench.limit(0))))


def test_prefix_token_is_the_rarest(spark, make_docs):
    docs = make_docs([(1, "a b c d e " * 3), (2, "c d e f g")])
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    w = decontaminate.item_windows(bench)
    tokens = w.selectExpr("k", "posexplode(shingles) as (offset, h)")
    counts = {r["h"]: r["c"] for r in decontaminate.token_counts(docs, [5], bit_filter(tokens)).collect()}
    by = [counts.get(r["h"], 0) for r in tokens.orderBy("offset").collect()]
    assert by == [3, 0, 1, 0, 0, 0]
