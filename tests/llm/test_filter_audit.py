import random
from itertools import permutations
from math import factorial

from tests.oracle_compare import compare, duck
from vetolex.llm import filter_audit
from vetolex.llm.queries import op13

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """Every order replayed over every document."""
    marks = {}
    for doc_id, quality, toxic in labels:
        old = marks.get(doc_id, (False, False))
        marks[doc_id] = (old[0] or quality == 1, old[1] or toxic == 1)
    docs = []
    for r in rows:
        t = r[1] or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t),
                 "E": r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == t for o in rows)}
        docs.append(((r[3] if len(r) > 3 else "en") or "", fails, marks.get(r[0], (False, False)) if r[0] is not None else (False, False)))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in mine)
                steps.append(("".join(order), i, f, len(left), len(gone), failing - len(gone),
                              sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)))
        shapley = {f: sum(s[4] for s in steps if s[2] == f) for f in "ABCDE"}
        out += [(part, o, i, *counts, shapley[f]) for o, i, f, *counts in steps]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", *filter_audit._COUNTS).collect())


def corpus():
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        n = rnd.choice([0, 5, 199, 200, 260])
        vocabulary = rnd.choice([40, 100, 5000])
        words = [rnd.choice(["w", "W", "é", "WW"] if rnd.random() < 0.2 else "w") + str(rnd.randrange(vocabulary)) for _ in range(n)]
        if rnd.random() < 0.3 and words:
            words[0] += rnd.choice("#$%&*|")
        rows.append((i, " ".join(words), "s", rnd.choice(["en", "de", None, ""])))
    for i in range(60):
        rows.append((1000 + i, rnd.choice(rows[:40])[1], "s", rnd.choice(["en", "de"])))
    return rows + [(2000, None), (2001, ""), (2001, ""), (None, rows[3][1]), (None, None), (2002, "x " * 30_000), (5, rows[5][1], "s", "fr")]


def test_corpus_against_replayed_orders(spark, make_docs):
    rows = corpus()
    rnd = random.Random(1)
    labels = [(r[0], rnd.choice([0, 1, None]), rnd.choice([0, 1])) for r in rows if rnd.random() < 0.5] + [(3, 0, 0), (3, 1, 1), (None, 1, 1), (99_999, 1, 1)]
    assert got(filter_audit.audit(make_docs(rows), spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_potentials_give_the_mean_over_orders():
    rnd = random.Random(7)
    for players in (1, 3, 5):
        v = [0] + [rnd.randrange(-50, 50) for _ in range((1 << players) - 1)]
        p = filter_audit.potentials(v, players)
        total = [0] * players
        for order in permutations(range(players)):
            s = 0
            for i in order:
                total[i] += v[s | 1 << i] - v[s]
                s |= 1 << i
        assert [p[len(v) - 1] - p[(len(v) - 1) ^ (1 << i)] for i in range(players)] == total
        assert sum(total) == factorial(players) * v[-1]


def test_a_long_text_is_judged_like_a_short_one(monkeypatch):
    texts = [b"a b a " * 90, b"A" * 30 + b" x" * 400, b"", "é é ".encode() * 200]
    want = [filter_audit.failed(t) for t in texts]
    monkeypatch.setattr(filter_audit, "LONG", 10)
    assert [filter_audit.failed(t) for t in texts] == want


def test_edges(spark, write_sf):
    none = spark.createDataFrame([], LABELS)
    assert got(op13(spark, write_sf([], labels=none))) == []
    rows = [(1, None, None, None)]
    assert got(op13(spark, write_sf(rows, labels=none))) == brute(rows, [])


def test_query_against_sql(spark, small_dir):
    problems, n = compare(op13(spark, small_dir), duck(small_dir), filter_audit.ORACLE)
    assert not problems and n
