import numpy as np
from pyspark.sql import functions as F

from vetolex.llm import rules
from vetolex.llm.queries import op8

SPACE = " \t\n\v\f\r"


def brute(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


def same(rows, out):
    want = {}
    for doc_id, text, *_ in rows:
        want.setdefault(doc_id, []).append(brute(text))
    assert len(out) == len(rows)
    for r in out:
        got = tuple(r)[1:7]
        assert got in want[r["doc_id"]], (r, want[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_query_against_brute_force(spark, small_dir):
    import duckdb
    rows = duckdb.sql(f"select doc_id, text from '{small_dir}/documents.parquet'").fetchall()
    same(rows, op8(spark, small_dir).collect())


def test_edges(spark, write_sf):
    rows = [(1, None), (2, ""), (3, "a a a a"), (4, "x\n \nx\nx y\vz " * 40), (5, "é ü # <b>  " * 30), (6, "w " * 20_000), (7, "p q r p q r"), (7, "p q r p q r"), (None, "z")]
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (None, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    same(rows, op8(spark, write_sf(rows, labels=labels)).collect())
    assert op8(spark, write_sf([], labels=labels.limit(0))).count() == 0


def test_list_finds_planted_conjunctions_and_its_column_agrees(spark):
    rng = np.random.default_rng(0)
    n = 3000
    cols = {c: rng.integers(0, 200, n) for c in rules.COUNTS}
    cols["n_words"] = rng.integers(60, 400, n)
    df = spark.createDataFrame([tuple(int(cols[c][i]) for c in rules.COUNTS) for i in range(n)], ", ".join(f"{c} long" for c in rules.COUNTS))
    rows = df.select("*", *[rules.feature(f).alias(f"f_{f}") for f in rules.FEATURES]).toPandas()
    x = {f: rows[f"f_{f}"].to_numpy(float) for f in rules.FEATURES}
    bad = ((x["symbols_per_word"] > 0.6) & (x["n_words"] <= 250)) | (x["dup_line_share"] > 5)
    found = rules.learn(x, bad)
    covered = np.zeros(n, bool)
    for r in found:
        covered |= rules._covers(r, x)
    assert (covered == bad).mean() > 0.97
    keep = df.select(rules.verdict(found).alias("k")).toPandas().k.to_numpy()
    assert (keep == ~covered).all()


def test_held_out_labels_agree(spark):
    from vetolex.llm.common import table
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    fit = labels.where("doc_id % 2 = 0")
    out = rules.judge_documents(docs, fit).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    r = out.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double")).alias("hit"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 500 and r["hit"] > 0.95
