import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_neardup import brute as components


def test_stages_on_the_small_tables(spark, small_dir):
    """Each stage against brute force on its own input."""
    read = spark.read.parquet(f"{small_dir}/documents.parquet")
    items = duckdb.sql(f"select item_id, text from '{small_dir}/benchmark.parquet'").fetchall()
    docs, kept = read, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, small_dir).cache()
        after = [tuple(r) for r in out.select("doc_id").collect()]
        if name == "toxicity":
            from vetolex.llm import toxicity
            labels = spark.read.parquet(f"{small_dir}/labels.parquet")
            scored = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
            assert sorted(r["doc_id"] for r in scored if r["score"] < 0.7) == sorted(x for x, in after)
        elif name == "near_dedup":
            assert sorted(x for x, in after) == sorted(r[0] for r in components(before, 5) if r[3])
        elif name == "decontaminate":
            assert sorted(x for x, in after) == sorted(r[0] for r in contaminated(before, items) if not r[5])
        elif name == "mix":
            taken = {x for x, in after}
            assert taken <= {i for i, _ in before} and all(sum(a == i for a, in after) <= 2 for i in taken)
        else:
            assert sorted(x for x, in after) == sorted(i for i, _ in before)
            counts = [r["count"] for r in out.groupBy("shard").count().collect()]
            assert max(counts) - min(counts) <= 1
            assert out.columns == [*read.columns, "shard", "slot", "curve"]
            assert sorted(tuple(r) for r in out.select("doc_id", "text").collect()) == sorted(before)
        if name != "shard":
            assert out.columns == read.columns
        docs = out
        kept[name] = len(after)
    assert kept["toxicity"] <= 200 and kept["shard"] == kept["mix"]


def test_edges(spark, write_sf):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None, None, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, long), (5, long + " end"), (6, " ".join(f"q{i}" for i in range(12))), (None, "x y")]
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(10)))], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    d = write_sf(rows, benchmark=bench, labels=labels)
    ids = [r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()]
    assert 6 not in ids and 5 not in ids and all(ids.count(i) <= 2 for i in ids)
    assert corpus_pipeline.run(spark, write_sf([], benchmark=bench, labels=labels)).count() == 0


def test_equal_rows_share_the_copies_of_their_group(spark, make_docs):
    """Every row repeated: the mix holds as many rows of each group as the operator takes, none lost by rounding."""
    from collections import Counter

    from vetolex.llm import entropy, stages
    rows = [(i, f"w{i} " * (i % 7 + 1), f"s{i % 3}") for i in range(12) for _ in range(i % 5 + 1)] + [(None, "a b c", None)] * 7
    docs = make_docs(rows)
    want = Counter()
    for r in entropy.mix_documents(docs).collect():
        want[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in stages.mix(spark, docs, "").collect())
    assert got == +want and max(got.values()) > 1


def test_columns_of_any_name_stay(spark, write_sf, make_docs):
    """Documents whose other columns have the names that stages would use."""
    from vetolex.llm import stages
    names = ["__row", "__ROW_", "__score", "__n", "__id", "__key", "__text", "__copies", "__times", "__number", "shard", "slot", "row"]
    rows = [(i, f"q{i % 9} " * 6 + " ".join(f"w{i % 9}x{j}" for j in range(8)), "s") for i in range(20)]
    docs = make_docs([*rows, rows[0], rows[0]]).select("doc_id", "text", "lang", "source", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    d = write_sf(rows, benchmark=spark.createDataFrame([(1, "w3x0 w3x1 w3x2 w3x3")], "item_id long, text string"),
                 labels=spark.createDataFrame([(2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        assert out.columns[:len(docs.columns)] == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
