"""Work that follows the rows once: solver steps, one scoring call, bounded batches and term counts without a table of keys."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vetolex.functions.sql_functions import function_bodies
from vetolex.operators import evaluate as E
from vetolex.operators import model as M
from vetolex.operators import rowlocal
from vetolex.operators import text as TX
from vetolex.operators import train as TR
from vetolex.operators.features import add_polarity_features
from vetolex.plans import q_model


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def many_terms(spark):
    """Rows of a few frequent and very many rare words; chance gives one label in eight."""
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(180_000)]
    rows = [(i, int(rng.random() < 0.88), " ".join(words[60 * i:60 * i + 60])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, label int, text string").repartition(4)


def test_a_fit_over_many_rare_terms_ends_soon_and_sharply(many_terms):
    _, fit, _, _ = TR.trained_run(many_terms)
    assert fit.iterations <= 20 and fit.max_gradient < 1e-7


def test_no_dense_row_leaves_the_driver(spark):
    rows = TR._scale_rows(spark, 3, 5, 100)
    assert "LocalTableScan" not in plan(rows)
    got = {r["label"]: r["features"].toArray() for r in rows.collect()}
    assert np.array_equal(got[0.0], -got[1.0]) and got[0.0][0] == got[0.0][2] > 0 and not got[0.0][3:].any()


def test_filters_do_not_score_again(spark, small_dir):
    s = q_model.scored(spark, small_dir)
    labelled = s.withColumn("label", (F.col("id") % 2).cast("int"))
    for df in (q_model._driver_rows(spark, small_dir), E.danger_cases(labelled), E.decisive_cases(s, M.fixed_model(spark))):
        text = plan(df).split("+- == Initial Plan ==")[0]
        assert len(re.findall(r"(?:ArrowEvalPython|BatchEvalPython) \[", text)) == 1, text


def test_a_batch_is_scored_in_runs(monkeypatch):
    terms = pa.table({"term": ["a", "b", "a b"], "idx": [0, 1, 2], "idf": [1.0, 2.0, 3.0], "coef": [0.5, -1.0, 2.0], "shown": [0.5, -1.0, 2.0]})
    rng, seen = random.Random(1), []
    lists = pa.array([[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(300)] + [[]], pa.list_(pa.string())).slice(3)
    weights = rowlocal.PackedWeights(terms)
    whole = weights.score(lists, 2)
    inner = rowlocal.PackedWeights._score
    monkeypatch.setattr(rowlocal, "TOKENS_AT_ONCE", 100)
    monkeypatch.setattr(rowlocal.PackedWeights, "_score", lambda self, x, d: (seen.append(len(x.flatten())), inner(self, x, d))[1])
    assert weights.score(lists, 2).to_pylist() == whole.to_pylist() and len(seen) > 20 and max(seen) < 130
    assert weights.score(lists.slice(0, 0), 2).to_pylist() == []


def test_terms_are_counted_in_their_row(spark):
    df = spark.createDataFrame([(1, "Bad good BAD good"), (1, "bad good XX xx"), (None, "one two"), (None, "two one two"), (2, ""), (3, None), (4, "x")],
                               "id long, text string")
    tf = TX.term_frequency(df)
    assert not re.search(r"Aggregate\(keys=\[[^\]]*term", plan(tf))
    by_rows = TX.term_occurrences(df, "text").groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    assert sorted(map(str, tf.collect())) == sorted(map(str, by_rows.collect()))


def test_terms_are_tokenized_once(spark):
    df = spark.createDataFrame([(1, "Bad good BAD good"), (2, "")], "id long, text string")
    assert plan(TX.term_frequency(df)).count("regexp_extract_all(") == 2  # the tokens, and the bigrams read off them


def test_partitions_of_rows_follow_the_bytes_read(spark, tmp_path, monkeypatch):
    spark.range(20_000).select("id", F.hex(F.xxhash64("id")).alias("text")).write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(TX, "BYTES_PER_PARTITION", 20_000)
    one, two = TX.by_row(df), TX.by_row(df.union(df))
    assert one.rdd.getNumPartitions() >= 8 and two.rdd.getNumPartitions() >= 1.9 * one.rdd.getNumPartitions()
    assert one.join(df, "id").count() == 20_000


def test_sql_functions_strip_the_low_plane_first(spark):
    body = function_bodies()["vx_emoji_pos_count"][2]
    assert body.count("regexp_replace(") > 2
    df = spark.createDataFrame([("a 😊😊 ❤️ :) b",), ("",), (None,)], "text string")
    both = add_polarity_features(df).select("emoji_pos_count", F.expr(body).alias("by_sql"))
    assert all(r.emoji_pos_count == r.by_sql for r in both.collect())
