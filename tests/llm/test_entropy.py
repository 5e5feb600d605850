import pytest
from pyspark.sql import functions as F

from tests.oracle_compare import compare, duck
from vetolex.llm import entropy
from vetolex.llm.queries import op5


def test_query_matches_sql_and_targets(spark, small_dir):
    problems, n = compare(op5(spark, small_dir), duck(small_dir), entropy.ORACLE)
    assert not problems and n == 200
    out = op5(spark, small_dir).toPandas()
    assert (out.taken <= 2 * out["size"]).all()


def test_water_level(spark):
    src = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50)], "key string, tokens long")
    got = {r["key"]: r["target"] for r in entropy.capped_targets(src).collect()}
    total = 1.5 * 1160
    assert got["c"] == 20 and got["a"] == 200 and got[None] == 100  # at their ceilings
    assert got["b"] == pytest.approx(total - 320)


def test_two_constraint_columns_converge(spark):
    rows = [("a", "x", 100), ("a", "y", 50), ("b", "x", 30), ("b", "y", 120)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    goal = {"source": [("a", 90.0), ("b", 110.0)], "lang": [("x", 60.0), ("y", 140.0)]}
    fam = {c: spark.createDataFrame(v, "key string, target double") for c, v in goal.items()}
    out = entropy.balance(cells, fam, tol=1e-9).toPandas()
    out["held"] = out.tokens * out.rate
    for c, v in goal.items():
        for k, t in v:
            assert out[out[c] == k].held.sum() == pytest.approx(t, rel=1e-6)
    # an exponential tilt: rates factor over the columns
    r = {(x.source, x.lang): x.rate for x in out.itertuples()}
    assert r["a", "x"] * r["b", "y"] == pytest.approx(r["a", "y"] * r["b", "x"], rel=1e-9)


def test_contradiction_is_an_error(spark):
    cells = spark.createDataFrame([("a", "x", 10)], "source string, lang string, tokens long")
    fam = {"source": spark.createDataFrame([("a", 5.0)], "key string, target double"),
           "lang": spark.createDataFrame([("x", 9.0)], "key string, target double")}
    with pytest.raises(ValueError, match="constraints"):
        entropy.balance(cells, fam, max_steps=5)


def test_edges(spark, write_sf):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 500, None), (3, "w " * 500, None), (4, "x y", "b"), (None, "p q r", "b")]
    out = op5(spark, write_sf(rows)).toPandas()
    assert len(out) == 6 and (out.taken <= 2 * out["size"]).all() and out["target"].notna().all()
    assert op5(spark, write_sf([])).count() == 0


def test_sources_come_near_their_targets(spark, make_docs):
    rows = [(i, "w " * (1 + i * 7 % 90), "big" if i % 3 else f"s{i % 5}") for i in range(600)]
    out = entropy.mix_documents(make_docs(rows)).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 90 for r in out)
