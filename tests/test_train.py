"""MLlib training: the fit converges near the optimum, both scorers agree (≤ 1e-9), settings and gates hold."""

import os

import pytest
from pyspark.sql import functions as F

from vetolex.operators import gates as G
from vetolex.operators import model as M
from vetolex.operators import persist as PS
from vetolex.operators import train as TR

# Texts of kinds that scorers have disagreed on.
EDGE_TEXTS = (None, "", "   ", "q", "7", "__", "q r s", "Übergröße naïveté Ærøskøbing", "ĲSSELMEER İzmir", "echo echo echo ECHO Echo",
              "...!?;:", "don't can't", "tab\tline\nfeed\rreturn", "👍👍👍", "🙂 :) 😭 :(", "x" * 5000, "river stone " * 800, "1234 56 7,890",
              "snake_case_words and-hyphens", "日本語 テキスト", "a b c d e f g h")


def corpus(n=80):
    """Rows of a rule: a mood of each label's own words, a topic that both share, now and then an emoji."""
    moods = {1: ("splendid", "gentle", "cheerful", "bright"), 0: ("dreary", "bitter", "gloomy", "stale")}
    topics = ("harbour walk", "train ride", "soup kettle", "paper lantern", "garden fence")
    rows = []
    for i in range(n):
        y = i % 2
        text = f"{topics[i % 5]} was {moods[y][i // 2 % 4]} and {moods[y][i // 3 % 4]}"
        if i % 7 == 0:
            text += " 😊" if y else " 😭"
        rows.append((i, y, text))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.createDataFrame(corpus(), "id long, label int, text string")
    return TR.trained_run(df)


def test_converges_with_all_cores_and_is_near_the_optimum(fitted):
    run, fit, model, vec = fitted
    assert 0 < fit.iterations < 100 and fit.max_gradient <= TR.TOL
    assert run.n_text > 0 and model.n_text == run.n_text and run.n_train == run.n_train_all == 64
    assert TR.gradient_norm(run, model) < 1e-3


def test_fit_equals_the_library_solver(fitted):
    """MLlib's own solver, given enough steps, ends at the same weights."""
    from pyspark.ml.classification import LogisticRegression
    run, fit, _, vec = fitted
    other = LogisticRegression(maxIter=3000, regParam=1.0 / run.n_train, elasticNetParam=0.0, standardization=False, tol=1e-12).fit(vec.coalesce(1).cache())
    assert abs(other.coefficients.toArray() - fit.model.coefficients.toArray()).max() < 5e-3 and abs(other.intercept - fit.model.intercept) < 5e-3


def test_scale_of_columns_does_not_hang_on_the_order_of_rows(spark, fitted):
    """Each scale row first in its partition: the columns' variance is that of the data and the floor, and the fit converges."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.stat import Summarizer
    run, _, _, vec = fitted
    n, width = run.n_train, run.n_text + 4
    scale = TR._scale_rows(spark, run.n_text, width, n)
    own = vec.select("label", "features", F.lit(1.0).alias("weight"))
    parts = [scale.where(f"label = {y}").unionByName(own.where(f"label = {y}")).coalesce(1) for y in (0, 1)]
    rows = parts[0].unionByName(parts[1])
    got = rows.agg(Summarizer.variance(F.col("features"), F.col("weight")).alias("v")).first().v.toArray()[:run.n_text]
    x = np.array([r.features.toArray()[:run.n_text] for r in own.collect()])
    assert np.allclose(got, x.var(axis=0, ddof=1) + TR.COLUMN_FLOOR / n, rtol=0.05)
    lr = LogisticRegression(regParam=1.0 / n, standardization=False, weightCol="weight", tol=TR.SOLVER_TOL, maxIter=100)
    assert TR.max_gradient(vec, lr.fit(rows), n) <= TR.TOL


def test_iteration_bound_is_an_error(fitted):
    run, _, _, vec = fitted
    with pytest.raises(TR.NotConverged):
        TR.train_logistic(vec, run.n_train, max_iter=2)


def test_fit_rows_are_bounded_by_split_hash(spark):
    df = spark.createDataFrame(corpus(), "id long, label int, text string")
    runs = [TR.prepare(df, max_fit_rows=20) for _ in range(2)]
    assert runs[0].n_train == 20 and runs[0].n_train_all == 64
    ids = [sorted(r.id for r in run.rows("train").collect()) for run in runs]
    assert ids[0] == ids[1] and len(ids[0]) == 20 and runs[0].rows("val").count() == 16


def test_parity_on_splits_and_edge_texts(spark, fitted):
    run, fit, model, vec = fitted
    lr = fit.model
    val = run.rows("val")
    assert TR.parity_check(M.score_relational(val, model), TR.score_mllib(lr, TR.assemble_hybrid(run, val))).first().passed
    assert TR.parity_check(M.score_relational(run.rows("train"), model), TR.score_mllib(lr, vec)).first().passed
    from vetolex.operators.features import add_polarity_features
    edge = add_polarity_features(spark.createDataFrame([(i, 0, t) for i, t in enumerate(EDGE_TEXTS)], "id long, label int, text string"))
    rel = M.score_relational(edge, model)
    r = TR.parity_check(rel, TR.score_mllib(lr, TR.assemble_hybrid(run, edge))).first()
    assert r.passed and r.n == len(EDGE_TEXTS) and r.max_abs_diff <= 1e-9
    other = M.parity_join(rel, M.score_rowwise(edge, model)).collect()
    assert len(other) == len(EDGE_TEXTS) and all(abs(x.p1_a - x.p1_b) < 1e-9 and x.pred_a == x.pred_b for x in other)


def test_scorers_agree_without_any_broadcast(spark, fitted):
    """The large-vocabulary path: the joins on terms shuffle."""
    run, _, model, _ = fitted
    key = "spark.sql.autoBroadcastJoinThreshold"
    adaptive = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    want = {r.id: r.p1 for r in M.score_relational(run.rows("val"), model).collect()}
    held = spark.conf.get(key)
    spark.conf.set(key, "-1")
    spark.conf.set(adaptive, "-1")
    try:
        scored = M.score_relational(run.rows("val"), model)
        got = {r.id: r.p1 for r in scored.collect()}
        plan = scored._jdf.queryExecution().executedPlan().toString()
        tf = TR.tfidf_rows(run, run.rows("val")).collect()
    finally:
        spark.conf.set(key, held)
        spark.conf.unset(adaptive)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    norms = {}
    for r in tf:
        norms[r.id] = norms.get(r.id, 0) + r.value ** 2
    assert norms and all(abs(v - 1) < 1e-9 for v in norms.values())


def test_save_load_roundtrip(spark, tmp_path):
    m = M.fixed_model(spark)
    path = PS.save_model(m, str(tmp_path / "m"))
    again = PS.load_model(spark, path)
    assert again.n_text == m.n_text and abs(again.intercept - m.intercept) < 1e-15
    assert again.numeric_coef == m.numeric_coef and again.settings == m.settings
    assert again.weights.exceptAll(m.weights).count() == 0


@pytest.mark.parametrize("setting,value", [("token_pattern", "[a-z]+"), ("lowercase", False), ("ngram_min", 2), ("norm", "l1"), ("sublinear_tf", True)])
def test_a_saved_model_with_other_settings_is_refused(spark, tmp_path, setting, value):
    path = PS.save_model(M.fixed_model(spark), str(tmp_path / "m"))
    params = spark.read.json(os.path.join(path, "params")).withColumn(setting, F.lit(value)).collect()
    spark.createDataFrame(params).coalesce(1).write.mode("overwrite").json(os.path.join(path, "params"))
    with pytest.raises(M.UnsupportedModel, match=setting):
        PS.load_model(spark, path)


def test_gates_raise(spark, fitted):
    _, fit, model, _ = fitted
    lr = fit.model
    good = G.model_config_gate(model, lr.numClasses, lr.numFeatures)
    assert G.enforce(good, "settings").count() == 13
    with pytest.raises(G.GateFailed, match="width"):
        G.enforce(G.model_config_gate(model, 2, lr.numFeatures + 1), "settings")
    with pytest.raises(G.GateFailed, match="binary"):
        G.enforce(G.config_gate(spark, M.TextSettings(binary=True), 2, 9, 5, 4), "settings")
    f1 = spark.createDataFrame([(0.84015,)], "f1 double")
    assert G.enforce(G.metric_gate(f1, 0.8402), "metric").first().passed
    for value in (0.84, None):
        with pytest.raises(G.GateFailed):
            G.enforce(G.metric_gate(spark.createDataFrame([(value,)], "f1 double"), 0.8402), "metric")
    w = spark.createDataFrame([("emoji_pos_count", 0.1), ("emoji_neg_count", 0.2)], "term string, coef double")
    with pytest.raises(G.GateFailed, match="emoji_neg_count"):
        G.enforce(G.sign_gate(w), "signs")
