"""Stored results appear whole or not at all; a run that is worse than the accepted one raises."""

import os

import pytest
from pyspark.sql import functions as F

from vetolex.operators import features as FE
from vetolex.operators import gates as G
from vetolex.operators import model as M
from vetolex.operators import persist as PS
from vetolex.operators import versions

POSTS = "id long, label int, text string"


def test_readers_see_the_version_published_last(spark, tmp_path):
    root = str(tmp_path / "t")
    assert versions.current(spark, root) is None
    paths = [versions.commit(spark, root, lambda p, n=n: spark.range(n).write.parquet(p)) for n in (3, 5)]
    assert len(set(paths)) == 2 and versions.current(spark, root) == paths[1] and spark.read.parquet(versions.current(spark, root)).count() == 5
    assert spark.read.parquet(paths[0]).count() == 3

    def fails(path):
        spark.range(9).write.parquet(path)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        versions.commit(spark, root, fails)
    assert versions.current(spark, root) == paths[1] and sorted(f for f in os.listdir(root) if f.startswith("v-")) == sorted(os.path.basename(p) for p in paths)


def test_a_publication_that_was_not_committed_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "t")
    path = versions.commit(spark, root, lambda p: spark.range(1).write.parquet(p))
    os.makedirs(f"{root}/{versions.LOG}/_temporary/0")
    with open(f"{root}/{versions.LOG}/_temporary/0/part-0.json", "w") as f:
        f.write('{"seq":9,"version":"v-none"}\n')
    assert versions.current(spark, root) == path


def test_a_save_that_stops_between_weights_and_params_leaves_the_old_model(spark, tmp_path, monkeypatch):
    root, old = str(tmp_path / "m"), M.fixed_model(spark)
    PS.save_model(old, root)
    new = M.LinearTextModel(old.weights.withColumn("coef", F.col("coef") * 2), 9.0, old.numeric_coef, old.n_text)

    def stop(*_a, **_k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", stop)   # params are made after the weights are written
        with pytest.raises(KeyboardInterrupt):
            PS.save_model(new, root)
    again = PS.load_model(spark, root)
    assert again.intercept == old.intercept and again.weights.exceptAll(old.weights).count() == 0
    PS.save_model(new, root)
    again = PS.load_model(spark, root)
    assert again.intercept == 9.0 and again.weights.exceptAll(new.weights).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        PS.load_model(spark, str(tmp_path / "none"))


def test_a_feature_table_is_stored_only_if_its_checks_pass(spark, tmp_path):
    path = str(tmp_path / "features")
    good = spark.createDataFrame([(1, 1, "happy 😊"), (2, 0, "bad 😭"), (2, 0, "bad 😭")], POSTS)
    with pytest.raises(FileNotFoundError):
        FE.read_feature_table(spark, path)
    checks = {r.check: (r.violations, r.passed, r.rows) for r in FE.write_feature_table(good, path).collect()}
    assert checks == {c: (0, True, 3) for c in ("no_nulls", "non_negative_counts", "binary_labels")}
    for rows, what in (([(1, None, "x")], "no_nulls: 1"), ([(1, 1, None), (2, None, None)], "no_nulls: 3"), ([(1, 2, "x")], "binary_labels: 1")):
        with pytest.raises(FE.InvalidFeatures, match=what):
            FE.write_feature_table(spark.createDataFrame(rows, POSTS), path)
    with pytest.raises(FE.InvalidFeatures, match="required_columns"):
        FE.write_feature_table(good.drop("label"), path)
    stored = FE.read_feature_table(spark, path)
    assert stored.exceptAll(FE.add_polarity_features(good)).count() == 0 and stored.count() == 3
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 1
    FE.write_feature_table(good.limit(0), path)
    assert FE.read_feature_table(spark, path).count() == 0


def test_the_checks_need_no_second_scan(spark, tmp_path, small_dir):
    """Rows read by the write: a scan's accumulators count each row once."""
    from vetolex.sources.tables import posts
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = posts(spark, small_dir).mapInArrow(count, POSTS)
    n = df.count()
    before = seen.value
    FE.write_feature_table(df, str(tmp_path / "f"))
    assert seen.value - before == n


def test_runs_are_gated_by_the_last_accepted_one(spark, tmp_path):
    history = str(tmp_path / "runs")
    metric = lambda v: spark.createDataFrame([(v,)], "f1 double")
    assert G.runs(spark, history).count() == 0
    first = G.gate_against_history(metric(0.81234), history).first()
    assert (first.value, first.benchmark, first.passed) == (0.8123, None, True)
    for worse in (0.8, None):
        with pytest.raises(G.GateFailed):
            G.gate_against_history(metric(worse), history)
    assert G.gate_against_history(metric(0.80), history, tolerance=0.02).first().benchmark == 0.8123
    assert G.gate_against_history(metric(0.805), history).first().benchmark == 0.8
    rows = [(r.seq, r.value, r.accepted) for r in G.runs(spark, history).orderBy("seq").collect()]
    assert rows == [(1, 0.8123, True), (2, 0.8, False), (3, None, False), (4, 0.8, True), (5, 0.805, True)]
    assert G.gate_against_history(metric(0.1).withColumnRenamed("f1", "accuracy"), history, "accuracy").first().benchmark is None


def test_a_fitted_model_predicts_in_a_session_that_has_observed(spark, tmp_path):
    """An observation in the session must not keep a fitted model from travelling to the tasks."""
    from tests.test_train import corpus
    from vetolex.operators import train as TR
    df = spark.createDataFrame(corpus(40), POSTS)
    FE.write_feature_table(df, str(tmp_path / "f"))
    run, fit, _, vec = TR.trained_run(df)
    assert TR.score_mllib(fit.model, vec).count() == run.n_train
