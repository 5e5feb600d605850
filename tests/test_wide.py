"""Fits on every training row, of any number of columns."""

import inspect

import pytest
from pyspark.ml.classification import LogisticRegression

from tests.test_train import corpus
from vetolex.operators import model as M
from vetolex.operators import train as TR
from vetolex.operators import wide as W


def test_every_training_row_is_fitted_on(spark):
    """No bound unless a caller gives one."""
    assert inspect.signature(TR.prepare).parameters["max_fit_rows"].default is None and not hasattr(TR, "MAX_FIT_ROWS")
    run = TR.prepare(spark.createDataFrame(corpus(), "id long, label int, text string"))
    assert run.n_train == run.n_train_all == run.rows("train").count() == 64


@pytest.fixture
def wide(monkeypatch):
    """Every fit takes the way of many columns, in small blocks, chunks and pieces."""
    monkeypatch.setattr(TR, "MLLIB_COLUMNS", 0)
    for name, value in (("BLOCK", 300), ("CHUNK", 40), ("TASK", 200), ("SLICE", 16), ("RUN", 16), ("DIRECT", 0)):
        monkeypatch.setattr(W, name, value)


def rows_twice_and_bare():
    """Rows of one id, rows without a known term and none with numerics."""
    return corpus() + [(3, 0, "harbour walk was stale"), (200, 1, "?"), (201, 0, "!"), (202, 1, "unseen")]


def test_a_wide_fit_equals_the_library_solver(spark, wide):
    run, fit, model, vec = TR.trained_run(spark.createDataFrame(rows_twice_and_bare(), "id long, label int, text string"))
    assert isinstance(fit.model, W.WideModel) and fit.max_gradient < 1e-8 and fit.iterations < 60
    other = LogisticRegression(maxIter=3000, regParam=1.0 / run.n_train, standardization=False, tol=1e-14).fit(vec.coalesce(1).cache())
    got = {r.idx: r.coef for r in fit.model.coefficients.collect()}
    assert sorted(got) == list(range(run.n_text + 4))
    assert max(abs(got[i] - x) for i, x in enumerate(other.coefficients.toArray())) < 1e-4 and abs(other.intercept - fit.model.intercept) < 1e-4
    assert TR.gradient_norm(run, model) < 1e-4
    again = TR.train_logistic(vec, run.n_train)  # from the stored vectors
    assert all(abs(got[r.idx] - r.coef) < 1e-6 for r in again.model.coefficients.collect())


def test_a_wide_model_is_also_the_librarys(spark, wide):
    run, fit, model, vec = TR.trained_run(spark.createDataFrame(corpus(), "id long, label int, text string"))
    lr = TR.mllib_model(fit.model)
    assert (lr.numClasses, lr.numFeatures, lr.intercept) == (2, run.n_text + 4, fit.model.intercept)
    assert TR.parity_check(M.score_relational(run.rows("train"), model), TR.score_mllib(fit.model, vec)).first().passed
    assert abs(TR.max_gradient(vec, lr, run.n_train) - fit.max_gradient) < 1e-9


def test_a_wide_fit_that_is_stopped_early_is_an_error(spark, wide):
    run = TR.prepare(spark.createDataFrame(corpus(), "id long, label int, text string"))
    with pytest.raises(TR.NotConverged):
        TR.fit_rows(run, run.rows("train"), max_iter=1)


def test_experiments_agree_on_both_ways(spark, monkeypatch):
    """Feature sets and boosts give the same tables by MLlib's solver and by wide fits, which store the text block once."""
    from vetolex.operators import experiments as X
    df = spark.createDataFrame(corpus(), "id long, label int, text string")
    found, stored, side = [], [], []
    monkeypatch.setattr(X, "fit_many", lambda fns, workers=3, f=X.fit_many: side.append(workers) or f(fns, workers))
    monkeypatch.setattr(W, "text_blocks", lambda *rows, f=W.text_blocks: stored.append(1) or f(*rows))
    for bound in (TR.MLLIB_COLUMNS, 0):
        monkeypatch.setattr(TR, "MLLIB_COLUMNS", bound)
        bf = X.BoostFits(df)
        table = sorted(map(tuple, X.run_feature_experiments(bf.base, X.cumulative_sets()).collect()))
        models = {b: m for (b, _), (_, m) in bf.fit_all([(5, False), (20, False)]).items()}
        logits = {(r.id, r.boost): r.text_logit for r in bf.text_logits("val", models).collect()}
        found.append((table, logits))
    (table, logits), (table_, logits_) = found
    assert table == table_ and len(stored) == 1
    assert side == [3, 3, 1, 1]  # wide fits one after the other
    assert logits.keys() == logits_.keys() and len(logits) == 32 and all(abs(logits[k] - logits_[k]) < 1e-3 for k in logits)


def test_a_fit_that_the_library_ends_too_early_is_finished(spark, monkeypatch):
    """MLlib's solver may stop above the bound on the gradient before it has used its steps."""
    run = TR.prepare(spark.createDataFrame(corpus(), "id long, label int, text string"))
    vec = TR.assemble_hybrid(run, run.rows("train"), split="train")
    monkeypatch.setattr(TR, "SOLVER_TOL", 0.1)
    fit = TR.train_logistic(vec, run.n_train)
    assert isinstance(fit.model, TR.LogisticRegressionModel) and fit.max_gradient < 1e-8
    assert TR.max_gradient(vec, fit.model, run.n_train) < 1e-8
