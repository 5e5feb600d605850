"""What fits share: text rows are made once for fits side by side, and the training rows are written once for a fit."""

from vetolex.operators import experiments as X
from vetolex.operators import train as TR
from tests.test_train import corpus


def test_side_by_side_fits_make_the_text_rows_once(spark, monkeypatch):
    bf = X.BoostFits(spark.createDataFrame(corpus(), "id long, label int, text string"))
    made = []
    monkeypatch.setattr(TR, "tfidf_rows", lambda run, rows, f=TR.tfidf_rows: made.append(1) or f(run, rows))
    got = bf.fit_all([(5, False), (10, False), (10, True)])
    assert len(got) == 3 and len(made) == 1


def test_a_fit_reads_its_rows_from_the_shared_folder(spark, monkeypatch):
    """The plan that the solver reads again and again has no shuffle, join or Python call in it."""
    run = TR.prepare(spark.createDataFrame(corpus(), "id long, label int, text string"))
    seen = []

    class Spy(TR.LogisticRegression):
        def fit(self, rows):
            seen.append(rows._jdf.queryExecution().executedPlan().toString())
            return super().fit(rows)

    monkeypatch.setattr(TR, "LogisticRegression", Spy)
    TR.train_logistic(TR.assemble_hybrid(run, run.rows("train"), split="train"), run.n_train)
    assert len(seen) == 1 and "FileScan parquet" in seen[0]
    assert not any(x in seen[0] for x in ("Exchange", "EvalPython", "Join"))


def test_vectors_are_made_without_python_and_texts_counted_once(spark, monkeypatch):
    """A stored vector is read back as the sparse vector of its row's entries; training texts are not tokenized again for them."""
    counted = []
    monkeypatch.setattr(TR.T, "term_frequency", lambda rows, f=TR.T.term_frequency: counted.append(1) or f(rows))
    run = TR.prepare(spark.createDataFrame(corpus(), "id long, label int, text string"))
    vec = TR.assemble_hybrid(run, run.rows("train"), split="train")
    assert len(counted) == 1 and "EvalPython" not in vec._jdf.queryExecution().executedPlan().toString()
    entries = {}
    for r in run.tfidf_for("train").collect():
        entries.setdefault(r.id, {})[r.idx] = r.value
    rows = vec.join(run.rows("train").select("id", *run.numeric_cols), "id").collect()
    assert len(rows) == run.n_train and any(len(e) for e in entries.values())
    for r in rows:
        want = entries.get(r.id, {}) | {run.n_text + k: float(r[c]) for k, c in enumerate(run.numeric_cols) if r[c]}
        got = dict(zip(r.features.indices.tolist(), r.features.values.tolist()))
        assert r.features.size == run.n_text + len(run.numeric_cols) and got == want == dict(zip(r.indices, r.x_values))
