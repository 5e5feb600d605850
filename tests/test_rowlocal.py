"""Scoring in place: the same results as the joined form, no shuffle, and a stream that survives a killed batch."""

import os
import re

import pyarrow as pa
import pytest

from tests.test_train import EDGE_TEXTS
from vetolex.operators import model as M
from vetolex.operators import rowlocal
from vetolex.operators.features import add_polarity_features
from vetolex.sources.tables import files_state, posts_all, read_table, spread
from vetolex.streaming.score import CONVERSATION_SCHEMA, run_stream_score, score_batch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return {r.id: (r.text_logit, r.p1, r.model_prediction, [tuple(d) for d in r.text_drivers]) for r in df.collect()}


@pytest.mark.parametrize("drivers", [3, 1, None])
def test_equals_the_joined_form(spark, small_dir, drivers):
    model = M.fixed_model(spark)
    extra = spark.createDataFrame([(10**7 + i, t) for i, t in enumerate(EDGE_TEXTS + ("the of the the of", "good good good bad " * 2000))], "id long, text string")
    df = add_polarity_features(posts_all(spark, small_dir).select("id", "text").unionByName(extra))
    here, joined = rows(M.score_relational(df, model, drivers=drivers)), rows(M.score_joined(df, model, drivers=drivers))
    assert here.keys() == joined.keys() and len(here) > 200
    for i, (logit, p1, label, items) in joined.items():
        assert abs(here[i][0] - logit) < 1e-12 and abs(here[i][1] - p1) < 1e-12 and here[i][2:] == (label, items), i


def test_nothing_is_shuffled(spark, small_dir):
    model = M.fixed_model(spark)
    docs = read_table(spark, small_dir, "documents").selectExpr("doc_id AS id", "text")
    for df in (M.predict_sentiment(docs, model), M.scored_frame(docs, model), M.score_relational(add_polarity_features(docs), model)):
        assert "ArrowEvalPython" in plan(df) and not re.search("Exchange|Join|Aggregate|Sort", plan(df))


def test_keeps_the_rows_and_columns_of_the_input(spark):
    """Repeated keys, null keys and other columns: one row out for each row in."""
    df = add_polarity_features(spark.createDataFrame([(1, "good", "a"), (1, "good", "b"), (None, "bad", None), (2, None, "c")], "id long, text string, idx string"))
    out = M.score_relational(df, M.fixed_model(spark))
    assert out.columns[:7] == df.columns and sorted((r.idx or "") for r in out.collect()) == ["", "a", "b", "c"]
    assert M.score_relational(df.limit(0), M.fixed_model(spark)).count() == 0


def test_the_bound_is_on_measured_bytes(spark):
    model = M.fixed_model(spark)
    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    try:
        for value, sent in (("1", False), ("1g", True), ("-1", False), ("64kb", True)):
            spark.conf.set(key, value)
            assert (model.sent() is not None) == sent
    finally:
        spark.conf.set(key, held)


def test_packed_weights_need_no_pairs_and_no_rows():
    w = rowlocal.PackedWeights(pa.table({"term": ["a"], "idx": [0], "idf": [2.0], "coef": [-0.5], "shown": [-0.5]}))
    out = w.score(pa.array([["a", "b", "a"], [], None, ["b"]], pa.list_(pa.string())), 3).to_pylist()
    assert [r["text_logit"] for r in out] == [-0.5, 0, 0, 0] and [len(r["text_drivers"]) for r in out] == [1, 0, 0, 0]
    assert len(w.score(pa.array([], pa.list_(pa.string())), 3)) == 0


def test_a_slice_of_a_batch_scores_like_the_whole():
    w = rowlocal.PackedWeights(pa.table({"term": ["a", "a b", "b"], "idx": [0, 1, 2], "idf": [2.0, 1.0, 3.0], "coef": [-0.5, 4.0, 1.0], "shown": [-0.5, 4.0, 1.0]}))
    lists = pa.array([["a", "b"], ["b", "a"], ["a", "b", "a", "b"], ["b"]])
    assert w.score(lists.slice(1, 2), None).to_pylist() == w.score(lists, None).to_pylist()[1:3]


def _conversations(spark, path, n_files=4):
    words = ["good", "bad", "love having bugs 😭", "the of", "great 😊"]
    for f in range(n_files):
        df = spark.createDataFrame([(f, i, "user", f"{words[(f + i) % 5]} {i}") for i in range(6)], CONVERSATION_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(path)


def test_a_killed_batch_runs_again_and_is_in_the_sink_once(spark, tmp_path):
    source, sink, ckpt = (str(tmp_path / x) for x in ("source", "sink", "ckpt"))
    _conversations(spark, source)
    model = M.fixed_model(spark)
    first = run_stream_score(spark, source, sink, ckpt, model, max_files_per_trigger=2)
    commits = sorted(int(f) for f in os.listdir(f"{ckpt}/commits") if f.isdigit())
    assert first.count() == 24 and len(commits) >= 2
    # killed after the sink's commit, before the query's own: the batch is run again on restart
    for name in (str(commits[-1]), f".{commits[-1]}.crc"):
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")
    # and a task's file that no commit names
    score_batch(spark.read.schema(CONVERSATION_SCHEMA).parquet(source).limit(1), model).coalesce(1).write.mode("append").parquet(sink + "-stray")
    stray = next(f for f in os.listdir(sink + "-stray") if f.endswith(".parquet"))
    os.link(f"{sink}-stray/{stray}", f"{sink}/{stray}")
    _conversations(spark, source, 1)
    again = run_stream_score(spark, source, sink, ckpt, model, max_files_per_trigger=2).drop("timestamp")
    whole = score_batch(spark.read.schema(CONVERSATION_SCHEMA).parquet(source), model).drop("timestamp")
    assert again.count() == whole.count() == 30
    assert again.exceptAll(whole).count() == 0 and whole.exceptAll(again).count() == 0


def test_a_model_too_large_to_send_streams_through_the_batch_plan(spark, small_dir, tmp_path):
    key = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        source = str(tmp_path / "source")
        _conversations(spark, source, 2)
        out = run_stream_score(spark, source, str(tmp_path / "sink"), str(tmp_path / "ckpt"), M.fixed_model(spark))
        want = score_batch(spark.read.schema(CONVERSATION_SCHEMA).parquet(source), M.fixed_model(spark))
        got = {(r.conv_id, r.turn): r.confidence for r in out.collect()}
        assert got == {(r.conv_id, r.turn): r.confidence for r in want.collect()} and len(got) == 12
    finally:
        spark.conf.set(key, held)


def test_small_tables_are_spread_and_filters_still_reach_the_scan(spark, small_dir, monkeypatch):
    from vetolex.sources import tables
    docs = read_table(spark, small_dir, "documents")
    out = spread(docs.select("doc_id", "text")).where("doc_id < 5").select("doc_id")
    assert out._jdf.rdd().getNumPartitions() == spark.sparkContext.defaultParallelism and out.count() == docs.where("doc_id < 5").count()
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,5)]" in plan(out) and "text" not in plan(out)
    monkeypatch.setattr(tables, "SPREAD_BYTES", 10)
    assert "Exchange" not in plan(spread(docs))


def test_a_table_replaced_in_place_is_another(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    states = []
    for n in (3, 4):
        spark.range(n).write.mode("overwrite").parquet(path)
        states.append(files_state(spark.read.parquet(path)))
    assert states[0] != states[1] and states[1] == files_state(spark.read.parquet(path))
