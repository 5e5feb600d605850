"""Grid operators and experiments on given rows, against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from vetolex.functions import lexicons as L
from vetolex.operators import certify as CE
from vetolex.operators import experiments as X
from vetolex.operators import model as M

# (id, grid, boost, guard): logit, veto confidence (None: the veto does not fire)
GRID = {
    (1, "A", 10, 1): (1.82, None), (1, "A", 10, 3): (1.82, None),       # 0.3 + 0.85 + 0.55 + 0.12
    (2, "A", 10, 1): (-0.88, None), (2, "A", 10, 2): (-0.88, None),     # -0.2 - 1.9 + 1.1 + 0.12; the words guard
    (2, "A", 10, 3): (-0.88, 0.9405),                                   # 0.75 + 0.2 * 20 / 21
    (3, "A", 10, 1): (-0.63, 0.75), (3, "A", 10, 3): (-0.63, 0.75),     # 0.85 - 0.95 - 0.65 + 0.12; emojis balance
    (2, "B", 1, 2): (0.83, None), (2, "B", 1, 3): (0.83, 0.8833),       # -0.2 - 0.19 + 1.1 + 0.12; 0.75 + 0.2 * 2 / 3
}


def test_grid_rows_by_hand(spark):
    rows = [(1, 0.3, 10, 0, 1, 0, 0), (2, -0.2, 0, 20, 2, 0, 1), (3, 0.0, 10, 10, 0, 1, 0)]
    df = spark.createDataFrame(rows, "id long, text_logit double, emoji_pos_count int, emoji_neg_count int, "
                                     "word_pos_count int, word_neg_count int, label int")
    configs = X.grid_configs("A", (10,)) + X.grid_configs("B", (1,), proportional=True)
    got = {(r.id, r.grid, r.boost, r.guard): r for r in X.grid_rows(df, M.fixed_model(spark), configs).collect()}
    assert len(got) == 18
    for key, (logit, veto) in GRID.items():
        r = got[key]
        p1 = 1 / (1 + math.exp(-logit))
        assert r.grid_veto == (veto is not None) and r.grid_prediction == (0 if veto else int(logit > 0)), key
        assert abs(r.grid_confidence - (veto or max(p1, 1 - p1))) < 1e-9, key


def test_feature_sets_and_cumulative_columns(spark):
    """Which columns each experiment adds, and what they count: plain occurrences, a pair per lexicon."""
    assert {n: list(c) for n, c in X.feature_sets()} == {
        "text_only": [], "text_presence": ["has_emoji"], "text_count": ["has_emoji", "emoji_count"], "text_polarity": ["early_pos", "early_neg"]}
    sets = X.cumulative_sets()
    assert [len(c) for _, c in sets] == [2, 4, 6]
    df = spark.createDataFrame([("so good 😊😊 😭 :) :( awful",)], "text string")
    r = df.select(*[v.alias(k) for k, v in sets[-1][1].items()]).first().asDict()
    assert (r["emoji_pos"], r["emoji_neg"], r["emoticon_pos"], r["emoticon_neg"]) == (2, 1, 1, 1) and r["word_pos"] == r["word_neg"] == 1
    r = df.select(*[v.alias(k) for k, v in X.feature_sets()[2][1].items()]).first()
    assert (r.has_emoji, r.emoji_count) == (1, 3)


def test_boost_floor_names_the_best(spark):
    rows = [(5, True, 0.6), (5, False, 0.9), (10, True, 0.7), (10, True, 0.8), (15, True, 0.9), (15, True, 0.6)]
    out = X.boost_floor(spark.createDataFrame(rows, "boost int, passed boolean, confidence double")).collect()
    # 10 and 15 pass both with equal average confidence: the smaller boost is the minimum that works
    assert {r.boost: (r.passed, r.avg_confidence, r.best) for r in out} == {5: (1, 0.75, False), 10: (2, 0.75, True), 15: (2, 0.75, False)}


def test_guard_scores_extended_cases_with_the_base_model(spark, monkeypatch):
    from vetolex.plans import q_experiments as Q
    asked = []

    class Fits:
        def fit_all(self, keys):
            asked.extend(keys)
            return {k: (None, M.fixed_model(spark)) for k in keys}
    monkeypatch.setattr(Q, "fits", lambda *_: Fits())
    out = {r.category: r for r in Q.q_exp_guard(spark, "unused").collect()}
    assert asked == [(L.EMOJI_BOOST, False)]
    # "beautiful" is a word of the extended list only, one of them does not stop the veto (guard 2)
    assert out["pos-overwhelm"].total == 2 and out["sarcasm"].fires == 3
    asked.clear()
    floor = Q.q_exp_boost_floor(spark, "unused").collect()
    assert asked == [(b, False) for b in X.BOOSTS_FLOOR] and sum(r.best for r in floor) == 1
    assert {r.boost: r.passed for r in floor}[5] < {r.boost: r.passed for r in floor}[10]


def test_veto_strategies_and_integrity(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 0, 10, 1, 0), (2, 0, 0.5, 0, 10, 0, 0), (3, 1, 0.5, 10, 0, 0, 0)],
                                 "id long, label int, text_logit double, emoji_pos_count int, emoji_neg_count int, word_pos_count int, word_neg_count int")
    heavy = M.LinearTextModel(M.fixed_model(spark).weights, 2.0, dict(M.FIXED_NUMERIC_COEF), len(M.FIXED_TEXT_WEIGHTS))
    out = {r.strategy: r for r in X.veto_strategy(heavy, lambda m: rows, X.case_rows(spark, X.INTEGRITY_CASE, extended=True)).collect()}
    assert [round(out[s].accuracy, 4) for s, _ in X.STRATEGIES] == [0.6667, 1.0, 0.6667]
    assert [round(out[s].delta, 4) for s, _ in X.STRATEGIES] == [0.0, 0.3333, 0.0]
    assert [out[s].integrity_veto for s, _ in X.STRATEGIES] == [False, False, True]


def test_decision_per_metric_winner(spark):
    names = "grid string, boost int, guard int, accuracy double, f1 double, behavioral double, sarcasm long, pos_overwhelm long"
    a = spark.createDataFrame([("A", 10, 2, 0.8, 0.8, 0.9, 3, 1), ("A", 5, 2, 0.9, 0.9, 0.5, 0, 2)], names)
    b = spark.createDataFrame([("B", 3, 2, 0.8, 0.7, 0.9, 3, 2)], names)
    out = {r.metric: (r.winner, r.adopted) for r in X.decision(a, b).collect()}
    assert out == {"accuracy": ("tie", "B"), "f1": ("A", "B"), "behavioral": ("tie", "B"), "sarcasm": ("tie", "B"), "pos_overwhelm": ("B", "B")}
    worse = b.withColumn("sarcasm", F.lit(2))
    assert {r.adopted for r in X.decision(a, worse).collect()} == {"A"}


def test_verification_run_counts_core_cases_only(spark):
    cases = CE.VERIFICATION_CASES + CE.KNOWN_LIMITATIONS
    assert len(CE.VERIFICATION_CASES) == 9 and len(cases) == 11
    cf = CE.cases_frame(spark, cases, "text string, expected int, category string")
    # right on all but the overwhelm case, and wrong on one limitation
    rec = cf.select("id", F.when((F.col("category") == "pos-overwhelm") | (F.col("id") == 10), 1 - F.col("expected")).otherwise(F.col("expected")).alias("prediction_int"))
    out = {r.category: (r.passed, r.total, r.counted) for r in CE.verify_behaviour(rec, cf).collect()}
    assert out == {"sarcasm": (3, 3, True), "pos-overwhelm": (0, 1, True), "genuine-sad": (2, 2, True), "text-dominant": (3, 3, True),
                   "known-limitation": (1, 2, False), "core": (8, 9, True)}


def test_audit_and_golden_rows(spark):
    drivers = "top_drivers array<struct<token:string,weight:double>>"
    rec = spark.createDataFrame([(0, "Positive", 0.9, False, "Clear Signal", "t", [("a", 1.0)]), (1, "Negative", 0.8, True, None, "t", []),
                                 (2, "Negative", 0.85, True, "Clear Signal", "t", [("word_neg_count", -1.0)])],
                                f"id long, prediction string, confidence double, veto_applied boolean, entropy_flag string, timestamp string, {drivers}")
    assert {r.id: (r.audit_ok, r.n_drivers, r.all_valid) for r in CE.audit_report(rec).collect()} == {
        0: (True, 1, False), 1: (False, 0, False), 2: (True, 1, False)}
    assert {r.id: (r.path, r.hardcoded_085, r.in_range) for r in CE.confidence_audit(rec).collect()} == {
        0: ("model", False, True), 1: ("veto", False, True), 2: ("veto", True, True)}
    cases = CE.cases_frame(spark, [("x", "Positive", "a"), ("y", "Positive", "b"), ("z", "Negative", "word_neg_count")],
                           "text string, expected string, expected_driver string")
    assert {r.id: (r.label_ok, r.driver_ok) for r in CE.golden_behaviour(rec, cases).collect()} == {0: (True, True), 1: (False, False), 2: (True, True)}


@pytest.mark.parametrize("failed", [0, 1])
def test_health_report(spark, failed):
    checks = spark.createDataFrame([("test_veto_x", 0, True), ("test_confidence_y", failed, not failed)], "check string, violations long, passed boolean")
    r = CE.health_report(checks).first()
    assert (r.status, r.exit_code, r.summary.failed, r.recommendation) == (
        ("FAILED", 1, 1, CE.NOT_READY) if failed else ("PASSED", 0, 0, CE.READY))
    assert r.failed_by_category == ({"confidence": ["test_confidence_y"]} if failed else {})


def test_grid_metrics_and_ranking(spark):
    rows = [("A", 10, 10, 2, 1, 1, 0.9), ("A", 10, 10, 2, 0, 1, 0.6), ("A", 10, 10, 1, 1, 0, 0.8),
            ("B", 3, 3, 2, 1, 1, 0.7)]
    df = spark.createDataFrame(rows, "grid string, boost int, threshold int, guard int, label int, "
                                     "grid_prediction int, grid_confidence double")
    res = X.grid_metrics(df)
    got = {(r.grid, r.guard): (r.accuracy, r.f1) for r in res.collect()}
    assert got[("A", 2)] == (0.5, round(2 / 3, 6)) and got[("A", 1)] == (0.0, 0.0) and got[("B", 2)] == (1.0, 1.0)
    best = X.argmax_config(res).first()
    assert (best.grid, best.guard) == ("B", 2)
    d = {(r.grid, r.guard): r.delta_accuracy for r in X.delta_vs_baseline(res).collect()}
    assert d[("A", 2)] == 0.0 and d[("B", 2)] == 0.5


def test_rescale_is_linear(spark):
    df = spark.createDataFrame([(30, 20)], "emoji_pos_count int, emoji_neg_count int")
    r = X.rescale(df, 7).first()
    assert (r.emoji_pos_count, r.emoji_neg_count) == (21, 14)
