"""Configuration-grid, report and check-row queries over the fixed model (SQL-checkable parts
of §2.3, §2.4, §2.5, §2.6, §2.7, §2.8, §2.9, §2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import experiments as X
from ..operators import model as M
from ..operators import quality as V
from ..operators.certify import check_rows, health_summary
from ..operators.features import add_polarity_features
from ..sources.tables import posts_all, read_table
from . import sqlfrag as Q
from .q_model import VAL, scored, scored_cte
from .registry import query

PA = Q.posts_all_sql()
GRID_A = X.grid_configs("A", X.BOOSTS_GRID_A)
GRID_B = X.grid_configs("B", X.BOOSTS_GRID_B, proportional=True)
CEILING = X.grid_configs("C", X.BOOSTS_CEILING, guards=(L.VETO_GUARD,))
LANGS = ("de", "en", "es", "fr")


def grid_sql(configs, source=VAL) -> str:
    cfg = Q.values_table(configs, ["grid", "boost", "threshold", "guard"])
    c = dict(M.FIXED_NUMERIC_COEF)
    logit = (f"text_logit + (CAST(e_pos_b AS DOUBLE) * CAST({c['emoji_pos_count']!r} AS DOUBLE) + "
             f"CAST(e_neg_b AS DOUBLE) * CAST({c['emoji_neg_count']!r} AS DOUBLE) + "
             f"CAST(word_pos_count AS DOUBLE) * CAST({c['word_pos_count']!r} AS DOUBLE) + "
             f"CAST(word_neg_count AS DOUBLE) * CAST({c['word_neg_count']!r} AS DOUBLE)) + CAST({M.FIXED_INTERCEPT!r} AS DOUBLE)")
    fired = "(NOT (word_pos_count >= guard AND e_pos_b = 0) AND e_neg_b >= threshold AND e_neg_b >= e_pos_b)"
    return scored_cte(source, extended_words=True) + (
        f", cfg AS {cfg}, "
        "gb AS (SELECT z.*, cfg.grid, cfg.boost, cfg.threshold, cfg.guard, (emoji_pos_count // 10) * cfg.boost AS e_pos_b, "
        "(emoji_neg_count // 10) * cfg.boost AS e_neg_b FROM z, cfg), "
        f"gl AS (SELECT *, {logit} AS grid_logit, {fired} AS grid_veto FROM gb), "
        f"gr AS (SELECT *, CASE WHEN grid_veto THEN 0 WHEN grid_logit > 0 THEN 1 ELSE 0 END AS grid_prediction, "
        f"CASE WHEN grid_veto THEN {Q.veto_confidence('e_neg_b', 'e_pos_b')} ELSE greatest({Q.sigmoid('grid_logit')}, 1 - {Q.sigmoid('grid_logit')}) END AS grid_confidence FROM gl)")


def grid_metrics_sql(configs) -> str:
    f1 = ("CASE WHEN 2 * count_if(label = 1 AND grid_prediction = 1) + count_if(label = 0 AND grid_prediction = 1) + "
          "count_if(label = 1 AND grid_prediction = 0) = 0 THEN 0.0 ELSE 2.0 * count_if(label = 1 AND grid_prediction = 1) / "
          "(2 * count_if(label = 1 AND grid_prediction = 1) + count_if(label = 0 AND grid_prediction = 1) + count_if(label = 1 AND grid_prediction = 0)) END")
    return (f"SELECT grid, boost, threshold, guard, round(avg(CAST(label = grid_prediction AS INTEGER)), 6) AS accuracy, "
            f"round({f1}, 6) AS f1, round(avg(grid_confidence), 6) AS avg_confidence, CAST(count(*) AS BIGINT) AS n FROM gr "
            "GROUP BY grid, boost, threshold, guard")


def grid_frame(spark, sf, configs):
    return X.grid_rows(scored(spark, sf, True, extended_words=True), M.fixed_model(spark), configs)


def results_frame(spark, sf):
    return X.grid_metrics(grid_frame(spark, sf, GRID_A + GRID_B))


RESULTS_SQL = lambda: grid_sql(GRID_A + GRID_B) + ", res AS (" + grid_metrics_sql(GRID_A + GRID_B) + ") "


@query("parametric_veto", lambda: (
    f"SELECT id, g.guard, {Q.veto_fires('emoji_neg_count', 'emoji_pos_count', 'word_pos_count', guard='g.guard')} AS fired "
    f"FROM (SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in Q.polarity_ext('text').items()) + f" FROM {PA}), "
    "(SELECT unnest([1, 2, 3]) AS guard) g"))
def q_parametric_veto(spark, sf):
    f = add_polarity_features(posts_all(spark, sf), extended_words=True)
    x = f.withColumn("guard", F.explode(F.array(*[F.lit(g) for g in X.GUARDS])))
    return x.select("id", "guard", S.sarcasm_veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count",
                                                         guard=F.col("guard")).alias("fired"))


@query("veto_theta", lambda: grid_sql(GRID_B) + " SELECT id, boost, threshold, guard, grid_veto AS fired FROM gr")
def q_veto_theta(spark, sf):
    return grid_frame(spark, sf, GRID_B).select("id", "boost", "threshold", "guard", F.col("grid_veto").alias("fired"))


@query("case_config_cross_join", lambda: grid_sql(GRID_A) + " SELECT id, boost, guard, grid_prediction FROM gr")
def q_case_config_cross_join(spark, sf):
    return grid_frame(spark, sf, GRID_A).select("id", "boost", "guard", "grid_prediction")


@query("avg_confidence", lambda: grid_sql(GRID_A) + " SELECT boost, guard, round(avg(grid_confidence), 6) AS avg_confidence FROM gr GROUP BY boost, guard")
def q_avg_confidence(spark, sf):
    return grid_frame(spark, sf, GRID_A).groupBy("boost", "guard").agg(F.round(F.avg("grid_confidence"), 6).alias("avg_confidence"))


@query("union_results", lambda: grid_sql(GRID_A + GRID_B) + " " + grid_metrics_sql(GRID_A + GRID_B))
def q_union_results(spark, sf):
    """Both grids' results as one table; the rows are scored and aggregated in one pass."""
    return results_frame(spark, sf)


@query("sort_results", lambda: RESULTS_SQL() + "SELECT * FROM res ORDER BY accuracy DESC, f1 DESC, grid, boost, guard")
def q_sort_results(spark, sf):
    return X.sort_results(results_frame(spark, sf))


@query("argmax_config", lambda: RESULTS_SQL() + "SELECT * FROM res ORDER BY accuracy DESC, f1 DESC, grid, boost, guard LIMIT 1")
def q_argmax_config(spark, sf):
    return X.argmax_config(results_frame(spark, sf))


@query("delta_vs_baseline", lambda: RESULTS_SQL() + (
    "SELECT grid, boost, threshold, guard, round(accuracy - (SELECT accuracy FROM res WHERE grid = 'A' AND boost = 10 AND guard = 2), 6) AS delta_accuracy, "
    "round(f1 - (SELECT f1 FROM res WHERE grid = 'A' AND boost = 10 AND guard = 2), 6) AS delta_f1 FROM res"))
def q_delta_vs_baseline(spark, sf):
    return X.delta_vs_baseline(results_frame(spark, sf))


def _with_lang(spark, sf, df):
    langs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return df.join(langs, "id")


@query("pass_by_category", lambda: scored_cte(VAL) + (
    ", lz AS (SELECT z.*, d.lang FROM z JOIN documents d ON z.id = d.doc_id) "
    "SELECT lang, CAST(sum(CAST(label = prediction_int AS INTEGER)) AS BIGINT) AS passed, CAST(count(*) AS BIGINT) AS total FROM lz GROUP BY lang"))
def q_pass_by_category(spark, sf):
    o = E.with_outcome(_with_lang(spark, sf, scored(spark, sf, True)), p="prediction_int")
    return X.pass_by_category(o, "lang")


@query("pass_rate_pivot", lambda: grid_sql(CEILING) + (
    ", lg AS (SELECT gr.*, d.lang FROM gr JOIN documents d ON gr.id = d.doc_id) SELECT boost, "
    + ", ".join(f"round(avg(CASE WHEN lang = '{lg}' THEN CAST(label = grid_prediction AS INTEGER) END), 6) AS {lg}" for lg in LANGS)
    + " FROM lg GROUP BY boost"))
def q_pass_rate_pivot(spark, sf):
    rows = _with_lang(spark, sf, grid_frame(spark, sf, CEILING)).withColumn("correct", F.col("label") == F.col("grid_prediction"))
    return X.pass_rate_pivot(rows, "boost", "lang", LANGS)


@query("exp_scaled_confidence", lambda: (
    "SELECT id, " + Q.veto_fires("e_neg", "e_pos", "w_pos") + " AS fired, "
    f"CASE WHEN {Q.veto_fires('e_neg', 'e_pos', 'w_pos')} THEN {Q.veto_confidence('e_neg', 'e_pos')} END AS confidence, "
    f"CASE WHEN e_neg + e_pos > 0 THEN round({Q.signal_gap('e_neg', 'e_pos')}, 4) ELSE 0.0 END AS signal_gap FROM "
    f"(SELECT id, {Q.polarity_ext('text')['emoji_pos_count']} AS e_pos, {Q.polarity_ext('text')['emoji_neg_count']} AS e_neg, "
    f"{Q.polarity_ext('text')['word_pos_count']} AS w_pos FROM {PA})"))
def q_exp_scaled_confidence(spark, sf):
    f = add_polarity_features(posts_all(spark, sf), extended_words=True)
    fired = S.sarcasm_veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count")
    return f.select("id", fired.alias("fired"),
                    F.when(fired, S.veto_confidence("emoji_neg_count", "emoji_pos_count")).alias("confidence"),
                    F.when(F.col("emoji_neg_count") + F.col("emoji_pos_count") > 0,
                           F.round(S.signal_gap("emoji_neg_count", "emoji_pos_count"), 4)).otherwise(F.lit(0.0)).alias("signal_gap"))


@query("format_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM events")
def q_format_timestamp(spark, sf):
    return read_table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query("label_encode", lambda: scored_cte() + (
    "SELECT id, CASE WHEN (CASE WHEN prediction_int = 1 THEN 'Positive' ELSE 'Negative' END) = 'Positive' THEN 1 ELSE 0 END AS label_int FROM z"))
def q_label_encode(spark, sf):
    out = M.predict_sentiment(posts_all(spark, sf), M.fixed_model(spark))
    return out.select("id", S.label_encode("prediction").alias("label_int"))


# ---------------------------------------------------------------- check rows over scored records

def _scored_records(spark, sf):
    return M.predict_sentiment(posts_all(spark, sf), M.fixed_model(spark))


def _response_sql() -> str:
    rs = ("SELECT z.*, round(confidence_raw, 4) AS confidence, CASE WHEN prediction_int = 1 THEN 'Positive' ELSE 'Negative' END AS prediction, "
          "CASE WHEN confidence_raw < 0.7 THEN 'High Ambiguity' ELSE 'Clear Signal' END AS entropy_flag, "
          "(SELECT count(*) FROM dr WHERE dr.id = z.id AND rnk <= 3) AS n_drivers FROM z")
    return scored_cte() + f", rs AS ({rs}) "


def _check(name, expr, passed=None):
    p = passed or f"CAST({expr} AS BIGINT) = 0"
    frm = "FROM rs" if "count" in expr else ""
    return f"SELECT {Q.lit(name)} AS \"check\", CAST({expr} AS BIGINT) AS violations, {p} AS passed {frm}"


RESPONSE_CHECKS = [
    ("response_keys", "0"),
    ("response_types", "0"),
    ("label_values", "count_if(prediction NOT IN ('Positive', 'Negative'))"),
    ("label_int_values", "count_if(prediction_int NOT IN (0, 1))"),
    ("confidence_range", "count_if(confidence < 0.5 OR confidence > 1.0 OR confidence IS NULL)"),
    ("flag_values", "count_if(entropy_flag NOT IN ('High Ambiguity', 'Clear Signal'))"),
    ("driver_count", "count_if(n_drivers > 3)"),
    ("label_consistency", "count_if((prediction = 'Positive') <> (prediction_int = 1))"),
]
AUDIT_CHECKS = [
    ("driver_fields", "0", None), ("flag_valid", "count_if(entropy_flag NOT IN ('High Ambiguity', 'Clear Signal'))", None),
    ("timestamp_present", "0", None), ("empty_drivers", "count_if(n_drivers = 0)", "TRUE"),
]
VETO_CHECKS = [
    ("veto_confidence_range", "count_if(veto_applied AND (confidence < 0.75 OR confidence > 0.95))"),
    ("model_confidence_range", "count_if(NOT veto_applied AND (confidence < 0.5 OR confidence > 1.0))"),
    ("no_hardcoded_085", "count_if(veto_applied AND confidence = 0.85)"),
]


@query("validate_response", lambda: _response_sql() + " UNION ALL ".join(_check(n, e) for n, e in RESPONSE_CHECKS))
def q_validate_response(spark, sf):
    return V.validate_response(_scored_records(spark, sf))


@query("validate_audit", lambda: _response_sql() + " UNION ALL ".join(_check(n, e, p) for n, e, p in AUDIT_CHECKS))
def q_validate_audit(spark, sf):
    return V.validate_audit(_scored_records(spark, sf))


@query("validate_veto_range", lambda: _response_sql() + " UNION ALL ".join(_check(n, e) for n, e in VETO_CHECKS))
def q_validate_veto_range(spark, sf):
    return V.validate_veto_range(_scored_records(spark, sf))


def _all_checks_sql() -> str:
    body = " UNION ALL ".join([_check(n, e) for n, e in RESPONSE_CHECKS] + [_check(n, e) for n, e in VETO_CHECKS])
    return _response_sql() + f", ck AS ({body}) "


@query("categorize_checks", lambda: _all_checks_sql() + f"SELECT \"check\", {Q.categorize('\"check\"')} AS category, passed FROM ck")
def q_categorize_checks(spark, sf):
    return check_rows(_scored_records(spark, sf)).select("check", S.categorize_check("check").alias("category"), "passed")


@query("health_summary", lambda: _all_checks_sql() + (
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count_if(passed) AS BIGINT) AS passed, CAST(count_if(NOT passed) AS BIGINT) AS failed, "
    "CASE WHEN count_if(NOT passed) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, "
    "CASE WHEN count_if(NOT passed) = 0 THEN 'Ready for Deployment' ELSE 'Do Not Deploy — Behavioral Regression Detected' END AS recommendation FROM ck"))
def q_health_summary(spark, sf):
    return health_summary(check_rows(_scored_records(spark, sf)))
