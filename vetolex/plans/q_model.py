"""Queries for relational TF-IDF, scoring with the fixed model, veto resolution, drivers and
evaluation (§2.5, §2.6, §2.7, §2.8, §2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import model as M
from ..operators import persist as PS
from ..operators import text as T
from ..operators.split import split_sql, stratified_split
from ..sources.tables import posts, posts_all
from . import sqlfrag as Q
from .registry import query

P = Q.posts_sql()
PA = Q.posts_all_sql()
VAL = f"(SELECT id, label, text FROM {split_sql(P)} WHERE split = 'val')"


# ---------------------------------------------------------------- SQL side of the fixed model

def scored_cte(source: str = PA, extended_words: bool = False) -> str:
    """CTEs ``f`` features, ``c`` in-vocabulary term counts, ``z`` resolved rows, ``dr`` ranked drivers."""
    rows = M.fixed_weight_rows()
    w = Q.values_table(rows, ["term", "idx", "idf", "coef"])
    num = " + ".join(f"CAST({c} AS DOUBLE) * CAST({coef!r} AS DOUBLE)" for c, coef in M.FIXED_NUMERIC_COEF)
    n_text = len(M.FIXED_TEXT_WEIGHTS)
    num_drivers = " UNION ALL ".join(
        f"SELECT id, {n_text + k} AS idx, {Q.lit(c)} AS token, CAST({round(coef, 4)!r} AS DOUBLE) AS weight FROM f WHERE {c} <> 0"
        for k, (c, coef) in enumerate(M.FIXED_NUMERIC_COEF))
    veto = Q.veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count")
    pol = Q.polarity_ext("text") if extended_words else Q.polarity("text")
    feats = ", ".join(f"{e} AS {n}" for n, e in pol.items())
    return f"""WITH w AS {w},
f AS (SELECT id, {"" if source == PA else "label, "}text, {feats} FROM {source}),
tk AS (SELECT id, {Q.tokens('text')} AS tok FROM f),
g AS (SELECT id, unnest({Q.ngrams('tok')}) AS term FROM tk),
c AS (SELECT g.id, g.term, w.idx, w.idf, w.coef, count(*) AS tf FROM g JOIN w ON g.term = w.term
      WHERE w.idf IS NOT NULL GROUP BY g.id, g.term, w.idx, w.idf, w.coef),
a AS (SELECT id, sum(tf * idf * coef) / sqrt(sum(tf * idf * tf * idf)) AS text_logit FROM c GROUP BY id),
s AS (SELECT f.*, coalesce(a.text_logit, 0.0) AS text_logit,
      coalesce(a.text_logit, 0.0) + ({num}) + CAST({M.FIXED_INTERCEPT!r} AS DOUBLE) AS logit FROM f LEFT JOIN a ON f.id = a.id),
r AS (SELECT s.*, {Q.sigmoid('logit')} AS p1, CASE WHEN logit > 0 THEN 1 ELSE 0 END AS model_prediction,
      {veto} AS veto_applied FROM s),
z AS (SELECT r.*, CASE WHEN veto_applied THEN 0 ELSE model_prediction END AS prediction_int,
      CASE WHEN veto_applied THEN {Q.veto_confidence('emoji_neg_count', 'emoji_pos_count')} ELSE greatest(p1, 1 - p1) END AS confidence_raw,
      greatest(p1, 1 - p1) AS model_confidence FROM r),
d AS (SELECT id, idx, term AS token, round(coef, 4) AS weight FROM c UNION ALL {num_drivers}),
dr AS (SELECT d.*, row_number() OVER (PARTITION BY d.id ORDER BY CASE WHEN z.veto_applied AND d.token = 'emoji_neg_count' THEN 0 ELSE 1 END,
       abs(d.weight) DESC, d.idx) AS rnk FROM d JOIN z ON d.id = z.id)
"""


def scored(spark, sf, val_only=False, extended_words=False, labelled=False, drivers=M.KEEP_DRIVERS):
    """Every post scored; with ``labelled`` the labelled ones, with ``val_only`` their validation split."""
    if val_only:
        p = stratified_split(posts(spark, sf)).where(F.col("split") == "val").drop("split")
    else:
        p = (posts if labelled else posts_all)(spark, sf)
    return M.scored_frame(p, M.fixed_model(spark), extended_words=extended_words, drivers=drivers)


# ---------------------------------------------------------------- TF-IDF (fit on the whole corpus)

TF_SQL = (f"WITH tk AS (SELECT id, {Q.tokens('text')} AS tok FROM {PA}), "
          f"g AS (SELECT id, unnest({Q.ngrams('tok')}) AS term FROM tk), "
          "tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY id, term), "
          "n AS (SELECT count(*) AS n FROM documents), "
          "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
          "v AS (SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM df, n WHERE df >= 2 AND df <= floor(0.95 * n)) ")


@query("term_frequency", lambda: (
    TF_SQL + "SELECT id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_grams, CAST(max(tf) AS BIGINT) AS max_tf FROM tf GROUP BY id"))
def q_term_frequency(spark, sf):
    tf = T.term_frequency(posts_all(spark, sf))
    return tf.groupBy("id").agg(F.count(F.lit(1)).cast("bigint").alias("n_terms"), F.sum("tf").cast("bigint").alias("n_grams"),
                                F.max("tf").cast("bigint").alias("max_tf"))


@query("document_frequency", lambda: TF_SQL + "SELECT term, CAST(df AS BIGINT) AS df FROM df WHERE df >= 2")
def q_document_frequency(spark, sf):
    return T.document_frequency(T.term_frequency(posts_all(spark, sf))).where(F.col("df") >= 2).select("term", F.col("df").cast("bigint"))


@query("idf_fit", lambda: TF_SQL + "SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM v")
def q_idf_fit(spark, sf):
    docs = posts_all(spark, sf)
    _, vocab, _ = T.fit_tfidf(docs, keep=False)
    return vocab.select("term", F.col("df").cast("bigint"), F.round("idf", 6).alias("idf"))


#: hash buckets of the stored rows; a deployment takes as many as keep a bucket within a task's memory
BUCKETS = 16

TFIDF_SQL = (
    TF_SQL + ", x AS (SELECT tf.id, tf.term, tf.tf * v.idf AS x FROM tf JOIN v ON tf.term = v.term), "
    "nrm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM x GROUP BY id), "
    "val AS (SELECT x.id, x.x / nrm.norm AS value FROM x JOIN nrm ON x.id = nrm.id) "
    "SELECT id, CAST(count(*) AS BIGINT) AS nnz, round(sum(value), 6) AS sum_value, round(sum(value * value), 6) AS sum_sq, "
    "round(max(value), 6) AS max_value FROM val GROUP BY id")


def row_sums(v):
    return v.groupBy("id").agg(F.count(F.lit(1)).cast("bigint").alias("nnz"), F.round(F.sum("value"), 6).alias("sum_value"),
                               F.round(F.sum(F.col("value") * F.col("value")), 6).alias("sum_sq"),
                               F.round(F.max("value"), 6).alias("max_value"))


@query("tfidf_transform", lambda: TFIDF_SQL)
def q_tfidf_transform(spark, sf):
    docs = posts_all(spark, sf)
    tf, vocab, _ = T.fit_tfidf(docs)
    return row_sums(T.tfidf_transform(tf, vocab, columns=()))


@query("tfidf_bucketed", lambda: TFIDF_SQL)
def q_tfidf_bucketed(spark, sf):
    """The same from a bucketed table: rows are shuffled when it is stored, and not again before tokenizing."""
    docs = PS.sink_bucketed(posts_all(spark, sf), BUCKETS)
    tf, vocab, _ = T.fit_tfidf(docs, placed=True)
    return row_sums(T.tfidf_transform(tf, vocab, columns=()))


# ---------------------------------------------------------------- scoring with the fixed model

@query("vocab_lookup_join", lambda: scored_cte() + "SELECT id, term, idx, CAST(tf AS BIGINT) AS tf FROM c")
def q_vocab_lookup_join(spark, sf):
    model = M.fixed_model(spark)
    c = M.text_contributions(posts_all(spark, sf), model)
    return c.select("id", "term", "idx", F.col("tf").cast("bigint"))


@query("score_relational", lambda: scored_cte() + (
    "SELECT id, round(text_logit, 6) AS text_logit, round(logit, 6) AS logit, round(p1, 6) AS p1, model_prediction FROM z"))
def q_score_relational(spark, sf):
    s = scored(spark, sf)
    return s.select("id", F.round("text_logit", 6).alias("text_logit"), F.round("logit", 6).alias("logit"),
                    F.round("p1", 6).alias("p1"), "model_prediction")


@query("sigmoid", lambda: scored_cte() + "SELECT id, round(p1, 6) AS p1, round(1 - p1, 6) AS p0 FROM z")
def q_sigmoid(spark, sf):
    s = scored(spark, sf)
    return s.select("id", F.round("p1", 6).alias("p1"), F.round(1 - F.col("p1"), 6).alias("p0"))


@query("confidence", lambda: scored_cte() + "SELECT id, round(greatest(p1, 1 - p1), 6) AS model_confidence FROM z")
def q_confidence(spark, sf):
    return scored(spark, sf).select("id", F.round("model_confidence", 6).alias("model_confidence"))


@query("entropy_flag", lambda: scored_cte() + (
    "SELECT id, CASE WHEN confidence_raw < 0.7 THEN 'High Ambiguity' ELSE 'Clear Signal' END AS entropy_flag FROM z"))
def q_entropy_flag(spark, sf):
    return scored(spark, sf).select("id", "entropy_flag")


@query("round_n", lambda: scored_cte() + "SELECT id, round(confidence_raw, 4) AS confidence, round(p1, 2) AS p1_2 FROM z")
def q_round_n(spark, sf):
    return scored(spark, sf).select("id", "confidence", F.round("p1", 2).alias("p1_2"))


@query("resolve_prediction", lambda: scored_cte() + "SELECT id, veto_applied, model_prediction, prediction_int FROM z")
def q_resolve_prediction(spark, sf):
    return scored(spark, sf).select("id", "veto_applied", "model_prediction", "prediction_int")


@query("active_features", lambda: scored_cte() + "SELECT id, idx, token FROM d")
def q_active_features(spark, sf):
    s = scored(spark, sf, drivers=None)
    return S.explode_nonempty(s, M.active_drivers(M.fixed_model(spark)), "d", "id").select("id", "d.idx", "d.token")


@query("top_drivers", lambda: scored_cte() + "SELECT id, CAST(rnk AS INTEGER) AS driver_rank, token, weight FROM dr WHERE rnk <= 3")
def q_top_drivers(spark, sf):
    return _driver_rows(spark, sf)


def _driver_rows(spark, sf):
    model = M.fixed_model(spark)
    s = scored(spark, sf)
    ranked = s.select("id", M.rank_drivers(M.active_drivers(model), F.col("veto_applied"), 3).alias("top"))
    # outer, as in explode_nonempty: an inferred filter on the size would rank and score once more
    return ranked.select("id", F.posexplode_outer("top").alias("pos", "d")).where(F.col("pos").isNotNull()).select(
        "id", (F.col("pos") + 1).cast("int").alias("driver_rank"), "d.token", "d.weight")


@query("predict_sentiment", lambda: scored_cte() + (
    ", dd AS (SELECT id, string_agg(token, '|' ORDER BY rnk) AS drivers FROM dr WHERE rnk <= 3 GROUP BY id) "
    "SELECT z.id, CASE WHEN prediction_int = 1 THEN 'Positive' ELSE 'Negative' END AS prediction, prediction_int, "
    "round(confidence_raw, 4) AS confidence, CASE WHEN confidence_raw < 0.7 THEN 'High Ambiguity' ELSE 'Clear Signal' END AS entropy_flag, "
    "veto_applied, coalesce(dd.drivers, '') AS drivers FROM z LEFT JOIN dd ON z.id = dd.id"))
def q_predict_sentiment(spark, sf):
    out = M.predict_sentiment(posts_all(spark, sf), M.fixed_model(spark))
    return out.select("id", "prediction", "prediction_int", "confidence", "entropy_flag", "veto_applied",
                      F.concat_ws("|", F.transform("top_drivers", lambda d: d["token"])).alias("drivers"))


@query("classify_signal_type", lambda: scored_cte() + f"SELECT id, CAST(rnk AS INTEGER) AS driver_rank, {Q.signal_type('token')} AS signal_type FROM dr WHERE rnk <= 3")
def q_classify_signal_type(spark, sf):
    return _driver_rows(spark, sf).select("id", "driver_rank", S.classify_signal_type("token").alias("signal_type"))


@query("driver_tier", lambda: scored_cte() + f"SELECT id, CAST(rnk AS INTEGER) AS driver_rank, {Q.tier('weight')} AS tier FROM dr WHERE rnk <= 3")
def q_driver_tier(spark, sf):
    return _driver_rows(spark, sf).select("id", "driver_rank", S.driver_tier("weight").alias("tier"))


@query("driver_label", lambda: scored_cte() + f"SELECT id, CAST(rnk AS INTEGER) AS driver_rank, {Q.driver_label('token')} AS display FROM dr WHERE rnk <= 3")
def q_driver_label(spark, sf):
    return _driver_rows(spark, sf).select("id", "driver_rank", S.driver_label("token").alias("display"))


@query("align_by_id", lambda: scored_cte(P) + (
    "SELECT z.id, z.label, z.emoji_pos_count, z.emoji_neg_count, z.word_pos_count, z.word_neg_count, z.prediction_int FROM z"))
def q_align_by_id(spark, sf):
    """Numeric block, labels and predictions of the same row brought together by ``id``, from one feature pass."""
    out = scored(spark, sf, labelled=True)
    return out.select("id", "label", *L.NUMERIC_FEATURES, "prediction_int")


# ---------------------------------------------------------------- evaluation on the validation split

@query("mismatch_flag", lambda: scored_cte(VAL) + (
    "SELECT id, label = model_prediction AS correct, label = 1 AND model_prediction = 0 AS false_negative, "
    "label = 0 AND model_prediction = 1 AS false_positive FROM z"))
def q_mismatch_flag(spark, sf):
    return E.with_outcome(scored(spark, sf, True)).select("id", "correct", "false_negative", "false_positive")


@query("bin_confidence", lambda: scored_cte(VAL) + f"SELECT id, {Q.bin_confidence('model_confidence')} AS conf_bin FROM z")
def q_bin_confidence(spark, sf):
    return scored(spark, sf, True).select("id", S.bin_confidence("model_confidence").alias("conf_bin"))


def f1_sql(tp, fp, fn):
    return f"CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) END"


@query("accuracy", lambda: scored_cte(VAL) + "SELECT round(avg(CAST(label = model_prediction AS INTEGER)), 6) AS accuracy FROM z")
def q_accuracy(spark, sf):
    return E.metrics(scored(spark, sf, True)).select("accuracy")


@query("f1_binary", lambda: scored_cte(VAL) + (
    "SELECT round(" + f1_sql("count_if(label = 1 AND model_prediction = 1)", "count_if(label = 0 AND model_prediction = 1)",
                               "count_if(label = 1 AND model_prediction = 0)") + ", 6) AS f1 FROM z"))
def q_f1_binary(spark, sf):
    return E.metrics(scored(spark, sf, True)).select("f1")


def _report_sql() -> str:
    def ratio(a, b):
        return f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END"
    parts = ["m AS (SELECT " + ", ".join(
        [f"count_if(label = {c} AND model_prediction = {c}) AS tp{c}" for c in (0, 1)]
        + [f"count_if(model_prediction = {c}) AS pred{c}" for c in (0, 1)]
        + [f"count_if(label = {c}) AS sup{c}" for c in (0, 1)] + ["count(*) AS n"]) + " FROM z)"]
    pr = {c: ratio(f"CAST(tp{c} AS DOUBLE)", f"pred{c}") for c in (0, 1)}
    rc = {c: ratio(f"CAST(tp{c} AS DOUBLE)", f"sup{c}") for c in (0, 1)}
    f1 = {c: f"CASE WHEN ({pr[c]}) + ({rc[c]}) = 0 THEN 0.0 ELSE 2 * ({pr[c]}) * ({rc[c]}) / (({pr[c]}) + ({rc[c]})) END" for c in (0, 1)}
    sel = []
    for c in (0, 1):
        sel.append(f"SELECT '{c}' AS class, round({pr[c]}, 6) AS precision, round({rc[c]}, 6) AS recall, round({f1[c]}, 6) AS f1, CAST(sup{c} AS BIGINT) AS support FROM m")
    sel.append("SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), round(CAST(tp0 + tp1 AS DOUBLE) / n, 6), CAST(n AS BIGINT) FROM m")
    sel.append(f"SELECT 'macro avg', round(({pr[0]}) * 0.5 + ({pr[1]}) * 0.5, 6), round(({rc[0]}) * 0.5 + ({rc[1]}) * 0.5, 6), "
               f"round(({f1[0]}) * 0.5 + ({f1[1]}) * 0.5, 6), CAST(n AS BIGINT) FROM m")
    w0, w1 = "(CAST(sup0 AS DOUBLE) / n)", "(CAST(sup1 AS DOUBLE) / n)"
    sel.append(f"SELECT 'weighted avg', round(({pr[0]}) * {w0} + ({pr[1]}) * {w1}, 6), round(({rc[0]}) * {w0} + ({rc[1]}) * {w1}, 6), "
               f"round(({f1[0]}) * {w0} + ({f1[1]}) * {w1}, 6), CAST(n AS BIGINT) FROM m")
    return scored_cte(VAL) + ", " + parts[0] + " " + " UNION ALL ".join(sel)


@query("classification_report", _report_sql)
def q_classification_report(spark, sf):
    return E.classification_report(scored(spark, sf, True))


@query("confusion_matrix", lambda: scored_cte(VAL) + (
    "SELECT 0 AS true_label, CAST(count_if(label = 0 AND model_prediction = 0) AS BIGINT) AS pred_0, "
    "CAST(count_if(label = 0 AND model_prediction = 1) AS BIGINT) AS pred_1 FROM z UNION ALL "
    "SELECT 1, CAST(count_if(label = 1 AND model_prediction = 0) AS BIGINT), CAST(count_if(label = 1 AND model_prediction = 1) AS BIGINT) FROM z"))
def q_confusion_matrix(spark, sf):
    return E.confusion_matrix(scored(spark, sf, True))


@query("error_counts", lambda: scored_cte(VAL) + (
    "SELECT CAST(count_if(label <> model_prediction) AS BIGINT) AS wrong, CAST(count_if(label = 1 AND model_prediction = 0) AS BIGINT) AS false_negatives, "
    "CAST(count_if(label = 0 AND model_prediction = 1) AS BIGINT) AS false_positives, "
    f"CAST(count_if(label <> model_prediction AND {Q.has_code_point_of('text', L.ERROR_ANALYSIS_EMOJIS)}) AS BIGINT) AS wrong_with_emoji FROM z"))
def q_error_counts(spark, sf):
    return E.error_counts(scored(spark, sf, True))


@query("calibration_bins", lambda: scored_cte(VAL) + (
    f"SELECT conf_bin, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(label = model_prediction AS INTEGER)), 6) AS accuracy "
    f"FROM (SELECT *, {Q.bin_confidence('model_confidence')} AS conf_bin FROM z) WHERE conf_bin IS NOT NULL GROUP BY conf_bin"))
def q_calibration_bins(spark, sf):
    return E.calibration_bins(scored(spark, sf, True))


@query("archetype_summary", lambda: scored_cte(VAL) + (
    f"SELECT {Q.archetype('text', 'label')} AS archetype, CAST(count(*) AS BIGINT) AS n, round(avg(model_confidence), 6) AS avg_confidence "
    "FROM z WHERE label <> model_prediction GROUP BY 1"))
def q_archetype_summary(spark, sf):
    return E.archetype_summary(scored(spark, sf, True))


@query("danger_cases", lambda: scored_cte(VAL) + (
    "SELECT id, label, model_prediction, round(model_confidence, 6) AS confidence, substr(text, 1, 55) AS preview "
    "FROM z WHERE label <> model_prediction AND model_confidence >= 0.85 ORDER BY model_confidence DESC, id"))
def q_danger_cases(spark, sf):
    d = E.danger_cases(scored(spark, sf, True))
    return d.select("id", "label", "model_prediction", F.round("model_confidence", 6).alias("confidence"),
                    S.truncate_text("text", 55).alias("preview"))


@query("sample_errors", lambda: scored_cte(VAL) + (
    f"SELECT id, archetype, CAST(rk AS INTEGER) AS rank FROM (SELECT id, {Q.archetype('text', 'label')} AS archetype, "
    f"row_number() OVER (PARTITION BY {Q.archetype('text', 'label')} ORDER BY id) AS rk FROM z WHERE label <> model_prediction) WHERE rk <= 3"))
def q_sample_errors(spark, sf):
    s = E.sample_errors_per_archetype(scored(spark, sf, True))
    return s.select("id", "archetype", F.col("rank").cast("int"))


@query("sample_wrong_rows", lambda: scored_cte(VAL) + "SELECT id, label, model_prediction FROM z WHERE label <> model_prediction ORDER BY id LIMIT 10")
def q_sample_wrong_rows(spark, sf):
    """The first ten wrong rows by key (a top-k)."""
    o = E.with_outcome(scored(spark, sf, True)).where(~F.col("correct"))
    return o.select("id", "label", "model_prediction").orderBy("id").limit(10)


@query("confidence_range_by_path", lambda: scored_cte() + (
    "SELECT veto_applied, min(round(confidence_raw, 4)) AS min_confidence, max(round(confidence_raw, 4)) AS max_confidence, "
    "CAST(count(*) AS BIGINT) AS n FROM z GROUP BY veto_applied"))
def q_confidence_range_by_path(spark, sf):
    return E.confidence_range_by_path(scored(spark, sf))


def _hist_by_sql() -> str:
    bins = 20
    return scored_cte(VAL) + (
        ", v AS (SELECT label = model_prediction AS correct, model_confidence AS x FROM z), "
        "s0 AS (SELECT correct, min(x) AS lo0, max(x) AS hi0 FROM v GROUP BY correct), "
        "st AS (SELECT correct, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s0), "
        f"b AS (SELECT v.correct, LEAST(GREATEST(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INTEGER), 0), {bins - 1}) + 1 AS bin FROM v JOIN st ON v.correct = st.correct), "
        "cnt AS (SELECT correct, bin, count(*) AS n FROM b GROUP BY correct, bin), "
        f"al AS (SELECT st.correct, CAST(g.bin AS INTEGER) AS bin, round(lo + (g.bin - 1) * (hi - lo) / {bins}, 6) AS bin_lo, "
        f"round(lo + g.bin * (hi - lo) / {bins}, 6) AS bin_hi FROM st, range(1, {bins + 1}) g(bin)) "
        "SELECT al.correct, al.bin, al.bin_lo, al.bin_hi, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM al "
        "LEFT JOIN cnt ON al.correct = cnt.correct AND al.bin = cnt.bin")


@query("confidence_histogram", _hist_by_sql)
def q_confidence_histogram(spark, sf):
    from ..operators.corpus import equal_width_histogram
    o = E.with_outcome(scored(spark, sf, True))
    return equal_width_histogram(o, "model_confidence", 20, by="correct")


@query("veto_misfire_rate", lambda: scored_cte(P) + (
    "SELECT CAST(count_if(veto_applied) AS BIGINT) AS fires, CAST(count_if(veto_applied AND label = 0) AS BIGINT) AS correct_fires, "
    "CASE WHEN count_if(veto_applied) = 0 THEN NULL ELSE round((count_if(veto_applied) - count_if(veto_applied AND label = 0)) / count_if(veto_applied), 6) END AS misfire_rate FROM z"))
def q_veto_misfire_rate(spark, sf):
    return E.veto_misfire_rate(scored(spark, sf, labelled=True))


@query("feature_ablation", lambda: scored_cte(VAL) + ", ab AS (" + " UNION ALL ".join(
    f"SELECT {Q.lit(name)} AS ablation, label, model_prediction, "
    f"CASE WHEN text_logit + ({' + '.join([f'CAST({c} AS DOUBLE) * CAST({coef!r} AS DOUBLE)' for c, coef in M.FIXED_NUMERIC_COEF if c not in skip] or ['0.0'])}) "
    f"+ CAST({M.FIXED_INTERCEPT!r} AS DOUBLE) > 0 THEN 1 ELSE 0 END AS ap FROM z"
    for name, skip in E.ABLATIONS) + "), per AS (SELECT ablation, avg(CAST(label = ap AS INTEGER)) AS acc, "
    "CAST(count_if(ap <> model_prediction) AS BIGINT) AS flips FROM ab GROUP BY ablation) "
    "SELECT ablation, round(acc, 6) AS accuracy, round(acc - (SELECT acc FROM per WHERE ablation = 'full'), 6) AS delta, flips FROM per")
def q_feature_ablation(spark, sf):
    model = M.fixed_model(spark)
    return E.feature_ablation(scored(spark, sf, True), model)


@query("decisive_cases", lambda: scored_cte(VAL) + (
    f"SELECT id FROM z WHERE (CASE WHEN text_logit + CAST({M.FIXED_INTERCEPT!r} AS DOUBLE) > 0 THEN 1 ELSE 0 END) <> model_prediction "
    f"AND (CASE WHEN text_logit + CAST({M.FIXED_INTERCEPT!r} AS DOUBLE) + ("
    + " + ".join(f"CAST({c} AS DOUBLE) * CAST({coef!r} AS DOUBLE)" for c, coef in M.FIXED_NUMERIC_COEF[:2])
    + ") > 0 THEN 1 ELSE 0 END) = model_prediction"))
def q_decisive_cases(spark, sf):
    return E.decisive_cases(scored(spark, sf, True), M.fixed_model(spark)).select("id")


@query("sample_decisive_rows", lambda: scored_cte(VAL) + (
    f"SELECT id, label, model_prediction FROM z WHERE (CASE WHEN text_logit + CAST({M.FIXED_INTERCEPT!r} AS DOUBLE) > 0 THEN 1 ELSE 0 END) <> model_prediction "
    f"AND (CASE WHEN text_logit + CAST({M.FIXED_INTERCEPT!r} AS DOUBLE) + ("
    + " + ".join(f"CAST({c} AS DOUBLE) * CAST({coef!r} AS DOUBLE)" for c, coef in M.FIXED_NUMERIC_COEF[:2])
    + ") > 0 THEN 1 ELSE 0 END) = model_prediction ORDER BY id LIMIT 8"))
def q_sample_decisive_rows(spark, sf):
    """The first eight rows, by key, that the emoji signal alone decides (a top-k)."""
    d = E.decisive_cases(scored(spark, sf, True), M.fixed_model(spark))
    return d.select("id", "label", "model_prediction").orderBy("id").limit(8)
