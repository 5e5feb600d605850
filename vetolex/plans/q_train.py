"""Training, weights, parity, gates and persistence queries (§2.1, §2.3 gates, §2.10).

Where SQL can decide the result (vocabulary, sizes, flags) there is an oracle; fitted numbers are
covered by tests (parity ≤ 1e-9, gradient check, round trips)."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import evaluate as E
from ..operators import gates as G
from ..operators import model as M
from ..operators import persist as PS
from ..operators import train as TR
from ..operators.features import add_polarity_features, read_feature_table, write_feature_table
from ..session import cut
from ..sources.tables import POSTS_SCHEMA, files_state, posts, posts_all, read_table, route_csv, scan_csv
from . import sqlfrag as Q
from .q_model import VAL, f1_sql, scored_cte
from .registry import query
from ..operators.split import split_sql, stratified_split

P = Q.posts_sql()


def train_vocab_sql() -> str:
    """Training-split vocabulary (df in [2, floor(0.95 n_train)]) and per-row features, as CTEs."""
    return (f"WITH s AS {split_sql(P)}, "
            f"tr AS (SELECT id, label, text, {Q.polarity_select('text')} FROM s WHERE split = 'train'), "
            f"tk AS (SELECT id, {Q.tokens('text')} AS tok FROM tr), "
            f"g AS (SELECT id, unnest({Q.ngrams('tok')}) AS term FROM tk), "
            "tf AS (SELECT DISTINCT id, term FROM g), "
            "dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
            "n AS (SELECT count(*) AS n FROM tr), "
            "v AS (SELECT term FROM dfq, n WHERE df >= 2 AND df <= floor(0.95 * n)) ")


class Trained:
    """A fitted run; vectors, scores and MLlib's form of a wide model are made when a query asks for them."""

    def __init__(self, spark, sf):
        self.spark = spark
        self.run, self.fit, self.model, self._vec_train = TR.fitted_run(posts(spark, sf))
        self.val = self.run.rows("val")

    @cached_property
    def lr(self):
        return TR.mllib_model(self.fit.model)

    @cached_property
    def vec_train(self):
        return self._vec_train if self._vec_train is not None else TR.assemble_hybrid(self.run, self.run.rows("train"), split="train")

    @cached_property
    def vec_val(self):
        return TR.assemble_hybrid(self.run, self.val, split="val")

    @cached_property
    def scored_val(self):
        return cut(M.resolve(M.score_relational(self.val, self.model)))


_MEMO: dict = {}


def tables_state(spark, sf) -> tuple:
    return tuple(files_state(read_table(spark, sf, name)) for name in ("documents", "labels"))


def trained(spark, sf) -> Trained:
    """The model of this session and of the tables as they are now: a fit is kept per path, size and time of
    the files read, and never across sessions."""
    files = tables_state(spark, sf)
    held = _MEMO.get(files)
    if held is None or held.spark is not spark:
        _MEMO.clear()
        held = _MEMO[files] = Trained(spark, sf)
    return held


@query("assemble_hybrid", lambda: train_vocab_sql() + (
    ", cnt AS (SELECT tf.id, count(*) AS c FROM tf JOIN v ON tf.term = v.term GROUP BY tf.id) "
    "SELECT tr.id, CAST(tr.label AS DOUBLE) AS label, CAST(coalesce(cnt.c, 0) + "
    + " + ".join(f"CAST({c} <> 0 AS INTEGER)" for c in ("emoji_pos_count", "emoji_neg_count", "word_pos_count", "word_neg_count"))
    + " AS BIGINT) AS nnz FROM tr LEFT JOIN cnt ON tr.id = cnt.id"))
def q_assemble_hybrid(spark, sf):
    t = trained(spark, sf)
    return t.vec_train.select("id", "label", F.col("nnz").cast("bigint"))


@query("train_logistic")
def q_train_logistic(spark, sf):
    t = trained(spark, sf)
    return spark.createDataFrame(
        [(t.run.n_train, t.run.n_train_all, t.run.n_text, t.run.n_text + 4, t.fit.iterations, t.fit.max_gradient <= TR.TOL,
          float(t.fit.model.intercept), t.fit.max_gradient)],
        "n_train long, n_train_all long, n_text int, n_features int, iterations int, converged boolean, intercept double, max_gradient double")


@query("extract_weights", lambda: train_vocab_sql() + (
    ", w AS (SELECT dfq.term, CAST(row_number() OVER (ORDER BY encode(dfq.term)) - 1 AS BIGINT) AS idx, round(ln((1.0 + n) / (1.0 + df)) + 1.0, 6) AS idf "
    "FROM dfq JOIN v ON dfq.term = v.term, n) SELECT * FROM w UNION ALL SELECT name, (SELECT count(*) FROM w) + k, NULL FROM "
    + Q.values_table([[c, k] for k, c in enumerate(L.NUMERIC_FEATURES)], ["name", "k"])))
def q_extract_weights(spark, sf):
    """Terms, indices and idf of the trained weights; the fitted coefficients are tested by their gradient."""
    return trained(spark, sf).model.weights.select("term", "idx", F.round("idf", 6).alias("idf"))


@query("score_mllib")
def q_score_mllib(spark, sf):
    t = trained(spark, sf)
    return TR.score_mllib(t.lr, t.vec_val)


@query("parity_check", lambda: f"SELECT CAST(0 AS BIGINT) AS label_mismatches, CAST(0 AS BIGINT) AS unmatched, CAST(count(*) AS BIGINT) AS n, true AS passed FROM {VAL}")
def q_parity_check(spark, sf):
    t = trained(spark, sf)
    return TR.parity_check(t.scored_val, TR.score_mllib(t.lr, t.vec_val)).drop("max_abs_diff")


@query("train_evaluate")
def q_train_evaluate(spark, sf):
    t = trained(spark, sf)
    model_only = E.metrics(t.scored_val, p="model_prediction").withColumn("scorer", F.lit("model"))
    with_veto = E.metrics(t.scored_val, p="prediction_int").withColumn("scorer", F.lit("model+veto"))
    return model_only.unionByName(with_veto)


@query("gate_metric", lambda: scored_cte(VAL) + (
    "SELECT 'f1' AS metric, round(f1, 4) AS value, round(f1, 4) AS benchmark, true AS passed FROM (SELECT "
    + f1_sql("count_if(label = 1 AND model_prediction = 1)", "count_if(label = 0 AND model_prediction = 1)",
             "count_if(label = 1 AND model_prediction = 0)") + " AS f1 FROM z)"))
def q_gate_metric(spark, sf):
    """A reloaded model against the accepted run of the model that was saved; a run that is worse raises."""
    val = stratified_split(posts(spark, sf)).where(F.col("split") == "val").drop("split")
    history = PS.scratch_path(spark, "runs")
    model = M.fixed_model(spark)
    G.gate_against_history(E.metrics(M.scored_frame(val, model)), history)
    again = PS.load_model(spark, PS.save_model(model, PS.scratch_path(spark, "model")))
    return G.gate_against_history(E.metrics(M.scored_frame(val, again)), history)


@query("gate_coef_sign", lambda: (
    "SELECT t.term, true AS passed FROM (VALUES ('emoji_pos_count'), ('emoji_neg_count')) t(term) WHERE EXISTS (SELECT 1 FROM documents)"))
def q_gate_coef_sign(spark, sf):
    """Signs of the emoji weights of a model trained on all posts whose emojis lean to one side, that side as label."""
    rows = add_polarity_features(posts_all(spark, sf)).where("emoji_pos_count <> emoji_neg_count")
    leaning = rows.select("id", (F.col("emoji_pos_count") > F.col("emoji_neg_count")).cast("int").alias("label"), "text")
    model = TR.fitted_run(cut(leaning))[2]
    return G.enforce(G.sign_gate(model.weights), "coefficient signs").select("term", "passed")


@query("gate_model_config")
def q_gate_model_config(spark, sf):
    """Every setting of the trained model against what the scorer reproduces."""
    t = trained(spark, sf)
    return G.enforce(G.model_config_gate(t.model, t.fit.model.numClasses, t.fit.model.numFeatures), "model settings")


@query("global_signals")
def q_global_signals(spark, sf):
    return M.global_signals(trained(spark, sf).model, 5)


@query("coef_table")
def q_coef_table(spark, sf):
    w = trained(spark, sf).model.weights
    top = w.orderBy(F.col("coef").desc(), "idx").limit(15).withColumn("section", F.lit("top"))
    bottom = w.orderBy(F.col("coef").asc(), "idx").limit(15).withColumn("section", F.lit("bottom"))
    nums = w.where(F.col("idf").isNull()).withColumn("section", F.lit("numeric"))
    return top.unionByName(bottom).unionByName(nums).select("section", "term", "idx", F.round("coef", 4).alias("coef"))


@query("save_model", lambda: train_vocab_sql() + (
    "SELECT false AS numeric, CAST(count(*) AS BIGINT) AS n FROM v UNION ALL SELECT true, CAST(4 AS BIGINT)"))
def q_save_model(spark, sf):
    t = trained(spark, sf)
    path = PS.save_model(t.model, PS.scratch_path(spark, "model"))
    return spark.read.parquet(os.path.join(path, "weights")).groupBy(F.col("idf").isNull().alias("numeric")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


@query("write_feature_table", lambda: f"SELECT id, label, text, {Q.polarity_select('text')} FROM {P}")
def q_write_feature_table(spark, sf):
    """Features built, checked and stored in one pass, and read back from the published version."""
    path = PS.scratch_path(spark, "feature_table")
    write_feature_table(posts(spark, sf), path)
    return read_feature_table(spark, path)


@query("load_model", lambda: train_vocab_sql() + f"SELECT true AS equal, CAST((SELECT count(*) FROM {VAL}) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_text FROM v")
def q_load_model(spark, sf):
    t = trained(spark, sf)
    path = PS.save_model(t.model, PS.scratch_path(spark, "model"))
    again = PS.load_model(spark, path)
    back = M.resolve(M.score_relational(t.val, again)).select("id", F.col("p1").alias("p1_reloaded"))
    j = t.scored_val.select("id", "p1").join(back, "id", "full_outer")
    return j.agg(F.every(F.coalesce(F.abs(F.col("p1") - F.col("p1_reloaded")) <= 1e-12, F.lit(False))).alias("equal"),
                 F.count(F.lit(1)).cast("bigint").alias("n"), F.lit(again.n_text).cast("bigint").alias("n_text"))


@query("save_estimator_roundtrip", "SELECT CAST(0 AS BIGINT) AS differences, true AS passed")
def q_save_estimator_roundtrip(spark, sf):
    t = trained(spark, sf)
    return PS.estimator_roundtrip(t.lr, t.vec_val, PS.scratch_path(spark, "estimator"))


@query("sink_table", lambda: f"SELECT id, label, text, {Q.polarity_select('text')} FROM {P}")
def q_sink_table(spark, sf):
    path = PS.sink_table(add_polarity_features(posts(spark, sf)), PS.scratch_path(spark, "features"))
    return spark.read.parquet(path)


@query("scan_csv", lambda: f"SELECT id, label, text FROM {P}")
def q_scan_csv(spark, sf):
    path = PS.sink_table(posts(spark, sf), PS.scratch_path(spark, "posts_csv"), fmt="csv")
    return scan_csv(spark, path, POSTS_SCHEMA)


# a foreign export of every document, in lines of ours: one in ten has a label that is no number, no text, a field too many or no label
EXPORT_SQL = ("(SELECT id, CAST(id % 2 AS INTEGER) AS label, text, id % 10 AS k, '\"' || replace(text, '\"', '\"\"') || '\"' AS quoted "
              f"FROM {Q.posts_all_sql()} WHERE text IS NOT NULL)")
EXPORT_LINE = ("CASE k WHEN 0 THEN id || ',abc,' || quoted WHEN 1 THEN id || ',' || label WHEN 2 THEN id || ',' || label || ',' || quoted || ',9' "
               "WHEN 3 THEN id || ',,' || quoted ELSE id || ',' || label || ',' || quoted END")


@query("scan_csv_rejects", lambda: (
    f"SELECT id, CASE WHEN k > 3 THEN label END AS label, CASE WHEN k > 3 THEN text END AS text, CASE WHEN k < 3 THEN {EXPORT_LINE} END AS record, "
    f"CASE WHEN k < 3 THEN 'malformed' WHEN k = 3 THEN 'missing label' ELSE '' END AS reason FROM {EXPORT_SQL}"))
def q_scan_csv_rejects(spark, sf):
    """Lines that no writer of ours made, routed: good rows and the reject table, every record in one of them."""
    text = posts_all(spark, sf).where("text is not null")
    lines = (text.selectExpr("id", "cast(id % 2 as int) as label", "id % 10 as k", """concat('"', replace(text, '"', '""'), '"') as quoted""")
             .selectExpr(f"{EXPORT_LINE} as value"))
    path = PS.scratch_path(spark, "export")
    lines.write.text(path)
    good, bad = route_csv(spark, path, POSTS_SCHEMA, PS.scratch_path(spark, "routed"), header=False)
    none = F.lit(None).cast("string")
    return good.select("id", "label", "text", none.alias("record"), F.lit("").alias("reason")).union(
        bad.select(F.regexp_extract("record", "^([0-9]+)", 1).cast("long"), none.cast("int"), none,
                   F.when(F.col("reason") == "malformed", F.col("record")), "reason"))

