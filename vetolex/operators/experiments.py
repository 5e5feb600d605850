"""Configuration experiments (§2.11) and the grid operators behind them (§2.6 ``case_config_cross_join``,
``veto_theta``; §2.7 ``avg_confidence``, ``pass_rate_pivot``, ``pass_by_category``; §2.8 ``sort_results``,
``argmax_config``, ``delta_vs_baseline``; §2.9 ``union_results``).

Rows × configurations is a per-row ``explode`` of a literal configuration array (tens of
entries), never a join.  The emoji signal is linear in the boost, so one feature pass at
boost 1 (occurrence counts) serves every configuration; the text block does not depend on
the boost and is computed once.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from ..session import cut
from .evaluate import f1_expr
from .quality import count_if

# FIXED VALUES — configuration grids of the boost / guard experiments.
BOOSTS_FLOOR = (5, 7, 9, 10, 11, 13, 15)
BOOSTS_CEILING = (10, 20, 50, 100, 200)
BOOSTS_GRID_A = (5, 7, 10, 13, 15, 20)      # threshold fixed at 10
BOOSTS_GRID_B = (1, 2, 3, 5, 7)             # threshold = boost
GUARDS = (1, 2, 3)


def grid_configs(name: str, boosts, guards=GUARDS, proportional: bool = False):
    return [(name, b, (b if proportional else L.EMOJI_BOOST), g) for b in boosts for g in guards]


def config_array(configs) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("grid"), F.lit(b).alias("boost"), F.lit(t).alias("threshold"),
                              F.lit(g).alias("guard")) for n, b, t, g in configs])


def with_occurrences(scored: DataFrame) -> DataFrame:
    """Emoji/emoticon occurrence counts (boost 1) from the boost-10 feature columns."""
    return scored.withColumns({"e_pos_1": (F.col("emoji_pos_count") / L.EMOJI_BOOST).cast("int"),
                               "e_neg_1": (F.col("emoji_neg_count") / L.EMOJI_BOOST).cast("int")})


def grid_rows(scored: DataFrame, model, configs) -> DataFrame:
    """Every row under every configuration: rescaled emoji signal, model logit, veto, final label."""
    base = with_occurrences(scored)
    x = base.withColumn("_c", F.explode(config_array(configs))).select("*", "_c.*").drop("_c")
    e_pos = F.col("e_pos_1") * F.col("boost")
    e_neg = F.col("e_neg_1") * F.col("boost")
    c = model.numeric_coef
    logit = (F.col("text_logit") + (F.lit(0.0) + e_pos.cast("double") * c["emoji_pos_count"]
                                    + e_neg.cast("double") * c["emoji_neg_count"]
                                    + F.col("word_pos_count").cast("double") * c["word_pos_count"]
                                    + F.col("word_neg_count").cast("double") * c["word_neg_count"])
             + F.lit(model.intercept))
    x = x.withColumns({"e_pos_b": e_pos, "e_neg_b": e_neg, "grid_logit": logit})
    x = x.withColumn("grid_p1", S.sigmoid("grid_logit"))
    fired = S.sarcasm_veto_fires("e_neg_b", "e_pos_b", "word_pos_count", F.col("threshold"), F.col("guard"))
    return (x.withColumn("grid_veto", fired)
            .withColumn("grid_prediction", F.when(fired, 0).when(F.col("grid_logit") > 0, 1).otherwise(0))
            .withColumn("grid_confidence", F.when(fired, S.veto_confidence("e_neg_b", "e_pos_b"))
                        .otherwise(S.confidence("grid_p1"))))


def grid_metrics(rows: DataFrame, y: str = "label") -> DataFrame:
    yy, pp = F.col(y), F.col("grid_prediction")
    out = rows.groupBy("grid", "boost", "threshold", "guard").agg(
        F.avg((yy == pp).cast("int")).alias("_acc"),
        count_if((yy == 1) & (pp == 1)).alias("_tp"), count_if((yy == 0) & (pp == 1)).alias("_fp"),
        count_if((yy == 1) & (pp == 0)).alias("_fn"), F.avg("grid_confidence").alias("_conf"),
        F.count(F.lit(1)).cast("bigint").alias("n"))
    return out.select("grid", "boost", "threshold", "guard", F.round("_acc", 6).alias("accuracy"),
                      F.round(f1_expr(F.col("_tp"), F.col("_fp"), F.col("_fn")), 6).alias("f1"),
                      F.round("_conf", 6).alias("avg_confidence"), "n")


def sort_results(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("accuracy").desc(), F.col("f1").desc(), "grid", "boost", "guard")


def argmax_config(results: DataFrame) -> DataFrame:
    return sort_results(results).limit(1)


def delta_vs_baseline(results: DataFrame, boost: int = L.EMOJI_BOOST, guard: int = L.VETO_GUARD,
                      grid: str = "A") -> DataFrame:
    """Metric minus the baseline configuration's metric (window over the tiny result table)."""
    w = Window.partitionBy()
    is_base = (F.col("grid") == grid) & (F.col("boost") == boost) & (F.col("guard") == guard)
    return results.select("grid", "boost", "threshold", "guard",
                          F.round(F.col("accuracy") - F.max(F.when(is_base, F.col("accuracy"))).over(w), 6).alias("delta_accuracy"),
                          F.round(F.col("f1") - F.max(F.when(is_base, F.col("f1"))).over(w), 6).alias("delta_f1"))


def pass_by_category(rows: DataFrame, category: str, ok: str = "correct") -> DataFrame:
    return rows.groupBy(category).agg(F.sum(F.col(ok).cast("int")).cast("bigint").alias("passed"),
                                      F.count(F.lit(1)).cast("bigint").alias("total"))


def pass_rate_pivot(rows: DataFrame, index: str, pivot: str, values, ok: str = "correct") -> DataFrame:
    return rows.groupBy(index).pivot(pivot, list(values)).agg(F.round(F.avg(F.col(ok).cast("int")), 6))


# ---------------------------------------------------------------- refit experiments (MLlib)

def fit_many(fns, workers: int = 3):
    """Independent fits submitted together: each iteration of a fit is a short, latency-bound
    Spark job on a few partitions, so running fits side by side keeps the executors busy.

    MLlib's solver keeps about twenty vectors as long as the vocabulary on the driver for every fit that runs.  Wide fits go one
    after the other: a pass of one has tasks for all cores, and the driver then keeps the row vectors of one."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(lambda f: f(), fns))


def feature_set_vectors(run, rows: DataFrame, extra: dict[str, Column], split: str | None = None) -> DataFrame:
    """Shared TF-IDF block ‖ the given extra numeric columns (text-only when empty)."""
    from .train import assemble_hybrid
    r = rows.withColumns(extra) if extra else rows
    return assemble_hybrid(run, r, numeric_cols=tuple(extra), split=split)


def feature_sets() -> list[tuple[str, dict]]:
    """Text alone, and with presence, presence and count, or early polarity of its emojis."""
    known = S.extract_known_emojis("text")
    has, count = (F.size(known) > 0).cast("int"), F.size(known)
    return [("text_only", {}), ("text_presence", {"has_emoji": has}), ("text_count", {"has_emoji": has, "emoji_count": count}),
            ("text_polarity", {"early_pos": S.emoji_polarity_count("text", L.EARLY_POSITIVE_EMOJIS, 1),
                               "early_neg": S.emoji_polarity_count("text", L.EARLY_NEGATIVE_EMOJIS, 1)})]


def cumulative_sets() -> list[tuple[str, dict]]:
    """Plain counts, a pair of columns per lexicon: emojis, then also emoticons, then also words."""
    pairs = [("expanded_emoji", {"emoji_pos": S.emoji_polarity_count("text", L.POSITIVE_EMOJIS, 1),
                                 "emoji_neg": S.emoji_polarity_count("text", L.NEGATIVE_EMOJIS, 1)}),
             ("plus_emoticons", {"emoticon_pos": S.emoticon_count("text", L.POSITIVE_EMOTICONS, 1),
                                 "emoticon_neg": S.emoticon_count("text", L.NEGATIVE_EMOTICONS, 1)}),
             ("plus_words", {"word_pos": S.word_presence_count("text", L.POSITIVE_WORDS),
                             "word_neg": S.word_presence_count("text", L.NEGATIVE_WORDS)})]
    out, so_far = [], {}
    for name, pair in pairs:
        so_far = {**so_far, **pair}
        out.append((name, so_far))
    return out


def evaluate_fit(lr_model, vectors: DataFrame, name: str) -> DataFrame:
    out = lr_model.transform(vectors).select(F.col("label").cast("int").alias("label"),
                                             F.col("prediction").cast("int").alias("p"))
    yy, pp = F.col("label"), F.col("p")
    return out.agg(F.round(F.avg((yy == pp).cast("int")), 6).alias("accuracy"),
                   F.round(f1_expr(count_if((yy == 1) & (pp == 1)), count_if((yy == 0) & (pp == 1)),
                                   count_if((yy == 1) & (pp == 0))), 6).alias("f1")).withColumn("experiment", F.lit(name))


def run_feature_experiments(run, sets: list[tuple[str, dict]]) -> DataFrame:
    """Fit one model per feature set on the shared training TF-IDF; evaluate on validation rows."""
    from .train import fit_rows
    train, val = run.rows("train"), run.rows("val")
    wide = run.is_wide(())
    run.text_blocks() if wide else run.text_rows("train")  # once, before the fits that run side by side ask for them
    run.text_rows("val")

    def one(extra):
        model = fit_rows(run, train.withColumns(extra) if extra else train, tuple(extra))[0].model
        return model, None if wide else feature_set_vectors(run, val, extra, "val")
    fitted = fit_many([lambda e=extra: one(e) for _, extra in sets], 1 if wide else 3)
    if wide:
        return evaluate_wide(run, [(name, extra, m) for (name, extra), (m, _) in zip(sets, fitted)])
    out = None
    for (name, _), (m, vv) in zip(sets, fitted):
        r = evaluate_fit(m, vv, name)
        out = r if out is None else out.unionByName(r)
    return out.select("experiment", "accuracy", "f1")


def text_sums(tfidf: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """``(id, s0, s1, ...)``: each row's sum of value x coef under every table ``(idx, coef)``.

    The tables are first put side by side, so an entry meets one row, however many models there are."""
    names = [f"s{k}" for k in range(len(tables))]
    side = None
    for k, t in enumerate(tables):
        one = t.select("idx", *[F.col("coef").alias(n) if i == k else F.lit(0.0).alias(n) for i, n in enumerate(names)])
        side = one if side is None else side.unionByName(one)
    side = side.groupBy("idx").agg(*[F.sum(n).alias(n) for n in names]) if len(tables) > 1 else side
    return tfidf.join(side, "idx").groupBy("id").agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names])


def evaluate_wide(run, fitted: list[tuple[str, dict, object]]) -> DataFrame:
    """:func:`evaluate_fit` of models without a coefficient vector: validation texts meet all of their coefficients in one join."""
    tables = [m.coefficients.where(F.col("idx") < run.n_text) for _, _, m in fitted]
    rows = run.rows("val").join(cut(text_sums(run.tfidf_for("val"), tables)), "id", "left")
    yy, out = F.col("label"), None
    for k, (name, extra, m) in enumerate(fitted):
        own = dict(m.coefficients.where(F.col("idx") >= run.n_text).collect())  # a handful
        margin = F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.lit(m.intercept)
        for j, c in enumerate(extra):
            margin = margin + F.col(c).cast("double") * F.lit(own[run.n_text + j])
        scored = (rows.withColumns(extra) if extra else rows).withColumn("p", F.when(margin > 0, 1).otherwise(0))
        r = scored.agg(F.round(F.avg((yy == F.col("p")).cast("int")), 6).alias("accuracy"),
                       F.round(f1_expr(count_if((yy == 1) & (F.col("p") == 1)), count_if((yy == 0) & (F.col("p") == 1)),
                                       count_if((yy == 1) & (F.col("p") == 0))), 6).alias("f1")).withColumn("experiment", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out.select("experiment", "accuracy", "f1")


# ---------------------------------------------------------------- per-boost refits

# FIXED VALUES — behaviour probes of the boost and veto experiments: (text, expected, category).
CONFLICT_CASES = (
    ("i love having bugs 😭", 0, "conflict"),
    ("great, another meeting 😧", 0, "conflict"),
    ("this is terrible 😊", 0, "conflict"),
    ("I hate this so much 😍", 0, "conflict"),
)
CEILING_CASES = (
    ("This is a terrible and awful day 😊", 0, "text-dominant"),
    ("I hate this movie, it was bad 😊", 0, "text-dominant"),
    ("I love this so much 😍", 1, "agreement"),
    ("Absolute garbage 😭", 0, "agreement"),
    ("i love having bugs 😭", 0, "sarcasm"),
)
BOUNDARY_CASES = (
    ("i love having bugs 😭", 0, "sarcasm"),
    ("great, another meeting 😧", 0, "sarcasm"),
    ("wow amazing day 😭😭", 0, "sarcasm"),
    ("RIP grandma 😭", 0, "genuine-sad"),
    ("this movie made me cry 😭", 0, "genuine-sad"),
    ("I'm dead 😭😭", 1, "ambiguous-emoji"),
    ("she ate that performance 😭", 1, "ambiguous-emoji"),
    ("this is so beautiful 😭😭", 1, "pos-overwhelm"),
    ("I can't believe we won 😭", 1, "pos-overwhelm"),
)


def rescale(df: DataFrame, boost: int) -> DataFrame:
    """Emoji signal at another boost (linear in the boost), from boost-10 columns."""
    return df.withColumns({c: ((F.col(c) / L.EMOJI_BOOST).cast("int") * boost).cast("int")
                           for c in ("emoji_pos_count", "emoji_neg_count")})


class BoostFits:
    """One shared split + training vocabulary; one LR fit per (boost, word list), memoised.
    Only the emoji columns change between boosts, so TF-IDF is never refitted."""

    def __init__(self, posts: DataFrame):
        from .train import prepare
        self.spark = posts.sparkSession
        self.base = prepare(posts)
        self.fits: dict = {}

    @cached_property
    def ext(self):
        """The same rows, split and vocabulary with the extended words' counts; the TF-IDF rows are shared with the base run."""
        from .features import add_polarity_features
        rows = add_polarity_features(self.base.data.drop(*L.NUMERIC_FEATURES), extended_words=True)
        return replace(self.base, data=cut(rows), numeric_cols=L.NUMERIC_FEATURES)

    def run(self, extended: bool):
        return self.ext if extended else self.base

    def fit_all(self, keys):
        from .train import extract_weights, fit_rows
        todo = [k for k in keys if k not in self.fits]
        if todo:  # once, before the fits that run side by side ask for it
            self.base.text_blocks() if self.base.is_wide() else self.base.text_rows("train")
        runs = {extended: self.run(extended) for _, extended in todo}

        def one(key):
            boost, extended = key
            run = runs[extended]
            lr = fit_rows(run, rescale(run.rows("train"), boost))[0].model
            return key, (lr, extract_weights(run, lr))
        for key, val in fit_many([lambda k=k: one(k) for k in todo], 1 if self.base.is_wide() else 3):
            self.fits[key] = val
        return {k: self.fits[k] for k in keys}

    def text_logits(self, split: str, models: dict) -> DataFrame:
        """``(id, boost, text_logit)`` of a split's rows under every model, from its TF-IDF rows read once."""
        sums = text_sums(self.base.tfidf_for(split), [m.text_weights.select("idx", "coef") for m in models.values()])
        each = F.array(*[F.struct(F.lit(b).alias("boost"), F.col(f"s{k}").alias("text_logit")) for k, b in enumerate(models)])
        return sums.select("id", F.explode(each).alias("_e")).select("id", "_e.boost", "_e.text_logit")

    def scored_text(self, split: str):
        """Rows of a split with extended-word features, and a function that adds a model's text logit to them."""
        return lambda model: (self.ext.rows(split).join(self.text_logits(split, {0: model}).drop("boost"), "id", "left")
                              .withColumn("text_logit", F.coalesce("text_logit", F.lit(0.0))))


def at_boost(rows: DataFrame, model, boost: int) -> DataFrame:
    """Emoji signal at ``boost`` and the model's logit and label, from rows that have ``text_logit``."""
    from .model import numeric_logit
    out = rescale(rows, boost).withColumn("logit", F.col("text_logit") + numeric_logit(model) + F.lit(model.intercept))
    return out.withColumn("p1", S.sigmoid("logit")).withColumn("model_prediction", F.when(F.col("logit") > 0, 1).otherwise(0))


def grid_labels(logits: DataFrame, rows: DataFrame, models: dict, thresholds: dict) -> DataFrame:
    """Labels of the rows at every boost and guard, from the text logits of all boosts."""
    out = None
    for boost, model in models.items():
        own = logits.where(F.col("boost") == boost).drop("boost")
        r = rows.join(own, "id", "left").withColumn("text_logit", F.coalesce("text_logit", F.lit(0.0)))
        g = guarded(at_boost(r, model, boost), boost, thresholds[boost]).select("boost", "threshold", "guard", "label", "prediction_int")
        out = g if out is None else out.unionByName(g)
    return out


def grid_case_labels(model, rows: DataFrame, boost: int, threshold: int) -> DataFrame:
    from .model import score_relational
    s = guarded(score_relational(rescale(rows, boost), model), boost, threshold)
    return s.select("boost", "threshold", "guard", "label", "category", "prediction_int")


def guarded(scored: DataFrame, boost: int, threshold: int) -> DataFrame:
    """Each scored row under every guard of the veto (a literal array exploded per row)."""
    s = scored.withColumn("guard", F.explode(F.array(*[F.lit(g) for g in GUARDS])))
    fired = S.sarcasm_veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count", threshold, F.col("guard"))
    return s.withColumns({"boost": F.lit(boost), "threshold": F.lit(threshold),
                          "prediction_int": F.when(fired, 0).otherwise(F.col("model_prediction"))})


def grid_table(grid: str, val: DataFrame, cases: DataFrame) -> DataFrame:
    """Metrics of the validation rows and pass counts of the cases, per configuration."""
    from .evaluate import metrics
    keys = ["boost", "threshold", "guard"]
    met = metrics(val, p="prediction_int", by=keys).drop("n")
    ok = (F.col("prediction_int") == F.col("label")).cast("int")
    beh = cases.groupBy(*keys).agg(F.round(F.avg(ok), 6).alias("behavioral"),
                                   *[F.sum(F.when(F.col("category") == cat, ok).otherwise(0)).cast("bigint").alias(cat.replace("-", "_"))
                                     for cat in ("sarcasm", "pos-overwhelm", "genuine-sad", "text-dominant")])
    # both sides hold one row per configuration (tens of rows)
    return met.join(beh, keys).select(F.lit(grid).alias("grid"), *keys, "accuracy", "f1", "behavioral", "sarcasm", "pos_overwhelm",
                                      "genuine_sad", "text_dominant")


DECISION_METRICS = ("accuracy", "f1", "behavioral", "sarcasm", "pos_overwhelm")


def decision(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per metric: the best configuration of each grid, the winner, and which grid is adopted.

    Best: behaviour, then sarcasm, overwhelm, accuracy.  B is adopted only if it beats A on behaviour or
    overwhelm without losing sarcasm."""
    order = [F.col(c).desc() for c in ("behavioral", "sarcasm", "pos_overwhelm", "accuracy")] + ["boost", "guard"]
    best = a.orderBy(*order).limit(1).unionByName(b.orderBy(*order).limit(1))
    row = best.groupBy().agg(*[F.max(F.when(F.col("grid") == g, F.col(c).cast("double"))).alias(f"{c}_{g}") for c in DECISION_METRICS for g in "AB"])
    adopt_b = (((F.col("behavioral_B") > F.col("behavioral_A")) | (F.col("pos_overwhelm_B") > F.col("pos_overwhelm_A")))
               & (F.col("sarcasm_B") >= F.col("sarcasm_A")))
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_A").alias("option_a"), F.col(f"{c}_B").alias("option_b"),
                              F.when(F.col(f"{c}_B") > F.col(f"{c}_A"), "B").when(F.col(f"{c}_A") > F.col(f"{c}_B"), "A").otherwise("tie").alias("winner"))
                     for c in DECISION_METRICS])
    return row.select(F.explode(each).alias("m"), F.when(adopt_b, "B").otherwise("A").alias("adopted")).select("m.*", "adopted")


# FIXED VALUES — the case that a strict veto must catch and a soft one may not: (text, expected, category).
INTEGRITY_CASE = (("I love bugs 😭", 0, "integrity"),)
STRATEGIES = (("base_ml", None), ("soft_veto", 1), ("strict_veto", 2))


def veto_strategy(model, rows_for, integrity: DataFrame) -> DataFrame:
    """Accuracy, F1 and delta without veto and with both guards, and whether the veto catches the integrity case."""
    from .evaluate import metrics
    scored = at_boost(rows_for(model), model, L.EMOJI_BOOST)
    out = None
    for name, guard in STRATEGIES:
        fired = F.lit(False) if guard is None else S.sarcasm_veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count", L.EMOJI_BOOST, guard)
        m = metrics(scored.withColumn("prediction_int", F.when(fired, 0).otherwise(F.col("model_prediction"))), p="prediction_int")
        caught = integrity.agg(F.every(fired).alias("integrity_veto"))
        m = m.join(F.broadcast(caught)).withColumn("strategy", F.lit(name))  # one row each
        out = m if out is None else out.unionByName(m)
    base = F.max(F.when(F.col("strategy") == "base_ml", F.col("accuracy"))).over(Window.partitionBy())  # three rows
    return out.select("strategy", "accuracy", "f1", F.round(F.col("accuracy") - base, 6).alias("delta"), "integrity_veto")


def cases_scored(model, rows: DataFrame, boost: int, veto: str) -> DataFrame:
    s = score_at(model, rows, boost, veto=veto)
    return (s.select(F.lit(boost).alias("boost"), "id", "category", "label", "prediction_int", "fired", "confidence")
            .withColumn("passed", F.col("prediction_int") == F.col("label")))


def boost_floor(cases: DataFrame) -> DataFrame:
    """Passed cases and average confidence per boost; ``best``: most passed, then most confident, then smallest."""
    per = cases.groupBy("boost").agg(F.sum(F.col("passed").cast("int")).cast("bigint").alias("passed"),
                                     F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    first = F.row_number().over(Window.orderBy(F.col("passed").desc(), F.col("avg_confidence").desc(), "boost"))  # a row per boost
    return per.withColumn("best", first == 1)


def score_at(model, rows: DataFrame, boost: int, threshold=L.EMOJI_BOOST, guard=L.VETO_GUARD,
             veto: str = "production") -> DataFrame:
    """Relational score of ``rows`` (boost-10 features) at ``boost`` with the given veto rule."""
    from .model import score_relational
    s = score_relational(rescale(rows, boost), model)
    if veto == "original":
        fired = S.original_veto_fires("emoji_neg_count", "emoji_pos_count", threshold)
        conf = F.lit(L.ORIGINAL_VETO_CONFIDENCE)
    elif veto == "none":
        fired, conf = F.lit(False), F.lit(None).cast("double")
    else:
        fired = S.sarcasm_veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count", threshold, guard)
        conf = S.veto_confidence("emoji_neg_count", "emoji_pos_count")
    return (s.withColumn("fired", fired)
            .withColumn("prediction_int", F.when(fired, 0).otherwise(F.col("model_prediction")))
            .withColumn("confidence", F.round(F.when(fired, conf).otherwise(S.confidence("p1")), 4)))


def case_rows(spark, cases, extended: bool = False) -> DataFrame:
    from .features import add_polarity_features
    df = spark.createDataFrame([(i, t, e, c) for i, (t, e, c) in enumerate(cases)],
                               "id long, text string, label int, category string")
    return add_polarity_features(df, extended_words=extended)
