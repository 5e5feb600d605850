"""Evaluation of scored rows: metrics, confusion, calibration, error analysis, ablation
(§2.7, §2.8, §2.10).  By default the model's own label and confidence are judged; the veto-resolved ones
can be named instead.  Every metric is a single aggregation pass; per-group samples use
a window partitioned by the (few) group keys over the *error* rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from .quality import count_if


def _tp_fp_fn(y: Column, p: Column):
    return (count_if((y == 1) & (p == 1)), count_if((y == 0) & (p == 1)), count_if((y == 1) & (p == 0)))


def f1_expr(tp: Column, fp: Column, fn: Column) -> Column:
    den = 2 * tp + fp + fn
    return F.when(den == 0, F.lit(0.0)).otherwise((2 * tp).cast("double") / den)


def metrics(df: DataFrame, y: str = "label", p: str = "model_prediction", by=None) -> DataFrame:
    """accuracy and binary F1 (positive class 1; 0 when undefined), optionally per group."""
    tp, fp, fn = _tp_fp_fn(F.col(y), F.col(p))
    g = df.groupBy(*by) if by else df.groupBy()
    out = g.agg(F.avg((F.col(y) == F.col(p)).cast("int")).alias("_acc"), tp.alias("_tp"), fp.alias("_fp"),
                fn.alias("_fn"), F.count(F.lit(1)).alias("n"))
    return out.select(*(by or []), F.round("_acc", 6).alias("accuracy"),
                      F.round(f1_expr(F.col("_tp"), F.col("_fp"), F.col("_fn")), 6).alias("f1"),
                      F.col("n").cast("bigint").alias("n"))


def classification_report(df: DataFrame, y: str = "label", p: str = "model_prediction") -> DataFrame:
    """precision / recall / f1 / support for each class, then accuracy, macro and weighted avg."""
    yy, pp = F.col(y), F.col(p)
    row = df.agg(*[count_if((yy == c) & (pp == c)).alias(f"tp{c}") for c in (0, 1)],
                 *[count_if(pp == c).alias(f"pred{c}") for c in (0, 1)],
                 *[count_if(yy == c).alias(f"sup{c}") for c in (0, 1)],
                 F.count(F.lit(1)).alias("n"))

    def ratio(a, b):
        return F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.col(a) / F.col(b))

    cls = []
    for c in (0, 1):
        prec, rec = ratio(f"tp{c}", f"pred{c}"), ratio(f"tp{c}", f"sup{c}")
        f1 = F.when(prec + rec == 0, F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
        cls.append((str(c), prec, rec, f1, F.col(f"sup{c}")))
    acc = (F.col("tp0") + F.col("tp1")) / F.col("n")
    rows = [F.struct(F.lit(name).alias("class"), pr.alias("precision"), rc.alias("recall"), f.alias("f1"),
                     s.cast("bigint").alias("support")) for name, pr, rc, f, s in cls]
    rows.append(F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), acc.alias("f1"), F.col("n").cast("bigint").alias("support")))
    for name, weight in (("macro avg", None), ("weighted avg", True)):
        if weight:
            w0, w1 = F.col("sup0") / F.col("n"), F.col("sup1") / F.col("n")
        else:
            w0 = w1 = F.lit(0.5)
        rows.append(F.struct(F.lit(name).alias("class"),
                             (cls[0][1] * w0 + cls[1][1] * w1).alias("precision"),
                             (cls[0][2] * w0 + cls[1][2] * w1).alias("recall"),
                             (cls[0][3] * w0 + cls[1][3] * w1).alias("f1"),
                             F.col("n").cast("bigint").alias("support")))
    out = row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def confusion_matrix(df: DataFrame, y: str = "label", p: str = "model_prediction") -> DataFrame:
    """2×2 counts with zero cells kept: one row per true class, columns pred_0 / pred_1."""
    yy, pp = F.col(y), F.col(p)
    row = df.agg(*[count_if((yy == a) & (pp == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    rows = [F.struct(F.lit(a).alias("true_label"), F.col(f"c{a}0").cast("bigint").alias("pred_0"),
                     F.col(f"c{a}1").cast("bigint").alias("pred_1")) for a in (0, 1)]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def with_outcome(df: DataFrame, y: str = "label", p: str = "model_prediction") -> DataFrame:
    return df.withColumns({"correct": F.col(y) == F.col(p),
                           "false_negative": (F.col(y) == 1) & (F.col(p) == 0),
                           "false_positive": (F.col(y) == 0) & (F.col(p) == 1)})


def error_counts(df: DataFrame, text: str = "text") -> DataFrame:
    o = with_outcome(df)
    return o.agg(count_if(~F.col("correct")).cast("bigint").alias("wrong"),
                 count_if(F.col("false_negative")).cast("bigint").alias("false_negatives"),
                 count_if(F.col("false_positive")).cast("bigint").alias("false_positives"),
                 count_if(~F.col("correct") & S.emoji_error_flag(text)).cast("bigint").alias("wrong_with_emoji"))


def calibration_bins(df: DataFrame, conf: str = "model_confidence") -> DataFrame:
    """count and accuracy per right-closed confidence bin; empty bins (and conf = 0.5) absent."""
    o = with_outcome(df).withColumn("conf_bin", S.bin_confidence(conf)).where(F.col("conf_bin").isNotNull())
    return o.groupBy("conf_bin").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                     F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


def archetype_summary(df: DataFrame, text: str = "text", conf: str = "model_confidence") -> DataFrame:
    wrong = with_outcome(df).where(~F.col("correct")).withColumn("archetype", S.classify_archetype(text, "label"))
    return wrong.groupBy("archetype").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                          F.round(F.avg(conf), 6).alias("avg_confidence"))


def danger_cases(df: DataFrame, conf: str = "model_confidence", threshold: float = 0.85) -> DataFrame:
    """Wrong with confidence >= threshold, most confident first (ties by id)."""
    o = with_outcome(df)
    return o.where(~F.col("correct") & (F.col(conf) >= threshold)).orderBy(F.col(conf).desc(), "id")


def sample_errors_per_archetype(df: DataFrame, per_group: int = 3, text: str = "text") -> DataFrame:
    """First ``per_group`` wrong rows (by id) of every archetype (salted two-step top-k)."""
    from .topk import top_k_per_group
    wrong = with_outcome(df).where(~F.col("correct")).withColumn("archetype", S.classify_archetype(text, "label"))
    return top_k_per_group(wrong, ["archetype"], [F.col("id")], per_group)


def confidence_range_by_path(df: DataFrame, conf: str = "confidence") -> DataFrame:
    return df.groupBy("veto_applied").agg(F.min(conf).alias("min_confidence"), F.max(conf).alias("max_confidence"),
                                          F.count(F.lit(1)).cast("bigint").alias("n"))


def veto_misfire_rate(df: DataFrame, fired: str = "veto_applied", y: str = "label") -> DataFrame:
    """Fires, correct fires (true label 0), misfire share (null when nothing fired)."""
    row = df.agg(count_if(F.col(fired)).alias("fires"), count_if(F.col(fired) & (F.col(y) == 0)).alias("correct_fires"))
    return row.select(F.col("fires").cast("bigint"), F.col("correct_fires").cast("bigint"),
                      F.when(F.col("fires") == 0, F.lit(None).cast("double"))
                      .otherwise(F.round((F.col("fires") - F.col("correct_fires")) / F.col("fires"), 6)).alias("misfire_rate"))


# ---------------------------------------------------------------- ablation

ABLATIONS = (
    ("full", ()),
    ("no_emoji", ("emoji_pos_count", "emoji_neg_count")),
    ("no_words", ("word_pos_count", "word_neg_count")),
    ("no_numerics", L.NUMERIC_FEATURES),
)


def ablation_frame(scored: DataFrame, model) -> DataFrame:
    """Every row × every ablation (a literal array exploded per row, not a join): the logit
    recomputed without the zeroed addends, and whether the label flips."""
    from .model import numeric_logit
    cfg = F.array(*[F.struct(F.lit(name).alias("ablation"),
                             numeric_logit(model, skip=skip).alias("num_logit")) for name, skip in ABLATIONS])
    out = scored.withColumn("_cfg", F.explode(cfg)).select("*", "_cfg.ablation", "_cfg.num_logit").drop("_cfg")
    logit = F.col("text_logit") + F.col("num_logit") + F.lit(model.intercept)
    return (out.withColumn("ablated_logit", logit)
            .withColumn("ablated_prediction", F.when(F.col("ablated_logit") > 0, 1).otherwise(0))
            .withColumn("flipped", F.col("ablated_prediction") != F.col("model_prediction")))


def feature_ablation(scored: DataFrame, model, y: str = "label") -> DataFrame:
    """accuracy per ablation, delta vs the full model, and number of flipped labels."""
    a = ablation_frame(scored, model)
    per = a.groupBy("ablation").agg(F.avg((F.col(y) == F.col("ablated_prediction")).cast("int")).alias("_acc"),
                                    count_if(F.col("flipped")).cast("bigint").alias("flips"))
    # the window spans the per-ablation result (one row per configuration), not the data
    base = F.max(F.when(F.col("ablation") == "full", F.col("_acc"))).over(Window.partitionBy())
    return per.select("ablation", F.round("_acc", 6).alias("accuracy"), F.round(F.col("_acc") - base, 6).alias("delta"), "flips")


def decisive_cases(scored: DataFrame, model) -> DataFrame:
    """Rows whose label changes without the numerics, and for which the emoji block alone restores it."""
    from .model import numeric_logit
    no_num = F.col("text_logit") + F.lit(model.intercept)
    emoji_only = no_num + numeric_logit(model, cols=("emoji_pos_count", "emoji_neg_count"))
    return (scored.withColumn("pred_no_numerics", F.when(no_num > 0, 1).otherwise(0))
            .withColumn("pred_emoji_only", F.when(emoji_only > 0, 1).otherwise(0))
            .where((F.col("pred_no_numerics") != F.col("model_prediction")) & (F.col("pred_emoji_only") == F.col("model_prediction"))))
