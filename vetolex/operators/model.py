"""Linear text model over TF-IDF ‖ 4 numeric features, scored relationally (§2.10, §2.5, §2.8).

A model is a weights table ``(term, idx, idf, coef)`` — text terms carry an idf,
the four numeric features carry ``idf = null`` and the last four indices — plus an
intercept.  Rows are scored in place while the weights are small enough to be broadcast, by their
measured bytes, and else by joins and grouped sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from . import rowlocal
from .text import by_row, term_occurrences

WEIGHTS_SCHEMA = "term string, idx long, idf double, coef double"


@dataclass(frozen=True)
class TextSettings:
    """How the text block of a model was made; part of the model, saved and checked with it."""
    analyzer: str = "word"
    ngram_min: int = 1
    ngram_max: int = 2
    lowercase: bool = True
    token_pattern: str = L.TOKEN_PATTERN
    stop_words: bool = False
    strip_accents: bool = False
    binary: bool = False
    sublinear_tf: bool = False
    norm: str = "l2"
    smooth_idf: bool = True
    n_classes: int = 2


#: What the relational scorer reproduces.
SUPPORTED = TextSettings()


class UnsupportedModel(ValueError):
    """A model whose settings the scorer does not reproduce."""


def unsupported_settings(settings: TextSettings) -> list[str]:
    """Names of the settings that the scorer does not reproduce; it counts n-grams up to any length."""
    return [f.name for f in fields(TextSettings) if f.name != "ngram_max" and getattr(settings, f.name) != getattr(SUPPORTED, f.name)] \
        + (["ngram_max"] if settings.ngram_max not in (1, 2) else [])


@dataclass
class LinearTextModel:
    weights: DataFrame          # (term, idx, idf, coef); numerics have idf null
    intercept: float
    numeric_coef: dict          # feature name -> coefficient (4 values, held on the driver)
    n_text: int                 # vocabulary size
    ngram_max: int = 2
    settings: TextSettings = SUPPORTED
    _sent: list = field(default_factory=list, repr=False, compare=False)

    def __post_init__(self):
        bad = unsupported_settings(self.settings)
        if bad or self.settings.ngram_max != self.ngram_max:
            raise UnsupportedModel(f"the scorer does not reproduce {bad or ['ngram_max']} of {self.settings}")

    @property
    def text_weights(self) -> DataFrame:
        return self.weights.where(F.col("idf").isNotNull())

    def sent(self):
        """The weights as tasks hold them, sent once; None if they are larger than the session lets broadcast now."""
        bound = rowlocal.byte_limit(self.weights.sparkSession)
        if not self._sent or self._sent[0] != bound:
            self._sent[:] = [bound, rowlocal.packed(self.text_weights)]
        return self._sent[1]


def model_from_weights(weights: DataFrame, intercept: float, ngram_max: int = 2, settings: TextSettings = SUPPORTED) -> LinearTextModel:
    """Build a model from a weights table, checking that the numeric block is complete."""
    nums = {r["term"]: (r["idx"], r["coef"]) for r in weights.where(F.col("idf").isNull()).collect()}
    missing = [c for c in L.NUMERIC_FEATURES if c not in nums]
    if missing:
        raise ValueError(f"weights lack numeric features {missing}")
    n_text = weights.where(F.col("idf").isNotNull()).count()
    for k, c in enumerate(L.NUMERIC_FEATURES):
        if nums[c][0] != n_text + k:
            raise ValueError(f"numeric feature {c} has index {nums[c][0]}, expected {n_text + k}")
    return LinearTextModel(weights, float(intercept), {c: float(nums[c][1]) for c in L.NUMERIC_FEATURES}, n_text, ngram_max,
                           replace(settings, ngram_max=ngram_max))


# ---------------------------------------------------------------- fixed demonstration model

# FIXED VALUES — a small hand-set model (our own choice, not a trained artifact) so
# scoring, drivers, veto, calibration and ablation are deterministic and checkable
# against SQL.  (term, idf, coef); terms occur in the documents or the post suffixes.
FIXED_TEXT_WEIGHTS = (
    ("the", 1.05, 0.02), ("of", 1.10, -0.03), ("and", 1.08, 0.05), ("to", 1.20, 0.01),
    ("in", 1.22, -0.02), ("is", 1.30, -0.04), ("that", 1.40, 0.03), ("de", 1.50, -0.05),
    ("la", 1.70, 0.04), ("der", 1.80, -0.06), ("this", 2.00, -0.10), ("so", 2.50, 0.15),
    ("love", 3.20, 1.25), ("hate", 3.40, -1.45), ("great", 3.00, 0.95), ("bugs", 3.60, -0.85),
    ("wonderful", 3.30, 0.90), ("terrible", 3.50, -1.60), ("good", 3.10, 0.70), ("bad", 3.20, -0.80),
    ("beautiful", 3.40, 0.75), ("amazing", 3.30, 0.80), ("having", 3.50, -0.20), ("see", 3.00, 0.10),
    ("http", 3.70, -0.30), ("excellent", 3.60, 1.10), ("perfect", 3.50, 1.05), ("unhappy", 3.80, -1.20),
    ("whatever", 3.80, -0.40), ("xd", 3.90, 0.60),
    ("of the", 1.60, 0.04), ("in the", 1.90, -0.03), ("the the", 1.70, -0.02), ("love having", 4.00, 0.30),
    ("having bugs", 4.00, -0.90), ("is terrible", 4.00, -0.50), ("so beautiful", 4.00, 0.40),
    ("good good", 4.00, 0.20), ("great wonderful", 4.00, 0.60),
)
FIXED_NUMERIC_COEF = (("emoji_pos_count", 0.085), ("emoji_neg_count", -0.095),
                      ("word_pos_count", 0.55), ("word_neg_count", -0.65))
FIXED_INTERCEPT = 0.12


def fixed_weight_rows():
    terms = sorted(FIXED_TEXT_WEIGHTS, key=lambda r: r[0])
    rows = [(t, i, idf, coef) for i, (t, idf, coef) in enumerate(terms)]
    rows += [(name, len(terms) + k, None, coef) for k, (name, coef) in enumerate(FIXED_NUMERIC_COEF)]
    return rows


def fixed_model(spark: SparkSession) -> LinearTextModel:
    w = spark.createDataFrame(fixed_weight_rows(), WEIGHTS_SCHEMA)
    return LinearTextModel(w, FIXED_INTERCEPT, dict(FIXED_NUMERIC_COEF), len(FIXED_TEXT_WEIGHTS), 2)


# ---------------------------------------------------------------- relational scoring

def text_contributions(df: DataFrame, model: LinearTextModel, text: str = "text", id_col: str = "id") -> DataFrame:
    """``(id, term, idx, idf, coef, tf)`` for in-vocabulary n-grams (OOV dropped by the inner join)."""
    occ = term_occurrences(df, text, id_col, model.ngram_max)
    j = occ.join(model.text_weights.select("term", "idx", "idf", "coef"), "term")
    return j.groupBy("id", "term", "idx", "idf", "coef").agg(F.count(F.lit(1)).alias("tf"))


KEEP_DRIVERS = 3


def text_block(df: DataFrame, model: LinearTextModel, text: str = "text", id_col: str = "id",
               drivers: int | None = KEEP_DRIVERS) -> DataFrame:
    """Per row: normalised text logit and active text drivers (idx, token, weight).

    ``drivers``: how many to keep, the strongest by rounded weight, ties by index (None: all).  A row's
    known terms are gathered and then cut, so only the kept ones travel on."""
    c = text_contributions(df, model, text, id_col)
    x = F.col("tf") * F.col("idf")
    own = F.collect_list(F.struct((-F.abs(F.round("coef", 4))).alias("key"), F.col("idx"), F.col("term").alias("token"),
                                  F.round("coef", 4).alias("weight")))
    ranked = F.array_sort(own)
    ranked = ranked if drivers is None else F.slice(ranked, 1, drivers)
    return c.groupBy("id").agg(
        (F.sum(x * F.col("coef")) / F.sqrt(F.sum(x * x))).alias("text_logit"),
        F.transform(ranked, lambda d: F.struct(d["idx"].alias("idx"), d["token"].alias("token"), d["weight"].alias("weight"))).alias("text_drivers"))


def numeric_logit(model: LinearTextModel, cols=L.NUMERIC_FEATURES, skip=()) -> Column:
    out = F.lit(0.0)
    for c in cols:
        if c not in skip:
            out = out + F.col(c).cast("double") * F.lit(model.numeric_coef[c])
    return out


def score_relational(df: DataFrame, model: LinearTextModel, text: str = "text", id_col: str = "id",
                     drivers: int | None = KEEP_DRIVERS, rows: DataFrame | None = None) -> DataFrame:
    """Adds ``text_logit, logit, p1, model_prediction, text_drivers``.

    Rows are scored where they are as long as the model's weights may be broadcast, by their measured bytes;
    a larger model is joined (:func:`score_joined`).  Rows without any known term keep intercept + numerics."""
    sent = model.sent()
    if sent is None:
        return score_joined(df, model, text, id_col, drivers, rows)
    out = df.withColumn("_vx_tok", S.tokenize(text)).withColumn("_vx_s", rowlocal.text_score(F.col("_vx_tok"), sent, drivers))
    return _decided(out.select(*df.columns, "_vx_s.text_logit", "_vx_s.text_drivers"), model)


def score_joined(df: DataFrame, model: LinearTextModel, text: str = "text", id_col: str = "id",
                 drivers: int | None = KEEP_DRIVERS, rows: DataFrame | None = None) -> DataFrame:
    """The same by a join on the terms, for weights of any size: a left join back from the rows.

    ``rows``: the raw rows by key that ``df`` was derived from; given, both branches read one exchange."""
    if rows is None:
        df = rows = by_row(df, id_col)
    tb = text_block(rows, model, text, id_col, drivers).withColumnRenamed("id", id_col)
    out = df.join(tb, id_col, "left")
    return _decided(out.withColumn("text_logit", F.coalesce(F.col("text_logit"), F.lit(0.0))).withColumn(
        "text_drivers", F.coalesce(F.col("text_drivers"), F.array().cast("array<struct<idx:bigint,token:string,weight:double>>"))), model)


def _decided(df: DataFrame, model: LinearTextModel) -> DataFrame:
    return (df.withColumn("logit", F.col("text_logit") + numeric_logit(model) + F.lit(model.intercept))
            .withColumn("p1", S.sigmoid("logit"))
            .withColumn("model_prediction", F.when(F.col("logit") > 0, 1).otherwise(0)))


def numeric_drivers(model: LinearTextModel) -> Column:
    items = []
    for k, c in enumerate(L.NUMERIC_FEATURES):
        d = F.struct(F.lit(model.n_text + k).cast("long").alias("idx"), F.lit(c).alias("token"),
                     F.lit(round(model.numeric_coef[c], 4)).alias("weight"))
        items.append(F.when(F.col(c) != 0, d))
    return F.filter(F.array(*items), lambda d: d.isNotNull())


def active_drivers(model: LinearTextModel) -> Column:
    """All active features (terms present ‖ non-zero numerics) with their coefficient."""
    return F.concat(F.col("text_drivers"), numeric_drivers(model))


def rank_drivers(drivers: Column, veto: Column, keep: int = 3) -> Column:
    """Order by |rounded weight| desc, ties by feature index; on veto the negative-emoji
    driver goes first; keep ``keep``."""
    keyed = F.transform(drivers, lambda d: F.struct(
        F.when(veto & (d["token"] == "emoji_neg_count"), 0).otherwise(1).alias("k0"),
        (-F.abs(d["weight"])).alias("k1"), d["idx"].alias("k2"), d["token"].alias("token"), d["weight"].alias("weight")))
    ordered = F.transform(F.array_sort(keyed), lambda d: F.struct(d["token"].alias("token"), d["weight"].alias("weight")))
    return F.slice(ordered, 1, keep)


def resolve(df: DataFrame, guard=L.VETO_GUARD, threshold=L.EMOJI_BOOST) -> DataFrame:
    """Veto wins, else the model (``predict.py`` order): label, confidence, ambiguity flag."""
    veto = S.sarcasm_veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count", threshold, guard)
    conf_raw = F.when(veto, S.veto_confidence("emoji_neg_count", "emoji_pos_count")).otherwise(S.confidence("p1"))
    return (df.withColumn("veto_applied", veto)
            .withColumn("prediction_int", F.when(veto, F.lit(0)).otherwise(F.col("model_prediction")))
            .withColumn("confidence_raw", conf_raw)
            .withColumn("confidence", F.round("confidence_raw", 4))
            .withColumn("entropy_flag", S.entropy_flag("confidence_raw"))
            .withColumn("model_confidence", S.confidence("p1")))


def predict_sentiment(df: DataFrame, model: LinearTextModel, text: str = "text", id_col: str = "id",
                      event_time: Column | None = None, keep_drivers: int = KEEP_DRIVERS) -> DataFrame:
    """Features → score → veto → confidence → flag → explained 8-field record (+ id)."""
    from .features import add_polarity_features
    rows = df.select(id_col, text)
    if model.sent() is None:
        rows = by_row(rows, id_col)
    scored = resolve(score_relational(add_polarity_features(rows, text), model, text, id_col, keep_drivers, rows))
    ts = event_time if event_time is not None else F.current_timestamp()
    return scored.select(
        id_col,
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col(text).alias("raw_text"),
        S.label_decode("prediction_int").alias("prediction"),
        "prediction_int", "confidence", "entropy_flag", "veto_applied",
        rank_drivers(active_drivers(model), F.col("veto_applied"), keep_drivers).alias("top_drivers"),
    )


def scored_frame(df: DataFrame, model: LinearTextModel, text: str = "text", extended_words: bool = False,
                 drivers: int | None = KEEP_DRIVERS) -> DataFrame:
    """Features + model + veto columns, used by the evaluation operators."""
    from .features import add_polarity_features
    rows = df if model.sent() is not None else by_row(df)
    return resolve(score_relational(add_polarity_features(rows, text, extended_words=extended_words), model, text, drivers=drivers, rows=rows))


def global_signals(model: LinearTextModel, top_n: int = 5) -> DataFrame:
    """The ``top_n`` strongest positive and negative weights (rounded to 2), ties by index."""
    w = model.weights.select("term", "idx", "coef")
    pos = w.orderBy(F.col("coef").desc(), "idx").limit(top_n).withColumn("direction", F.lit("positive"))
    neg = w.orderBy(F.col("coef").asc(), "idx").limit(top_n).withColumn("direction", F.lit("negative"))
    return pos.unionByName(neg).select("direction", F.col("term").alias("token"), "idx", F.round("coef", 2).alias("weight"))


# ---------------------------------------------------------------- second scorer

def score_rowwise(df: DataFrame, model: LinearTextModel, text: str = "text") -> DataFrame:
    """Same decision as :func:`score_relational` by other arithmetic, for :func:`parity_join`.

    No term is counted by grouping: each row's known n-grams are gathered in index order and one
    walk along them counts the runs and sums both parts of the normalised product.  Linear in the
    row's length but for that sort, whatever the size of the vocabulary."""
    rows = by_row(df)
    occ = term_occurrences(rows, text, "id", model.ngram_max).join(model.text_weights.select("term", "idx", "idf", "coef"), "term")
    grams = occ.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "idf", "coef"))).alias("_g"))
    zero = F.lit(0.0)
    start = F.struct(F.lit(-1).cast("long").alias("idx"), zero.alias("x"), zero.alias("coef"), zero.alias("dot"), zero.alias("sq"))

    def closed(s, idx, x, coef):
        # the run that ends here goes into the sums
        return F.struct(idx.alias("idx"), x.alias("x"), coef.alias("coef"), (s["dot"] + s["x"] * s["coef"]).alias("dot"),
                        (s["sq"] + s["x"] * s["x"]).alias("sq"))

    def step(s, g):
        same = F.struct(s["idx"].alias("idx"), (s["x"] + g["idf"]).alias("x"), s["coef"].alias("coef"), s["dot"].alias("dot"), s["sq"].alias("sq"))
        return F.when(g["idx"] == s["idx"], same).otherwise(closed(s, g["idx"], g["idf"], g["coef"]))

    walked = F.aggregate("_g", start, step, lambda s: closed(s, F.lit(-1).cast("long"), zero, zero))
    sums = grams.select("id", walked.alias("_a"))
    out = rows.join(sums, "id", "left")
    text_logit = F.when(F.col("_a.sq") > 0, F.col("_a.dot") / F.sqrt(F.col("_a.sq"))).otherwise(zero)
    out = out.withColumn("text_logit", text_logit).drop("_a")
    logit = F.col("text_logit") + numeric_logit(model) + F.lit(model.intercept)
    return (out.withColumn("logit", logit).withColumn("p1", S.sigmoid("logit"))
            .withColumn("model_prediction", F.when(F.col("logit") > 0, 1).otherwise(0)))


def parity_join(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """Row-by-row comparison of two scorers: full outer join on the row key."""
    return (a.select(id_col, F.col("p1").alias("p1_a"), F.col("model_prediction").alias("pred_a"))
            .join(b.select(id_col, F.col("p1").alias("p1_b"), F.col("model_prediction").alias("pred_b")), id_col, "full_outer"))
