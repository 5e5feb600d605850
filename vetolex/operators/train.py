"""Training on the relational TF-IDF (§2.10: ``assemble_hybrid``, ``train_logistic``,
``extract_weights``, ``score_mllib``, ``parity_check``, ``train_evaluate``).

* TF-IDF is fitted on the training rows only (vocabulary, idf), in long form.
* Feature vectors are ``TF-IDF block ‖ 4 numerics`` as sparse vectors; only the
  labelled training rows are turned into vectors.
* The objective is ``Σ logloss + ½‖w‖²`` with a free intercept, fitted by MLlib's ``LogisticRegression`` up to
  MLLIB_COLUMNS columns and beyond that by :mod:`.wide`, which needs no vector of that length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import lexicons as L
from ..session import cut
from . import text as T
from . import wide as W
from .features import add_polarity_features
from .model import LinearTextModel, model_from_weights
from .persist import scratch_path
from .split import split_hash, stratified_split

#: A fit whose mean loss has a partial derivative above TOL is refused; the solver's own tolerance is tighter.
MAX_ITER, TOL, SOLVER_TOL = 300, 1e-6, 1e-10
#: Weight of the two rows that set the scale of the text columns, and n times what they add to the variance of each.
WEIGHTLESS, COLUMN_FLOOR = 1e-14, 16.0
#: Columns up to which MLlib's solver fits; it keeps about 26 vectors of that length on the driver, in each of three fits side by side.
MLLIB_COLUMNS = 300_000
#: Non-zeros in a partition of training vectors, about 12 bytes each, and as many as make a core worth while.
NNZ_PER_PARTITION, NNZ_PER_CORE = 4_000_000, 2_000_000
#: Megabytes of a block of vectors that MLlib multiplies at once.
BLOCK_MB = 4.0


class NotConverged(RuntimeError):
    pass


@dataclass
class Fit:
    model: LogisticRegressionModel | W.WideModel
    iterations: int
    max_gradient: float        # of the mean loss, at the end


@dataclass
class TrainingRun:
    data: DataFrame            # id, label, text, numerics, split (persisted)
    vocab: DataFrame           # term, df, idf, idx (persisted)
    n_text: int
    n_train: int               # rows fitted on
    n_train_all: int           # rows of the training split, more only if the caller gave a bound
    numeric_cols: tuple
    boost: int = L.EMOJI_BOOST
    tfidf_cache: dict = field(default_factory=dict)
    train_tf: DataFrame | None = None  # id, term, tf of the training rows (persisted)

    def rows(self, split: str) -> DataFrame:
        return self.data.where(F.col("split") == split)

    def tfidf_for(self, split: str) -> DataFrame:
        """TF-IDF rows of one split, unpacked from :meth:`text_rows`."""
        return self.text_rows(split).select("id", F.explode("_tv").alias("_e")).select("id", "_e.idx", "_e.value")

    def text_rows(self, split: str) -> DataFrame:
        """TF-IDF entries of one split gathered by row (:func:`gathered`), written once to the shared folder: the text
        block does not change between fits (boosts and numeric feature sets only change the numerics)."""
        if split not in self.tfidf_cache:
            rows = self.train_tf if split == "train" and self.train_tf is not None else self.rows(split)
            self.tfidf_cache[split] = cut(gathered(tfidf_rows(self, rows)))
        return self.tfidf_cache[split]

    def text_blocks(self) -> W.TextBlocks:
        """The training texts' TF-IDF by column, for wide fits, stored once: term counts, scaled by idf and the rows' norms.

        Nothing is gathered by row: the joined counts go to their column's block."""
        if "blocks" not in self.tfidf_cache:
            rows = self.rows("train")
            tf = self.train_tf if self.train_tf is not None else T.term_frequency(rows)
            j = T.join_vocabulary(tf.where("id is not null").select("id", "term", F.col("tf").cast("int").alias("value")), self.vocab.select("term", "idx"))
            keys = rows.where("id is not null").select(F.col("id").alias("key")).distinct()
            total = self.vocab.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
            blocks = W.text_blocks(keys, j.select(F.col("id").alias("key"), "idx", "value"), total, self.vocab.select("idx", F.col("idf").alias("scale")))
            self.tfidf_cache["blocks"] = blocks.normalised()
        return self.tfidf_cache["blocks"]

    def is_wide(self, numeric_cols=None) -> bool:
        return self.n_text + len(self.numeric_cols if numeric_cols is None else numeric_cols) > MLLIB_COLUMNS


def prepare(posts: DataFrame, numeric_cols=L.NUMERIC_FEATURES, boost=L.EMOJI_BOOST,
            extended_words: bool = False, min_df: int = 2, max_df: float = 0.95, max_fit_rows: int | None = None) -> TrainingRun:
    """Features, split and training-set vocabulary, written once for every fit that follows.

    Every row of the training split is fitted on, unless a caller bounds them (by split hash); no query does."""
    feats = add_polarity_features(posts, boost=boost, extended_words=extended_words)
    data = cut(stratified_split(feats))
    train = data.where(F.col("split") == "train")
    n_all = n_train = train.count()
    if max_fit_rows is not None and n_all > max_fit_rows:
        fit = train.orderBy(split_hash("id"), "id").limit(max_fit_rows)
        data = cut(fit.unionByName(data.where(F.col("split") != "train")))
        train, n_train = data.where(F.col("split") == "train"), max_fit_rows
    tf = cut(T.term_frequency(train))  # the vocabulary and the text rows are made from the same counts
    vocab = cut(T.index_vocabulary(T.fit_vocabulary(tf, n_train, min_df, max_df)))
    return TrainingRun(data, vocab, vocab.count(), n_train, n_all, tuple(numeric_cols), boost, train_tf=tf)


def tfidf_rows(run: TrainingRun, rows: DataFrame) -> DataFrame:
    """``(id, idx, value)`` — normalised TF-IDF of ``rows``, or of their term counts, over the training vocabulary
    (one vocabulary join brings both idf and column index)."""
    tf = rows if rows.columns == ["id", "term", "tf"] else T.term_frequency(rows)
    j = T.join_vocabulary(tf, run.vocab.select("term", "idf", "idx"))
    return T.normalised(j.withColumn("_x", F.col("tf") * F.col("idf")), ["idx"])


def gathered(tfidf: DataFrame) -> DataFrame:
    """``(id, _tv)``: a row's TF-IDF entries in index order."""
    return tfidf.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_tv"))


def assemble_hybrid(run: TrainingRun, rows: DataFrame, numeric_cols=None, split: str | None = None) -> DataFrame:
    """``(id, label, features)``: TF-IDF block ‖ numerics (fixed order), sparse, written once to the shared folder.

    The vectors are made as the columns that a stored vector consists of and read back as vectors, without Python.  With ``split``, the text block comes from the run's persisted TF-IDF of that split
    (``rows`` must be that split's rows, possibly with other numeric columns)."""
    numeric_cols = tuple(numeric_cols if numeric_cols is not None else run.numeric_cols)
    per_row = run.text_rows(split) if split else gathered(tfidf_rows(run, rows))
    base = rows.select("id", "label", *numeric_cols).join(per_row, "id", "left")
    nums = F.array(*[F.struct(F.lit(run.n_text + k).cast("long").alias("idx"), F.col(c).cast("double").alias("value"))
                     for k, c in enumerate(numeric_cols)]) if numeric_cols else F.array().cast("array<struct<idx:bigint,value:double>>")
    entries = F.concat(F.coalesce(F.col("_tv"), F.array().cast("array<struct<idx:bigint,value:double>>")),
                       F.filter(nums, lambda e: e["value"] != 0))
    size = run.n_text + len(numeric_cols)
    indices, values = F.transform(entries, lambda e: e["idx"].cast("int")), F.transform(entries, lambda e: e["value"])
    rows = base.select("id", F.col("label").cast("double").alias("label"), F.size(entries).alias("nnz"), F.lit(size).alias("width"),
                       F.lit(run.n_text).alias("n_text"), indices.alias("indices"), values.alias("x_values"))
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.col("width").alias("size"), "indices", F.col("x_values").alias("values"))  # type 0: sparse
    return cut(rows.withColumn("features", vector),
               ST.StructType([*rows.schema, ST.StructField("features", VectorUDT())]))


def _scale_rows(spark, n_text: int, width: int, n: int) -> DataFrame:
    """Two rows of next to no weight, one per label and opposite in every text column, that add COLUMN_FLOOR / n to the
    variance of each of these columns (and leave its mean).

    MLlib's solver works on columns divided by their deviation.  Column j of the mean loss curves by about h * var_j + 1 / n,
    the second part from the penalty and h the mean of p * (1 - p).  For rare terms the penalty is nearly all of it, so
    columns divided by their own deviation are stretched a hundredfold and the solver crawls; columns with the floor
    1 / (h * n) below their variance all curve alike.  What the rows add to the gradient of a column is WEIGHTLESS times
    their value, under 6e-7 of one row's.  The tasks make them: the driver holds no dense copy.

    MLlib takes the variance row by row.  A row of weight w that comes before the others leaves an error of about 5e-17 / w
    of the floor: half a hundredth at this weight, but with 1e-20 a column's scale was whatever the order of rows made of it."""
    at = float(np.sqrt(COLUMN_FLOOR / n * max(n - 1, 1) / (2 * WEIGHTLESS)))

    value = F.when(F.col("label") == 0, F.lit(at)).otherwise(F.lit(-at))
    x = F.concat(F.array_repeat(value, n_text), F.array_repeat(F.lit(0.0), width - n_text))
    return spark.range(0, 2, 1, 1).select(F.col("id").cast("double").alias("label")).select(
        "label", array_to_vector(x).alias("features"), F.lit(WEIGHTLESS).alias("weight"))


def train_logistic(vectors: DataFrame, n_train: int, tol: float = TOL, max_iter: int = MAX_ITER) -> Fit:
    """MLlib's ``LogisticRegression`` on ``sum of logloss + half the squared weights``, intercept free.

    ``vectors`` are the stored rows of :func:`assemble_hybrid`, which the solver and its summary read four times.  Partitions follow the non-zeros.  After the fit one
    job takes the gradient at the result; if a partial derivative of the mean loss is above ``tol`` (MLlib ended at
    ``max_iter``), that is an error.  Vectors of more than MLLIB_COLUMNS columns are fitted by :mod:`.wide`, to the same end."""
    spark = vectors.sparkSession
    nnz, rows, width, n_text = vectors.agg(F.sum("nnz"), F.count(F.lit(1)), F.max("width"), F.max("n_text")).first()
    if width is not None and width > MLLIB_COLUMNS:
        return _train_wide_vectors(vectors, n_train, n_text, width, tol, max_iter)
    cores = min(spark.sparkContext.defaultParallelism, -(-(nnz or 0) // NNZ_PER_CORE))
    parts = int(max(cores, -(-(nnz or 0) // NNZ_PER_PARTITION), 1))
    weighted = vectors.select("label", "features", F.lit(1.0).alias("weight"))
    weighted = weighted.unionByName(_scale_rows(spark, n_text, width, rows)).coalesce(parts)
    lr = LogisticRegression(regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False, weightCol="weight", tol=SOLVER_TOL,
                            maxIter=max_iter, aggregationDepth=2, maxBlockSizeInMB=BLOCK_MB)
    fitted = lr.fit(weighted)
    # read back without its training summary, which holds the session and would travel with every prediction
    path = scratch_path(spark, "logistic")
    fitted.save(path)
    model, steps = LogisticRegressionModel.load(path), fitted.summary.totalIterations
    worst = max_gradient(vectors, model, n_train)
    if not worst <= tol and steps < max_iter:  # its line search ended above, as large numerics make it: the other solver ends below
        fit = _train_wide_vectors(vectors, n_train, n_text, width, tol, max_iter)
        return Fit(fit.model.mllib(), steps + fit.iterations, fit.max_gradient)
    if not worst <= tol:
        raise NotConverged(f"a partial derivative of {worst:.2g} after {steps} iterations, above {tol:.2g}")
    return Fit(model, steps, worst)


def _wide_fit(blocks: W.TextBlocks, labelled: DataFrame, n_train: int, n_text: int, tol: float, max_iter: int) -> Fit:
    model, steps, worst = W.fit(blocks, labelled, n_train, n_text, max_iter)
    if not worst <= tol:
        raise NotConverged(f"a partial derivative of {worst:.2g} after {steps} iterations, above {tol:.2g}")
    return Fit(model, steps, worst)


def _train_wide_vectors(vectors: DataFrame, n_train: int, n_text: int, width: int, tol: float, max_iter: int) -> Fit:
    """Stored vectors parted into text entries, which are stored again by column, and numerics."""
    def numeric(j: int):
        return F.coalesce(F.get(F.filter(entry, lambda e: e["idx"] == j)["value"], 0), F.lit(0.0)).alias(f"x{j}")

    entry = F.arrays_zip(F.col("indices").cast("array<bigint>").alias("idx"), F.col("x_values").alias("value"))
    keyed = cut(vectors.select(F.monotonically_increasing_id().alias("key"), "label", F.filter(entry, lambda e: e["idx"] < n_text).alias("entries"),
                               *[numeric(j) for j in range(n_text, width)]))
    entries = keyed.select("key", F.explode("entries").alias("_e")).select("key", "_e.idx", "_e.value")
    total = keyed.agg(F.coalesce(F.sum(F.size("entries")), F.lit(0))).first()[0]
    return _wide_fit(W.text_blocks(keyed.select("key"), entries, total), keyed.drop("entries"), n_train, n_text, tol, max_iter)


def fit_rows(run: TrainingRun, rows: DataFrame, numeric_cols=None, tol: float = TOL, max_iter: int = MAX_ITER) -> tuple[Fit, DataFrame | None]:
    """A fit on the run's training rows, possibly with other numeric columns, and the vectors it was made from.

    A wide run has no vectors: :func:`assemble_hybrid` would write the text block once for each fit, while the
    blocks that a wide fit reads are stored once and the numerics of each fit stand beside them."""
    cols = tuple(run.numeric_cols if numeric_cols is None else numeric_cols)
    if not run.is_wide(cols):
        vectors = assemble_hybrid(run, rows, cols, split="train")
        return train_logistic(vectors, run.n_train, tol, max_iter), vectors
    labelled = rows.select(F.col("id").alias("key"), "label", *cols)
    return _wide_fit(run.text_blocks(), labelled, run.n_train, run.n_text, tol, max_iter), None


def mllib_model(model) -> LogisticRegressionModel:
    return model.mllib() if isinstance(model, W.WideModel) else model


def coefficient_table(lr_model, spark: SparkSession) -> DataFrame:
    """``(idx, coef)``.  A wide model has them as rows; MLlib's holds them on the driver, from where they go out as an Arrow table."""
    if isinstance(lr_model, W.WideModel):
        return lr_model.coefficients
    values = lr_model.coefficients.toArray()
    return spark.createDataFrame(pa.table({"idx": np.arange(len(values), dtype=np.int64), "coef": values}))


def max_gradient(vectors: DataFrame, lr_model: LogisticRegressionModel, n_train: int) -> float:
    """The largest partial derivative of the mean loss at a fitted model, by one aggregation over its rows' non-zeros."""
    if lr_model.hasSummary:  # which holds the session and cannot travel to the tasks
        path = scratch_path(vectors.sparkSession, "logistic")
        lr_model.save(path)
        lr_model = LogisticRegressionModel.load(path)
    rows = lr_model.transform(vectors).select((vector_to_array("probability")[1] - F.col("label")).alias("r"), "indices", "x_values")
    cells = rows.select("r", F.explode(F.arrays_zip(F.concat("indices", F.array(F.lit(-1))).alias("idx"),
                                                    F.concat("x_values", F.array(F.lit(1.0))).alias("x"))).alias("c"))
    sums = cells.groupBy(F.col("c.idx").cast("long").alias("idx")).agg(F.sum(F.col("r") * F.col("c.x")).alias("g"))
    # a column in no row has the gradient of its penalty; the intercept (-1) has no penalty
    both = sums.join(coefficient_table(lr_model, vectors.sparkSession), "idx", "full_outer")
    slope = F.abs(F.coalesce("g", F.lit(0.0)) + F.coalesce("coef", F.lit(0.0))) / n_train
    return float(both.agg(F.max(slope)).first()[0])


def extract_weights(run: TrainingRun, lr_model, numeric_cols=None) -> LinearTextModel:
    """Weights table ``(term, idx, idf, coef)`` from the vocabulary and the coefficients, joined by index."""
    numeric_cols = tuple(numeric_cols if numeric_cols is not None else run.numeric_cols)
    spark = run.vocab.sparkSession
    coef = coefficient_table(lr_model, spark)
    text = run.vocab.select("term", "idx", "idf").join(coef, "idx")
    names = spark.createDataFrame([(c, run.n_text + k) for k, c in enumerate(numeric_cols)], "term string, idx long")
    nums = names.join(coef, "idx").select("term", "idx", F.lit(None).cast("double").alias("idf"), "coef")
    weights = cut(text.select("term", "idx", "idf", "coef").unionByName(nums.select("term", "idx", "idf", "coef")))
    if tuple(numeric_cols) == L.NUMERIC_FEATURES:
        return model_from_weights(weights, lr_model.intercept)
    return LinearTextModel(weights, float(lr_model.intercept),
                           {c: 0.0 for c in L.NUMERIC_FEATURES}, run.n_text, 2)


def score_mllib(lr_model, vectors: DataFrame) -> DataFrame:
    out = mllib_model(lr_model).transform(vectors)
    return out.select("id", vector_to_array("probability")[1].alias("p1_mllib"),
                      F.col("prediction").cast("int").alias("prediction_mllib"))


def parity_check(relational: DataFrame, mllib: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Full outer join on ``id``: max |Δp|, label mismatches, rows missing on either side."""
    j = relational.select("id", "p1", "model_prediction").join(mllib, "id", "full_outer")
    row = j.agg(F.max(F.abs(F.col("p1") - F.col("p1_mllib"))).alias("max_abs_diff"),
                F.sum(F.when(F.col("model_prediction") != F.col("prediction_mllib"), 1).otherwise(0)).cast("bigint").alias("label_mismatches"),
                F.sum(F.when(F.col("p1").isNull() | F.col("p1_mllib").isNull(), 1).otherwise(0)).cast("bigint").alias("unmatched"),
                F.count(F.lit(1)).cast("bigint").alias("n"))
    return row.withColumn("passed", (F.coalesce(F.col("max_abs_diff"), F.lit(0.0)) <= tolerance)
                          & (F.col("label_mismatches") == 0) & (F.col("unmatched") == 0))


def gradient_norm(run: TrainingRun, model: LinearTextModel) -> float:
    """Max |∂/∂θ (Σ logloss + ½‖w‖²)| at the fitted weights (optimality check).

    Computed in long form: residuals ``p - y`` of the relational scorer joined to the
    non-zero feature values, summed per feature index, plus the L2 term."""
    from .model import score_relational
    train = run.rows("train")
    resid = score_relational(train, model).select("id", (F.col("p1") - F.col("label")).alias("r"))
    text = run.tfidf_for("train")
    nums = train.select("id", F.explode(F.array(*[
        F.struct(F.lit(run.n_text + k).cast("long").alias("idx"), F.col(c).cast("double").alias("value"))
        for k, c in enumerate(L.NUMERIC_FEATURES)])).alias("e")).select("id", "e.idx", "e.value")
    x = text.unionByName(nums).where(F.col("value") != 0)
    g = x.join(resid, "id").groupBy("idx").agg(F.sum(F.col("r") * F.col("value")).alias("g"))
    w = model.weights.select("idx", "coef")
    gw = w.join(g, "idx", "left").select(F.abs(F.coalesce(F.col("g"), F.lit(0.0)) + F.col("coef")).alias("a"))
    g_max = gw.agg(F.max("a")).first()[0] or 0.0
    g_int = resid.agg(F.sum("r")).first()[0] or 0.0
    return max(abs(g_max), abs(g_int))


def fitted_run(posts: DataFrame, numeric_cols=L.NUMERIC_FEATURES):
    """Prepare, fit, and return (run, fit, model, train_vectors), the last None for a wide run."""
    run = prepare(posts, numeric_cols)
    fit, vec = fit_rows(run, run.rows("train"))
    return run, fit, extract_weights(run, fit.model), vec


def trained_run(posts: DataFrame, numeric_cols=L.NUMERIC_FEATURES):
    """Prepare, vectorise the training rows, fit, and return (run, fit, model, train_vectors)."""
    run, fit, model, vec = fitted_run(posts, numeric_cols)
    return run, fit, model, assemble_hybrid(run, run.rows("train"), split="train") if vec is None else vec
