"""Relational TF-IDF in long form (§2.10 ``term_frequency`` … ``tfidf_transform``).

The vocabulary is a DataFrame, never a driver-side dict, so its size is bounded
by the cluster and not by driver memory.  Plan shape:

* rows are hash-partitioned by ``id`` once, *before* tokenizing: the raw text is the
  smallest form of the data (a token is a few bytes of text but a ~30-byte
  ``(id, term, tf)`` row), and afterwards every per-document step — term counts,
  the L2 norm, the join back to the rows — runs without another exchange;
* n-grams are built per row with native array / regex functions and exploded;
* ``df``: ``groupBy(term)`` with partial aggregation, so frequent terms (the hot
  keys: "the", "of" …) are combined map-side before the only other shuffle;
* the vocabulary is joined back by ``term`` without a hint: Spark broadcasts it when its
  measured bytes allow, and otherwise shuffles, where AQE splits skewed term partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from ..session import cut


#: Stored bytes of the input in a partition of rows; what a task holds of their terms follows from it.
BYTES_PER_PARTITION = 8 << 20


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as Spark estimates them from the files; tables of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 60)


def by_row(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Hash-partition rows by their key so per-row groupings need no further exchange.

    The number of partitions follows the bytes read, so a task's share does not grow with the input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-leaf_bytes(df) // BYTES_PER_PARTITION)), id_col)


def term_occurrences(df: DataFrame, text: str = "text", id_col: str = "id", n_max: int = 2) -> DataFrame:
    """``(id, term)`` per n-gram occurrence (unigrams first, then bigrams)."""
    grams = S.with_ngrams(df.select(id_col, text), text, "_g", n_max)
    return S.explode_nonempty(grams.withColumnRenamed(id_col, "id") if id_col != "id" else grams, F.col("_g"), "term", "id")


#: Between texts of one id; its letters are in no lower-cased text, so n-grams across texts are told by it.
_BREAK = "XX"


def _grams_by_id(rows: DataFrame, text: str, n_max: int) -> DataFrame:
    """``(id, _g)``: all n-grams of an id's texts, sorted; none spans two texts."""
    lowered = rows.select("id", F.lower(S.safe_text(text)).alias("_t"))
    texts = lowered.groupBy("id").agg(F.collect_list("_t").alias("_t"))
    tok = F.regexp_extract_all(F.array_join("_t", f" {_BREAK} "), F.lit(L.TOKEN_PATTERN), F.lit(0))
    grams = texts.select("id", (F.size("_t") > 1).alias("_several"), tok.alias("_tok")).withColumn("_g", S.word_ngrams("_tok", n_max))
    inside = F.filter("_g", lambda g: ~F.contains(g, F.lit(_BREAK)))
    return grams.select("id", F.sort_array(F.when(F.col("_several"), inside).otherwise(F.col("_g"))).alias("_g"))


def term_frequency(df: DataFrame, text: str = "text", id_col: str = "id", n_max: int = 2, placed: bool = False) -> DataFrame:
    """``(id, term, tf)`` — raw in-row counts, partitioned by ``id``; ``placed`` rows are stored that way (``sink_bucketed``).

    A document's terms are counted in its own row, as runs of its sorted n-grams: no table of a partition's
    ``(id, term)`` keys is built, which would spill many times the text.  Only texts are gathered by id."""
    rows = df.select(F.col(id_col).alias("id"), text)
    rows = rows if placed else by_row(rows, "id")
    grams = _grams_by_id(rows, text, n_max).withColumn("_n", F.size("_g"))
    # no filter on the number of n-grams: the optimizer would write the tokenizing out again in it, below the projection
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))),
                     lambda i: (i < F.col("_n")) & ((i == 0) | (F.get("_g", i) != F.get("_g", i - 1))))
    starts = grams.withColumn("_s", first)
    runs = F.transform("_s", lambda i, k: F.struct(
        F.get("_g", i).alias("term"), (F.coalesce(F.get("_s", k + 1), F.col("_n")) - i).cast("long").alias("tf")))
    return S.explode_nonempty(starts, runs, "_e", "id").select("id", "_e.term", "_e.tf")


def document_frequency(tf: DataFrame) -> DataFrame:
    """``(term, df)`` — rows that contain the term."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def smooth_idf(n_docs, df_col="df"):
    """``ln((1 + n) / (1 + df)) + 1`` (the smooth idf with the +1 offset)."""
    return F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col(df_col))) + F.lit(1.0)


def fit_vocabulary(tf: DataFrame, n_docs: int, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """``(term, df, idf)`` for terms with ``min_df <= df <= max_df * n`` (fractional max_df)."""
    max_abs = math.floor(max_df * n_docs) if isinstance(max_df, float) else int(max_df)
    dfreq = document_frequency(tf)
    return (dfreq.where((F.col("df") >= min_df) & (F.col("df") <= max_abs))
            .withColumn("idf", smooth_idf(n_docs)))


def index_vocabulary(vocab: DataFrame) -> DataFrame:
    """Assign a dense column index in term order (code-point order = UTF-8 byte order).

    Uses a range-partitioned sort and per-partition offsets, never a single-partition window."""
    from .clean import reset_index
    return reset_index(vocab, order_col="term", out_col="idx")


def join_vocabulary(tf: DataFrame, vocab: DataFrame) -> DataFrame:
    """Inner join on ``term`` (drops out-of-vocabulary terms)."""
    return tf.join(vocab, "term")


def normalised(weighted: DataFrame, columns: list[str], x: str = "_x") -> DataFrame:
    """``columns`` and ``value`` = x over the L2 norm of the row's x, from rows with an ``id``.

    One grouping by id: a document's terms are gathered next to their sum of squares and
    unpacked again, so nothing is sorted and the weighted rows are computed once."""
    placed = weighted.select("id", *columns, x).repartition("id")  # rows as they are: half-made lists would be several times as large
    per_row = placed.groupBy("id").agg(F.collect_list(F.struct(*columns, x)).alias("_t"), F.sqrt(F.sum(F.col(x) * F.col(x))).alias("_n"))
    return (per_row.select("id", "_n", F.explode("_t").alias("_e"))
            .select("id", *[f"_e.{c}" for c in columns], (F.col(f"_e.{x}") / F.col("_n")).alias("value")))


def tfidf_transform(tf: DataFrame, vocab: DataFrame, columns: tuple = ("term", "tf", "idf")) -> DataFrame:
    """``(id, term, tf, idf, value)``: tf × idf, L2-normalised over in-vocabulary terms of the row.

    ``columns``: those wanted beside id and value; only they are shuffled with the weights."""
    j = join_vocabulary(tf, vocab.select("term", "idf")).withColumn("_x", F.col("tf") * F.col("idf"))
    return normalised(j, list(columns))


def fit_tfidf(df: DataFrame, text: str = "text", id_col: str = "id", n_max: int = 2,
              min_df: int = 2, max_df: float = 0.95, keep: bool = True, placed: bool = False):
    """Fit on ``df``: returns ``(tf, vocab, n_docs)``.

    With ``keep`` the term counts and the vocabulary are written to the shared folder once, because
    fitting and transforming both read them; a fit alone needs neither."""
    tf = term_frequency(df, text, id_col, n_max, placed)
    if keep:
        tf = cut(tf)
    n_docs = df.count()
    vocab = fit_vocabulary(tf, n_docs, min_df, max_df)
    return tf, cut(vocab) if keep else vocab, n_docs
