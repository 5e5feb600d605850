"""One-line built-ins used inside the composed operators, each also exposed as a query over
the tables (§2.2), plus the emoji-reference cleaning and the two-scorer parity join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import corpus as K
from ..operators import model as M
from ..operators.features import add_polarity_features
from ..sources.tables import posts_all, read_table
from . import sqlfrag as Q
from .q_model import scored_cte
from .registry import query

PA = Q.posts_all_sql()


@query("drop_columns", "SELECT doc_id, lang, source FROM documents")
def q_drop_columns(spark, sf):
    return read_table(spark, sf, "documents").drop("text", "n_chars", "not_a_column")


@query("rename_columns", "SELECT doc_id AS id, quality AS label, toxic FROM labels")
def q_rename_columns(spark, sf):
    return read_table(spark, sf, "labels").withColumnsRenamed({"doc_id": "id", "quality": "label"})


@query("select_columns", "SELECT doc_id, lang FROM documents")
def q_select_columns(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "lang")


@query("cast_columns", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(n_chars AS INTEGER) AS n_chars FROM documents")
def q_cast_columns(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("n_chars").cast("int").alias("n_chars"))


@query("drop_nulls", "SELECT conv_id, turn FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def q_drop_nulls(spark, sf):
    return read_table(spark, sf, "conversations").dropna(subset=["text", "role"]).select("conv_id", "turn")


@query("clean_emoji_reference", lambda: (
    f"SELECT symbol AS emoji, printf('0x%x', unicode(symbol)) AS unicode_codepoint, CAST(NULL AS VARCHAR) AS unicode_name "
    f"FROM (SELECT DISTINCT unnest({Q.symbols('text')}) AS symbol FROM {PA})"))
def q_clean_emoji_reference(spark, sf):
    """The corpus symbol inventory in the raw reference layout, then cleaned (snake case, strings)."""
    inv = K.symbol_occurrences(posts_all(spark, sf)).select("symbol").distinct()
    raw = inv.select(F.col("symbol").alias("Emoji"),
                     F.concat(F.lit("0x"), F.lower(F.hex(F.ascii("symbol")))).alias("Unicode codepoint"),
                     F.lit(None).cast("string").alias("Unicode name"))
    return C.clean_emoji_reference(raw)


@query("parity_join", lambda: scored_cte() + "SELECT id, round(p1, 6) AS p1_a, round(p1, 6) AS p1_b, model_prediction AS pred_a, model_prediction AS pred_b FROM z")
def q_parity_join(spark, sf):
    model = M.fixed_model(spark)
    feats = add_polarity_features(posts_all(spark, sf))
    j = M.parity_join(M.score_relational(feats, model), M.score_rowwise(feats, model))
    return j.select("id", F.round("p1_a", 6).alias("p1_a"), F.round("p1_b", 6).alias("p1_b"), "pred_a", "pred_b")
