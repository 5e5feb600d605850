"""Queries for scans, cleaning, data-quality checks, corpus aggregates, lexicon joins,
set operations and corpus top-k (§2.1–2.3, §2.6–2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from ..operators import clean as C
from ..operators import corpus as K
from ..operators import quality as V
from ..operators.features import add_polarity_features, validate_features
from ..operators.split import split_sql, stratified_split
from ..sources.tables import posts, posts_all, raw_corpus, read_table
from . import sqlfrag as Q
from .registry import query

P = Q.posts_sql()
PA = Q.posts_all_sql()
FT = Q.features_sql()
FA = Q.features_all_sql()
REF = tuple(e for e, _, _ in L.EMOJI_REFERENCE)
EXPANDED = L.distinct(L.POSITIVE_EMOJIS + L.NEGATIVE_EMOJIS)
EARLY = L.distinct(L.EARLY_POSITIVE_EMOJIS + L.EARLY_NEGATIVE_EMOJIS)


def lex_sql(values, col="emoji") -> str:
    return f"(SELECT unnest({Q.str_list(L.distinct(values))}) AS {col})"


def occ_sql(src=P) -> str:
    return f"(SELECT id, unnest({Q.known_emojis('text')}) AS emoji FROM {src})"


def sym_sql(src=P) -> str:
    return f"(SELECT id, unnest({Q.symbols('text')}) AS symbol FROM {src})"


def features(spark, sf):
    return add_polarity_features(posts(spark, sf))


def features_all(spark, sf):
    return add_polarity_features(posts_all(spark, sf))


# ---------------------------------------------------------------- §2.1 scans

@query("scan_parquet", "SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS text_chars FROM documents")
def q_scan_parquet(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars",
                                                     F.length("text").cast("bigint").alias("text_chars"))


@query("inspect_dataset", lambda: (
    "SELECT * FROM (VALUES "
    "(0, 'doc_id', (SELECT count(doc_id) FROM documents), 'bigint'), "
    "(1, 'text', (SELECT count(text) FROM documents), 'string'), "
    "(2, 'lang', (SELECT count(lang) FROM documents), 'string'), "
    "(3, 'source', (SELECT count(source) FROM documents), 'string'), "
    "(4, 'n_chars', (SELECT count(n_chars) FROM documents), 'bigint')) AS t(position, column_name, non_null, dtype)"))
def q_inspect_dataset(spark, sf):
    return K.inspect_dataset(read_table(spark, sf, "documents"))


@query("inspect_head", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def q_inspect_head(spark, sf):
    """The first five rows by key (the preview half of ``inspect_dataset``; a top-k, no full sort)."""
    return read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(5)


# ---------------------------------------------------------------- §2.2 cleaning, filters

@query("clean_posts", lambda: f"SELECT id, label, text FROM {P}")
def q_clean_posts(spark, sf):
    return C.clean_posts(raw_corpus(spark, sf))


@query("text_length_cap", lambda: (
    f"SELECT id, length(text) <= {L.MAX_TEXT_LEN} AS accepted, "
    f"CASE WHEN length(text) > {L.MAX_TEXT_LEN} THEN 'text_too_long' END AS reject_reason FROM {PA}"))
def q_text_length_cap(spark, sf):
    return C.text_length_cap(posts_all(spark, sf)).select("id", "accepted", "reject_reason")


@query("blank_filter", "SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(text, '\\S')")
def q_blank_filter(spark, sf):
    return C.blank_filter(read_table(spark, sf, "conversations")).select("conv_id", "turn", "role")


@query("filter_isin", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def q_filter_isin(spark, sf):
    return read_table(spark, sf, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query("filter_bool", lambda: (
    f"SELECT id FROM {FT} WHERE NOT (word_pos_count > 0) AND (emoji_neg_count >= 10 OR label = 0)"))
def q_filter_bool(spark, sf):
    f = features(spark, sf)
    return f.where(~(F.col("word_pos_count") > 0) & ((F.col("emoji_neg_count") >= 10) | (F.col("label") == 0))).select("id")


@query("reset_index", lambda: f"SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS row_index FROM {PA}")
def q_reset_index(spark, sf):
    return C.reset_index(posts_all(spark, sf).select("id")).select("id", "row_index")


# ---------------------------------------------------------------- §2.3 data quality

def _checks_sql(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT {Q.lit(name)} AS \"check\", CAST({expr} AS BIGINT) AS violations, CAST({expr} AS BIGINT) = 0 AS passed {frm}"
        for name, expr, frm in pairs)


@query("validate_posts", lambda: _checks_sql([
    ("column_order", "0", ""),
    ("binary_labels", "count_if(label NOT IN (0, 1) OR label IS NULL)", f"FROM {P}"),
    ("non_empty_text", "count_if(coalesce(length(text), 0) <= 0)", f"FROM {P}"),
]))
def q_validate_posts(spark, sf):
    return V.validate_posts(C.clean_posts(raw_corpus(spark, sf)).select("id", "label", "text"))


@query("validate_emoji_reference", lambda: _checks_sql([
    ("emoji_column", "0", ""),
    ("unique_emoji", "count(*) - count(DISTINCT symbol)", f"FROM (SELECT symbol, min(id) AS first_id FROM {sym_sql(PA)} GROUP BY symbol)"),
]))
def q_validate_emoji_reference(spark, sf):
    """The reference made from the corpus, a row per symbol with where it is first seen."""
    inventory = K.symbol_occurrences(posts_all(spark, sf)).groupBy(F.col("symbol").alias("emoji")).agg(F.min("id").alias("first_id"))
    return V.validate_emoji_reference(inventory)


@query("validate_features", lambda: _checks_sql([
    ("required_columns", "0", ""),
    ("no_nulls", "count_if(id IS NULL) + count_if(label IS NULL) + count_if(text IS NULL) + "
     + " + ".join(f"count_if({c} IS NULL)" for c in L.NUMERIC_FEATURES), f"FROM {FT}"),
    ("non_negative_counts", " + ".join(f"count_if({c} < 0)" for c in L.NUMERIC_FEATURES), f"FROM {FT}"),
]))
def q_validate_features(spark, sf):
    return validate_features(features(spark, sf))


@query("validate_shape", lambda: _checks_sql([
    ("row_count", f"CASE WHEN (SELECT count(*) FROM {FT}) = (SELECT count(*) FROM labels l JOIN documents d ON l.doc_id = d.doc_id) THEN 0 ELSE 1 END", ""),
    ("width", "0", ""),
]))
def q_validate_shape(spark, sf):
    expected = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id"), "doc_id").count()
    return V.validate_shape(features(spark, sf), expected_rows=expected, expected_width=7)


@query("stratified_split", lambda: f"SELECT id, label, split FROM {split_sql(P)}")
def q_stratified_split(spark, sf):
    return stratified_split(posts(spark, sf).select("id", "label"))


@query("validate_split", lambda: _checks_sql([
    ("sizes_add_up", "CASE WHEN count_if(split = 'train') + count_if(split = 'val') = count(*) THEN 0 ELSE 1 END", f"FROM {split_sql(P)}"),
    ("ids_unique_disjoint", "count(*) - count(DISTINCT id)", f"FROM {split_sql(P)}"),
    ("stratified_rate", "CASE WHEN abs(avg(CASE WHEN split = 'train' THEN label END) - avg(CASE WHEN split = 'val' THEN label END)) < 0.02 THEN 0 ELSE 1 END", f"FROM {split_sql(P)}"),
]))
def q_validate_split(spark, sf):
    return V.validate_split(stratified_split(posts(spark, sf).select("id", "label")))


@query("all_flags", lambda: (
    f"SELECT bool_and(label IN (0, 1)) AS labels_binary, bool_and(length(text) > 0) AS text_non_empty FROM {P}"))
def q_all_flags(spark, sf):
    return posts(spark, sf).agg(F.every(F.col("label").isin(0, 1)).alias("labels_binary"),
                                F.every(F.length("text") > 0).alias("text_non_empty"))


# ---------------------------------------------------------------- §2.7 corpus aggregates

@query("label_distribution", lambda: (
    f"SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {P} GROUP BY label"))
def q_label_distribution(spark, sf):
    return K.label_distribution(posts(spark, sf))


@query("describe_counts", lambda: (
    "SELECT count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, "
    "round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, "
    f"round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max FROM (SELECT CAST(len({Q.known_emojis('text')}) AS DOUBLE) AS x FROM {PA})"))
def q_describe_counts(spark, sf):
    return K.describe_column(posts_all(spark, sf).select(F.size(S.extract_known_emojis("text")).alias("emoji_count")), "emoji_count")


@query("emoji_presence_rate", lambda: f"SELECT round(avg(CAST(len({Q.known_emojis('text')}) > 0 AS INTEGER)), 6) AS rate FROM {PA}")
def q_emoji_presence_rate(spark, sf):
    return K.rate_by(posts_all(spark, sf), F.size(S.extract_known_emojis("text")) > 0)


@query("presence_by_label", lambda: (
    f"SELECT label, round(avg(CAST(len({Q.known_emojis('text')}) > 0 AS INTEGER)), 6) AS rate FROM {P} GROUP BY label"))
def q_presence_by_label(spark, sf):
    return K.rate_by(posts(spark, sf), F.size(S.extract_known_emojis("text")) > 0, by="label")


@query("count_by_label", lambda: (
    f"SELECT label, round(avg(len({Q.known_emojis('text')})), 6) AS mean_emoji_count FROM {P} GROUP BY label"))
def q_count_by_label(spark, sf):
    return posts(spark, sf).groupBy("label").agg(F.round(F.avg(F.size(S.extract_known_emojis("text"))), 6).alias("mean_emoji_count"))


def _hist_sql(value_sql: str, src: str, bins: int) -> str:
    return (
        f"WITH v AS (SELECT CAST({value_sql} AS DOUBLE) AS x FROM {src}), "
        "s0 AS (SELECT min(x) AS lo0, max(x) AS hi0 FROM v), "
        "s AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s0), "
        f"b AS (SELECT LEAST(GREATEST(CAST(floor((x - lo) / (hi - lo) * {bins}) AS INTEGER), 0), {bins - 1}) + 1 AS bin FROM v, s WHERE x IS NOT NULL), "
        "c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), "
        f"a AS (SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + (g.bin - 1) * (hi - lo) / {bins}, 6) AS bin_lo, "
        f"round(lo + g.bin * (hi - lo) / {bins}, 6) AS bin_hi FROM s, range(1, {bins + 1}) g(bin)) "
        "SELECT a.bin, a.bin_lo, a.bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM a LEFT JOIN c ON a.bin = c.bin")


@query("emoji_histogram", lambda: _hist_sql(f"len({Q.known_emojis('text')})", PA, 10))
def q_emoji_histogram(spark, sf):
    return K.equal_width_histogram(posts_all(spark, sf).select(F.size(S.extract_known_emojis("text")).alias("emoji_count")),
                                   "emoji_count", 10)


@query("sentiment_word_rates", lambda: (
    f"SELECT round(avg(CAST(len({Q.known_emojis('text')}) > 0 AS INTEGER)), 6) AS has_emoji, "
    f"round(avg(CAST(list_has_any({Q.ws_tokens('lower(text)')}, {Q.str_list(L.EDA_POSITIVE_WORDS)}) AS INTEGER)), 6) AS has_positive_words, "
    f"round(avg(CAST(list_has_any({Q.ws_tokens('lower(text)')}, {Q.str_list(L.EDA_NEGATIVE_WORDS)}) AS INTEGER)), 6) AS has_negative_words FROM {PA}"))
def q_sentiment_word_rates(spark, sf):
    p = posts_all(spark, sf)
    return p.agg(F.round(F.avg((F.size(S.extract_known_emojis("text")) > 0).cast("int")), 6).alias("has_emoji"),
                 F.round(F.avg(S.contains_sentiment_words("text", L.EDA_POSITIVE_WORDS).cast("int")), 6).alias("has_positive_words"),
                 F.round(F.avg(S.contains_sentiment_words("text", L.EDA_NEGATIVE_WORDS).cast("int")), 6).alias("has_negative_words"))


@query("explode_emojis", lambda: f"SELECT id, emoji FROM {occ_sql(PA)}")
def q_explode_emojis(spark, sf):
    return K.emoji_occurrences(posts_all(spark, sf))


@query("emoji_frequency", lambda: f"SELECT emoji, count(*) AS n FROM {occ_sql(PA)} GROUP BY emoji")
def q_emoji_frequency(spark, sf):
    return K.emoji_frequency(posts_all(spark, sf))


@query("emoji_coverage", lambda: (
    f"SELECT (SELECT count(DISTINCT symbol) FROM {sym_sql(PA)}) AS n_corpus, {len(REF)} AS n_reference, "
    f"(SELECT count(*) FROM (SELECT DISTINCT symbol FROM {sym_sql(PA)} INTERSECT SELECT emoji FROM {lex_sql(REF)})) AS n_both"))
def q_emoji_coverage(spark, sf):
    syms = K.symbol_occurrences(posts_all(spark, sf)).select(F.col("symbol").alias("emoji")).distinct()
    ref = F.broadcast(K.emoji_lexicon(spark, "reference").withColumn("_in", F.lit(1)))  # 16 rows
    # one aggregation: distinct corpus symbols and how many of them are reference emojis
    j = syms.join(ref, "emoji", "left")
    return j.agg(F.count(F.lit(1)).alias("n_corpus"), F.lit(len(REF)).alias("n_reference"),
                 F.count("_in").alias("n_both"))


@query("coverage_rate", lambda: (
    f"WITH f AS (SELECT emoji, count(*) AS n FROM {occ_sql(PA)} GROUP BY emoji) "
    f"SELECT round(sum(CASE WHEN emoji IN (SELECT emoji FROM {lex_sql(EARLY)}) THEN n ELSE 0 END) / sum(n), 6) AS coverage_early, "
    f"round(sum(CASE WHEN emoji IN (SELECT emoji FROM {lex_sql(EXPANDED)}) THEN n ELSE 0 END) / sum(n), 6) AS coverage_expanded FROM f"))
def q_coverage_rate(spark, sf):
    freq = K.emoji_frequency(posts_all(spark, sf))
    early = F.broadcast(K.emoji_lexicon(spark, "early").withColumn("_early", F.lit(1)))
    exp = F.broadcast(K.emoji_lexicon(spark, "expanded").withColumn("_exp", F.lit(1)))
    j = freq.join(early, "emoji", "left").join(exp, "emoji", "left")
    share = lambda flag: F.round(F.sum(F.when(F.col(flag).isNotNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return j.agg(share("_early").alias("coverage_early"), share("_exp").alias("coverage_expanded"))


@query("emoticon_prevalence", lambda: (
    f"SELECT round(avg(CAST({Q.any_substring('text', L.POSITIVE_EMOTICONS)} AS INTEGER)), 6) AS pos_rate, "
    f"round(avg(CAST({Q.any_substring('text', L.NEGATIVE_EMOTICONS)} AS INTEGER)), 6) AS neg_rate, "
    f"round(avg(CAST({Q.any_substring('text', L.POSITIVE_EMOTICONS)} AS INTEGER)) + avg(CAST({Q.any_substring('text', L.NEGATIVE_EMOTICONS)} AS INTEGER)), 6) AS combined FROM {PA}"))
def q_emoticon_prevalence(spark, sf):
    pos = F.avg(S.has_emoticon("text", L.POSITIVE_EMOTICONS).cast("int"))
    neg = F.avg(S.has_emoticon("text", L.NEGATIVE_EMOTICONS).cast("int"))
    return posts_all(spark, sf).agg(F.round(pos, 6).alias("pos_rate"), F.round(neg, 6).alias("neg_rate"),
                                F.round(pos + neg, 6).alias("combined"))


@query("word_prevalence", lambda: (
    f"SELECT round(avg(CAST({Q.any_substring('text', L.POSITIVE_WORDS, lower=True)} AS INTEGER)), 6) AS pos_rate, "
    f"round(avg(CAST({Q.any_substring('text', L.NEGATIVE_WORDS, lower=True)} AS INTEGER)), 6) AS neg_rate FROM {PA}"))
def q_word_prevalence(spark, sf):
    return posts_all(spark, sf).agg(
        F.round(F.avg(S.has_lexicon_word("text", L.POSITIVE_WORDS).cast("int")), 6).alias("pos_rate"),
        F.round(F.avg(S.has_lexicon_word("text", L.NEGATIVE_WORDS).cast("int")), 6).alias("neg_rate"))


@query("feature_summary", lambda: " UNION ALL ".join(
    f"SELECT {Q.lit(c)} AS feature, round(avg({c}), 6) AS mean, CAST(max({c}) AS BIGINT) AS max FROM {FA}"
    for c in L.NUMERIC_FEATURES))
def q_feature_summary(spark, sf):
    return K.feature_summary(features_all(spark, sf))


@query("null_count", lambda: (
    "SELECT CAST(" + " + ".join(f"count_if({c} IS NULL)" for c in ("id", "label", "text") + L.NUMERIC_FEATURES)
    + f" AS BIGINT) AS null_count FROM {FT}"))
def q_null_count(spark, sf):
    return K.null_count(features(spark, sf))


# ---------------------------------------------------------------- §2.6 lexicon joins

@query("lexicon_semi_join", lambda: f"SELECT id, symbol FROM {sym_sql(PA)} WHERE symbol IN (SELECT emoji FROM {lex_sql(EXPANDED)})")
def q_lexicon_semi_join(spark, sf):
    lex = F.broadcast(K.emoji_lexicon(spark).withColumnRenamed("emoji", "symbol"))
    return K.symbol_occurrences(posts_all(spark, sf)).join(lex, "symbol", "left_semi").select("id", "symbol")


@query("lexicon_anti_join", lambda: (
    f"SELECT symbol, count(*) AS n FROM {sym_sql(PA)} WHERE symbol NOT IN (SELECT emoji FROM {lex_sql(EXPANDED)}) GROUP BY symbol"))
def q_lexicon_anti_join(spark, sf):
    lex = F.broadcast(K.emoji_lexicon(spark).withColumnRenamed("emoji", "symbol"))
    return (K.symbol_occurrences(posts_all(spark, sf)).join(lex, "symbol", "left_anti")
            .groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))


@query("lexicon_left_join", lambda: (
    f"SELECT f.emoji, f.n, e.emoji IS NOT NULL AS in_early, x.emoji IS NOT NULL AS in_expanded "
    f"FROM (SELECT emoji, count(*) AS n FROM {occ_sql(PA)} GROUP BY emoji) f "
    f"LEFT JOIN {lex_sql(EARLY)} e ON f.emoji = e.emoji LEFT JOIN {lex_sql(EXPANDED)} x ON f.emoji = x.emoji"))
def q_lexicon_left_join(spark, sf):
    return _flagged_frequency(spark, posts_all(spark, sf))


def _flagged_frequency(spark, df):
    freq = K.emoji_frequency(df)
    early = F.broadcast(K.emoji_lexicon(spark, "early").withColumn("in_early", F.lit(True)))
    exp = F.broadcast(K.emoji_lexicon(spark, "expanded").withColumn("in_expanded", F.lit(True)))
    return (freq.join(early, "emoji", "left").join(exp, "emoji", "left")
            .select("emoji", "n", F.coalesce("in_early", F.lit(False)).alias("in_early"),
                    F.coalesce("in_expanded", F.lit(False)).alias("in_expanded")))


# ---------------------------------------------------------------- §2.8 corpus top-k

@query("top_emojis", lambda: (
    f"SELECT * FROM (SELECT f.emoji, f.n, e.emoji IS NOT NULL AS in_early, x.emoji IS NOT NULL AS in_expanded "
    f"FROM (SELECT emoji, count(*) AS n FROM {occ_sql(PA)} GROUP BY emoji) f "
    f"LEFT JOIN {lex_sql(EARLY)} e ON f.emoji = e.emoji LEFT JOIN {lex_sql(EXPANDED)} x ON f.emoji = x.emoji) "
    "ORDER BY n DESC, emoji LIMIT 20"))
def q_top_emojis(spark, sf):
    return _flagged_frequency(spark, posts_all(spark, sf)).orderBy(F.col("n").desc(), "emoji").limit(20)


# ---------------------------------------------------------------- §2.9 set operations

def _polarity_hits(spark, df, emojis):
    lex = F.broadcast(spark.createDataFrame([(e,) for e in L.single_code_points(emojis)], "symbol string"))
    return K.symbol_occurrences(df).join(lex, "symbol", "left_semi").select("symbol")


@query("lexicon_union", lambda: (
    f"SELECT symbol FROM {sym_sql(PA)} WHERE symbol IN (SELECT emoji FROM {lex_sql(L.POSITIVE_EMOJIS)}) "
    f"UNION SELECT symbol FROM {sym_sql(PA)} WHERE symbol IN (SELECT emoji FROM {lex_sql(L.NEGATIVE_EMOJIS)})"))
def q_lexicon_union(spark, sf):
    p = posts_all(spark, sf)
    return _polarity_hits(spark, p, L.POSITIVE_EMOJIS).union(_polarity_hits(spark, p, L.NEGATIVE_EMOJIS)).distinct()


@query("lexicon_intersect", lambda: (
    f"SELECT symbol FROM {sym_sql(PA)} WHERE symbol IN (SELECT emoji FROM {lex_sql(L.POSITIVE_EMOJIS)}) "
    f"INTERSECT SELECT symbol FROM {sym_sql(PA)} WHERE symbol IN (SELECT emoji FROM {lex_sql(L.NEGATIVE_EMOJIS)})"))
def q_lexicon_intersect(spark, sf):
    p = posts_all(spark, sf)
    return _polarity_hits(spark, p, L.POSITIVE_EMOJIS).intersect(_polarity_hits(spark, p, L.NEGATIVE_EMOJIS))


@query("lexicon_except", lambda: (
    f"SELECT symbol FROM {sym_sql(PA)} WHERE NOT regexp_matches(symbol, '[\\x00-\\x7F]') "
    f"EXCEPT SELECT emoji FROM {lex_sql(EXPANDED)}"))
def q_lexicon_except(spark, sf):
    syms = K.symbol_occurrences(posts_all(spark, sf)).where(~F.col("symbol").rlike("[\\x00-\\x7F]")).select("symbol")
    return syms.subtract(K.emoji_lexicon(spark).withColumnRenamed("emoji", "symbol"))
