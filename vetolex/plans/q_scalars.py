"""Queries for the row-level string, array, math and decision functions (§2.4, §2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import scalars as S
from ..functions.sql_functions import register_sql_functions
from ..operators.features import add_polarity_features
from ..sources.tables import posts, posts_all
from . import sqlfrag as Q
from .registry import query

P = Q.posts_sql()
PA = Q.posts_all_sql()
FA = Q.features_all_sql()


def features(spark, sf):
    return add_polarity_features(posts(spark, sf))


def features_all(spark, sf):
    return add_polarity_features(posts_all(spark, sf))


@query("polarity_features", lambda: f"SELECT id, label, {Q.polarity_select('text')} FROM {P}")
def q_polarity_features(spark, sf):
    return features(spark, sf).drop("text")


@query("emoji_polarity_count", lambda: (
    f"SELECT id, CAST({Q.emoji_count('text', L.POSITIVE_EMOJIS)} AS INTEGER) AS emoji_pos, "
    f"CAST({Q.emoji_count('text', L.NEGATIVE_EMOJIS)} AS INTEGER) AS emoji_neg FROM {PA}"))
def q_emoji_polarity_count(spark, sf):
    return posts_all(spark, sf).select("id", S.emoji_polarity_count("text", L.POSITIVE_EMOJIS).alias("emoji_pos"),
                                   S.emoji_polarity_count("text", L.NEGATIVE_EMOJIS).alias("emoji_neg"))


@query("emoticon_count", lambda: (
    f"SELECT id, CAST({Q.emoticon_count('text', L.POSITIVE_EMOTICONS)} AS INTEGER) AS emoticon_pos, "
    f"CAST({Q.emoticon_count('text', L.NEGATIVE_EMOTICONS)} AS INTEGER) AS emoticon_neg FROM {PA}"))
def q_emoticon_count(spark, sf):
    return posts_all(spark, sf).select("id", S.emoticon_count("text", L.POSITIVE_EMOTICONS).alias("emoticon_pos"),
                                   S.emoticon_count("text", L.NEGATIVE_EMOTICONS).alias("emoticon_neg"))


@query("word_presence_count", lambda: (
    f"SELECT id, CAST({Q.word_count('text', L.POSITIVE_WORDS)} AS INTEGER) AS word_pos, "
    f"CAST({Q.word_count('text', L.NEGATIVE_WORDS)} AS INTEGER) AS word_neg FROM {PA}"))
def q_word_presence_count(spark, sf):
    return posts_all(spark, sf).select("id", S.word_presence_count("text", L.POSITIVE_WORDS).alias("word_pos"),
                                       S.word_presence_count("text", L.NEGATIVE_WORDS).alias("word_neg"))


@query("polarity_features_ext", lambda: (
    "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in Q.polarity_ext("text").items()) + f" FROM {PA}"))
def q_polarity_features_ext(spark, sf):
    return add_polarity_features(posts_all(spark, sf), extended_words=True).drop("text")


@query("build_feature_table", lambda: f"SELECT id, label, text, {Q.polarity_select('text')} FROM {P}")
def q_build_feature_table(spark, sf):
    return features(spark, sf)


@query("extract_known_emojis", lambda: f"SELECT id, {Q.known_emojis('text')} AS known_emojis FROM {PA}")
def q_extract_known_emojis(spark, sf):
    return posts_all(spark, sf).select("id", S.extract_known_emojis("text").alias("known_emojis"))


@query("emoji_count", lambda: (
    f"SELECT id, CAST(len({Q.known_emojis('text')}) AS BIGINT) AS emoji_count, "
    f"len({Q.known_emojis('text')}) > 0 AS has_emoji FROM {PA}"))
def q_emoji_count(spark, sf):
    e = S.extract_known_emojis("text")
    return posts_all(spark, sf).select("id", F.size(e).cast("bigint").alias("emoji_count"), (F.size(e) > 0).alias("has_emoji"))


@query("extract_symbols", lambda: f"SELECT id, {Q.symbols('text')} AS symbols FROM {PA}")
def q_extract_symbols(spark, sf):
    return posts_all(spark, sf).select("id", S.extract_symbols("text").alias("symbols"))


@query("contains_sentiment_words", lambda: (
    f"SELECT id, list_has_any({Q.ws_tokens('lower(text)')}, {Q.str_list(L.EDA_POSITIVE_WORDS)}) AS has_positive_words, "
    f"list_has_any({Q.ws_tokens('lower(text)')}, {Q.str_list(L.EDA_NEGATIVE_WORDS)}) AS has_negative_words FROM {PA}"))
def q_contains_sentiment_words(spark, sf):
    return posts_all(spark, sf).select(
        "id", S.contains_sentiment_words("text", L.EDA_POSITIVE_WORDS).alias("has_positive_words"),
        S.contains_sentiment_words("text", L.EDA_NEGATIVE_WORDS).alias("has_negative_words"))


@query("has_emoticon", lambda: (
    f"SELECT id, {Q.any_substring('text', L.POSITIVE_EMOTICONS)} AS has_pos_emoticon, "
    f"{Q.any_substring('text', L.NEGATIVE_EMOTICONS)} AS has_neg_emoticon FROM {PA}"))
def q_has_emoticon(spark, sf):
    return posts_all(spark, sf).select("id", S.has_emoticon("text", L.POSITIVE_EMOTICONS).alias("has_pos_emoticon"),
                                   S.has_emoticon("text", L.NEGATIVE_EMOTICONS).alias("has_neg_emoticon"))


@query("has_lexicon_word", lambda: (
    f"SELECT id, {Q.any_substring('text', L.POSITIVE_WORDS, lower=True)} AS has_pos_word, "
    f"{Q.any_substring('text', L.NEGATIVE_WORDS, lower=True)} AS has_neg_word FROM {PA}"))
def q_has_lexicon_word(spark, sf):
    return posts_all(spark, sf).select("id", S.has_lexicon_word("text", L.POSITIVE_WORDS).alias("has_pos_word"),
                                       S.has_lexicon_word("text", L.NEGATIVE_WORDS).alias("has_neg_word"))


@query("tokenize", lambda: (
    f"SELECT id, CAST(len(tok) AS BIGINT) AS n_tokens, md5(array_to_string(tok, ' ')) AS tokens_md5 "
    f"FROM (SELECT id, {Q.tokens('text')} AS tok FROM {PA})"))
def q_tokenize(spark, sf):
    tok = S.tokenize("text")
    return posts_all(spark, sf).select("id", F.size(tok).cast("bigint").alias("n_tokens"),
                                       F.md5(F.concat_ws(" ", tok)).alias("tokens_md5"))


@query("word_ngrams", lambda: (
    f"SELECT id, CAST(len(g) AS BIGINT) AS n_grams, md5(array_to_string(g, '|')) AS grams_md5 "
    f"FROM (SELECT id, {Q.ngrams('tok')} AS g FROM (SELECT id, {Q.tokens('text')} AS tok FROM {PA}))"))
def q_word_ngrams(spark, sf):
    return (S.with_ngrams(posts_all(spark, sf), "text", "g", 2)
            .select("id", F.size("g").cast("bigint").alias("n_grams"), F.md5(F.concat_ws("|", "g")).alias("grams_md5")))


@query("truncate_text", lambda: f"SELECT id, substr(text, 1, 55) AS preview FROM {PA}")
def q_truncate_text(spark, sf):
    return posts_all(spark, sf).select("id", S.truncate_text("text", 55).alias("preview"))


@query("lower_text", lambda: f"SELECT id, md5(lower(text)) AS lower_md5 FROM {PA}")
def q_lower_text(spark, sf):
    return posts_all(spark, sf).select("id", F.md5(F.lower("text")).alias("lower_md5"))


# ---------------------------------------------------------------- §2.5 decisions over features

@query("signal_gap", lambda: (
    f"SELECT id, round({Q.signal_gap('emoji_neg_count', 'emoji_pos_count')}, 6) AS signal_gap FROM {FA}"))
def q_signal_gap(spark, sf):
    return features_all(spark, sf).select("id", F.round(S.signal_gap("emoji_neg_count", "emoji_pos_count"), 6).alias("signal_gap"))


@query("original_veto", lambda: (
    f"SELECT id, {Q.original_veto_fires('emoji_neg_count', 'emoji_pos_count')} AS veto_applied, "
    f"CASE WHEN {Q.original_veto_fires('emoji_neg_count', 'emoji_pos_count')} THEN 0 END AS veto_label, "
    f"CASE WHEN {Q.original_veto_fires('emoji_neg_count', 'emoji_pos_count')} THEN CAST(0.85 AS DOUBLE) END AS veto_confidence FROM {FA}"))
def q_original_veto(spark, sf):
    fired = S.original_veto_fires("emoji_neg_count", "emoji_pos_count")
    return features_all(spark, sf).select("id", fired.alias("veto_applied"),
                                      F.when(fired, F.lit(0)).alias("veto_label"),
                                      F.when(fired, F.lit(L.ORIGINAL_VETO_CONFIDENCE)).alias("veto_confidence"))


@query("sarcasm_veto", lambda: (
    f"SELECT id, {Q.veto_fires('emoji_neg_count', 'emoji_pos_count', 'word_pos_count')} AS veto_applied, "
    f"CASE WHEN {Q.veto_fires('emoji_neg_count', 'emoji_pos_count', 'word_pos_count')} "
    f"THEN {Q.veto_confidence('emoji_neg_count', 'emoji_pos_count')} END AS veto_confidence FROM {FA}"))
def q_sarcasm_veto(spark, sf):
    fired = S.sarcasm_veto_fires("emoji_neg_count", "emoji_pos_count", "word_pos_count")
    return features_all(spark, sf).select("id", fired.alias("veto_applied"),
                                      F.when(fired, S.veto_confidence("emoji_neg_count", "emoji_pos_count")).alias("veto_confidence"))


@query("emoji_error_flag", lambda: f"SELECT id, {Q.has_code_point_of('text', L.ERROR_ANALYSIS_EMOJIS)} AS emoji_error FROM {PA}")
def q_emoji_error_flag(spark, sf):
    return posts_all(spark, sf).select("id", S.emoji_error_flag("text").alias("emoji_error"))


@query("classify_archetype", lambda: f"SELECT id, {Q.archetype('text', 'label')} AS archetype FROM {P}")
def q_classify_archetype(spark, sf):
    return posts(spark, sf).select("id", S.classify_archetype("text", "label").alias("archetype"))


@query("label_decode", lambda: (
    f"SELECT id, CASE WHEN label = 1 THEN 'Positive' ELSE 'Negative' END AS label_name FROM {P}"))
def q_label_decode(spark, sf):
    return posts(spark, sf).select("id", S.label_decode("label").alias("label_name"))


@query("sql_functions", lambda: (
    f"WITH f AS (SELECT id, {Q.polarity_select('text')} FROM {PA}) SELECT *, {Q.veto_fires('emoji_neg_count', 'emoji_pos_count', 'word_pos_count')} AS veto_applied, "
    f"{Q.veto_confidence('emoji_neg_count', 'emoji_pos_count')} AS veto_confidence FROM f"))
def q_sql_functions(spark, sf):
    """The rules called from SQL as temporary functions, over every post."""
    register_sql_functions(spark)
    return spark.sql("""
        SELECT *, vx_sarcasm_veto(emoji_neg_count, emoji_pos_count, word_pos_count) AS veto_applied,
               vx_veto_confidence(emoji_neg_count, emoji_pos_count) AS veto_confidence
        FROM (SELECT id, vx_emoji_pos_count(text) AS emoji_pos_count, vx_emoji_neg_count(text) AS emoji_neg_count,
                     vx_word_pos_count(text) AS word_pos_count, vx_word_neg_count(text) AS word_neg_count FROM {posts})
        """, posts=posts_all(spark, sf))
