"""SQL-callable temporary functions for the scalar rules (SQL UDFs: inlined by the analyzer,
so they stay JVM-side and inside whole-stage codegen — no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import lexicons as L
from .scalars import below_class


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _emoji(t: str, emojis) -> str:
    chars = L.single_code_points(emojis)
    if min(ord(c) for c in chars) >= L.EMOJI_FLOOR:  # a cheap range class first, as in scalars.high_plane
        t = f"regexp_replace({t}, {_lit(below_class(L.EMOJI_FLOOR))}, '')"
    return f"(char_length({t}) - char_length(regexp_replace({t}, {_lit(L.char_class(chars))}, '')))"


def _emoticons(t: str, emoticons) -> str:
    return "(" + " + ".join(f"((char_length({t}) - char_length(replace({t}, {_lit(e)}, ''))) div {len(e)})"
                            for e in L.distinct(emoticons)) + ")"


def _words(t: str, words) -> str:
    return "(" + " + ".join(f"CAST(instr(lower({t}), {_lit(w)}) > 0 AS INT)" for w in L.distinct(words)) + ")"


def function_bodies(boost: int = L.EMOJI_BOOST) -> dict[str, tuple[str, str, str]]:
    t = "coalesce(text, '')"
    return {
        "vx_emoji_pos_count": ("text STRING", "INT",
                               f"CAST(({_emoji(t, L.POSITIVE_EMOJIS)} + {_emoticons(t, L.POSITIVE_EMOTICONS)}) * {boost} AS INT)"),
        "vx_emoji_neg_count": ("text STRING", "INT",
                               f"CAST(({_emoji(t, L.NEGATIVE_EMOJIS)} + {_emoticons(t, L.NEGATIVE_EMOTICONS)}) * {boost} AS INT)"),
        "vx_word_pos_count": ("text STRING", "INT", f"CAST({_words(t, L.POSITIVE_WORDS)} AS INT)"),
        "vx_word_neg_count": ("text STRING", "INT", f"CAST({_words(t, L.NEGATIVE_WORDS)} AS INT)"),
        "vx_sarcasm_veto": ("e_neg INT, e_pos INT, w_pos INT", "BOOLEAN",
                            f"NOT (w_pos >= {L.VETO_GUARD} AND e_pos = 0) AND e_neg >= {boost} AND e_neg >= e_pos"),
        "vx_veto_confidence": ("e_neg INT, e_pos INT", "DOUBLE",
                               f"round({L.VETO_CONF_LOW} + {L.VETO_CONF_SPAN} * CAST(e_neg - e_pos AS DOUBLE) / CAST(e_neg + e_pos + 1 AS DOUBLE), 4)"),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    names = []
    for name, (args, ret, body) in function_bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
        names.append(name)
    return names
