"""ANSI/DuckDB SQL fragments for the oracle queries, built from the same fixed values
as the column expressions so both sides share one definition of each rule."""

from __future__ import annotations

from ..functions import lexicons as L
from ..sources.tables import POST_SUFFIXES

WS_SQL = "[ \\t\\n\\x0B\\f\\r]+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def suffix_case(doc_id: str) -> str:
    whens = " ".join(f"WHEN {k} THEN {lit(s)}" for k, s in enumerate(POST_SUFFIXES))
    return f"(CASE {doc_id} % {len(POST_SUFFIXES)} {whens} END)"


def posts_sql() -> str:
    return (
        "(SELECT d.doc_id AS id, CAST(l.quality AS INTEGER) AS label, "
        f"d.text || {suffix_case('d.doc_id')} AS text "
        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id "
        "WHERE d.text IS NOT NULL AND l.quality IS NOT NULL)"
    )


def posts_all_sql() -> str:
    return f"(SELECT doc_id AS id, text || {suffix_case('doc_id')} AS text FROM documents)"


def emoji_count(t: str, emojis, boost=L.EMOJI_BOOST) -> str:
    cls = L.char_class(L.single_code_points(emojis))
    return f"((length({t}) - length(regexp_replace({t}, {lit(cls)}, '', 'g'))) * {boost})"


def emoticon_count(t: str, emoticons, boost=L.EMOJI_BOOST) -> str:
    parts = [f"((length({t}) - length(replace({t}, {lit(e)}, ''))) // {len(e)})" for e in L.distinct(emoticons)]
    return "((" + " + ".join(parts) + f") * {boost})"


def word_count(t: str, words) -> str:
    parts = [f"CAST(contains(lower({t}), {lit(w)}) AS INTEGER)" for w in L.distinct(words)]
    return "(" + " + ".join(parts) + ")"


def polarity(t: str, boost=L.EMOJI_BOOST, pos_words=L.POSITIVE_WORDS, neg_words=L.NEGATIVE_WORDS) -> dict[str, str]:
    return {
        "emoji_pos_count": f"CAST({emoji_count(t, L.POSITIVE_EMOJIS, boost)} + {emoticon_count(t, L.POSITIVE_EMOTICONS, boost)} AS INTEGER)",
        "emoji_neg_count": f"CAST({emoji_count(t, L.NEGATIVE_EMOJIS, boost)} + {emoticon_count(t, L.NEGATIVE_EMOTICONS, boost)} AS INTEGER)",
        "word_pos_count": f"CAST({word_count(t, pos_words)} AS INTEGER)",
        "word_neg_count": f"CAST({word_count(t, neg_words)} AS INTEGER)",
    }


def polarity_ext(t: str, boost=L.EMOJI_BOOST) -> dict[str, str]:
    return polarity(t, boost, L.word_list(L.POSITIVE_WORDS, L.POSITIVE_WORDS_EXTRA),
                    L.word_list(L.NEGATIVE_WORDS, L.NEGATIVE_WORDS_EXTRA))


def polarity_select(t: str = "text", **kw) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in polarity(t, **kw).items())


def features_sql(source: str | None = None) -> str:
    """``posts`` plus the four signals."""
    src = source or posts_sql()
    return f"(SELECT id, label, text, {polarity_select('text')} FROM {src})"


def features_all_sql() -> str:
    """``posts_all`` plus the four signals."""
    return f"(SELECT id, text, {polarity_select('text')} FROM {posts_all_sql()})"


def known_emojis(t: str) -> str:
    ref = tuple(e for e, _, _ in L.EMOJI_REFERENCE)
    return f"regexp_extract_all({t}, {lit(L.char_class(ref))}, 0)"


def symbols(t: str) -> str:
    return f"regexp_extract_all({t}, {lit(L.SYMBOL_PATTERN)}, 0)"


def ws_tokens(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, {lit(WS_SQL)}), lambda x: x <> '')"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {lit(L.TOKEN_PATTERN)}, 0)"


def ngrams(tok: str) -> str:
    bigrams = (f"list_transform(range(1, len({tok})), lambda i: {tok}[i] || ' ' || {tok}[i + 1])")
    return f"(CASE WHEN len({tok}) >= 2 THEN list_concat({tok}, {bigrams}) ELSE {tok} END)"


def any_substring(t: str, needles, lower=False) -> str:
    tt = f"lower({t})" if lower else t
    return "(" + " OR ".join(f"contains({tt}, {lit(n)})" for n in L.distinct(needles)) + ")"


def has_code_point_of(t: str, literal: str) -> str:
    return f"regexp_matches({t}, {lit(L.char_class(L.code_point_set(literal)))})"


def sigmoid(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 1.0 / (1.0 + exp(-({x}))) ELSE exp({x}) / (1.0 + exp({x})) END)"


def signal_gap(e_neg: str, e_pos: str) -> str:
    return f"(CAST({e_neg} - {e_pos} AS DOUBLE) / CAST({e_neg} + {e_pos} + 1 AS DOUBLE))"


def veto_confidence(e_neg: str, e_pos: str) -> str:
    return f"round({L.VETO_CONF_LOW} + {L.VETO_CONF_SPAN} * {signal_gap(e_neg, e_pos)}, 4)"


def veto_fires(e_neg: str, e_pos: str, w_pos: str, threshold=L.EMOJI_BOOST, guard=L.VETO_GUARD) -> str:
    return (f"(NOT ({w_pos} >= {guard} AND {e_pos} = 0) AND {e_neg} >= {threshold} AND {e_neg} >= {e_pos})")


def original_veto_fires(e_neg: str, e_pos: str, threshold=L.EMOJI_BOOST) -> str:
    return f"({e_neg} >= {threshold} AND {e_neg} >= {e_pos})"


def bin_confidence(c: str) -> str:
    edges = (0.5, 0.6, 0.7, 0.8, 0.9, 1.01)
    labels = ("0.50–0.60", "0.60–0.70", "0.70–0.80", "0.80–0.90", "0.90–1.00")
    whens = " ".join(f"WHEN {c} > {lo} AND {c} <= {hi} THEN {lit(lab)}"
                     for lo, hi, lab in zip(edges[:-1], edges[1:], labels))
    return f"(CASE {whens} END)"


def archetype(t: str, true_label: str) -> str:
    return (f"(CASE WHEN {has_code_point_of(t, L.ARCHETYPE_EMOJIS)} THEN 'emoji-text conflict' "
            f"WHEN len({ws_tokens(f'lower({t})')}) <= 4 THEN 'minimal context' "
            f"WHEN {any_substring(t, L.ARCHETYPE_POSITIVE_WORDS, lower=True)} AND {true_label} = 0 THEN 'lexical trap' "
            "ELSE 'sarcasm / ambiguous' END)")


def signal_type(tok: str) -> str:
    return (f"(CASE WHEN contains({tok}, 'emoji') THEN 'Visual' WHEN contains({tok}, 'word') THEN 'Lexicon' "
            "ELSE 'Token' END)")


def tier(w: str) -> str:
    return f"(CASE WHEN abs({w}) >= 1.5 THEN 'Critical' WHEN abs({w}) >= 0.5 THEN 'Strong' ELSE 'Moderate' END)"


def driver_label(tok: str) -> str:
    from ..functions.scalars import DRIVER_LABELS
    whens = " ".join(f"WHEN {tok} = {lit(k)} THEN {lit(v)}" for k, v in DRIVER_LABELS)
    return f"(CASE {whens} ELSE {tok} END)"


def categorize(name: str) -> str:
    return (f"(CASE WHEN contains({name}, 'lexicon') OR contains({name}, 'word') THEN 'lexicon_integrity' "
            f"WHEN contains({name}, 'veto') OR contains({name}, 'emoji') THEN 'emoji_veto' "
            f"WHEN contains({name}, 'sarcasm') THEN 'sarcasm_detection' "
            f"WHEN contains({name}, 'confidence') THEN 'confidence' ELSE 'other' END)")


def values_table(rows, columns) -> str:
    """An inline ``VALUES`` relation (for fixed, small parameter tables only)."""
    def fmt(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, str):
            return lit(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return repr(v)
    body = ", ".join("(" + ", ".join(fmt(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(columns)}))"
