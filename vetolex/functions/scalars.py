"""Row-level scalar functions as native column expressions (Column -> Column).

Everything here compiles to Catalyst expressions that run inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

# ASCII whitespace, spelled out so the JVM and the SQL oracle use one class.
WS = "[ \\t\\n\\x0B\\f\\r]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_text(text) -> Column:
    """Null text is scored as the empty string (nulls are dropped earlier by cleaning)."""
    return F.coalesce(_col(text), F.lit(""))


# ---------------------------------------------------------------- polarity

def below_class(min_code_point: int) -> str:
    """A range class of every code point below ``min_code_point``."""
    return "[\\x{0}-\\x{%X}]" % (min_code_point - 1)


def high_plane(text, floor: int = L.EMOJI_FLOOR) -> Column:
    """Only the code points at or above ``floor`` (every emoji entry is there).  One cheap
    range-class pass shrinks long texts to a few characters before the large emoji class runs."""
    return F.regexp_replace(safe_text(text), F.lit(below_class(floor)), F.lit(""))


def emoji_polarity_count(text, emojis, boost=L.EMOJI_BOOST, stripped: bool = False) -> Column:
    """``boost`` for every code point of ``text`` that is a one-code-point lexicon entry.

    ``stripped=True`` when ``text`` is already :func:`high_plane` output."""
    chars = L.single_code_points(emojis)
    if not chars:
        return F.lit(0)
    t = safe_text(text) if stripped or min(ord(c) for c in chars) < L.EMOJI_FLOOR else high_plane(text)
    removed = F.regexp_replace(t, F.lit(L.char_class(chars)), F.lit(""))
    return ((F.length(t) - F.length(removed)) * _boost(boost)).cast("int")


def _boost(boost) -> Column:
    return boost if isinstance(boost, Column) else F.lit(int(boost))


def substring_occurrences(text, needle: str) -> Column:
    """Non-overlapping, left-to-right occurrences (the ``str.count`` rule)."""
    t = safe_text(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def emoticon_count(text, emoticons, boost=L.EMOJI_BOOST) -> Column:
    terms = [substring_occurrences(text, e) for e in L.distinct(emoticons)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return (total * _boost(boost)).cast("int")


def word_presence_count(text, words, lowered: bool = False) -> Column:
    """Number of distinct lexicon words found as a substring of the lower-cased text."""
    low = safe_text(text) if lowered else F.lower(safe_text(text))
    total = F.lit(0)
    for w in L.distinct(words):
        total = total + F.when(F.instr(low, w) > 0, 1).otherwise(0)
    return total.cast("int")


def polarity_features(text, boost=L.EMOJI_BOOST, pos_words=L.POSITIVE_WORDS,
                      neg_words=L.NEGATIVE_WORDS) -> dict[str, Column]:
    """The four signals ``(emoji_pos_count, emoji_neg_count, word_pos_count, word_neg_count)``."""
    e_pos = emoji_polarity_count(text, L.POSITIVE_EMOJIS, boost) + emoticon_count(text, L.POSITIVE_EMOTICONS, boost)
    e_neg = emoji_polarity_count(text, L.NEGATIVE_EMOJIS, boost) + emoticon_count(text, L.NEGATIVE_EMOTICONS, boost)
    return {
        "emoji_pos_count": e_pos.cast("int"),
        "emoji_neg_count": e_neg.cast("int"),
        "word_pos_count": word_presence_count(text, pos_words),
        "word_neg_count": word_presence_count(text, neg_words),
    }


def polarity_features_ext(text, boost=L.EMOJI_BOOST) -> dict[str, Column]:
    return polarity_features(text, boost,
                             L.word_list(L.POSITIVE_WORDS, L.POSITIVE_WORDS_EXTRA),
                             L.word_list(L.NEGATIVE_WORDS, L.NEGATIVE_WORDS_EXTRA))


def extract_known_emojis(text, reference=None) -> Column:
    """Array of reference emojis in text order, repeats kept."""
    ref = reference or tuple(e for e, _, _ in L.EMOJI_REFERENCE)
    return F.regexp_extract_all(safe_text(text), F.lit(L.char_class(L.single_code_points(ref))), F.lit(0))


def extract_symbols(text) -> Column:
    return F.regexp_extract_all(safe_text(text), F.lit(L.SYMBOL_PATTERN), F.lit(0))


def whitespace_tokens(text) -> Column:
    """``str.split()``: whitespace runs, no empty tokens."""
    return F.filter(F.split(safe_text(text), WS), lambda x: x != F.lit(""))


def contains_sentiment_words(text, words) -> Column:
    toks = whitespace_tokens(F.lower(safe_text(text)))
    return F.arrays_overlap(toks, F.array(*[F.lit(w) for w in L.distinct(words)]))


def has_substring_any(text, needles, lower=False) -> Column:
    t = safe_text(text)
    if lower:
        t = F.lower(t)
    cond = F.lit(False)
    for n in L.distinct(needles):
        cond = cond | (F.instr(t, n) > 0)
    return cond


def has_emoticon(text, emoticons) -> Column:
    return has_substring_any(text, emoticons)


def has_lexicon_word(text, words) -> Column:
    return has_substring_any(text, words, lower=True)


def has_code_point_of(text, literal: str) -> Column:
    """True when any code point of ``literal`` occurs in the text."""
    return safe_text(text).rlike(L.char_class(L.code_point_set(literal)))


# ---------------------------------------------------------------- tokens

def tokenize(text) -> Column:
    """Lower-case, then runs of two or more letters / digits / underscores."""
    return F.regexp_extract_all(F.lower(safe_text(text)), F.lit(L.TOKEN_PATTERN), F.lit(0))


def word_ngrams(tokens, n_max: int = 2, n_min: int = 1) -> Column:
    """Unigrams first (when ``n_min == 1``), then n-grams joined by one space, n <= n_max.

    Tokens never contain whitespace, so the n-grams are read off the space-joined token
    string with one zero-width look-ahead match per token start — a native regex pass, no
    per-element lambda.  ``tokens`` should be a column *reference* (see :func:`with_ngrams`)."""
    tok = _col(tokens)
    parts = [tok] if n_min <= 1 else []
    if n_max >= max(n_min, 2):
        joined = F.array_join(tok, " ")
        for n in range(max(n_min, 2), n_max + 1):
            pattern = "(?<=^| )(?=(\\S+" + "(?: \\S+)" * (n - 1) + "))"
            parts.append(F.regexp_extract_all(joined, F.lit(pattern), F.lit(1)))
    if not parts:
        return F.array().cast("array<string>")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def with_ngrams(df, text_col: str = "text", out_col: str = "grams", n_max: int = 2,
                keep_tokens: bool = False):
    """Tokenize once into a column, then derive the n-gram array from that column."""
    out = df.withColumn("_tok", tokenize(text_col)).withColumn(out_col, word_ngrams("_tok", n_max))
    return out.withColumnRenamed("_tok", "tokens") if keep_tokens else out.drop("_tok")


def explode_nonempty(df, array_col, alias: str, *keep):
    """``explode`` without the optimizer's inferred ``size(array) > 0`` pre-filter.

    For a plain ``explode`` Spark infers that filter and pushes it below the projection,
    where it re-evaluates the (expensive) expression that builds the array.  The outer
    form keeps one evaluation; empty arrays give a null element, dropped right after."""
    return (df.select(*keep, F.explode_outer(array_col).alias(alias))
            .where(F.col(alias).isNotNull()))


def truncate_text(text, n: int) -> Column:
    return F.substring(safe_text(text), 1, n)


# ---------------------------------------------------------------- math / decisions

def sigmoid(x) -> Column:
    x = _col(x)
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def confidence(p1) -> Column:
    p1 = _col(p1)
    return F.greatest(p1, 1.0 - p1)


def entropy_flag(conf, threshold=L.AMBIGUITY_THRESHOLD) -> Column:
    return F.when(_col(conf) < threshold, F.lit("High Ambiguity")).otherwise(F.lit("Clear Signal"))


def label_decode(label) -> Column:
    return F.when(_col(label) == 1, F.lit("Positive")).otherwise(F.lit("Negative"))


def label_encode(name) -> Column:
    return F.when(_col(name) == "Positive", F.lit(1)).otherwise(F.lit(0))


def signal_gap(e_neg, e_pos) -> Column:
    e_neg, e_pos = _col(e_neg), _col(e_pos)
    return (e_neg - e_pos).cast("double") / (e_neg + e_pos + 1).cast("double")


def veto_confidence(e_neg, e_pos, low=L.VETO_CONF_LOW, span=L.VETO_CONF_SPAN) -> Column:
    return F.round(F.lit(low) + F.lit(span) * signal_gap(e_neg, e_pos), 4)


def original_veto_fires(e_neg, e_pos, threshold=L.EMOJI_BOOST) -> Column:
    e_neg, e_pos = _col(e_neg), _col(e_pos)
    return (e_neg >= threshold) & (e_neg >= e_pos)


def sarcasm_veto_fires(e_neg, e_pos, w_pos, threshold=L.EMOJI_BOOST, guard=L.VETO_GUARD) -> Column:
    """Guard first (``w_pos >= guard`` with no positive emoji defers to the model), then threshold.

    ``threshold`` and ``guard`` may be columns (used after a configuration cross join)."""
    e_neg, e_pos, w_pos = _col(e_neg), _col(e_pos), _col(w_pos)
    guard_c = guard if isinstance(guard, Column) else F.lit(guard)
    thr_c = threshold if isinstance(threshold, Column) else F.lit(threshold)
    guarded = (w_pos >= guard_c) & (e_pos == 0)
    return ~guarded & (e_neg >= thr_c) & (e_neg >= e_pos)


def bin_confidence(conf, edges=(0.5, 0.6, 0.7, 0.8, 0.9, 1.01),
                   labels=("0.50–0.60", "0.60–0.70", "0.70–0.80", "0.80–0.90", "0.90–1.00")) -> Column:
    """Right-closed bins ``(lo, hi]``; values outside every bin are null."""
    c = _col(conf)
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def classify_archetype(text, true_label) -> Column:
    low = F.lower(safe_text(text))
    emoji_signal = has_code_point_of(text, L.ARCHETYPE_EMOJIS)
    short = F.size(whitespace_tokens(low)) <= 4
    pos_word = has_substring_any(low, L.ARCHETYPE_POSITIVE_WORDS)
    return (F.when(emoji_signal, F.lit("emoji-text conflict"))
            .when(short, F.lit("minimal context"))
            .when(pos_word & (_col(true_label) == 0), F.lit("lexical trap"))
            .otherwise(F.lit("sarcasm / ambiguous")))


def emoji_error_flag(text) -> Column:
    return has_code_point_of(text, L.ERROR_ANALYSIS_EMOJIS)


def classify_signal_type(token) -> Column:
    t = _col(token)
    return (F.when(F.instr(t, "emoji") > 0, F.lit("Visual"))
            .when(F.instr(t, "word") > 0, F.lit("Lexicon"))
            .otherwise(F.lit("Token")))


def driver_tier(weight) -> Column:
    a = F.abs(_col(weight))
    return F.when(a >= 1.5, F.lit("Critical")).when(a >= 0.5, F.lit("Strong")).otherwise(F.lit("Moderate"))


# FIXED VALUES — friendly display names of the numeric drivers.
DRIVER_LABELS = (
    ("emoji_pos_count", "pos emoji"),
    ("emoji_neg_count", "neg emoji"),
    ("word_pos_count", "pos word"),
    ("word_neg_count", "neg word"),
)


def driver_label(token) -> Column:
    t = _col(token)
    out = None
    for k, v in DRIVER_LABELS:
        out = F.when(t == k, F.lit(v)) if out is None else out.when(t == k, F.lit(v))
    return out.otherwise(t)


def categorize_check(name) -> Column:
    """Bucket of a check name, first match wins."""
    n = _col(name)
    return (F.when((F.instr(n, "lexicon") > 0) | (F.instr(n, "word") > 0), F.lit("lexicon_integrity"))
            .when((F.instr(n, "veto") > 0) | (F.instr(n, "emoji") > 0), F.lit("emoji_veto"))
            .when(F.instr(n, "sarcasm") > 0, F.lit("sarcasm_detection"))
            .when(F.instr(n, "confidence") > 0, F.lit("confidence"))
            .otherwise(F.lit("other")))
