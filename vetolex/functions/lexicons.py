"""Polarity lexicons and the helpers that compile them into column expressions.

The lexicons are stored exactly as the scoring rules define them.  Matching of
emojis is per code point, so entries made of more than one code point (for
example a symbol followed by the variation selector U+FE0F) are kept here as
data but can never match; :func:`single_code_points` drops them when a regex
character class is compiled.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES — must equal the scoring rules this engine reproduces.
# Stated plainly, in their natural order.  Do not edit.
# --------------------------------------------------------------------------

POSITIVE_EMOJIS = (
    "😀", "😃", "😄", "😁", "😆", "😅", "🤣", "😂", "🙂", "🙃", "😉", "😊",
    "😇", "🥰", "😍", "🤩", "😘", "😗", "😚", "😙", "😋", "😛", "😜", "🤪",
    "😝", "🤑", "🤗", "🤭", "🥱", "😌", "😎", "🥳", "😏",
    "👍", "👏", "🙌", "👐", "🤲", "🤝", "👊", "✌️", "🤘", "👌", "🤙", "💪",
    "🙏", "🎉", "🎊", "🎈", "🧧", "✨", "🌟", "⭐", "⚡", "🔥", "💯", "✅", "✔️",
    "❤️", "🧡", "💛", "💚", "💙", "💜", "🖤", "🤍", "🤎", "💖", "💗", "💓",
    "💞", "💕", "💟", "❣️", "💘", "💝", "🎯", "🏆", "💎", "🚀", "📈", "🌈",
    "☀️", "🌸",
)

NEGATIVE_EMOJIS = (
    "🤨", "😐", "😑", "😶", "🙄", "😒", "🤥", "😌", "😔", "😪", "🤤", "😷",
    "🤒", "🤕", "🤢", "🤮", "🤧", "🥵", "🥶", "🥴", "😵", "🤯", "🤠", "🥳",
    "😎", "🤓", "🧐", "😕", "😟", "🙁", "☹️", "😮", "😯", "😲", "😳", "🥺",
    "😦", "😧", "😨", "😰", "😥", "😢", "😭", "😱", "😖", "😣", "😞", "😓",
    "😩", "😫", "🥱", "😤", "😡", "😠", "🤬", "😈", "👿", "💀", "☠️", "💩",
    "🤡", "👹", "👺", "👻",
    "👎", "✊", "🤛", "🤜", "🤞", "🤟", "🤘", "🤏", "👈", "👉", "👆", "👇",
    "🖕", "🖖", "🖐️", "✋", "🤚", "👋", "🙅", "🙆", "🙋", "💁", "🙇", "🤦",
    "🤷", "🚫", "❌", "🛑", "⚠️", "⛔", "🔇", "🔕",
    "💔", "🥀", "⛈️", "🌑", "📉", "🗑️", "💣", "🩹", "⚰️", "🥀", "🍂", "🌧️",
    "💧", "☁️",
)

POSITIVE_EMOTICONS = (":)", ":-)", ":D", "=D", ":P", ":-P", ";)", ";-)", "XD", "<3", "8)")
NEGATIVE_EMOTICONS = (":(", ":-(", ":'(", "D:", "D-:", ">:(", ":|", ":/", ":-/", ":S", "-_-")

POSITIVE_WORDS = (
    "happy", "good", "great", "love", "nice", "awesome",
    "beautiful", "amazing", "wonderful", "excellent", "perfect",
)
NEGATIVE_WORDS = ("sad", "bad", "terrible", "hate", "awful", "unhappy")

# Extension used by the veto-refinement experiments.
POSITIVE_WORDS_EXTRA = ("beautiful", "amazing", "wonderful", "excellent", "perfect")
NEGATIVE_WORDS_EXTRA = ("terrible", "horrible", "awful", "worst", "disgusting")

# Crude whitespace-token heuristic of the exploratory analysis (another list).
EDA_POSITIVE_WORDS = ("happy", "good", "great", "love", "nice", "awesome")
EDA_NEGATIVE_WORDS = ("sad", "bad", "angry", "hate", "terrible", "unhappy")

EMOJI_BOOST = 10
AMBIGUITY_THRESHOLD = 0.70
VETO_GUARD = 2
VETO_CONF_LOW = 0.75
VETO_CONF_SPAN = 0.20
ORIGINAL_VETO_CONFIDENCE = 0.85
MAX_TEXT_LEN = 2000

# The 16-row emoji reference table (emoji, code point, name).
EMOJI_REFERENCE = (
    ("😍", "0x1f60d", "SMILING FACE WITH HEART-SHAPED EYES"),
    ("😭", "0x1f62d", "LOUDLY CRYING FACE"),
    ("😘", "0x1f618", "FACE THROWING A KISS"),
    ("😊", "0x1f60a", "SMILING FACE WITH SMILING EYES"),
    ("😁", "0x1f601", "GRINNING FACE WITH SMILING EYES"),
    ("😉", "0x1f609", "WINKING FACE"),
    ("😄", "0x1f604", "SMILING FACE WITH OPEN MOUTH AND SMILING EYES"),
    ("😒", "0x1f612", "UNAMUSED FACE"),
    ("😔", "0x1f614", "PENSIVE FACE"),
    ("😢", "0x1f622", "CRYING FACE"),
    ("😆", "0x1f606", "SMILING FACE WITH OPEN MOUTH AND TIGHTLY-CLOSED EYES"),
    ("😀", "0x1f600", "GRINNING FACE"),
    ("😐", "0x1f610", "NEUTRAL FACE"),
    ("😛", "0x1f61b", "FACE WITH STUCK-OUT TONGUE"),
    ("😲", "0x1f632", "ASTONISHED FACE"),
    ("😧", "0x1f627", "ANGUISHED FACE"),
)

# The first, six-emoji lexicon (four positive, two negative) used before the expansion.
EARLY_POSITIVE_EMOJIS = ("😍", "😊", "😁", "😘")
EARLY_NEGATIVE_EMOJIS = ("😭", "😧")

# Emoji lists scanned code point by code point in the error analyses.
ERROR_ANALYSIS_EMOJIS = "😭😊😍😧😂❤️"
ARCHETYPE_EMOJIS = "😭😊😍😧😂❤️😁😘😩😤"
ARCHETYPE_POSITIVE_WORDS = ("great", "good", "happy", "love", "amazing", "perfect", "nice", "awesome")

# Numeric features appended after the TF-IDF block, in this order.
NUMERIC_FEATURES = ("emoji_pos_count", "emoji_neg_count", "word_pos_count", "word_neg_count")

# Token rule: two or more letters, digits or underscores (after lower-casing).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# "Symbol" rule of the exploratory analysis: not a word char, space or comma.
SYMBOL_PATTERN = r"[^\p{L}\p{N}_\s,]"

# --------------------------------------------------------------------------


def distinct(values) -> tuple[str, ...]:
    """Distinct values, first occurrence order."""
    seen: dict[str, None] = {}
    for v in values:
        seen.setdefault(v, None)
    return tuple(seen)


def single_code_points(values) -> tuple[str, ...]:
    """Entries that can match one code point (multi-code-point entries never match)."""
    return tuple(v for v in distinct(values) if len(v) == 1)


def char_class(chars) -> str:
    """A regex character class that matches any of ``chars`` (single code points)."""
    out = []
    for c in chars:
        out.append("\\" + c if c in "\\]^-[" else c)
    return "[" + "".join(out) + "]"


def code_point_set(literal: str) -> tuple[str, ...]:
    """Every code point of a literal (used where a string is iterated char by char)."""
    return distinct(literal)


def word_list(base, extra=()) -> tuple[str, ...]:
    return distinct(tuple(base) + tuple(extra))


# Lowest code point of any one-code-point emoji entry (derived, not a fixed value).
EMOJI_FLOOR = min(ord(c) for c in single_code_points(POSITIVE_EMOJIS + NEGATIVE_EMOJIS))
