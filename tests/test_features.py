import pytest
from pyspark.sql import functions as F

from tests import python_rules as R
from vetolex.functions import scalars as S
from vetolex.operators.features import add_polarity_features
from vetolex.sources.tables import posts

CASES = [
    ("I am happy 😊😊 :)", (30, 0, 1, 0)),
    ("This is bad 😭😔", (0, 20, 0, 1)),
    ("Classic faces :-) :(", (10, 10, 0, 0)),
    ("Bittersweet 😊😭", (10, 10, 0, 0)),
    ("Happy 😊", (10, 0, 1, 0)),
    ("Sad 😭", (0, 10, 0, 1)),
    ("unhappy", (0, 0, 1, 1)),
    ("whatever", (0, 0, 0, 1)),
    ("good good good", (0, 0, 1, 0)),
    (">:(", (0, 20, 0, 0)),
    ("see http://x", (0, 10, 0, 0)),
    ("😎", (10, 10, 0, 0)),
    ("❤️", (0, 0, 0, 0)),
    ("", (0, 0, 0, 0)),
    ("ambassador", (0, 0, 0, 1)),
    ("ID: (18)", (10, 10, 0, 0)),
    ("🥀🥀", (0, 20, 0, 0)),
]


def _feats(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = add_polarity_features(df).orderBy("id").collect()
    return [(r.emoji_pos_count, r.emoji_neg_count, r.word_pos_count, r.word_neg_count) for r in rows]


def test_exact_counts(spark):
    got = _feats(spark, [t for t, _ in CASES])
    for (text, exp), g in zip(CASES, got):
        assert g == exp, text
        assert R.features(text) == exp, text


def test_null_text_is_empty(spark):
    df = spark.createDataFrame([(1, None)], "id long, text string")
    r = add_polarity_features(df).first()
    assert (r.emoji_pos_count, r.emoji_neg_count, r.word_pos_count, r.word_neg_count) == (0, 0, 0, 0)


def test_unicode_edges(spark):
    texts = ["İSTANBUL ΣΑΣ", "️", "   ", "naïve 😊️"]
    assert _feats(spark, texts) == [R.features(t) for t in texts]


def test_matches_python_rules_on_documents(spark, small_dir):
    rows = add_polarity_features(posts(spark, small_dir)).collect()
    assert rows
    for r in rows:
        assert (r.emoji_pos_count, r.emoji_neg_count, r.word_pos_count, r.word_neg_count) == R.features(r.text)


def test_extended_words(spark):
    df = spark.createDataFrame([(1, "the worst, horrible and disgusting")], "id long, text string")
    r = add_polarity_features(df, extended_words=True).first()
    assert r.word_neg_count == 3


def test_tokens_and_ngrams(spark):
    texts = ["naïve café résumé coördinate", "a", "GREAT GREAT great Great", "x_y 12 ½½ éte"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = S.with_ngrams(df, "text", "g", 2, keep_tokens=True).orderBy("id").collect()
    assert len(out[0].tokens) == 4 and len(out[0].g) == 7
    assert out[1].tokens == [] and out[1].g == []
    assert out[2].g.count("great") == 4 and out[2].g.count("great great") == 3
    for r, t in zip(out, texts):
        assert r.tokens == R.tokens(t)
        assert r.g == R.ngrams(R.tokens(t))


def test_symbols_and_known_emojis(spark):
    df = spark.createDataFrame([(1, "a😍b, c😭😭 ✨! ❤️")], "id long, text string")
    r = df.select(S.extract_known_emojis("text").alias("k"), S.extract_symbols("text").alias("s")).first()
    assert r.k == ["😍", "😭", "😭"]
    assert "✨" in r.s and "!" in r.s and "️" in r.s and "," not in r.s


@pytest.mark.parametrize("e_neg,e_pos,w_pos,fired,conf", [
    (10, 0, 1, True, 0.9318), (20, 0, 0, True, 0.9405), (50, 0, 0, True, 0.9461), (10, 10, 0, True, 0.75),
    (10, 0, 2, False, None), (10, 10, 2, True, 0.75), (0, 0, 0, False, None), (10, 20, 0, False, None),
])
def test_veto(spark, e_neg, e_pos, w_pos, fired, conf):
    df = spark.createDataFrame([(e_neg, e_pos, w_pos)], "n int, p int, w int")
    f = S.sarcasm_veto_fires("n", "p", "w")
    r = df.select(f.alias("f"), F.when(f, S.veto_confidence("n", "p")).alias("c")).first()
    assert r.f == fired and r.c == conf


def test_bins_right_closed(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (0.60001,), (1.0,), (0.95,)], "c double")
    assert [r.b for r in df.select(S.bin_confidence("c").alias("b")).collect()] == \
        [None, "0.50–0.60", "0.60–0.70", "0.90–1.00", "0.90–1.00"]


def test_archetype_order(spark):
    df = spark.createDataFrame([("I love it ❤", 0), ("too short", 1), ("a b c d e great", 0), ("a b c d e f", 1)],
                               "text string, label int")
    got = [r.a for r in df.select(S.classify_archetype("text", "label").alias("a")).collect()]
    assert got == ["emoji-text conflict", "minimal context", "lexical trap", "sarcasm / ambiguous"]


def test_sql_functions(spark):
    from vetolex.functions.sql_functions import register_sql_functions
    register_sql_functions(spark)
    for text, exp in CASES:
        r = spark.sql("SELECT vx_emoji_pos_count(t) a, vx_emoji_neg_count(t) b, vx_word_pos_count(t) c, "
                      "vx_word_neg_count(t) d FROM VALUES (:t) AS x(t)", args={"t": text}).first()
        assert tuple(r) == exp, text
