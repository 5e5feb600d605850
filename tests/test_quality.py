"""Checks and cleaning on inputs that must fail or change; session and evaluation rules."""

from types import SimpleNamespace

import pytest

from vetolex import session
from vetolex.operators import clean as C
from vetolex.operators import corpus as K
from vetolex.operators import evaluate as E
from vetolex.operators import quality as V
from vetolex.operators.split import stratified_split

RECORD = "timestamp string, raw_text string, prediction string, prediction_int int, confidence double, entropy_flag string, " \
         "veto_applied boolean, top_drivers array<struct<token:string,weight:double>>"


def violations(df):
    return {r.check: r.violations for r in df.collect()}


def test_nulls_and_types_are_violations(spark):
    bad = spark.createDataFrame([("t", "x", None, None, None, None, False, []), ("t", "x", "Positive", 1, 0.9, "Clear Signal", False, [])], RECORD)
    v = violations(V.validate_response(bad))
    assert (v["label_values"], v["label_int_values"], v["confidence_range"], v["flag_values"], v["response_types"]) == (1, 1, 1, 1, 0)
    assert violations(V.validate_audit(bad))["flag_valid"] == 1
    mistyped = bad.withColumn("prediction_int", bad["prediction_int"].cast("string"))
    assert violations(V.validate_response(mistyped))["response_types"] == 1
    assert violations(V.validate_response(bad.drop("timestamp")))["response_keys"] == 1


def test_duplicate_reference_rows_are_found(spark):
    ref = spark.createDataFrame([("😀", "a"), ("😀", "b"), ("😭", "c")], "emoji string, unicode_name string")
    assert violations(V.validate_emoji_reference(ref))["unique_emoji"] == 1
    assert violations(V.validate_emoji_reference(C.emoji_reference(spark))) == {"emoji_column": 0, "unique_emoji": 0}


def test_reference_table_is_cleaned(spark):
    raw = spark.createDataFrame([(0, "😀", 0x1F600, "GRINNING FACE")], "index int, Emoji string, `Unicode codepoint` int, `Unicode name` string")
    out = C.clean_emoji_reference(raw)
    assert out.dtypes == [("emoji", "string"), ("unicode_codepoint", "string"), ("unicode_name", "string")]
    assert tuple(out.first()) == ("😀", "128512", "GRINNING FACE")


def test_dirty_posts_are_cleaned(spark):
    raw = spark.createDataFrame([("0", 7, "1", "good"), ("1", 8, None, "no label"), ("2", 9, "0", None), ("3", 10, "0", "bad")],
                                "`Unnamed: 0` string, index long, sentiment string, tweet string")
    out = C.clean_posts(raw)
    assert out.columns == ["id", "label", "text"] and dict(out.dtypes)["label"] == "int"
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(7, 1, "good"), (10, 0, "bad")]
    with pytest.raises(ValueError):
        C.clean_posts(raw.withColumn("post", raw["tweet"]))


def test_evaluation_judges_the_model_not_the_veto(spark):
    """One row on which both differ: the model is right, the veto overrides it."""
    df = spark.createDataFrame([(1, 1, 1, 0, 0.8, 0.94, "x"), (2, 0, 0, 0, 0.6, 0.6, "y")],
                               "id long, label int, model_prediction int, prediction_int int, model_confidence double, confidence_raw double, text string")
    assert E.metrics(df).first().accuracy == 1.0 and E.metrics(df, p="prediction_int").first().accuracy == 0.5
    assert E.error_counts(df).first().wrong == 0 and E.danger_cases(df).count() == 0
    bins = {r.conf_bin: r.accuracy for r in E.calibration_bins(df).collect()}
    assert bins == {"0.70–0.80": 1.0, "0.50–0.60": 1.0}
    assert [r.correct for r in E.with_outcome(df, p="prediction_int").orderBy("id").collect()] == [False, True]


def test_a_cluster_needs_a_shared_folder():
    named = []
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077", setCheckpointDir=named.append)
    spark = SimpleNamespace(sparkContext=sc, conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)
    spark.conf["spark.checkpoint.dir"] = "hdfs://shared"
    session.ensure_checkpoint_dir(spark)
    assert named == ["hdfs://shared"]


def test_split_is_exact_with_ties_and_small_labels(spark):
    rows = [(i, i % 3) for i in range(500)] + [(7, 0), (7, 0), (900, 5)]
    out = stratified_split(spark.createDataFrame(rows, "id long, label int")).collect()
    import hashlib
    for label in (0, 1, 2, 5):
        own = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, y in rows if y == label)
        n = int(len(own) * 0.2 + 0.5)
        got = sorted((hashlib.md5(f"42:{r.id}".encode()).hexdigest(), r.id) for r in out if r.label == label and r.split == "val")
        assert set(own[:n]) == set(got) and len(out) == len(rows)


def test_quartiles_from_counts_per_value(spark):
    import numpy as np
    values = [float(x) for x in np.random.default_rng(0).normal(size=101)] + [1.0] * 30
    r = K.describe_column(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x").first()
    assert [r.q25, r.q50, r.q75] == [round(float(q), 6) for q in np.quantile(values, [0.25, 0.5, 0.75])] and r["count"] == 131


def test_empty_histogram_has_no_bins(spark):
    assert K.equal_width_histogram(spark.createDataFrame([], "x double"), "x").count() == 0
