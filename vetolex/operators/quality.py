"""Data-quality checks.  Each returns a violations table ``(check, violations, passed)``
computed in a single aggregation pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L


def checks_frame(one_row: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Unpivot named violation counts of a one-row aggregate into check rows."""
    structs = [F.struct(F.lit(name).alias("check"), expr.cast("bigint").alias("violations")) for name, expr in checks]
    return (one_row.select(F.explode(F.array(*structs)).alias("c"))
            .select("c.check", "c.violations", (F.col("c.violations") == 0).alias("passed")))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def not_in(column: str, *values) -> Column:
    """Outside the allowed values; a null is outside too."""
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def validate_posts(df: DataFrame, target: str = "label", text: str = "text") -> DataFrame:
    """Exact columns ``[label, text]`` (ids allowed first); labels in {0,1}; non-empty text."""
    cols = [c for c in df.columns if c != "id"]
    schema_ok = 0 if cols == [target, text] else 1
    row = df.agg(
        count_if(~F.col(target).isin(0, 1) | F.col(target).isNull()).alias("bad_label"),
        count_if(F.coalesce(F.length(text), F.lit(0)) <= 0).alias("empty_text"),
    )
    return checks_frame(row, [("column_order", F.lit(schema_ok)),
                              ("binary_labels", F.col("bad_label")),
                              ("non_empty_text", F.col("empty_text"))])


def validate_emoji_reference(df: DataFrame, key: str = "emoji") -> DataFrame:
    if key not in df.columns:
        return checks_frame(df.sparkSession.range(1), [("emoji_column", F.lit(1))])
    row = df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("dups"))
    return checks_frame(row, [("emoji_column", F.lit(0)), ("unique_emoji", F.col("dups"))])


def validate_shape(df: DataFrame, expected_rows: int | None = None, expected_width: int | None = None) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"))
    checks = []
    if expected_rows is not None:
        checks.append(("row_count", F.when(F.col("n") == expected_rows, 0).otherwise(1)))
    if expected_width is not None:
        checks.append(("width", F.lit(0 if len(df.columns) == expected_width else 1)))
    return checks_frame(row, checks)


def validate_split(split_df: DataFrame, label: str = "label", id_col: str = "id",
                   split_col: str = "split", tolerance: float = 0.02) -> DataFrame:
    """Sizes add up, ids unique and disjoint, class rate differs by less than ``tolerance``."""
    row = split_df.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(id_col).alias("n_ids"),
        count_if(F.col(split_col) == "train").alias("n_train"),
        count_if(F.col(split_col) == "val").alias("n_val"),
        F.avg(F.when(F.col(split_col) == "train", F.col(label))).alias("rate_train"),
        F.avg(F.when(F.col(split_col) == "val", F.col(label))).alias("rate_val"),
    )
    return checks_frame(row, [
        ("sizes_add_up", F.when(F.col("n_train") + F.col("n_val") == F.col("n"), 0).otherwise(1)),
        ("ids_unique_disjoint", F.col("n") - F.col("n_ids")),
        ("stratified_rate", F.when(F.abs(F.col("rate_train") - F.col("rate_val")) < tolerance, 0).otherwise(1)),
    ])


#: field -> type of a scored record
RESPONSE_TYPES = {"timestamp": "string", "raw_text": "string", "prediction": "string", "prediction_int": "int",
                  "confidence": "double", "entropy_flag": "string", "veto_applied": "boolean",
                  "top_drivers": "array<struct<token:string,weight:double>>"}
RESPONSE_FIELDS = list(RESPONSE_TYPES)


def _response_spec(scored: DataFrame):
    kinds = dict(scored.dtypes)
    missing = len([c for c in RESPONSE_FIELDS if c not in kinds])
    mistyped = len([c for c, kind in RESPONSE_TYPES.items() if kinds.get(c, kind) != kind])
    aggs = [
        count_if(not_in("prediction", "Positive", "Negative")).alias("bad_label"),
        count_if(not_in("prediction_int", 0, 1)).alias("bad_int"),
        count_if((F.col("confidence") < 0.5) | (F.col("confidence") > 1.0) | F.col("confidence").isNull()).alias("bad_conf"),
        count_if(not_in("entropy_flag", "High Ambiguity", "Clear Signal")).alias("bad_flag"),
        count_if(F.size("top_drivers") > 3).alias("too_many_drivers"),
        count_if(~(F.col("prediction") == "Positive").eqNullSafe(F.col("prediction_int") == 1)).alias("label_mismatch"),
    ]
    checks = [
        ("response_keys", F.lit(missing)),
        ("response_types", F.lit(mistyped)),
        ("label_values", F.col("bad_label")),
        ("label_int_values", F.col("bad_int")),
        ("confidence_range", F.col("bad_conf")),
        ("flag_values", F.col("bad_flag")),
        ("driver_count", F.col("too_many_drivers")),
        ("label_consistency", F.col("label_mismatch")),
    ]
    return aggs, checks


def _veto_range_spec():
    aggs = [
        count_if(F.col("veto_applied") & ((F.col("confidence") < L.VETO_CONF_LOW) |
                                          (F.col("confidence") > L.VETO_CONF_LOW + L.VETO_CONF_SPAN))).alias("veto_out"),
        count_if(~F.col("veto_applied") & ((F.col("confidence") < 0.5) | (F.col("confidence") > 1.0))).alias("model_out"),
        count_if(F.col("veto_applied") & (F.col("confidence") == L.ORIGINAL_VETO_CONFIDENCE)).alias("hardcoded"),
    ]
    checks = [("veto_confidence_range", F.col("veto_out")),
              ("model_confidence_range", F.col("model_out")),
              ("no_hardcoded_085", F.col("hardcoded"))]
    return aggs, checks


def validate_response(scored: DataFrame) -> DataFrame:
    """Scored records: 8 fields, allowed labels/flags, confidence range."""
    aggs, checks = _response_spec(scored)
    return checks_frame(scored.agg(*aggs), checks)


def response_and_veto_checks(scored: DataFrame) -> DataFrame:
    """Response and veto-range checks from one aggregation pass over the scored records."""
    a1, c1 = _response_spec(scored)
    a2, c2 = _veto_range_spec()
    return checks_frame(scored.agg(*a1, *a2), c1 + c2)


def validate_audit(scored: DataFrame) -> DataFrame:
    """Audit rows: drivers carry token and weight; flag valid; timestamp present.

    Empty drivers are legitimate (text with no signal), so they are reported, not failed."""
    row = scored.agg(
        count_if(~F.forall("top_drivers", lambda d: d["token"].isNotNull() & d["weight"].isNotNull())).alias("bad_driver"),
        count_if(not_in("entropy_flag", "High Ambiguity", "Clear Signal")).alias("bad_flag"),
        count_if(F.col("timestamp").isNull()).alias("no_ts"),
        count_if(F.size("top_drivers") == 0).alias("empty_drivers"),
    )
    checks = checks_frame(row, [("driver_fields", F.col("bad_driver")), ("flag_valid", F.col("bad_flag")),
                                ("timestamp_present", F.col("no_ts")), ("empty_drivers", F.col("empty_drivers"))])
    return checks.withColumn("passed", F.when(F.col("check") == "empty_drivers", F.lit(True)).otherwise(F.col("passed")))


def validate_veto_range(scored: DataFrame) -> DataFrame:
    """Veto confidence within [0.75, 0.95], model confidence within [0.5, 1]; count the old 0.85."""
    aggs, checks = _veto_range_spec()
    return checks_frame(scored.agg(*aggs), checks)
