"""Streaming scoring query (§2.13): the stream's sink is checked against the same SQL scorer
as the batch queries (tests also compare stream and batch output directly)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import model as M
from ..operators.persist import scratch_path
from ..sources.tables import table_path
from ..streaming.score import run_stream_score

from .q_model import scored_cte
from .registry import query

KEY_SCALE = 1_000_000  # oracle only: (conv_id, turn) packed into one key for the SQL scorer


def _stream_sql() -> str:
    src = f"(SELECT conv_id * {KEY_SCALE} + turn AS id, 0 AS label, text FROM conversations)"
    return scored_cte(src) + (
        ", dd AS (SELECT id, string_agg(token, '|' ORDER BY rnk) AS drivers FROM dr WHERE rnk <= 3 GROUP BY id) "
        f"SELECT z.id // {KEY_SCALE} AS conv_id, z.id % {KEY_SCALE} AS turn, text AS raw_text, "
        "CASE WHEN prediction_int = 1 THEN 'Positive' ELSE 'Negative' END AS prediction, prediction_int, "
        "round(confidence_raw, 4) AS confidence, CASE WHEN confidence_raw < 0.7 THEN 'High Ambiguity' ELSE 'Clear Signal' END AS entropy_flag, "
        "veto_applied, coalesce(dd.drivers, '') AS drivers FROM z LEFT JOIN dd ON z.id = dd.id")


@query("stream_score", _stream_sql)
def q_stream_score(spark, sf):
    base = scratch_path(spark, "stream")
    out = run_stream_score(spark, table_path(sf, "conversations"), os.path.join(base, "sink"),
                           os.path.join(base, "checkpoint"), M.fixed_model(spark))
    return out.select("conv_id", "turn", "raw_text", "prediction", "prediction_int", "confidence", "entropy_flag",
                      "veto_applied", F.concat_ws("|", F.transform("top_drivers", lambda d: d["token"])).alias("drivers"))
