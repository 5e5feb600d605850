"""A corpus pipeline of five stages over the training-data operators.

Each stage maps ``documents`` to ``documents`` (the last adds its shard columns); its output is
written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vetolex.llm import stages
from vetolex.llm.common import stash, table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_duplicates),
    ("decontaminate", stages.drop_contaminated),
    ("mix", stages.mix),
    ("shard", stages.shard),
]

#: learned scores and similarity joins are not SQL: tests hold the rows against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
