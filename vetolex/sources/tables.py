"""Scans of the input tables and the deterministic ``posts`` views built on them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# FIXED VALUES — decoration appended to document text by ``doc_id % 24`` so the
# emoji / emoticon / lexicon rules have signal to work on (the generated text
# has none).  Index k holds the suffix for ``doc_id % 24 == k``.
POST_SUFFIXES = (
    "",
    " 😊",
    " 😭",
    " 😊😊😊",
    " 😭😧😔",
    " 😭😊",
    " 😍🚀",
    " 😒😐",
    " 😎",
    " ❤️",
    " :) :)",
    " >:(",
    " see http://x.y",
    " :-) :(",
    " XD <3",
    " 💀",
    " I love having bugs 😭",
    " so beautiful and amazing 😭",
    " great wonderful 😭😊",
    " this is terrible 😊",
    " unhappy whatever",
    " good good good bad",
    " !!!!",
    " 📈 excellent perfect",
)

POSTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("label", T.IntegerType(), False),
    T.StructField("text", T.StringType(), False),
])


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; projections and filters applied later are pushed into it."""
    return spark.read.parquet(table_path(sf_dir, name))


#: Bytes up to which a table is dealt over all cores: its few files or row groups would keep most of them idle.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table's rows dealt over the cores; a larger one as it is, since its splits fill them and a shuffle costs more.

    The size is the one that Spark estimates from the files.  Filters and unread columns still reach the scan."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def files_state(df: DataFrame) -> tuple:
    """Path, size and time of the files that a scan reads, so that a table replaced in place counts as another."""
    m = F.col("_metadata")
    rows = df.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct().collect()
    return tuple(sorted((r["p"], r["s"], str(r["t"])) for r in rows))


def post_suffix(doc_id) -> F.Column:
    arr = F.array(*[F.lit(s) for s in POST_SUFFIXES])
    k = (F.col(doc_id) % F.lit(len(POST_SUFFIXES))).cast("int") + 1
    return F.element_at(arr, k)


def posts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``posts_all(id, text)``: every document, whole text plus its suffix."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("id"),
                       F.concat(F.col("text"), post_suffix("doc_id")).alias("text"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``posts(id, label, text)``: labelled documents (``label = quality``), whole text plus suffix.

    ``labels`` is a small fraction of ``documents``; the join is a plain equi-join
    on the document key and Catalyst/AQE pick broadcast or shuffle from the sizes.
    """
    labels = (read_table(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
              .select("doc_id", F.col("quality").cast("int").alias("label")))
    # the suffix is never null, so the null test is on the stored text (pushed into the scan)
    docs = read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    docs = spread(docs)
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("id"), "label",
                    F.concat(F.col("text"), post_suffix("doc_id")).alias("text")))


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in the shape of a raw export: an index column to drop, aliased and string-typed columns, and
    nulls where a document has no label."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (docs.join(labels, "doc_id", "left")
            .select(F.col("doc_id").cast("string").alias("Unnamed: 0"), F.col("doc_id").alias("index"),
                    F.col("quality").cast("string").alias("sentiment"), F.concat(F.col("text"), post_suffix("doc_id")).alias("post")))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headered CSV with an explicit schema (no inference pass).

    Quoted line feeds make a CSV file unsplittable, so a file is one task: :func:`sink_table` bounds the
    records of each file it writes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def route_csv(spark: SparkSession, path: str, schema: T.StructType, folder: str, header: bool = True,
              multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(good, rejected)`` of CSV files that others wrote, in one parse, stored under ``folder``.

    A record with too few or too many fields or a value that is not of its column's type is ``malformed``; one
    without a value for a column that ``schema`` declares non-null is ``missing`` that column.  Both go to the reject
    table (file, record, reason), the record as it stands in the file if it is malformed, else written out again; all
    others are rows of ``schema``.  A header that disagrees with ``schema`` raises.  No files or only good or bad
    records give empty tables.  With ``multi_line`` a quoted field may hold line feeds, and a file is one task;
    without it files are split."""
    file, raw, reason, rejected = names = ["__file", "__record", "__reason", "__rejected"]
    if {n.lower() for n in names} & {f.name.lower() for f in schema}:
        raise ValueError(f"the schema uses one of the names {names}")
    read = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + [T.StructField(raw, T.StringType())])
    # every column is parsed whatever a later query selects: a value is only checked if it is parsed
    rows = (spark.read.schema(read).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", raw).option("columnPruning", False)
            .option("enforceSchema", False).option("header", header).option("multiLine", multi_line).option("escape", '"').csv(path))
    columns = [f.name for f in schema]
    absent = F.concat_ws(",", *[F.when(F.col(f"`{f.name}`").isNull(), F.lit(f.name)) for f in schema if not f.nullable])
    why = F.when(F.col(raw).isNotNull(), F.lit("malformed")).when(absent != "", F.concat(F.lit("missing "), absent))
    told = rows.select(F.col("_metadata.file_path").alias(file), *columns, raw, why.alias(reason))
    record = F.when(F.col(reason).isNotNull(), F.coalesce(raw, F.to_csv(F.struct(*columns))))
    told = told.withColumn(raw, record).withColumn(rejected, F.col(reason).isNotNull())
    told.write.mode("errorifexists").partitionBy(rejected).parquet(folder)
    stored = spark.read.schema(told.schema).parquet(folder)
    bad = stored.where(F.col(rejected)).select(F.col(file).alias("file"), F.col(raw).alias("record"), F.col(reason).alias("reason"))
    return stored.where(~F.col(rejected)).select(*columns), bad
