"""Pipeline stages: ``(spark, docs, sf_dir) -> docs`` with the operators' decisions carried out.

A stage keeps the columns of ``docs`` whatever their names: its own columns take names that ``docs`` has
not.  A row is named by doc_id and a hash of its text.  Every stage accepts nulls in any column,
empty and very long texts (read whole), repeated rows and empty tables, as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, entropy, hilbert, neardup, toxicity
from .common import ranked, release, row_key, shared_path, stash, table, text_bytes

SHINGLE = 5  # words, of the near-duplicate stage


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``docs`` has no column of it (in any case of letters)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows named in column ``row``; the names are distinct and few against the texts."""
    key, = fresh(docs, "__row")
    named = rows.select(F.col("row").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(named, key, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the same tables."""
    score, = fresh(docs, "__score")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    release()  # the sample that the model was trained on
    # the operator adds a column __text of its own
    names = [fresh(docs, "__kept")[0] if c.lower() == "__text" else c for c in docs.columns]
    scored = toxicity.score_documents(docs.toDF(*names), model, score)
    return scored.where(F.col(score) < toxicity.DECIDE).select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest doc_id, once if its row is repeated."""
    key, = fresh(docs, "__row")
    found = stash(neardup.near_duplicates(docs, SHINGLE).select("row", "n_shingles", "kept", "doc_id"), "components")
    left = _without(docs, found.where("not kept"))
    again = found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stash(again.select(F.col("row").alias(key)), "repeated")
    if again.isEmpty():
        return left
    named = left.withColumn(key, row_key())
    return (named.join(again, key, "left_anti").unionByName(named.join(again, key, "left_semi").dropDuplicates([key]))
            .select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: rows are repeated or left out.

    Of the copies that a group of equal rows takes, each row gets the whole part of its share and the first
    rows, in an order without meaning, one more, so that none are lost or added."""
    names = [f"c{i}" for i in range(len(docs.columns))]   # so that no column has a name used here
    at = {c.lower(): F.col(n) for c, n in zip(docs.columns, names)}
    taken = stash(entropy.mix_documents(docs).groupBy("doc_id", "key", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")), "copies")
    met = docs.toDF(*names).withColumn("text_key", F.xxhash64(F.coalesce(at["text"], F.lit(""))))
    met = met.join(taken, at["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("text_key") == F.col("key")) & at["source"].eqNullSafe(F.col("source")))
    out = met.where("n = 1").select(*names, F.col("copies").cast("int").alias("times"))
    if not taken.where("n > 1").isEmpty():
        # the random column lets range partitions cut a very large group; the ranking is written before it is read
        equal = ranked(met.where("n > 1").withColumn("cut", F.rand(7)), ["doc_id", "key", "source", "cut"], "place")
        starts = stash(equal.groupBy("doc_id", "key", "source").agg(F.min("place").alias("first")).select(
            F.col("doc_id").alias("i"), F.col("key").alias("k"), F.col("source").alias("s"), "first"), "starts")
        dealt = equal.join(starts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")))
        share = F.floor(F.col("copies") / F.col("n")) + (F.col("place") - F.col("first") < F.col("copies") % F.col("n")).cast("int")
        out = out.union(dealt.select(*names, share.cast("int").alias("times")))
    return out.where("times > 0").select(*names, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*names).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str, n_shards: int = 16) -> DataFrame:
    """The rows with ``shard``, ``slot`` and ``curve``, along the Hilbert curve over source, language and size.

    Whole rows are sorted along the curve, their only shuffle; where a row then lies gives its shard and slot, so
    each task writes its few shards in slot order.  The cells' ranges of every shard are written beside them, and
    the rows are read from there."""
    shard_, slot, curve = fresh(docs, "shard", "slot", "curve")
    names = [f"c{i}" for i in range(len(docs.columns))]   # so that no column has a name used here
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    text = text_bytes(at["text"])
    rows = docs.toDF(*names).select("*", *[F.col(at[c]).alias(c) for c in ("doc_id", "source", "lang")], F.length(text).cast("long").alias("size"),
                                    F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("number"))
    dealt = hilbert.hilbert_shards(rows, ["source", "lang", "size"], n_shards, ["text_crc32", "doc_id", "number"])
    path = shared_path(spark, "shards")
    hilbert.manifest(dealt, 3).write.parquet(f"{path}-manifest")
    kept = dealt.select(*names, "shard", "slot", "curve").toDF(*docs.columns, shard_, slot, curve)
    hilbert.write_shards(kept, path, shard_, slot, placed=True)
    return spark.read.schema(kept.schema).parquet(path).select(*kept.columns)
