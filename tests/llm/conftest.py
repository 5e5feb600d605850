import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators might use inside
    T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("rank", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source[, lang]]) tuples, with extra columns of clashing names."""
    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None, "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def write_sf(spark, make_docs, tmp_path_factory):
    """A folder of tables, so that registered queries run on small fixtures."""
    def write(docs, **tables):
        d = str(tmp_path_factory.mktemp("sf"))
        make_docs(docs).write.parquet(f"{d}/documents.parquet")
        for name, df in tables.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return d
    return write
