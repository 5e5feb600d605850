"""What queries leave behind in the folders of the executors."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from vetolex import session as S


def shuffled(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    return tracker.shuffleStatuses().size()


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    df = spark.range(1000).repartition(4, F.col("id") % 7).groupBy((F.col("id") % 5).alias("k")).agg(F.count("*").alias("n"))
    before, set_before = shuffled(spark), spark.conf.get(S._FREE, None)
    with ThreadPoolExecutor(3) as pool:  # side by side, as fits store their results
        stored = list(pool.map(lambda _: S.cut(df), range(6)))
    assert shuffled(spark) <= before and spark.conf.get(S._FREE, None) == set_before
    assert all(x.agg(F.sum("n")).first()[0] == 1000 for x in stored)
    assert df.count() == df.count() == 5  # a frame that was stored can be run again


def test_weights_travel_as_rows_without_what_is_not_wanted(spark):
    """TF-IDF rows reach their text's partition as single rows of the wanted columns, and the values stay the same."""
    from vetolex.operators import text as T
    docs = spark.createDataFrame([(1, "red red blue sky"), (2, "blue sky red"), (3, "blue"), (1, "sky red"), (None, "red sky")], "id long, text string")
    tf, vocab, _ = T.fit_tfidf(docs, min_df=1, max_df=1.0)
    whole, bare = T.tfidf_transform(tf, vocab), T.tfidf_transform(tf, vocab, columns=())
    assert bare.columns == ["id", "value"] and whole.columns == ["id", "term", "tf", "idf", "value"]
    assert sorted(round(r.value, 9) for r in whole.collect()) == sorted(round(r.value, 9) for r in bare.collect())
    plan = bare._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "REPARTITION_BY_COL" in plan and plan.index("partial_collect_list") < plan.index("REPARTITION_BY_COL")
