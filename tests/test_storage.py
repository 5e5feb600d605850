"""Records that do not fit are routed aside, none lost; bucketed rows are not shuffled again."""

import pytest
from pyspark.sql import types as T

from vetolex.operators import persist as PS
from vetolex.operators import text as TX
from vetolex.sources.tables import route_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("label", T.IntegerType(), False), T.StructField("text", T.StringType())])


def _lines(tmp_path, content, name="in.csv"):
    (tmp_path / name).write_text(content, encoding="utf-8")
    return str(tmp_path / name)


def test_each_record_is_good_or_rejected(spark, tmp_path):
    path = _lines(tmp_path, 'id,label,text\n1,0,"plain"\n2,abc,"x"\n3,1\n4,1,"y",9\n5,,"z"\n6,1,"two\nlines, ""quoted"" 😊"\n7,0,\n,,a\n99999999999999999999,1,b\n8,1,"c"\n')
    good, bad = route_csv(spark, path, SCHEMA, str(tmp_path / "out"))
    assert good.columns == ["id", "label", "text"]
    assert sorted((r.id, r.label, r.text) for r in good.collect() if r.text is not None) == [(1, 0, "plain"), (6, 1, 'two\nlines, "quoted" 😊'), (8, 1, "c")]
    assert good.where("text is null").count() == 1 and good.count() == 4
    told = {(r.reason, r.record) for r in bad.collect()}
    assert {r for x, r in told if x == "malformed"} == {'2,abc,"x"', "3,1", '4,1,"y",9', "99999999999999999999,1,b"}
    assert {x for x, _ in told if x != "malformed"} == {"missing label", "missing id,label"}
    assert len(told) == 6 and all(r.file.endswith("in.csv") for r in bad.collect())


def test_counts_do_not_depend_on_the_columns_read(spark, tmp_path):
    path = _lines(tmp_path, "id,label,text\n1,0,a\n2,x,b\n")
    good, bad = route_csv(spark, path, SCHEMA, str(tmp_path / "out"), multi_line=False)
    assert good.select("id").collect() == [(1,)] and good.count() == 1 and bad.count() == 1


@pytest.mark.parametrize("content,counts", [("id,label,text\n", (0, 0)), ("id,label,text\n1,1,a\n", (1, 0)), ("id,label,text\n1,b,a\n", (0, 1))])
def test_only_good_only_bad_or_no_records(spark, tmp_path, content, counts):
    good, bad = route_csv(spark, _lines(tmp_path, content), SCHEMA, str(tmp_path / "out"))
    assert (good.count(), bad.count()) == counts


def test_another_header_raises(spark, tmp_path):
    with pytest.raises(Exception, match="CSV header does not conform|header"):
        route_csv(spark, _lines(tmp_path, "id,text,label\n1,a,1\n"), SCHEMA, str(tmp_path / "out"))


def test_names_used_inside_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="__record"):
        route_csv(spark, "none", T.StructType([T.StructField("__RECORD", T.StringType())]), str(tmp_path / "out"))


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_rows_are_counted_and_joined_where_they_lie(spark, no_broadcast):
    rows = [(i, f"a b a word{i % 3}" if i % 7 else None) for i in range(50)] + [(None, "no id"), (3, "again a")]
    df = spark.createDataFrame(rows, "id long, text string")
    stored = PS.sink_bucketed(df, 8)
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
    counted = TX.term_frequency(stored, placed=True)
    assert "Exchange" not in _plan(counted)
    assert "Exchange" in _plan(TX.term_frequency(stored))
    assert sorted(map(str, counted.collect())) == sorted(map(str, TX.term_frequency(df).collect()))
    other = PS.sink_bucketed(df.select("id").where("id is not null").distinct(), 8)
    joined = stored.join(other, "id")
    assert "Exchange" not in _plan(joined) and joined.count() == 51
