"""Every SQL-checked Spark query against its DuckDB oracle (the driver's correctness gate), on sf0.001."""

import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, small_dir, name):
    problems, n = compare(E.queries()[name](spark, small_dir), con, E.oracle_sql()[name])
    assert not problems, problems


def test_every_query_has_entry():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 150


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and {"prediction", "confidence", "veto_applied", "drivers"} <= set(df.columns)


def test_every_oracle_sql_plans_in_duckdb(con):
    """Every oracle statement parses and binds against the tables (EXPLAIN only, no execution)."""
    bad = []
    for name, sql in E.oracle_sql().items():
        try:
            con.execute("EXPLAIN " + sql)
        except Exception as e:  # noqa: BLE001
            bad.append((name, str(e)[:200]))
    assert not bad, bad
