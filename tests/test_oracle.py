"""Every registered query against its DuckDB oracle on the smallest tables."""
import pytest

from conftest import SMALL

import __spark_entry__ as E
from oracle_check import compare, duck_connection, duck_types, spark_types

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SMALL)


def test_every_query_has_an_oracle_or_tests_of_its_own():
    rows_only = set(QUERIES) - set(ORACLE) - set(E.LLM_QUERIES)
    assert rows_only == {"fit_network_users", "zero_shot_vectors"}
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    assert spark_types(df) == duck_types(duck, ORACLE[name])
    got = df.toPandas()
    want = duck.execute(ORACLE[name]).df()
    ok, msg = compare(got, want)
    assert ok, msg


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "step" in df.columns
