"""Every registered query equals its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import RAW, compare, family

SQL = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW:
        c.sql(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    if name not in SQL:
        assert len(df.columns) > 0
        return
    rel = con.sql(SQL[name])
    problems = compare(df.columns, [family(f.dataType.simpleString()) for f in df.schema.fields], rows,
                       rel.columns, [family(str(x)) for x in rel.types], rel.fetchall())
    assert not problems, problems


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
