"""Every query with SQL gives the SQL's rows."""

from pathlib import Path

import duckdb
import pytest

from pixelfold.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def rows(df, columns):
    return sorted(tuple(None if x != x else x for x in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", oracle.oracle_sql())
def test_same_rows(spark, tables, name):
    ours, theirs = queries.queries()[name](spark, FOLDER).toPandas(), tables.sql(oracle.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) and rows(ours, list(ours.columns)) == rows(theirs, list(ours.columns))


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - oracle.oracle_sql().keys()))
def test_others_run(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
