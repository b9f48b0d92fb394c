"""Every registered click-log query against its SQL in another engine, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from clickspark.plans import queries

TABLES = ("events", "part", "customer", "lineitem", "embeddings")


def _cell(x):
    return str(round(float(x), 5) + 0.0) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def engine(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_against_sql(spark, small, engine, name):
    df = queries.queries()[name](spark, small)
    told = engine.execute(queries.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted([_cell(x) for x in r] for r in told.fetchall())
    ours = sorted([_cell(r[n]) for n in names] for r in df.collect())
    assert ours == theirs


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if Path(small).name == "sf0.001":
        assert entry.entry(spark).count() > 0
