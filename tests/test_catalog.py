import glob
import os

import pytest

from tidewell.plans import catalog, problems, streams

ALL = {**catalog.QUERIES, **problems.QUERIES, **streams.QUERIES}
SQL = {**catalog.SQL, **problems.SQL, **streams.SQL}


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) else v for v in row]) for row in rows)


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    got, want = ALL[name](spark, data), duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    places = [want.columns.index(c) for c in columns]
    assert plain([[r[c] for c in columns] for r in got.collect()]) == plain([[r[i] for i in places] for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert ALL[name](spark, data).count() > 0
