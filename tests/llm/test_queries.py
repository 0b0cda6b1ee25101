import pytest

from tidewell.llm import queries

from ..test_catalog import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, data)
    rows = got.collect()
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        places = [want.columns.index(c) for c in columns]
        assert plain([[r[c] for c in columns] for r in rows]) == plain([[r[i] for i in places] for r in want.fetchall()])
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
