import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")


def cell(x):
    if x is None or x != x:
        return None
    return round(float(x), 6) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver tables are not here")
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    found = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(list(want.columns), want.fetchall())


MAY_BE_EMPTY = {"q_levenshtein_fix"}  # at the smallest scale


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql(spark, sf, name):
    """Rows, none twice, and the same rows when the query runs again."""
    found = [tuple(map(str, r)) for r in entry.queries()[name](spark, sf).collect()]
    assert len(set(found)) == len(found) and (found or name in MAY_BE_EMPTY)
    assert sorted(found) == sorted(tuple(map(str, r)) for r in entry.queries()[name](spark, sf).collect())
