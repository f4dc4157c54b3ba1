import pytest

from lexspark.llm import queries
from tests import edge

#: Results that repeated rows of one id may change: other sizes, groups or copies of vectors.
BY_ROW = {"p2_found", "p2_neighbours", "p8_packed", "p8_fill", "p9_mixed", "p9_shares"}


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    return {kind: edge.write(spark, sf, tmp_path_factory.mktemp(kind), kind) for kind in ("empty", "nulls", "clash")}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_odd_tables(spark, sf, odd, name):
    query = queries.QUERIES[name]
    assert query(spark, odd["empty"]).count() == 0
    found = query(spark, odd["nulls"]).collect()
    if name in ("p9_shares",):
        assert all(r["tokens"] is None for r in found)
    elif name in ("p7_found", "p7_counts"):
        assert found == []
    else:
        assert found == []
    got = sorted(map(tuple, query(spark, odd["clash"]).distinct().collect()), key=str)
    if name not in BY_ROW:
        assert got == sorted(map(tuple, query(spark, sf).collect()), key=str)
