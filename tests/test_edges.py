import pytest

from lexspark.plans import packed_and_nested
from tests import edge


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    return {kind: edge.write(spark, sf, tmp_path_factory.mktemp(kind), kind) for kind in ("empty", "nulls", "clash")}


@pytest.mark.parametrize("name", packed_and_nested.QUERIES)
def test_odd_tables(spark, sf, odd, name):
    query = packed_and_nested.QUERIES[name]
    assert query(spark, odd["empty"]).count() == 0
    assert query(spark, odd["nulls"]).count() == 0
    want = sorted(map(tuple, query(spark, sf).collect()), key=str)
    got = sorted(map(tuple, query(spark, odd["clash"]).distinct().collect()), key=str)
    assert got == want  # rows that occur twice and columns with clashing names change nothing
