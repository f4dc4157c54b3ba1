import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import names as n

FULL = "Nguyễn Trọng Long"
SAME = ["nguyễn trọng long", "NGUYỄN TRỌNG LONG", "Nguyen Trong Long", "Nguyễn\xa0Trọng  Long", "Long, Nguyễn Trọng", "Long Nguyễn Trọng", "N. T. Long", "N.T.Long", "Ng. Trọng Long", "Nguyễn T. Long", "Nguyễn Long", "NguyễnTrọng Long", "Nguyễn Trọng Lnog", "Nguyễn Trrọng Long", "Nguyễn Trọng Long (SN 1974)", "Nguyễn Trọng Long - 1974", "bị cáo tên Nguyễn Trọng Long", " Nguyễn Trọng Long;", "Nguyễn Trọng Long tức “Mèo”"]
OTHER = ["Nguyễn Trọng Hùng", "Trần Văn Long", "Phạm Thị Hoa", "Lê Quang Vinh"]


@pytest.mark.parametrize("written", SAME)
def test_variants_are_alike(written):
    assert n.similarity(n.Name(FULL), n.Name(written)) >= n.ACCEPT


@pytest.mark.parametrize("written", OTHER)
def test_others_are_not(written):
    assert n.similarity(n.Name(FULL), n.Name(written)) < n.ACCEPT


def test_aliases():
    whole = n.Name("Châu Duy Ninh (tên gọi khác: Rô)")
    for written in ("Rô", "Ninh Rô", "Ninh “Rô”", "Châu Duy Ninh, tự Rô"):
        assert n.similarity(whole, n.Name(written)) >= n.ACCEPT
    assert n.similarity(whole, n.Name("Mập")) == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aăbcđêgh .,-“”()1N", max_size=25), st.text(alphabet="aăbcđêgh .,-“”()1N", max_size=25))
def test_similarity_is_symmetric_and_bounded(a, b):
    x, y = n.Name(a), n.Name(b)
    s = n.similarity(x, y)
    assert -0.02 <= s <= 1.01 and abs(s - n.similarity(y, x)) < 0.02


def test_bands_follow_the_collision_curve():
    b = n.bands(0.99, 0.45, 2)
    assert 1 - (1 - 0.45**2) ** b >= 0.99 > 1 - (1 - 0.45**2) ** (b - 1)


def mentions(spark, rows):
    return spark.createDataFrame([(i, "r1", *r) for i, r in enumerate(rows)], "id long, block string, name string, centre boolean, list string")


def pairs(spark, rows):
    return {(r["id_a"], r["id_b"]) for r in n.same_person(mentions(spark, rows)).collect()}


def test_stars(spark):
    rows = [(FULL, True, "a"), ("Trần Tấn Long", True, "a"), ("Lê Thị Thảo", True, "a"), ("Lê Thị Thao", True, "a"), ("N. T. Long", False, "b"), ("T. T. Long", False, "b"), ("Lê Thị Thảo", False, "b"), ("LÊ THỊ THAO", False, "c"), (None, False, "c"), ("  ", False, "c"), (FULL, False, "c")]
    assert pairs(spark, rows) == {(0, 4), (4, 10), (1, 5), (3, 7)}


def test_ambiguous_name_goes_to_the_centre_that_is_free(spark):
    rows = [("Trần Tấn Long", True, "a"), ("Trần Thanh Long", True, "a"), ("Trần Tấn Lonng", False, "b"), ("T. T. Long", False, "b")]
    assert pairs(spark, rows) == {(0, 2), (1, 3)}
    assert pairs(spark, rows[:2] + rows[3:]) == set()  # both centres are free: nobody knows


def test_without_centres_and_empty(spark):
    rows = [("Lê Tấn Thao", False, "a"), ("LÊ TẤN THAO", False, "a"), ("L. T. Thao", False, "a"), ("Phạm Hoa", False, "a")]
    assert pairs(spark, rows) == {(0, 1), (0, 2), (1, 2)}
    assert n.same_person(mentions(spark, rows).limit(0)).count() == 0


def test_all_names_of_a_key_meet(spark):
    rows = [(7, 1, False, 20), (7, 2, False, 10), (7, 3, False, 10), (7, 4, False, 9), (8, 4, False, 9), (8, 5, False, 9), (9, 6, False, 5)]
    keys = spark.createDataFrame(rows, "key long, vid long, centre boolean, length int")
    met = {(r["vid"], r["other"]) for r in n._meet(keys, leads=True).collect()}
    assert met == {(2, 1), (3, 1), (4, 1), (3, 2), (4, 2), (4, 3), (5, 4)}
    assert n._meet(keys, leads=False).count() == 0


def test_parts_of_hot_blocks_and_small_batches_change_nothing(spark, monkeypatch):
    first, last = ["Nguyễn Văn", "Trần Thị", "Lê Hữu", "Phạm Minh"], ["Hùng", "Hưng", "Lan", "Lân", "Tuấn", "Tuân", "Hạnh"]
    people = [f"{a} {b}" for a in first for b in last]
    rows = [(i, "hot", x, False, "a") for i, x in enumerate(people)] + [(100 + i, "hot", x.replace("n", "nn", 1), False, "b") for i, x in enumerate(people)]
    rows += [(300 + i, "r", x, i % 4 == 0, "c") for i, x in enumerate(people)] + [(400 + i, "r", x.upper(), False, "d") for i, x in enumerate(people)]
    df = spark.createDataFrame(rows, "id long, block string, name string, centre boolean, list string").repartition(3).cache()
    want = sorted(n.same_person(df).collect())
    assert len(want) > 40
    monkeypatch.setattr(n, "HOT", 5)
    monkeypatch.setattr(n, "_PAIRS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert sorted(n.same_person(df).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
