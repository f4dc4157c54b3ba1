import pytest
from pyspark.sql import functions as F

from lexspark.operators import law

# Expected outcomes of the thirty lookups (query, found, level, reason, normalized).
CASES = [
    ("106", True, "dieu", None, "106"), ("106-1", True, "khoan", None, "106-1"), ("106-1-a", True, "diem", None, "106-1-a"), ("106-1-d", True, "diem", None, "106-1-d"),
    ("106-1-đ", False, None, "diem_not_found", "106-1-đ"), ("Dieu 106, khoan 1, diem a", True, "diem", None, "106-1-a"), ("Điều 106, khoản 1, điểm a", True, "diem", None, "106-1-a"),
    ("ĐIỀU 106, KHOẢN 1, ĐIỂM a", True, "diem", None, "106-1-a"), ("  Dieu   106   -   Khoan 1   -   Diem   a   ", True, "diem", None, "106-1-a"), ("dieu 106 khoan 1 diem b", True, "diem", None, "106-1-b"),
    ("106/1/a", True, "diem", None, "106-1-a"), ("106.1.a", True, "diem", None, "106-1-a"), ("106,1,a", True, "diem", None, "106-1-a"), ("106_1_a", True, "diem", None, "106-1-a"),
    ("***106@@@1###a$$$", True, "diem", None, "106-1-a"), ("0106-01-a", False, None, "dieu_not_found", "0106-01-a"), (None, False, None, "signature is None", None), ("", False, None, "signature is empty", None),
    ("dieu", False, None, "invalid signature: 'dieu'", None), ("abc-1-a", False, None, "invalid dieu in signature: 'abc-1-a'", None), ("106-1-a-extra", False, None, "too many parts in signature: '106-1-a-extra'", None),
    ("999", False, None, "dieu_not_found", "999"), ("106-99", False, None, "khoan_not_found", "106-99"), ("106-1-z", False, None, "diem_not_found", "106-1-z"), ("khoan 1 dieu 106", False, None, "khoan_not_found", "1-106"),
    ("3-1-d", True, "diem", None, "3-1-d"), ("3-1-đ", True, "diem", None, "3-1-đ"), ("89", True, "dieu", None, "89"), ("89-1", False, None, "khoan_not_found", "89-1"),
]
LINES = """lời mở đầu
Chương I. Tổng quát
Điều 1. Phạm vi
1. Khoản một
tiếp theo
a) điểm a
đ) điểm đê
1.5 không phải khoản
2. Khoản hai
Điều 3. Nguyên tắc
1. Đối với
d) điểm d
đ) điểm đ
Chương II
a) điểm mồ côi
Điều 89. Xóa án tích
dòng hai
Điều 106. Tha tù
1. Điều kiện
a) một
b) hai
c) ba
d) bốn
2. Thực hiện"""


@pytest.fixture(scope="module")
def nodes(spark):
    lines = spark.createDataFrame([(1, i, s) for i, s in enumerate(LINES.split("\n"))], "doc_id long, line_no int, line string")
    return law.hierarchy(lines)


def test_hierarchy(nodes):
    rows = [tuple(r)[1:] for r in nodes.orderBy("start_line").collect()]
    assert rows[0] == ("I", None, None, None, "chuong", 1, "Tổng quát")
    assert ("I", "1", "1", None, "khoan", 3, "Khoản một\ntiếp theo") in rows
    assert ("I", "1", "1", "đ", "diem", 6, "điểm đê\n1.5 không phải khoản") in rows
    assert ("II", None, None, None, "chuong", 13, "a) điểm mồ côi") in rows
    assert ("II", "89", None, None, "dieu", 15, "Xóa án tích\ndòng hai") in rows
    assert not any("mở đầu" in (r[-1] or "") for r in rows)


def test_article_before_any_chapter(spark):
    lines = spark.createDataFrame([(1, 0, "x"), (1, 1, "Điều 5. Tên"), (1, 2, "1. k")], "doc_id long, line_no int, line string")
    got = {(r["chuong"], r["dieu"], r["khoan"]) for r in law.hierarchy(lines).collect()}
    assert got == {("Unknown", "5", None), ("Unknown", "5", "1")}
    assert law.hierarchy(lines.limit(0)).count() == 0


def test_golden_lookups(spark, nodes):
    texts = law.level_texts(nodes.where("level <> 'chuong'").withColumnRenamed("start_line", "pos").drop("doc_id", "chuong"))
    queries = spark.createDataFrame([(i, q) for i, (q, *_) in enumerate(CASES)], "pos int, query string")
    got = {r["pos"]: r for r in law.lookup(queries, texts).collect()}
    assert len(got) == len(CASES)
    for i, (_, found, level, reason, normalized) in enumerate(CASES):
        r = got[i]
        assert (r["found"], r["level"], r["reason"], r["normalized"]) == (found, level, reason, normalized), CASES[i]
    assert got[2]["text"] == "[dieu 106] Tha tù\n[khoan 1] Điều kiện\n[diem a] một"
    assert got[1]["text"].endswith("[diem d] bốn") and "khoan 2" not in got[1]["text"]


def test_mentions_chain(spark):
    rows = spark.createDataFrame([(1, "theo điểm a, b khoản 2 Điều 51 và khoản 3 Điều 9."), (2, None), (3, "")], "id long, t string")
    got = [(r["id"], r["chain"], r["kind"], r["index"]) for r in law.mentions(rows).orderBy("id", "chain", "ord").collect()]
    assert got == [(1, 0, "điểm", "a"), (1, 0, "điểm", "b"), (1, 0, "khoản", "2"), (1, 0, "điều", "51"), (1, 1, "khoản", "3"), (1, 1, "điều", "9")]


def test_citations(spark):
    got = spark.range(1).select(law.citations(F.lit("Điều 51, điều 174a ĐIỀU 3")).alias("c")).first()["c"]
    assert got == ["51", "174a", "3"]


def test_clean_lines(spark):
    rows = [(1, 0, "Điều 1. Tên[3]\t1. khoản một; a) điểm a; b)2 điểm b"), (1, 1, "2 Khoản này được sửa đổi theo Luật"), (1, 2, "12"), (1, 3, None), (1, 4, "người phạm tội 2. khoản hai theo điều 3. x")]
    paragraphs = spark.createDataFrame(rows, "doc_id long, para_no int, t string")
    got = [r["line"] for r in law.clean_lines(paragraphs).orderBy("line_no").collect()]
    assert got == ["Điều 1. Tên", "1. khoản một;", "a) điểm a;", "b)2 điểm b", "người phạm tội", "2. khoản hai theo điều 3. x"]
    levels = [(r["level"], r["own_text"]) for r in law.hierarchy(law.clean_lines(paragraphs)).orderBy("start_line").collect()]
    assert levels == [("dieu", "Tên"), ("khoan", "khoản một;"), ("diem", "điểm a;"), ("diem", "điểm b\nngười phạm tội"), ("khoan", "khoản hai theo điều 3. x")]
