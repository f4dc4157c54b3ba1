import pytest

from lexspark.llm import scanned as s

WORDS = "Nguyễn Văn Hiếu điều khiển xe máy đến bến xe thuộc xã Phước An huyện Trung Ninh để tìm gặp người làm chứng không nói gì với công an".split()
PROSE = " ".join(WORDS) + ". "


def body(*changes):
    words = (PROSE * 4).split(" ")
    for at, w in changes:
        words[at] = w
    text, line = [], ""
    for w in words:
        if len(line) + len(w) > 60:
            text.append(line.strip())
            line = ""
        line += w + " "
    return [*text, line.strip()]


def page(k, header, number):
    lines = body()
    cut = len(lines) // 2
    extra = ([header] if header else []) + ([number.format(k)] if number else [])
    return "\n".join(lines[:cut] + extra + lines[cut:])


@pytest.fixture(scope="module")
def kinds(spark):
    rows = [(i, "f", PROSE * 30) for i in range(40)]
    rows += [(100 + i, "f", page(i, f"TÒA ÁN NHÂN DÂN TỈNH SỐ {i % 3}", "- {} -")) for i in range(6)]
    rows += [(200, "f", page(7, None, "Trang {}")), (201, "f", page(7, "Bản án số 63/2020/HS-ST    7", None))]
    rows += [(300, "f", "\n".join(body((5, "rnáy")))), (301, "f", "\n".join(body((20, "khôn9")))), (302, "f", PROSE + "giá 371.700.00O đồng. " + PROSE)]
    hyphened = body()
    rows += [(400, "f", "\n".join([*hyphened, "người làm ch-", "ứng nói với công an."])), (401, "f", PROSE + "từ 2016-\n2021 đến nay. " + PROSE), (402, "f", PROSE + "biển số 20E9-\n311.15 của. " + PROSE)]
    rows += [(500, "f", None), (501, "f", ""), (502, "f", "\n\n\n"), (503, "f", "x" * 100_000), (504, "f", PROSE + "Nguyễn Văn Hiêếu và trogn."), (1, "f", PROSE * 30)]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "id long, field string, t string, level int, b string").repartition(3)
    found: dict = {}
    for r in s.find_noise(df).collect():
        found.setdefault(r["id"], []).append(r["kind"])
    return found


def test_clean_and_odd_texts_have_no_noise(kinds):
    assert not [i for i in kinds if i < 100 or i >= 500]


def test_headers_and_page_numbers(kinds):
    assert all(sorted(kinds[100 + i]) == ["header", "page_no"] for i in range(6))
    assert kinds[200] == ["page_no"] and sorted(kinds[201]) == ["header", "page_no"]


def test_misread_words_and_numbers(kinds):
    assert kinds[300] == kinds[301] == kinds[302] == ["char"]


def test_hyphens(kinds):
    assert kinds[400] == ["hyphen"] and 401 not in kinds and 402 not in kinds


def test_repair(spark):
    text = "Người làm chứn9 khai thấy Hiếu trèo qua cửa vào ch-\nTrang 7\nứng cứ.\n\nĐoạn hai có giá 371.700.00O đồng."
    rows = [(i, "f", "Người làm chứng khai thấy Hiếu trèo qua cửa vào chứng cứ. " * 20) for i in range(5)] + [(9, "f", text)]
    got = {r["id"]: r["repaired"] for r in s.repair(spark.createDataFrame(rows, "id long, field string, t string")).collect()}
    assert got[9] == "Người làm chứng khai thấy Hiếu trèo qua cửa vào chứng cứ.\nĐoạn hai có giá 371.700.000 đồng."
    assert got[0] == rows[0][2]
    assert s.find_noise(spark.createDataFrame([], "id long, field string, t string")).count() == 0


def test_copies_of_a_text_do_not_make_its_misreadings_words(spark):
    noisy = "\n".join(body((6, "rnáy")))
    rows = [(i, "f", noisy) for i in range(90)] + [(100 + i, "f", f"Hồ sơ {i} ghi chiếc máy đã mất") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, field string, t string").repartition(3)
    assert {r["id"] for r in s.find_noise(df).where("kind = 'char'").collect()} == set(range(90))


def test_long_headers_and_large_page_numbers(spark):
    header = "TÒA ÁN NHÂN DÂN TỈNH TRUNG NINH VÀ CÁC TÒA ÁN NHÂN DÂN KHU VỰC THUỘC TỈNH CÙNG VIỆN KIỂM SÁT CÙNG CẤP"
    assert len(header) > 97
    lines = body()
    third = len(lines) // 3
    book = "\n".join([*lines[:third], header, "- 1203 -", *lines[third : 2 * third], header, "- 1204 -", *lines[2 * third :]])
    bare = "\n".join([*lines[:third], "1203", *lines[third : 2 * third], "1204", *lines[2 * third :]])
    year = "\n".join([*lines[:third], "1999", *lines[third:]])
    df = spark.createDataFrame([(1, "f", book), (2, "f", bare), (3, "f", year)], "id long, field string, t string")
    got = {}
    for r in s.find_noise(df).collect():
        got.setdefault(r["id"], set()).add(r["kind"])
    assert got == {1: {"header", "page_no"}, 2: {"page_no"}}


def test_confusions_outside_the_list_are_learned(spark):
    clean = "thông hình khách chánh nhanh phạm những hoàng thành chính khai hành thẩm".split()
    rows = [(i, "f", f"{w} " * 30 + f"số {k} {i}") for k in range(4) for i, w in enumerate(clean, 100 * k)]
    rows += [(1000 + i, "f", "ghi " + w.replace("h", "li", 1) + f" rồi {i}") for i, w in enumerate(clean)]
    rows += [(2000, "f", "liên liền liệu " * 40), (2001, "f", "nnhanh thônng trogn kêt"), (2002, "f", "li liliông")]
    df = spark.createDataFrame(rows, "id long, field string, t string").repartition(3)
    got = {r["id"] for r in s.find_noise(df).where("kind = 'char'").collect()}
    assert got == {1000 + i for i in range(len(clean))}


def test_any_number_of_confusions_in_a_word(spark):
    words = [("nghiêng", 200), ("n9ћ!ên9", 2), ("ñ9ћ!êñ9", 1), ("nguyễn", 300), ("ñguyễñ", 3), ("|!10965@†ñћƣðō§€(", 1)]
    df = spark.createDataFrame(words, "key string, n long")
    got = {r["variant"]: r["target"] for r in s.corrections(df).collect()}
    assert got == {"n9ћ!ên9": "nghiêng", "ñ9ћ!êñ9": "nghiêng", "ñguyễñ": "nguyễn"}


def test_numbers_by_shape(spark):
    rows = [(i, "f", f"biển ZQ1234{i % 10} ngày 12/3/2015 và 40l xăng, phòng {i % 7}l") for i in range(60)] + [(100, "f", "biển ZQl2O45"), (101, "f", "ngày l2/3/2015"), (102, "f", "mua 41l xăng")]
    df = spark.createDataFrame(rows, "id long, field string, t string").repartition(3)
    assert {r["id"] for r in s.find_noise(df).where("kind = 'char'").collect()} == {100, 101}
