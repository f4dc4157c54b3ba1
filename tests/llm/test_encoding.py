import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.llm import encoding as e

CLEAN = [
    "Công an xã đã cho Nguyễn Đức Hiếu đối chất với Lê Xuân Cương; hai bên giữ nguyên lời khai.",
    "Kết luận định giá số 1173 xác định máy tính xách tay có tổng trị giá 20.500.000 đồng, như đã bàn bạc từ trước.",
    "TÒA ÁN NHÂN DÂN TỈNH HẢI LỘC quyết định xử phạt bị cáo 05 (năm) năm tù về tội trộm cắp.",
    "Trước đó người làm chứng khai thấy bị cáo trèo qua cửa sổ vào bên trong vào khoảng bảy giờ tối.",
    "The panel fully considered the statement and the defendant was heard at the court.",
    "Le tribunal a relevé que le prévenu n’avait pas restitué la somme à la société plaignante.",
]
TEXT = CLEAN[0] + " " + CLEAN[1]


def garble(text, wrong, right="utf-8"):
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(right))


GARBLED = {
    "utf8 as cp1252": garble(TEXT, "cp1252"),
    "utf8 as cp1250": garble(TEXT, "cp1250"),
    "utf8 as cp1251": garble(TEXT, "cp1251"),
    "utf8 as cp1258": garble(TEXT, "cp1258"),
    "utf8 as mac_roman": garble(TEXT, "mac_roman"),
    "utf8 as cp1252 twice": garble(garble(TEXT, "cp1252"), "cp1252"),
    "tcvn3 as latin1": "".join(e._TCVN3.get(c, c) for c in TEXT),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t, "x") for i, t in enumerate(CLEAN * 30)]
    rows += [(1000 + k, g, "x") for k, g in enumerate(GARBLED.values())]
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, TEXT.encode("utf-8").decode("ascii", "replace"), "x"), (2003, unicodedata.normalize("NFD", TEXT), "x"), (2004, TEXT.upper(), "x")]
    rows += [(2005, "".join(c for c in unicodedata.normalize("NFD", TEXT) if not unicodedata.combining(c)), "x"), (2006, "Tờ khai ghi tên Ångström và Ćwikła, ½, ® và § 5 với giá 3 € — xong.", "x")]
    rows += [(2007, TEXT + " " + garble("Nguyễn Thị Hường", "cp1252") + " " + CLEAN[3], "x"), (2008, "đ" * 300_000, "x")]
    rows += [(2009, TEXT + " nhà/" + garble("Hường", "cp1252") + "/Đức và " + CLEAN[3], "x")]
    df = spark.createDataFrame(rows, "id long, t string, restored string").repartition(3)
    return {r["id"]: r for r in e.find_garbled(df, "id", "t").collect()}


def test_clean_texts_are_left_alone(found):
    assert not [i for i in found if i < 1000 or i in (2000, 2001, 2003, 2004, 2005, 2006, 2008)]


@pytest.mark.parametrize("k", range(len(GARBLED)))
def test_garbled_texts_are_restored(found, k):
    assert found[1000 + k]["restored"] == TEXT  # two pairs may fit the same characters


def test_lost_and_partly_garbled(found):
    assert found[2002]["states"] == ["lost"]
    assert "Nguyễn Thị Hường" in found[2007]["restored"] and found[2007]["n_tokens"] == 3


def test_clean_word_joined_to_a_garbled_one(found):
    assert found[2009]["restored"] == TEXT + " nhà/Hường/Đức và " + CLEAN[3] and found[2009]["n_tokens"] == 1


def test_transitions_follow_the_counts():
    counts = e.np.zeros((e._N, e._N))
    counts[0, 0], counts[0, 1], counts[1, 1], counts[1, 0] = 1e6, 5e3, 1e5, 5e3
    change = e.trained(counts)
    assert e.prior()[0, 1] < change[0, 1] < -4 and change[0, 9] >= e.prior()[0, 9] - 3 and not change.diagonal().any()


def test_transitions_come_from_all_texts(spark):
    """Each of 6,000 texts counts, and only texts with a doubtful token are labelled twice."""
    rows = [(i, GARBLED["utf8 as cp1251"] if i % 50 == 0 else f"{CLEAN[i % 4]} {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    bigrams = e.count_bigrams(df, "t")
    change, texts = e.train(df, "id", "t", bigrams)
    counts, model = e.np.zeros((e._N, e._N)), e.Model(bigrams)
    for _, t in rows:
        if model.label(t):
            for pair, n in model.changes.items():
                counts[pair] += n
        else:
            counts[0, 0] += t.count(" ") + 1
    assert (change == e.trained(counts)).all() and (counts.sum(1) > 0).sum() > 1
    assert {r["id"] for r in texts.collect()} == set(range(0, 6000, 50))


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert e.find_garbled(df, "id", "t").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet=e.VIET + "abcnght ", min_size=1, max_size=20))
def test_inverse_undoes_the_wrong_decoding(text):
    token = text.replace(" ", "")
    for codec in ("cp1252", "cp1251", "mac_roman"):
        if any(c > "\x7f" for c in token):
            wrong, at, out = garble(token, codec), 0, ""
            while at < len(wrong):
                n, x = (e._utf8_as(codec)(wrong, at) or [(1, wrong[at])])[0]
                at, out = at + n, out + x
            assert out == token


def test_what_the_transitions_leave_alone_is_worked_out_once(spark, monkeypatch):
    """A token's hope is worked out once a worker, for both labellings, and counting traces no more than one token."""
    rows = [(i, t) for i, t in enumerate([*CLEAN, *GARBLED.values(), TEXT + " nhà/" + garble("Hường", "cp1252") + "/Đức"] * 4)]
    bigrams = e.count_bigrams(spark.createDataFrame(rows, "id long, t string"), "t")
    asked, hope = e.Counter(), e.Model.hope
    monkeypatch.setattr(e.Model, "hope", lambda self, token: asked.update([token]) or hope(self, token))
    first = e.shared_model(bigrams, e.prior())
    counts = e.np.zeros((e._N, e._N))
    for _, t in rows:
        whole = e.Model(bigrams)
        with monkeypatch.context() as own:
            own.setattr(e.Model, "hope", hope)
            spans = whole.label(t)
        assert bool(first.label(t, tracing=False)) == bool(spans) and (not spans or first.changes == whole.changes)
        for pair, n in whole.changes.items() if spans else ():
            counts[pair] += n
    second, alone = e.shared_model(bigrams, e.trained(counts)), e.Model(bigrams, e.trained(counts))
    labels = [second.label(t) for _, t in rows]
    assert max(asked.values()) == 1
    monkeypatch.setattr(e.Model, "hope", hope)
    assert labels == [alone.label(t) for _, t in rows] and any(labels)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=e.VIET + "".join(e._TCVN3.values()) + "Ã¡ºâ€™»Рђ鄧�abo", min_size=1, max_size=8))
def test_pairs_are_asked_wherever_they_can_begin(token):
    asked = [s for s, (_, chunks) in enumerate(e.PAIRS, 1) if any(chunks(token, k) for k in range(len(token)) if token[k] > "\x7f" or (s in e._TWO and token[k + 1 : k + 2] > "\x7f"))]
    assert [s for s in e.Model(e.np.ones((e._K, e._K))).options(token) if s < e._N - 1] == asked
