import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.operators import packed
from lexspark.operators.shred import Repeated, assemble, shred_json

CC = Repeated("can_cu", (("Can_Cu_Dieu_Luat",),), ("Dieu",))
BC = Repeated("bi_cao", (("THONG_TIN_CHUNG", "Thong_Tin_Bi_Cao"), ("Thong_Tin_Bi_Cao",)), ("Ho_Ten",))
PQ = Repeated("phan_quyet", (("PHAN_QUYET",),), ("Bi_Cao",), (CC,))


def shredded(spark, payloads):
    rows = spark.createDataFrame(list(enumerate(payloads)), "raw long, payload string")
    return shred_json(rows, "raw", "payload", (BC, PQ)).cache()


def plain(spark, payloads, leaf):
    return sorted(tuple(r) for r in assemble(shredded(spark, payloads), leaf).collect())


def test_positions_and_parents(spark):
    doc = {"PHAN_QUYET": [{"Bi_Cao": "A", "Can_Cu_Dieu_Luat": [{"Dieu": 5}, None, {"Khoan": 1}]}, None, {"Bi_Cao": "B", "Can_Cu_Dieu_Luat": {"Dieu": "7"}}, {"Bi_Cao": None, "Can_Cu_Dieu_Luat": []}]}
    payload = [json.dumps(doc)]
    assert plain(spark, payload, "phan_quyet.Bi_Cao") == [(0, 1, "A"), (0, 3, "B"), (0, 4, None)]
    assert plain(spark, payload, "phan_quyet.can_cu.Dieu") == [(0, 1, 1, "5"), (0, 1, 3, None), (0, 3, 1, "7")]


def test_odd_payloads(spark):
    inner = {"Thong_Tin_Bi_Cao": [{"Ho_Ten": "X"}]}
    payloads = [
        None, "", "null", "{broken", "```json\n" + json.dumps(inner) + "\n```", json.dumps(json.dumps(inner)), json.dumps([{"result": {"output": inner}}]),
        json.dumps({"Thong_Tin_Bi_Cao": [[None, {"Ho_Ten": "Y"}]]}), json.dumps({"Thong_Tin_Bi_Cao": json.dumps([{"Ho_Ten": "Z"}])}), json.dumps({"Thong_Tin_Bi_Cao": "no list"}), "12", "[]",
    ]
    assert plain(spark, payloads, "bi_cao.Ho_Ten") == [(4, 1, "X"), (5, 1, "X"), (6, 1, "X"), (7, 2, "Y"), (8, 1, "Z")]



def test_empty_table(spark):
    rows = spark.createDataFrame([], "raw long, payload string")
    assert assemble(shred_json(rows, "raw", "payload", (BC, PQ)), "bi_cao.Ho_Ten").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.fixed_dictionaries({"Bi_Cao": st.one_of(st.none(), st.text("ab", max_size=2)), "Can_Cu_Dieu_Luat": st.lists(st.one_of(st.none(), st.fixed_dictionaries({"Dieu": st.integers(0, 9)})), max_size=3)})), max_size=4), min_size=1, max_size=4))
def test_round_trip_against_brute_force(spark, docs):
    want = [(i, p, c, str(x["Dieu"])) for i, d in enumerate(docs) for p, v in enumerate(d, 1) if v for c, x in enumerate(v["Can_Cu_Dieu_Luat"], 1) if x]
    assert plain(spark, [json.dumps({"PHAN_QUYET": d}) for d in docs], "phan_quyet.can_cu.Dieu") == sorted(want)


SINGLE = ["Trốn thuế"] * 30 + ["Mua, bán và cất giữ"] * 30 + ["Giật đồ"] * 30
CASES = {
    "Trốn thuế; Giật đồ": ["Trốn thuế", "Giật đồ"],
    "Mua, bán và cất giữ, Trốn thuế": ["Mua, bán và cất giữ", "Trốn thuế"],
    "Trốn thuế, và Giật đồ": ["Trốn thuế", "Giật đồ"],
    '"Trốn thuế" và "Mua, bán và cất giữ"': ["Trốn thuế", "Mua, bán và cất giữ"],
    "1. Trốn thuế\n2. Giật đồ": ["Trốn thuế", "Giật đồ"],
    "(1) Giật đồ (2) Trốn thuế": ["Giật đồ", "Trốn thuế"],
    '["Giật đồ", "Mua, bán và cất giữ"]': ["Giật đồ", "Mua, bán và cất giữ"],
    "- Giật đồ\n- Trốn thuế": ["Giật đồ", "Trốn thuế"],
    "Giật đồ;; Giật đồ ;": ["Giật đồ", "Giật đồ"],
}


def test_packed_cells(spark):
    cells = SINGLE + list(CASES) + [None, "", " ; "]
    rows = spark.createDataFrame([(i, c, "clash", 1) for i, c in enumerate(cells)], "key long, cell string, item string, pos int")
    got = packed.unpack(rows, "key", ["cell"]).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["id"], r["pos"])):
        by.setdefault(r["id"], []).append(r["item"])
    for i, c in enumerate(cells):
        assert by.get(i) == (CASES.get(c, [c]) if c and c.strip(" ;") else None), c


def test_packed_empty(spark):
    assert packed.unpack(spark.createDataFrame([], "key long, cell string"), "key", ["cell"]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1;,.\"'|\n ()[]-", max_size=40))
def test_atoms_lie_in_order_inside_the_cell(cell):
    spans, kinds = packed.atoms(cell)
    assert len(kinds) == max(0, len(spans) - 1)
    assert all(a < b for a, b, _ in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_wrappers_of_any_depth(spark):
    node = {"Thong_Tin_Bi_Cao": [{"Ho_Ten": "deep"}]}
    for k in range(40):
        node = {f"w{k}": node} if k % 3 else json.dumps([node])
    assert plain(spark, [json.dumps(node)], "bi_cao.Ho_Ten") == [(0, 1, "deep")]


def test_values_of_any_number_of_parts(spark):
    for parts in (4, 10, 25):
        value = ", ".join(f"phần {chr(97 + k)}" for k in range(parts))
        cells = [value] * 60 + ["trộm"] * 60 + [f"{value}; trộm", f"trộm, {value}, trộm"]
        rows = spark.createDataFrame(list(enumerate(cells)), "key long, cell string")
        got = {}
        for r in packed.unpack(rows, "key", ["cell"]).where("id >= 120").orderBy("id", "pos").collect():
            got.setdefault(r["id"], []).append(r["item"])
        assert got == {120: [value, "trộm"], 121: ["trộm", value, "trộm"]}, parts
