import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspark import sources
from lexspark.operators import cover, documents, generation, vector_topk
from lexspark.operators.vector_topk import exact_topk
from lexspark.runtime import latest_delivery
from lexspark.sources import sinks
from lexspark.streaming import ingest


def frames(spark, queries, sets):
    q = spark.createDataFrame([(k, s) for k, v in queries.items() for s in v], "query long, sig string")
    t = spark.createDataFrame([(k, s) for k, v in sets.items() for s in v], "case_id long, sig string")
    return q, t


def test_greedy_pads_with_the_smallest(spark):
    q, t = frames(spark, {1: "abc"}, {10: "ab", 11: "c", 12: "xyz", 13: "w", 14: "abcdefg"})
    got = [(r["case_id"], r["gain"], r["covered"]) for r in cover.greedy(q, t, 3).orderBy("iteration").collect()]
    assert got == [(14, 3, 3), (11, 0, 3), (13, 0, 3)]


def test_greedy_against_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = {i: set(rng.choice(list("abcdefghij"), rng.integers(1, 6))) for i in range(12)}
    queries = {i: set(rng.choice(list("abcdefghij"), 5)) for i in range(4)}
    got = {(r["query"], r["iteration"]): r["case_id"] for r in cover.greedy(*frames(spark, queries, sets), 4).collect()}
    for k, want in queries.items():
        left, covered = dict(sets), set()
        for i in range(1, 5):
            best = min(left, key=lambda c: (-len((left[c] & want) - covered), len(left[c]), c))
            covered |= left.pop(best) & want
            assert got[k, i] == best


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_linear_programme_bounds(seed):
    rng = np.random.default_rng(seed)
    a = (rng.random((4, 6)) < 0.5).astype(float)
    a[:, 0] = 1
    c = a.sum(0) + rng.integers(0, 3, 6)
    value, x = cover.solve_cover(a, np.maximum(c, 1))
    best = min(sum(max(c[j], 1) for j in s) for r in range(1, 7) for s in itertools.combinations(range(6), r) if a[:, list(s)].any(1).all())
    assert value <= best + 1e-9 and (a @ x >= 1 - 1e-7).all() and abs(np.maximum(c, 1) @ x - value) < 1e-6


def test_linear_cover_fallback(spark):
    q, t = frames(spark, {1: "ab", 2: "az"}, {10: "a", 11: "b", 12: "ab"})
    got = {r["query"]: r for r in cover.linear_cover(q, t, 15).collect()}
    assert got[1]["status"] == "optimal" and got[1]["lp_value"] == 2.0 and got[1]["covered"] == 2
    assert got[2]["status"] == "fallback" and got[2]["n_candidates"] == 2


@pytest.mark.parametrize("per_doc", [False, True])
def test_exact_topk_against_brute_force(spark, per_doc):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, i // 3, x[i].tolist()) for i in range(60)] + [(60, 90, None), (61, 91, [0.0] * 8)]
    v = spark.createDataFrame(rows, "id long, doc long, v array<float>").repartition(3)
    got = {}
    for r in exact_topk(v, v.where("id % 5 = 0"), 4, per_doc).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc"] if per_doc else r["other_id"])
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 5):
        order = [j for j in sorted(range(60), key=lambda j: (round(1 - u[q] @ u[j], 12), j)) if j // 3 != q // 3]
        want = list(dict.fromkeys(j // 3 for j in order))[:4] if per_doc else order[:4]
        assert got[q] == want


@pytest.mark.parametrize("per_doc", [False, True])
def test_exact_topk_of_many_queries_in_blocks(spark, monkeypatch, per_doc):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, f"d{i % 9}", rng.normal(size=6).tolist()) for i in range(90)], "id long, doc string, v array<double>").cache()
    few = sorted(exact_topk(v, v, 3, per_doc).collect())
    monkeypatch.setattr(vector_topk, "BLOCK", 13)
    assert sorted(exact_topk(v, v, 3, per_doc).collect()) == few


def test_exact_topk_of_many_encoded_queries(spark, tmp_path, monkeypatch):
    """The vectors come from an encoder and the queries are rows of the same table."""
    spark.createDataFrame([(i, f"từ{i % 7} w{i % 5} x{i}" if i % 11 else None) for i in range(90)], "doc_id long, t string").write.parquet(str(tmp_path / "d"))
    v = spark.read.parquet(str(tmp_path / "d")).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), vector_topk.hashed_embedding(F.col("t")).alias("v"))
    q = v.where(F.col("id") % 2 == 0)
    few = sorted(exact_topk(v, q, 3).select("query_id", "other_id", "rank").collect())
    monkeypatch.setattr(vector_topk, "BLOCK", 13)
    assert sorted(exact_topk(v, q, 3).select("query_id", "other_id", "rank").collect()) == few and len(few) == 3 * sum(i % 2 == 0 and i % 11 > 0 for i in range(90))


def test_latest_delivery(spark):
    rows = spark.createDataFrame([(1, "a", None, 1), (1, "b", "2020-01-01", 2), (2, None, None, 3)], "k long, v string, at string, loaded int").withColumn("at", F.to_timestamp("at"))
    assert {(r["k"], r["v"], r["loaded"]) for r in latest_delivery(rows, "k", "at").collect()} == {(1, "b", 2), (2, None, 3)}


JUDGMENT = """BẢN ÁN
Ngày 01 tháng 2 năm 2020, tại trụ sở Tòa án xét xử sơ thẩm
1. Nguyễn Văn A, sinh ngày 01/02/1990
- Bị hại: Trần B
**NỘI DUNG VỤ ÁN**
x
có nói đến quyết định hình phạt trong câu này rất dài, không phải đề mục của phần nào cả
NHẬN ĐỊNH CỦA TÒA ÁN
[1] một
[2] hai
tiếp
* [2] ba
[3]
III. VỀ QUYẾT ĐINH
# QUYẾT ĐỊNH:
1. ba"""


def lines_of(spark, *texts):
    return spark.createDataFrame([(d, i, s) for d, t in enumerate(texts, 1) for i, s in enumerate(t.split("\n"))], "doc_id long, line_no int, line string")


def test_sections(spark):
    lines = lines_of(spark, JUDGMENT, "nothing", "Nhận định như sau: dài " + "x" * 60)
    bounds = documents.sections(lines).cache()
    got = {r["doc_id"]: r for r in bounds.collect()}
    r = got[1]
    assert (r["trial_date"], r["lien_quan"], r["noi_dung"], r["nhan_dinh"], r["quyet_dinh"], r["missing"]) == (1, 3, 4, 7, 14, [])
    assert got[2]["missing"] == ["Bi_cao (trial date line not found)", "NOI_DUNG_VU_AN", "NHAN_DINH", "QUYET_DINH"]
    assert got[3]["nhan_dinh"] == 0 and "NHAN_DINH" not in got[3]["missing"]
    texts = {r["section"]: r["text"] for r in documents.section_texts(lines, bounds).collect()}
    assert set(texts) == {"Bi_cao", "Lien_quan", "NOI_DUNG_VU_AN", "NHAN_DINH", "QUYET_DINH"} and texts["Lien_quan"] == "- Bị hại: Trần B"


def test_slices_and_points(spark):
    lines = lines_of(spark, "mở\n1. một\n2. hai\ntiếp\n1. ba")
    items = [(r["item"], r["body"]) for r in documents.slices(lines, r"^(\d+)\. ").orderBy("start_line").collect()]
    assert items == [("1", "1. một"), ("2", "2. hai\ntiếp"), ("1", "1. ba")]
    points = lines_of(spark, "[1] một\n[2] hai\ntiếp\n* **[2]** ba\n[3]", "không có số\nhai dòng", " ")
    got = {(r["doc_id"], r["no"], r["text"]) for r in documents.reasoning_points(points).collect()}
    assert got == {(1, "[1]", "một"), (1, "[2]", "hai\ntiếp\n\nba"), (2, "[1]", "không có số\nhai dòng")}


@pytest.mark.parametrize(
    ("header", "narrative", "kind"),
    [("xét xử phúc thẩm", None, "phuc_tham"), ("Xét xử SƠ THẨM", None, "so_tham"), ("có kháng cáo", None, "phuc_tham"), ("khác", "bản án sơ thẩm", "unknown"), (None, "Bản án hình sự sơ thẩm", "phuc_tham"), (None, None, "unknown")],
)
def test_case_type(spark, header, narrative, kind):
    row = spark.createDataFrame([(header, narrative)], "h string, n string").select(documents.case_type(F.col("h"), F.col("n")).alias("k")).first()
    assert row["k"] == kind


def test_narrative_parts(spark):
    rows = spark.createDataFrame([(1, "NỘI DUNG VỤ ÁN:\nTrước. Tại bản cáo trạng số 5 truy tố."), (2, "chi co. Cao trang so 7 noi"), (3, "không có"), (4, None)], "id long, t string")
    got = {r["id"]: tuple(r["p"]) for r in rows.select("id", documents.narrative_parts(F.col("t")).alias("p")).collect()}
    assert got == {1: ("Trước.", "Tại bản cáo trạng số 5 truy tố."), 2: ("chi co.", "Cao trang so 7 noi"), 3: ("không có", None), 4: (None, None)}


def test_label_codes_of_wrong_types(spark):
    rows = [(1, None, None, None, None, None, None, False), (2, None, None, None, None, 1, None, False), (3, None, None, None, None, 1, 1, False), (4, "1", None, None, "BLHS", 1, 1, True)]
    items = spark.createDataFrame(rows, "doc_id long, dieu string, khoan string, diem string, source string, n_verdicts int, n_items int, is_item boolean")
    got = {r["doc_id"]: r["errors"] for r in documents.label_sets(items).collect()}
    assert got == {1: ["verdict_invalid_type"], 2: ["basis_invalid_type"], 3: ["basis_item_not_object"], 4: []}


def test_latest_delivery_with_maps(spark):
    rows = spark.createDataFrame([(1, 1, {"a": 1}, [{"x": 1}]), (1, 2, {"b": 2}, None), (2, None, None, [])], "k long, at long, m map<string,int>, n array<map<string,int>>")
    assert {(r["k"], r["at"], str(r["m"])) for r in latest_delivery(rows, "k", "at").collect()} == {(1, 2, "{'b': 2}"), (2, None, "None")}


def test_two_statutes_do_not_mix(spark):
    from lexspark.operators import law

    nodes = spark.createDataFrame([("a", 1, "5", None, None, "dieu", "A5"), ("b", 2, "5", None, None, "dieu", "B5"), ("b", 3, "5", "1", None, "khoan", "B51"), ("b", 4, "đ", None, None, "dieu", "x"), ("b", 5, "5", None, None, "dieu", "B5 last")], "law_id string, pos int, dieu string, khoan string, diem string, level string, own_text string")
    q = spark.createDataFrame([("a", 1, "5-1"), ("b", 2, "5-1"), ("b", 3, "5"), ("a", 4, "5"), ("c", 5, "5")], "law_id string, pos int, query string")
    got = {r["pos"]: (r["reason"], r["text"]) for r in law.lookup(q, law.level_texts(nodes)).collect()}
    assert got[1][0] == "khoan_not_found" and got[4][1] == "[dieu 5] A5" and got[5][0] == "dieu_not_found"
    assert got[2] == (None, "[dieu 5] B5 last\n[khoan 1] B51") and "B5 last" in got[3][1] and "A5" not in got[3][1]


def test_new_versions(spark, tmp_path):
    rows = spark.range(3)
    assert [sinks.new_version(rows, str(tmp_path / "t")) for _ in range(2)] == [str(tmp_path / "t" / "v1"), str(tmp_path / "t" / "v2")]
    sinks.write_records(rows.selectExpr("id", "id * 2 AS x"), str(tmp_path / "r"), "id")
    assert len(list((tmp_path / "r").glob("id=*/*.json"))) == 3


def test_labels_are_strict(spark):
    rows = [
        (1, "51", "1", "a", "BLHS", 1, 2), (1, None, None, None, "Nghị định", 1, 2), (2, None, "1", None, "BLHS", 1, 1), (3, None, None, None, None, 1, 0),
        (4, "5", None, None, "Luật khác", 1, 1), (5, None, None, None, None, 0, None), (6, "51", "1, 2", None, "bộ luật Hình sự", 1, 1), (6, "51", None, None, "BLHS", 1, 1),
    ]
    items = spark.createDataFrame(rows, "doc_id long, dieu string, khoan string, diem string, source string, n_verdicts int, n_items int")
    got = {r["doc_id"]: (r["signatures"], r["errors"]) for r in documents.label_sets(items).collect()}
    assert got == {1: (["51-1-a"], []), 2: (None, ["missing_dieu"]), 3: (None, ["basis_empty"]), 4: (None, ["no_labels_extracted"]), 5: (None, ["verdict_empty"]), 6: (["51", "51-1", "51-2"], [])}


def test_defendants_and_point_map(spark):
    t = "1. Nguyễn Văn A, sinh ngày 01/02/1990 tại X;\n2) Trần B, sinh năm 1991\n(Các bị cáo có mặt)"
    rows = spark.createDataFrame([(1, t), (2, None), (3, "Lê C, làm ruộng")], "doc_id long, t string")
    got = [(r["doc_id"], r["pos"], r["entry"], r["name"]) for r in documents.defendants(rows).orderBy("doc_id", "pos").collect()]
    assert got == [(1, 1, "1. Nguyễn Văn A, sinh ngày 01/02/1990 tại X;", "Nguyễn Văn A"), (1, 2, "2) Trần B, sinh năm 1991", "Trần B"), (3, 1, "Lê C, làm ruộng", "Lê C")]
    points = spark.createDataFrame([(1, 0, "2", "x"), (1, 1, "1", "y"), (1, 2, "2", "z")], "doc_id long, pos int, no string, text string")
    assert {(r["no"], r["text"]) for r in documents.point_map(points).collect()} == {("2", "x\n\nz"), ("1", "y")}


def test_merge_words(spark):
    rows = spark.createDataFrame([(1, "QUYẾT ĐINH của tòa", "QUYẾT ĐỊNH của tòa"), (2, "một hai ba", "một"), (3, None, None), (4, "a b", "a b c")], "id long, old string, new string")
    assert {r["id"]: r["merged"] for r in documents.merge_words(rows).collect()} == {1: "QUYẾT ĐỊNH của tòa", 2: "một hai ba", 3: "", 4: "a b"}


def test_generation_port(spark):
    rows = spark.createDataFrame([(1, '{"name": "A"}'), (2, None), (3, "broken")], "id long, prompt string")

    def down(_):
        raise OSError("down")

    got = {r["id"]: r for r in generation.validated(generation.call(rows, [("x", down), ("x", down), ("y", generation.offline)]), "defendants ARRAY<STRUCT<Bi_Cao STRING>>").collect()}
    assert (got[1]["provider"], got[1]["attempts"], got[1]["status"]) == ("y", ["x: down"], "ok")
    assert got[2]["status"] == "generation_error" and len(got[3]["attempts"]) == 2


def test_json_folder_and_counters(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"case_id": "1", "n_sigs": 2}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"case_id": "1", "n_sigs": 0}))
    rows = sources.json_folder(spark, str(tmp_path), "case_id STRING, n_sigs INT").cache()
    got = sources.scan_counters(rows).first().asDict()
    assert got == {"files_seen": 3, "json_errors": 1, "skipped_missing_articles": 0, "skipped_empty_clause_set": 1, "loaded_cases": 1, "duplicate_case_ids": 1}
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse|FAILFAST"):
        sources.json_folder(spark, str(tmp_path), "case_id STRING, n_sigs INT", strict=True).collect()


def test_law_json_must_be_a_list(spark, tmp_path):
    (tmp_path / "ok.json").write_text('[{"index": "I"}, {"index": "II"}]')
    (tmp_path / "bad.json").write_text('{"index": "I"}')
    assert [r["index"] for r in sources.law_json(spark, str(tmp_path / "ok.json"), "index STRING").orderBy("chapter_pos").collect()] == ["I", "II"]
    with pytest.raises(Exception, match="must hold a list"):
        sources.law_json(spark, str(tmp_path / "bad.json"), "index STRING").collect()


def test_external_port(spark):
    rows = spark.createDataFrame([("a.docx", bytearray(b"hi")), ("b.docx", bytearray(b"")), ("c.docx", bytearray(b"\xff"))], "path string, content binary")
    assert {r["file"]: r["status"] for r in sources.external(rows, lambda b: bytes(b).decode()).collect()} == {"a.docx": "OK", "b.docx": "EMPTY", "c.docx": "FAIL"}


def test_upsert_report_split_quarantine(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    assert sinks.upsert(spark, rows, path) == 2
    assert sinks.upsert(spark, rows.union(spark.createDataFrame([(3, "c")], "id long, v string")), path) == 1
    assert spark.read.parquet(path).count() == 3
    sinks.write_report(spark.createDataFrame([(1, "ă")], "n int, s string"), str(tmp_path / "r" / "report.json"))
    assert json.loads((tmp_path / "r" / "report.json").read_text()) == {"n": 1, "s": "ă"}
    files = spark.createDataFrame([("x.json", "d1/x.json"), ("x.json", "d2/x.json"), ("y.json", "d1/y.json")], "file string, path string")
    good, moved = sinks.quarantine(files, files.where("file = 'x.json'"))
    assert [r["file"] for r in good.collect()] == ["y.json"] and {r["target"] for r in moved.collect()} == {"x.json", "x__dup_1.json"}
    sinks.write_split(spark.createDataFrame([("b", True), ("a", False), ("c", True)], "stem string, is_test boolean"), str(tmp_path / "split"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "split_test")).collect()] == ["b", "c"]


def test_stream_is_incremental(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(source)
    for _ in range(2):
        ingest(spark, source, "id long, v string", target, check).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([(2, "x"), (3, "c")], "id long, v string").write.mode("append").parquet(source)
    ingest(spark, source, "id long, v string", target, check, files_per_batch=1).awaitTermination()
    assert {(r["id"], r["v"]) for r in spark.read.parquet(target).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_summary_cleanup_and_validity(spark):
    raw = "```\nlời dẫn\nThưa luật sư, câu một.\n- ghi chú\nThưa luật sư, tôi   bị\nkiện vì vay tiền.\n```"
    rows = spark.createDataFrame([(1, raw), (2, None), (3, "x" * 90), (4, "* " + "x" * 90)], "id long, t string")
    got = {r["id"]: (r["c"], r["v"]) for r in rows.select("id", documents.clean_summary(F.col("t")).alias("c"), documents.summary_is_valid(F.col("t")).alias("v")).collect()}
    assert got[1][0] == "Thưa luật sư, tôi bị kiện vì vay tiền." and got[2] == ("", False)
    assert got[3][1] and not got[4][1]


def test_text_report(spark):
    out = sinks.text_report(spark.createDataFrame([("a", 0.5), (None, 1.0)], "k string, v double"), "Title", 6)
    assert out == "Title\n=====\nk     v\na     0.5000\n      1.0000\n"


def test_small_functions(spark):
    from lexspark.functions import text

    rows = spark.createDataFrame([(200, "x"), (401, ""), (500, " a \n b "), (500, None)], "s int, b string")
    got = [tuple(r["h"]) for r in rows.select(text.http_answer(F.col("s"), F.col("b")).alias("h")).collect()]
    assert got == [("yes", "HTTP 200"), ("no", "HTTP 401 (auth failed)"), ("no", "HTTP 500: a b"), ("no", "HTTP 500")]
    one = spark.range(1).select(text.map_text(F.create_map(F.lit("b"), F.lit(" y "), F.lit("a"), F.lit("x"), F.lit("c"), F.lit(" "))).alias("m"), text.exact_round(F.lit(0.03125), 4).alias("r")).first()
    assert (one["m"], one["r"]) == ("x\n\ny", 0.0312)


def test_stream_runs_on_and_stops_at_a_target(spark, tmp_path):
    from lexspark.sources.sinks import path_exists
    from lexspark.streaming import stop_when

    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(str(tmp_path / "in"))
    target = str(tmp_path / "out")
    q = ingest(spark, str(tmp_path / "in"), "id long", target, str(tmp_path / "c"), files_per_batch=1, every=0.2)
    assert stop_when(q, lambda: path_exists(spark, target) and spark.read.parquet(target).count() >= 10, 0.2)
    assert not q.isActive and spark.read.parquet(target).count() >= 10


def test_retry_with_warnings(spark):
    def shy(prompt):
        if "again" in prompt:
            raise ValueError("no")
        return "" if "empty" in prompt else "answer"

    rows = spark.createDataFrame([(1, "fine"), (2, "empty"), (3, None)], "id long, prompt string")
    got = {r["id"]: (r["response"], r["retried"], r["warnings"]) for r in generation.with_retry(rows, [("p", shy)], F.col("response") == "", F.lit("again")).collect()}
    assert got == {1: ("answer", False, []), 2: ("", True, ["empty answer, asked again", "no second answer"]), 3: (None, False, [])}
