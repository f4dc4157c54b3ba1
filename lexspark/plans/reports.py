"""Document processing, quality rules and reports over the judgment tables and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import chunk, sentencing, text
from lexspark.functions.signatures import article_of
from lexspark.operators import documents, generation, law
from lexspark.plans.legal import VERDICTS_SQL, verdicts
from lexspark.plans.retrieval import LABELS_SQL, labels
from lexspark.runtime import latest_delivery, table
from lexspark.sources import first_files, select_files
from lexspark.sources.sinks import not_done, quarantine

LIMIT = 1500


def _proposals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_delivery(table(spark, sf_dir, "de_nghi_vien_kiem_sat").select("mention_id", "loaded_at", *columns), "mention_id")


PROPOSALS_SQL = "SELECT DISTINCT ON (mention_id) * FROM de_nghi_vien_kiem_sat ORDER BY mention_id, loaded_at DESC"
PEOPLE_SQL = "SELECT DISTINCT ON (mention_id) * FROM thong_tin_bi_cao ORDER BY mention_id, loaded_at DESC"


def _people(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_delivery(table(spark, sf_dir, "thong_tin_bi_cao").select("mention_id", "loaded_at", *columns), "mention_id")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field, t): the non-blank text fields of every record."""
    rows = table(spark, sf_dir, "extracted_fields")
    parts = F.create_map(F.lit("qua_trinh_dieu_tra"), F.col("noi_dung_vu_an.qua_trinh_dieu_tra"), F.lit("ket_luan_cac_ben"), F.col("noi_dung_vu_an.ket_luan_cac_ben"), F.lit("quyet_dinh"), F.col("quyet_dinh"))
    return rows.select("record_id", F.explode(parts).alias("field", "t")).where(text.strip(F.col("t")) != "")


def q_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-packed chunks of every document with their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.sentence_chunks(F.col("text"), LIMIT)).alias("i", "c"))
    return docs.select("doc_id", chunk.chunk_id(F.col("doc_id"), F.lit("text"), F.col("i")).alias("chunk_id"), F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


def q_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by field: number of texts, chunks, and the most in one text."""
    sized = _fields(spark, sf_dir).select("field", F.size(chunk.sentence_chunks(F.col("t"), LIMIT)).alias("n"))
    return sized.groupBy("field").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_chunks"), F.max("n").cast("long").alias("most"))


_PACK_SQL = """WITH RECURSIVE src AS ({src}),
  s AS (SELECT id, list_filter(string_split(regexp_replace(b, '([.!?])[\\s\\x{{85}}\\x{{a0}}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: true) AS ss, b FROM (SELECT id, regexp_replace(t, '^[\\s\\x{{85}}\\x{{a0}}]+|[\\s\\x{{85}}\\x{{a0}}]+$', '', 'g') AS b FROM src WHERE t IS NOT NULL) WHERE b <> ''),
  f AS (SELECT id, ss, 1 AS i, []::VARCHAR[] AS out, '' AS cur FROM s WHERE length(b) > 1500
    UNION ALL
    SELECT id, ss, i + 1,
      CASE WHEN length(cur) + length(ss[i]) + 1 <= 1500 THEN out
           ELSE list_concat(CASE WHEN cur = '' THEN out ELSE list_append(out, cur) END, list_transform(range(0, greatest((length(ss[i]) - 1) // 1500, 0)), lambda k: trim(substr(ss[i], (k * 1500 + 1)::BIGINT, 1500)))) END,
      CASE WHEN length(cur) + length(ss[i]) + 1 <= 1500 THEN CASE WHEN cur = '' THEN ss[i] ELSE cur || ' ' || ss[i] END
           ELSE trim(substr(ss[i], (greatest((length(ss[i]) - 1) // 1500, 0) * 1500 + 1)::BIGINT, 1500)) END
    FROM f WHERE i <= len(ss)),
  c AS (SELECT id, CASE WHEN cur = '' THEN out ELSE list_append(out, cur) END AS cs FROM f WHERE i = len(ss) + 1
    UNION ALL SELECT id, [b] FROM s WHERE length(b) <= 1500)"""


def q_incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors of cases whose judgment no document holds yet."""
    new = table(spark, sf_dir, "chunk_vectors").where("coalesce(source_type, '') <> 'law'").select("vec_id", "doc_id")
    done = table(spark, sf_dir, "documents").where("record_id is not null").select(F.col("record_id").cast("string").alias("doc_id")).distinct()
    return not_done(new, done, "doc_id")


def q_split_train_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the judgments, at least one, by a hash of the file name; the number is rounded half to even."""
    files = table(spark, sf_dir, "extracted_fields").select("record_id", F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem"))
    total = files.count()
    n_test = max(1, round(total * 0.1))
    keyed = files.withColumn("h", F.md5(F.concat(F.lit("42"), "stem"))).withColumn("bucket", F.conv(F.substring("h", 1, 4), 16, 10).cast("int"))
    # The n-th smallest hash lies in one of 65,536 buckets; only the rows of that bucket are ranked.
    left, edge = n_test, -1
    for r in keyed.groupBy("bucket").count().orderBy("bucket").collect():
        edge = r["bucket"]
        if left <= r["count"]:
            break
        left -= r["count"]
    inside = keyed.where(F.col("bucket") == edge).withColumn("r", F.row_number().over(Window.orderBy("h", "record_id")))
    ranked = inside.select("record_id", "stem", (F.col("r") <= left).alias("is_test"))
    return keyed.where(F.col("bucket") != edge).select("record_id", "stem", (F.col("bucket") < edge).alias("is_test")).unionByName(ranked)


def q_field_success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each extracted field is filled, with its share in percent."""
    e = table(spark, sf_dir, "extracted_fields")
    filled = {
        "danh_sach_bi_cao": F.coalesce(F.size("danh_sach_bi_cao"), F.lit(0)) > 0,
        "ket_luan_cac_ben": F.coalesce(F.trim("noi_dung_vu_an.ket_luan_cac_ben"), F.lit("")) != "",
        "nguoi_tham_gia": F.coalesce(F.trim("nguoi_tham_gia"), F.lit("")) != "",
        "nhan_dinh_cua_toa_an": F.coalesce(F.size("nhan_dinh_cua_toa_an"), F.lit(0)) > 0,
        "quyet_dinh": F.coalesce(F.trim("quyet_dinh"), F.lit("")) != "",
    }
    row = e.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in filled.items()])
    long = row.select("total", F.explode(F.create_map(*[x for k in filled for x in (F.lit(k), F.col(k))])).alias("field", "filled"))
    return long.select("field", "filled", F.round(100 * F.col("filled") / F.col("total"), 1).alias("percent"))


def q_case_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracted_fields").select(F.coalesce("case_type", F.lit("unknown")).alias("case_type"))
    counts = e.groupBy("case_type").agg(F.count("*").alias("n"))
    return counts.select("case_type", "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1).alias("percent"))


def q_empty_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the three lists without a name or an offence."""
    a = _people(spark, sf_dir, "record_id", "ho_ten").select("mention_id", "record_id", F.lit("bi_cao").alias("source"), F.lit("ho_ten").alias("field"), F.col("ho_ten").alias("v"))
    parts = [a]
    for name, rows in (("de_nghi", _proposals(spark, sf_dir, "record_id", "phat_tu")), ("phan_quyet", verdicts(spark, sf_dir, "record_id", "phat_tu"))):
        parts.append(rows.select("mention_id", "record_id", F.lit(name).alias("source"), F.lit("phat_tu").alias("field"), F.col("phat_tu").alias("v")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.where("trim(coalesce(v, '')) = ''").select("mention_id", "record_id", "source", "field")


def q_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _people(spark, sf_dir, "record_id", "ho_ten").select(F.col("record_id").alias("doc_id"), F.lit("a").alias("list"), F.col("ho_ten").alias("name"))
    b = _proposals(spark, sf_dir, "record_id", "bi_cao").select(F.col("record_id").alias("doc_id"), F.lit("b").alias("list"), F.col("bi_cao").alias("name"))
    c = verdicts(spark, sf_dir, "record_id", "bi_cao").select(F.col("record_id").alias("doc_id"), F.lit("c").alias("list"), F.col("bi_cao").alias("name"))
    return documents.count_mismatch(a.unionByName(b).unionByName(c))


def q_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur in more than one of a judgment's lists in the same spelling."""
    b = _proposals(spark, sf_dir, "record_id", "bi_cao").select(F.col("record_id").alias("doc_id"), F.col("bi_cao").alias("name"))
    c = verdicts(spark, sf_dir, "record_id", "bi_cao").select(F.col("record_id").alias("doc_id"), F.col("bi_cao").alias("name"))
    return documents.repeated_names(b.unionByName(c))


def q_quarantine_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of records with an empty defendant list, no party, or a null case type: kept or moved, with free names."""
    e = table(spark, sf_dir, "extracted_fields").select("record_id", F.regexp_replace("filename", "__dup_[0-9]+", "").alias("file"), F.col("filename").alias("path"), "danh_sach_bi_cao", "nguoi_tham_gia", "case_type")
    empty = e.where("coalesce(size(danh_sach_bi_cao), 0) <= 0").select("file")
    bad = empty.union(e.where("nguoi_tham_gia is null").select("file")).union(e.where("case_type is null").select("file"))
    good, moved = quarantine(e.select("record_id", "file", "path"), bad)
    return good.select("record_id", F.lit("kept").alias("state"), F.col("file").alias("target")).unionByName(moved.select("record_id", F.lit("moved").alias("state"), "target"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracted_fields").where("nhan_dinh_cua_toa_an is not null")
    return e.select("record_id", F.explode("nhan_dinh_cua_toa_an").alias("no", "t"))


def q_keyword_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose reasoning speaks of mitigation, aggravation and exhibits: any, all, none."""
    words = (documents.MITIGATING, documents.AGGRAVATING, documents.EXHIBITS)
    p = _points(spark, sf_dir).groupBy("record_id").agg(*[F.bool_or(F.contains(F.lower("t"), F.lit(w))).alias(f"w{i}") for i, w in enumerate(words)])
    n = F.col("w0").cast("int") + F.col("w1").cast("int") + F.col("w2").cast("int")
    return p.agg(F.count_if(n > 0).alias("any_of"), F.count_if(n == 3).alias("all_of"), F.count_if(n == 0).alias("none_of"))


def q_reasoning_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings, mitigating and aggravating points of each record in order, without the first point."""
    p = _points(spark, sf_dir).where("no <> '[1]'").withColumn("i", F.regexp_extract("no", r"(\d+)", 1).cast("int"))

    def joined(condition: F.Column) -> F.Column:
        kept = F.array_sort(F.collect_list(F.when(condition, F.struct("i", "t"))))
        return F.md5(F.array_join(F.transform(kept, lambda x: x["t"]), "\n\n"))

    low = F.lower("t")
    return p.groupBy("record_id").agg(
        joined(documents.is_finding(F.col("t"))).alias("summary"),
        joined(F.contains(low, F.lit(documents.MITIGATING))).alias("giam_nhe"),
        joined(F.contains(low, F.lit(documents.AGGRAVATING))).alias("tang_nang"),
    )


def q_any_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by whether any reasoning point states findings."""
    p = _points(spark, sf_dir).groupBy("record_id").agg(F.bool_or(documents.is_finding(F.col("t"))).alias("found"))
    return p.groupBy("found").agg(F.count("*").alias("n"))


def q_summary_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", documents.summary_is_valid(F.col("text")).alias("ok"))
    return d.groupBy("source").agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"))


def q_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the statute by six classes that do not exclude each other."""
    lines = table(spark, sf_dir, "law_nodes").where("own_text is not null").select(F.explode(F.split("own_text", "\n")).alias("line"))
    names = ("possible_footnotes", "too_short", "numeric_only", "weird_symbols", "missing_structure", "suspicious_lowercase_start")
    return lines.select(*documents.line_classes(F.col("line"))).agg(F.count("*").alias("n_lines"), *[F.count_if(n).alias(n) for n in names])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "extracted_fields").where("quyet_dinh is not null")
    return e.select(F.col("record_id").alias("doc_id"), F.posexplode(F.split("quyet_dinh", "\n")).alias("line_no", "line"))


def q_section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered items of every decision from marker to marker."""
    out = documents.slices(_lines(spark, sf_dir), r"^(\d{1,2})\. ")
    return out.select("doc_id", "item", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("body").alias("digest"))


def q_section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of the sections of records written out as one text."""
    e = table(spark, sf_dir, "extracted_fields")
    whole = F.concat(F.lit("Ngày 05 tháng 6 năm 2020 tại trụ sở Tòa án xét xử\nBị hại: một người\nNỘI DUNG VỤ ÁN\n"), F.coalesce("noi_dung_vu_an.qua_trinh_dieu_tra", F.lit("")), F.lit("\nNHẬN ĐỊNH CỦA TÒA ÁN\n"), F.lit("Xét\n"), F.coalesce("quyet_dinh", F.lit("")))
    lines = e.select(F.col("record_id").alias("doc_id"), F.posexplode(F.split(whole, "\n")).alias("line_no", "line"))
    out = documents.sections(lines)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("trial_date", "lien_quan", "noi_dung", "nhan_dinh", "quyet_dinh")], F.array_join("missing", "|").alias("missing"))


def q_point_map_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning points modulo three, so that numbers repeat and texts are appended in order."""
    p = _points(spark, sf_dir).select(F.col("record_id").alias("doc_id"), F.regexp_extract("no", r"(\d+)", 1).cast("int").alias("pos"), F.col("t").alias("text"))
    out = documents.point_map(p.withColumn("no", (F.col("pos") % 3).cast("long")))
    return out.select("doc_id", "no", F.md5("text").alias("digest"))


def q_defendant_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defendants of the lists written as one numbered text and split again."""
    e = table(spark, sf_dir, "extracted_fields").where("size(danh_sach_bi_cao) > 0")
    numbered = F.array_join(F.transform("danh_sach_bi_cao", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    out = documents.defendants(e.select(F.col("record_id").alias("doc_id"), numbered.alias("t")))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "entry")


def q_full_outer_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed and given penalties per judgment aligned by name key; of equal keys the last mention counts."""
    def keyed(rows: DataFrame, side: str) -> DataFrame:
        k = rows.select("record_id", text.name_key(F.col("bi_cao")).alias("name_key"), "mention_id").where("name_key <> ''")
        return k.groupBy("record_id", "name_key").agg(F.max("mention_id").alias(side))

    a, b = keyed(_proposals(spark, sf_dir, "record_id", "bi_cao"), "a"), keyed(verdicts(spark, sf_dir, "record_id", "bi_cao"), "b")
    j = a.join(b, ["record_id", "name_key"], "full_outer")
    state = F.when(F.col("a").isNull(), "pred_only").when(F.col("b").isNull(), "gt_only").otherwise("matched")
    return j.select("record_id", "name_key", "a", "b", state.alias("state"))


def q_sentence_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of every distinct penalty text."""
    rows = verdicts(spark, sf_dir, "phat_tu").where("phat_tu is not null").select("phat_tu").distinct()
    return rows.select("phat_tu", sentencing.months(F.col("phat_tu")).cast("long").alias("months"))


def q_rmse_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square difference of proposed and given months per judgment, and its mean; a missing side has 0."""
    j = q_full_outer_align(spark, sf_dir)
    a = _proposals(spark, sf_dir, "phat_tu").select(F.col("mention_id").alias("a"), sentencing.months(F.col("phat_tu")).alias("ma"))
    b = verdicts(spark, sf_dir, "phat_tu").select(F.col("mention_id").alias("b"), sentencing.months(F.col("phat_tu")).alias("mb"))
    d = j.join(a, "a", "left").join(b, "b", "left").withColumn("d", (F.coalesce("ma", F.lit(0)) - F.coalesce("mb", F.lit(0))).cast("double"))
    per = d.groupBy("record_id").agg(F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rmse"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg("rmse"), 4).alias("macro_rmse"))


def q_status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by the first reason that would skip them."""
    e = table(spark, sf_dir, "extracted_fields").select("record_id", F.col("record_id").cast("string").alias("doc"), F.col("noi_dung_vu_an.ket_luan_cac_ben").alias("summary"), "danh_sach_bi_cao")
    done = table(spark, sf_dir, "documents").where("record_id is not null").select("record_id", F.lit(True).alias("done")).distinct()
    known = table(spark, sf_dir, "law_nodes").where("law_level = 'dieu'").select("dieu", F.lit(True).alias("in_law")).distinct()
    cited = labels(spark, sf_dir).select("doc", article_of(F.col("sig")).alias("dieu")).distinct().join(known, "dieu", "left").groupBy("doc").agg(F.bool_or(F.coalesce("in_law", F.lit(False))).alias("in_law"))
    j = e.join(done, "record_id", "left").join(cited, "doc", "left")
    reason = (
        F.when(F.col("done"), "already_exists")
        .when(F.col("summary").isNull(), "missing_summary")
        .when(F.coalesce(F.size("danh_sach_bi_cao"), F.lit(0)) <= 0, "missing_eval_doc")
        .when(F.col("in_law").isNull(), "empty_predicted_articles")
        .when(~F.col("in_law"), "missing_law_context")
        .otherwise("processed")
    )
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def q_size_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by source and language, by source, and in all, in one pass of three levels."""
    d = table(spark, sf_dir, "documents")
    d.createOrReplaceTempView("lexspark_documents")
    return spark.sql("SELECT source, lang, CAST(grouping(source) AS BIGINT) AS all_sources, CAST(grouping(lang) AS BIGINT) AS all_langs, sum(n_chars) AS n_chars, count(*) AS n FROM lexspark_documents GROUP BY GROUPING SETS ((source, lang), (source), ())")


def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dotted path of JSON text summed by event type; unknown paths are null."""
    e = table(spark, sf_dir, "events").select("event_type", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"), F.expr("try_variant_get(try_parse_json(props), '$.no.where', 'string')").alias("none"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("none").alias("n_unknown"))


def q_levenshtein_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of defendants in verdicts that a correction to the listed name would be accepted for."""
    a = verdicts(spark, sf_dir, "record_id", "bi_cao").select("record_id", F.col("bi_cao").alias("old")).distinct()
    b = _people(spark, sf_dir, "record_id", "ho_ten").select("record_id", F.col("ho_ten").alias("new")).distinct()
    near = a.join(b, "record_id").where("old <> new").where(F.levenshtein(F.lower("old"), F.lower("new")) <= 2)
    return near.where(text.accept_correction(F.col("old"), F.col("new"))).select("record_id", "old", "new")


def q_fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without accents (đ kept), their keys, and how many spellings share one."""
    p = _people(spark, sf_dir, "ho_ten").select("ho_ten").distinct()
    key = text.name_key(F.col("ho_ten"))
    return p.groupBy(key.alias("name_key")).agg(F.count("*").alias("n"), F.min(F.lower(text.strip_accents(F.col("ho_ten")))).alias("folded"))


def q_first_n_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "extracted_fields").select("record_id", F.col("filename").alias("file"))
    return first_files(files, 25).select("record_id", "file")


def q_selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of names with repeats and one that no file has: the files found in order, and the missing name."""
    files = table(spark, sf_dir, "extracted_fields").select("record_id", F.col("filename").alias("file"))
    listed = table(spark, sf_dir, "documents").where("record_id is not null").select("doc_id", "record_id").join(files, "record_id").select((F.col("doc_id") * 2).alias("pos"), F.concat(F.lit("  "), "file").alias("name"))
    listed = listed.unionByName(spark.createDataFrame([(5, "nowhere.md")], "pos long, name string"))
    found, missing = select_files(files, listed)
    return found.select("file", "pos", F.lit(True).alias("found")).unionByName(missing.select("file", "pos", F.lit(False).alias("found")))


def q_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts of both forms from the fields that are filled."""
    e = table(spark, sf_dir, "extracted_fields")
    a, b = text.strip(F.col("noi_dung_vu_an.ket_luan_cac_ben")), text.strip(F.col("nguoi_tham_gia"))
    plain = F.concat_ws("\n\n", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    named = F.concat_ws("\n\n", F.when(a != "", F.concat(F.lit("[ket_luan]\n"), a)), F.when(b != "", F.concat(F.lit("[nguoi_tham_gia]\n"), b)))
    return e.select("record_id", F.md5(plain).alias("plain"), F.md5(named).alias("named"), F.array_join(F.array_compact(F.array(F.when(F.coalesce(a, F.lit("")) == "", F.lit("ket_luan")), F.when(F.coalesce(b, F.lit("")) == "", F.lit("nguoi_tham_gia")))), "|").alias("missing"))


def q_llm_stub_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verdict through the generation port with a failing provider first, then the offline one; validated."""
    rows = verdicts(spark, sf_dir, "bi_cao", "phat_tu").select(F.col("mention_id").alias("id"), generation.prompt(name=F.col("bi_cao"), hint=F.col("phat_tu")).alias("prompt"))

    def down(_: str) -> str:
        raise ConnectionError("offline")

    answered = generation.call(rows, [("remote", down), ("offline", generation.offline)])
    return generation.validated(answered, "defendants ARRAY<STRUCT<Bi_Cao STRING, Phat_Tu STRING>>").select("id", "provider", "status", F.size("attempts").cast("long").alias("n_failed"), F.col("parsed.defendants")[0]["Bi_Cao"].alias("bi_cao"))


def q_spelling_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names corrected word by word towards each near spelling of the judgment's verdicts where the change is trusted."""
    a = verdicts(spark, sf_dir, "record_id", "bi_cao").select("record_id", F.col("bi_cao").alias("new")).distinct()
    b = _people(spark, sf_dir, "record_id", "ho_ten").select(F.col("mention_id").alias("id"), "record_id", F.col("ho_ten").alias("old"))
    near = b.join(a, "record_id").where("old <> new").where(F.levenshtein(F.lower("old"), F.lower("new")) <= 4)
    return documents.merge_words(near.select("id", "old", "new")).distinct()


def q_narrative_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", documents.narrative_parts(F.col("text")).alias("p"))
    return d.select("doc_id", F.length("p.before").cast("long").alias("before"), F.length("p.after").cast("long").alias("after"))


def q_detected_case_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select(documents.case_type(F.substring_index("text", "\n", 1), F.col("text")).alias("kind"), "source")
    return d.groupBy("source", "kind").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        q_chunk_documents, q_chunk_stats, q_incremental_antijoin, q_split_train_test, q_field_success_rates, q_case_type_distribution, q_empty_fields, q_count_mismatch, q_duplicate_names,
        q_quarantine_union, q_keyword_triple, q_reasoning_extract, q_any_regex, q_summary_validity, q_line_quality, q_section_items, q_section_bounds, q_point_map_append, q_defendant_entries,
        q_full_outer_align, q_sentence_months, q_rmse_macro, q_status_tally, q_size_rollup, q_json_props, q_levenshtein_fix, q_fold_text, q_first_n_files, q_selected_files, q_query_text,
        q_llm_stub_roundtrip, q_spelling_merge, q_narrative_split, q_detected_case_type,
    )
}

_FOLD_SQL = "regexp_replace(lower(strip_accents({c})), '[^a-z0-9]', '', 'g')"
_FIELDS_SQL = """SELECT record_id, 'qua_trinh_dieu_tra' AS field, noi_dung_vu_an.qua_trinh_dieu_tra AS t FROM extracted_fields UNION ALL SELECT record_id, 'ket_luan_cac_ben', noi_dung_vu_an.ket_luan_cac_ben FROM extracted_fields UNION ALL SELECT record_id, 'quyet_dinh', quyet_dinh FROM extracted_fields"""
_POINTS_SQL = "SELECT record_id, e.key AS no, e.value AS t FROM (SELECT record_id, unnest(map_entries(nhan_dinh_cua_toa_an)) AS e FROM extracted_fields)"
_MONTHS_SQL = """(SELECT x AS phat_tu, CASE WHEN s = '' OR regexp_matches(s, 'cai tao khong giam giu|an treo|phat tien|canh cao|mien hinh phat|khong phai di tu|khong tu') THEN 0
    ELSE coalesce(CASE WHEN j <> '' THEN coalesce(try_cast(regexp_extract(j, '(\\d{1,3})\\s*nam\\s*(\\d{1,3})\\s*thang', 1) AS INT) * 12 + try_cast(regexp_extract(j, '(\\d{1,3})\\s*nam\\s*(\\d{1,3})\\s*thang', 2) AS INT), try_cast(regexp_extract(j, '(\\d{1,3})\\s*nam', 1) AS INT) * 12, try_cast(regexp_extract(j, '(\\d{1,3})\\s*thang', 1) AS INT), CASE WHEN contains(j, 'chung than') THEN 360 END) END,
      try_cast(regexp_extract(s, '(\\d{1,3})\\s*nam\\s*(\\d{1,3})\\s*thang\\s*tu\\b', 1) AS INT) * 12 + try_cast(regexp_extract(s, '(\\d{1,3})\\s*nam\\s*(\\d{1,3})\\s*thang\\s*tu\\b', 2) AS INT), try_cast(regexp_extract(s, '(\\d{1,3})\\s*nam\\s*tu\\b', 1) AS INT) * 12, try_cast(regexp_extract(s, '(\\d{1,3})\\s*thang\\s*tu\\b', 1) AS INT),
      CASE WHEN contains(s, 'chung than') THEN 360 END, try_cast(regexp_extract(s, '(\\d{1,3})\\s*nam\\s*(\\d{1,3})\\s*thang', 1) AS INT) * 12 + try_cast(regexp_extract(s, '(\\d{1,3})\\s*nam\\s*(\\d{1,3})\\s*thang', 2) AS INT), try_cast(regexp_extract(s, '(\\d{1,3})\\s*nam', 1) AS INT) * 12, try_cast(regexp_extract(s, '(\\d{1,3})\\s*thang', 1) AS INT), 0) END::BIGINT AS months
   FROM (SELECT x, s, regexp_extract(s, 'tong hop[^.;,:\\n]*') AS j FROM (SELECT DISTINCT x, trim(regexp_replace(regexp_replace(lower(strip_accents(x)), '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS s FROM ({src}))))"""
_ALIGN_SQL = f"""SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.name_key, b.name_key) AS name_key, a.a, b.b, CASE WHEN a.a IS NULL THEN 'pred_only' WHEN b.b IS NULL THEN 'gt_only' ELSE 'matched' END AS state
  FROM (SELECT record_id, {_FOLD_SQL.format(c='bi_cao')} AS name_key, max(mention_id) AS a FROM ({PROPOSALS_SQL}) GROUP BY 1, 2 HAVING {_FOLD_SQL.format(c='any_value(bi_cao)')} <> '') a
  FULL OUTER JOIN (SELECT record_id, {_FOLD_SQL.format(c='bi_cao')} AS name_key, max(mention_id) AS b FROM ({VERDICTS_SQL}) GROUP BY 1, 2 HAVING {_FOLD_SQL.format(c='any_value(bi_cao)')} <> '') b ON a.record_id = b.record_id AND a.name_key = b.name_key"""
_FINDING_SQL = "regexp_matches(t, '(?i)" + "|".join(documents.FINDINGS) + "')"
_NORM_SQL = "lower(trim(regexp_replace(regexp_replace({c}, '[\\s\\x{{a0}}]+', ' ', 'g'), '^ | $', '', 'g')))"

_HEAD_SQL = "upper(replace(replace(strip_accents(trim(regexp_replace(regexp_replace(trim({c}), '^#{{1,6}}\\s*', ''), '[*\\\\]', '', 'g'))), 'đ', 'd'), 'Đ', 'D'))"


def _case_type_sql() -> str:
    """The header is the first line of a text; without one the first 3000 characters decide."""
    h, n = _HEAD_SQL.format(c="h"), _HEAD_SQL.format(c="substr(text, 1, 3000)")
    return f"""SELECT source, CASE WHEN h <> '' THEN CASE WHEN contains({h}, 'PHUC THAM') THEN 'phuc_tham' WHEN contains({h}, 'SO THAM') THEN 'so_tham' WHEN contains({h}, 'KHANG CAO') OR contains({h}, 'KHANG NGHI') THEN 'phuc_tham' ELSE 'unknown' END
        WHEN contains({n}, 'BAN AN') AND contains({n}, 'SO THAM') THEN 'phuc_tham' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT *, split_part(text, chr(10), 1) AS h FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2"""


SQL = {
    "q_detected_case_type": _case_type_sql(),
    "q_chunk_documents": _PACK_SQL.format(src="SELECT doc_id AS id, text AS t FROM documents") + " SELECT id AS doc_id, id || '__text__' || lpad((i - 1)::VARCHAR, 3, '0') AS chunk_id, length(c) AS n, md5(c) AS digest FROM (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM c)",
    "q_chunk_stats": _PACK_SQL.format(src=f"SELECT record_id || field AS id, t FROM ({_FIELDS_SQL})") + " SELECT regexp_extract(id, '[a-z_]+$') AS field, count(*) AS n_texts, CAST(sum(len(cs)) AS BIGINT) AS n_chunks, max(len(cs)) AS most FROM c GROUP BY 1",
    "q_incremental_antijoin": "SELECT vec_id, doc_id FROM chunk_vectors WHERE coalesce(source_type, '') <> 'law' AND doc_id NOT IN (SELECT record_id::VARCHAR FROM documents WHERE record_id IS NOT NULL)",
    "q_split_train_test": """WITH f AS (SELECT record_id, regexp_replace(filename, '\\.[^.]*$', '') AS stem FROM extracted_fields), k AS (SELECT *, row_number() OVER (ORDER BY md5('42' || stem), record_id) AS r FROM f)
        SELECT record_id, stem, r <= (SELECT greatest(1, round_even(count(*) * 0.1, 0)) FROM f) AS is_test FROM k""",
    "q_field_success_rates": " UNION ALL ".join(
        f"SELECT '{n}' AS field, count(*) FILTER ({c}) AS filled, round(100 * count(*) FILTER ({c}) / count(*), 1) AS percent FROM extracted_fields"
        for n, c in (("danh_sach_bi_cao", "len(danh_sach_bi_cao) > 0"), ("ket_luan_cac_ben", "trim(noi_dung_vu_an.ket_luan_cac_ben) <> ''"), ("nguoi_tham_gia", "trim(nguoi_tham_gia) <> ''"), ("nhan_dinh_cua_toa_an", "cardinality(nhan_dinh_cua_toa_an) > 0"), ("quyet_dinh", "trim(quyet_dinh) <> ''"))
    ),
    "q_case_type_distribution": "SELECT coalesce(case_type, 'unknown') AS case_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM extracted_fields GROUP BY 1",
    "q_empty_fields": f"""SELECT mention_id, record_id, 'bi_cao' AS source, 'ho_ten' AS field FROM ({PEOPLE_SQL}) WHERE trim(coalesce(ho_ten, '')) = '' UNION ALL SELECT mention_id, record_id, 'de_nghi', 'phat_tu' FROM ({PROPOSALS_SQL}) WHERE trim(coalesce(phat_tu, '')) = ''
        UNION ALL SELECT mention_id, record_id, 'phan_quyet', 'phat_tu' FROM ({VERDICTS_SQL}) WHERE trim(coalesce(phat_tu, '')) = ''""",
    "q_count_mismatch": f"""WITH l AS (SELECT record_id AS doc_id, 'a' AS l, ho_ten AS name FROM ({PEOPLE_SQL}) UNION ALL SELECT record_id, 'b', bi_cao FROM ({PROPOSALS_SQL}) UNION ALL SELECT record_id, 'c', bi_cao FROM ({VERDICTS_SQL})),
        d AS (SELECT DISTINCT doc_id, l, {_NORM_SQL.format(c='name')} AS name FROM l WHERE trim(name) <> ''), c AS (SELECT doc_id, count(*) FILTER (l = 'a') AS n_a, count(*) FILTER (l = 'b') AS n_b, count(*) FILTER (l = 'c') AS n_c FROM d GROUP BY 1) SELECT * FROM c WHERE n_a <> n_b OR n_b <> n_c""",
    "q_duplicate_names": f"""SELECT doc_id, trim(regexp_replace(name, '[\\s\\x{{a0}}]+', ' ', 'g')) AS name, count(*) AS n FROM (SELECT record_id AS doc_id, bi_cao AS name FROM ({PROPOSALS_SQL}) UNION ALL SELECT record_id, bi_cao FROM ({VERDICTS_SQL})) WHERE trim(regexp_replace(name, '[\\s\\x{{a0}}]+', ' ', 'g')) <> '' GROUP BY 1, 2 HAVING count(*) > 1""",
    "q_quarantine_union": """WITH e AS (SELECT record_id, regexp_replace(filename, '__dup_[0-9]+', '') AS file, filename AS path, coalesce(len(danh_sach_bi_cao), 0) = 0 OR nguoi_tham_gia IS NULL OR case_type IS NULL AS bad FROM extracted_fields), b AS (SELECT DISTINCT file FROM e WHERE bad),
        m AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY path) - 1 AS n FROM e WHERE file IN (SELECT file FROM b))
        SELECT record_id, 'kept' AS state, file AS target FROM e WHERE file NOT IN (SELECT file FROM b) UNION ALL SELECT record_id, 'moved', CASE WHEN n = 0 THEN file ELSE regexp_replace(file, '\\.[^.]*$', '') || '__dup_' || n || regexp_extract(file, '\\.[^.]*$') END FROM m""",
    "q_keyword_triple": f"""WITH p AS (SELECT record_id, max(contains(lower(t), 'tình tiết giảm nhẹ')::INT) + max(contains(lower(t), 'tình tiết tăng nặng')::INT) + max(contains(lower(t), 'xử lý vật chứng')::INT) AS n FROM ({_POINTS_SQL}) GROUP BY 1)
        SELECT count(*) FILTER (n > 0) AS any_of, count(*) FILTER (n = 3) AS all_of, count(*) FILTER (n = 0) AS none_of FROM p""",
    "q_reasoning_extract": f"""WITH p AS (SELECT record_id, regexp_extract(no, '[0-9]+')::INT AS i, t FROM ({_POINTS_SQL}) WHERE no <> '[1]')
        SELECT record_id, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER ({_FINDING_SQL}), '')) AS summary, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (contains(lower(t), 'tình tiết giảm nhẹ')), '')) AS giam_nhe, md5(coalesce(string_agg(t, chr(10) || chr(10) ORDER BY i) FILTER (contains(lower(t), 'tình tiết tăng nặng')), '')) AS tang_nang FROM p GROUP BY 1""",
    "q_any_regex": f"SELECT found, count(*) AS n FROM (SELECT record_id, bool_or({_FINDING_SQL}) AS found FROM ({_POINTS_SQL}) GROUP BY 1) GROUP BY 1",
    "q_summary_validity": "WITH d AS (SELECT source, trim(regexp_replace(coalesce(text, ''), '[\\s\\x{85}\\x{a0}]+', ' ', 'g')) AS f FROM documents), o AS (SELECT source, length(f) >= 80 AND NOT (contains(f, '*') OR contains(f, '```') OR " + " OR ".join(f"contains(lower(f), '{n}')" for n in documents.NOISE) + ") AS ok FROM d) SELECT source, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid FROM o GROUP BY 1",
    "q_line_quality": """WITH l AS (SELECT trim(unnest(string_split(own_text, chr(10)))) AS s FROM law_nodes WHERE own_text IS NOT NULL) SELECT count(*) AS n_lines, count(*) FILTER (regexp_matches(s, '(?i)(?:Điều này|Khoản này|Điểm này|Theo quy định)')) AS possible_footnotes, count(*) FILTER (length(s) <= 3) AS too_short,
        count(*) FILTER (regexp_matches(s, '^\\d+[.)]?$')) AS numeric_only, count(*) FILTER (regexp_matches(s, '^[^a-zA-ZĐđ]+$')) AS weird_symbols, count(*) FILTER (NOT regexp_matches(s, '^(?:Chương|Điều|Khoản|Điểm|[A-ZĐ])')) AS missing_structure, count(*) FILTER (regexp_matches(s, '^[a-zđ]')) AS suspicious_lowercase_start FROM l""",
    "q_section_items": """WITH l AS (SELECT record_id AS doc_id, unnest(string_split(quyet_dinh, chr(10))) AS line, generate_subscripts(string_split(quyet_dinh, chr(10)), 1) - 1 AS n FROM extracted_fields),
        s AS (SELECT *, sum(regexp_matches(line, '^\\d{1,2}\\. ')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS seg FROM l)
        SELECT doc_id, regexp_extract(arg_min(line, n), '^(\\d{1,2})\\. ', 1) AS item, min(n) AS start_line, max(n) AS end_line, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM s WHERE seg > 0 GROUP BY doc_id, seg""",
    "q_point_map_append": f"""WITH p AS (SELECT record_id AS doc_id, regexp_extract(no, '[0-9]+')::INT AS pos, t FROM ({_POINTS_SQL})) SELECT doc_id, (pos % 3)::BIGINT AS no, md5(string_agg(t, chr(10) || chr(10) ORDER BY pos)) AS digest FROM p GROUP BY 1, 2""",
    "q_defendant_entries": "SELECT record_id AS doc_id, generate_subscripts(danh_sach_bi_cao, 1) AS pos, generate_subscripts(danh_sach_bi_cao, 1) || '. ' || unnest(danh_sach_bi_cao) AS entry FROM extracted_fields WHERE len(danh_sach_bi_cao) > 0",
    "q_full_outer_align": _ALIGN_SQL,
    "q_sentence_months": "SELECT phat_tu, months FROM " + _MONTHS_SQL.replace("{src}", f"SELECT phat_tu AS x FROM ({VERDICTS_SQL}) WHERE phat_tu IS NOT NULL"),
    "q_rmse_macro": f"""WITH j AS ({_ALIGN_SQL}), m AS (SELECT * FROM {_MONTHS_SQL.replace('{src}', f"SELECT phat_tu AS x FROM ({VERDICTS_SQL}) WHERE phat_tu IS NOT NULL UNION SELECT phat_tu FROM ({PROPOSALS_SQL}) WHERE phat_tu IS NOT NULL")}),
        d AS (SELECT j.record_id, (coalesce(ma.months, 0) - coalesce(mb.months, 0))::DOUBLE AS d FROM j LEFT JOIN ({PROPOSALS_SQL}) a ON a.mention_id = j.a LEFT JOIN ({VERDICTS_SQL}) b ON b.mention_id = j.b LEFT JOIN m ma ON ma.phat_tu = a.phat_tu LEFT JOIN m mb ON mb.phat_tu = b.phat_tu),
        p AS (SELECT record_id, round(sqrt(avg(d * d)), 6) AS rmse FROM d GROUP BY 1) SELECT count(*) AS n, round(avg(rmse), 4) AS macro_rmse FROM p""",
    "q_status_tally": "WITH l AS (SELECT doc, max(CASE WHEN split_part(sig, '-', 1) IN (SELECT dieu FROM law_nodes WHERE law_level = 'dieu') THEN 1 ELSE 0 END) AS in_law FROM (" + LABELS_SQL + """) GROUP BY 1)
        SELECT CASE WHEN record_id IN (SELECT record_id FROM documents WHERE record_id IS NOT NULL) THEN 'already_exists' WHEN noi_dung_vu_an.ket_luan_cac_ben IS NULL THEN 'missing_summary' WHEN coalesce(len(danh_sach_bi_cao), 0) = 0 THEN 'missing_eval_doc'
          WHEN in_law IS NULL THEN 'empty_predicted_articles' WHEN in_law = 0 THEN 'missing_law_context' ELSE 'processed' END AS reason, count(*) AS n FROM extracted_fields LEFT JOIN l ON doc = record_id::VARCHAR GROUP BY 1""",
    "q_size_rollup": "SELECT source, lang, grouping(source)::BIGINT AS all_sources, grouping(lang)::BIGINT AS all_langs, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())",
    "q_json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, 0::BIGINT AS n_unknown FROM events GROUP BY 1",
    "q_fold_text": f"SELECT {_FOLD_SQL.format(c='ho_ten')} AS name_key, count(*) AS n, min(lower(strip_accents(ho_ten))) AS folded FROM (SELECT DISTINCT ho_ten FROM ({PEOPLE_SQL})) GROUP BY 1",
    "q_first_n_files": "SELECT record_id, filename AS file FROM extracted_fields ORDER BY filename LIMIT 25",
    "q_selected_files": "SELECT filename AS file, min(doc_id * 2) AS pos, true AS found FROM documents JOIN extracted_fields USING (record_id) GROUP BY 1 UNION ALL SELECT 'nowhere.md', 5, false",
    "q_query_text": """WITH e AS (SELECT record_id, trim(noi_dung_vu_an.ket_luan_cac_ben) AS a, trim(nguoi_tham_gia) AS b FROM extracted_fields)
        SELECT record_id, md5(concat_ws(chr(10) || chr(10), nullif(a, ''), nullif(b, ''))) AS plain, md5(concat_ws(chr(10) || chr(10), CASE WHEN a <> '' THEN '[ket_luan]' || chr(10) || a END, CASE WHEN b <> '' THEN '[nguoi_tham_gia]' || chr(10) || b END)) AS named,
          concat_ws('|', CASE WHEN coalesce(a, '') = '' THEN 'ket_luan' END, CASE WHEN coalesce(b, '') = '' THEN 'nguoi_tham_gia' END) AS missing FROM e""",
    "q_llm_stub_roundtrip": f"SELECT mention_id AS id, 'offline' AS provider, 'ok' AS status, 1::BIGINT AS n_failed, coalesce(bi_cao, '') AS bi_cao FROM ({VERDICTS_SQL})",
}
