"""Judgments: sections by boundary lines, fields inside sections, rules of quality, label sets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.signatures import article_of, expand
from lexspark.functions.text import heading_norm, is_penal_code, name_norm, strip, strip_diacritics

HEADING_LENGTH = 40
# Folded upper-case words and patterns that mark the boundaries of a judgment.
TRIAL_WORDS = ("XET XU", "TAI TRU SO", "THU LY")
TRIAL_DATE = r"NGAY\s+\d{1,2}\s+THANG\s+\d{1,2}\s+NAM\s+\d{4}|NGAY\s+\d{1,2}/\d{1,2}/\d{4}|(?:TRONG\s+(?:CAC\s+)?|TU\s+)NGAY"
PARTIES = r"^(?:-\s*)?(?:(?:BI|NGUOI\s+BI)\s+HAI|NGUYEN\s+DON\s+DAN\s+SU|BI\s+DON\s+DAN\s+SU|NGUOI\s+LAM\s+CHUNG)\b"
MISSING = (("trial_date", "Bi_cao (trial date line not found)"), ("noi_dung", "NOI_DUNG_VU_AN"), ("nhan_dinh", "NHAN_DINH"), ("quyet_dinh", "QUYET_DINH"))


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, trial_date, lien_quan, noi_dung, nhan_dinh, quyet_dinh, missing) of (doc_id, line_no, line).

    Every boundary is the first matching line at or after the boundary before it (from the start where that is
    absent); the reasoning has three weaker forms to fall back on, the decision must be a heading of its own. Third
    parties count only between the trial date and the narrative. Absent boundaries are null and, but for the
    parties, named in ``missing``. One conditional minimum per boundary and form, chained over one partitioning.
    """
    n = heading_norm(F.col("line"))
    rows = lines.withColumn("n", n).withColumn("heading", F.trim("line").rlike(r"^#{1,6}\s") | (F.length(F.trim(F.regexp_replace("n", r":+$", ""))) <= HEADING_LENGTH))
    whole = Window.partitionBy("doc_id")

    def has(*words: str) -> Column:
        out = F.lit(True)
        for w in words:
            out = out & F.contains("n", F.lit(w))
        return out

    def first(condition: Column, after: Column | None = None) -> Column:
        at = condition if after is None else condition & (F.col("line_no") >= F.coalesce(after, F.lit(0)))
        return F.min(F.when(at, F.col("line_no"))).over(whole)

    trial = (has(TRIAL_WORDS[0]) | has(TRIAL_WORDS[1]) | has(TRIAL_WORDS[2])) & F.col("n").rlike(TRIAL_DATE)
    title = F.regexp_replace(F.regexp_replace("n", r"^\s*[\[(]?\s*\d+\s*[\])]?\s*\.?\s*", ""), r"^VE\s+", "")
    decision = F.col("heading") & F.startswith(F.regexp_replace(title, r"^[: .]+", ""), F.lit("QUYET DINH"))
    rows = rows.withColumn("trial_date", first(trial))
    rows = rows.withColumn("noi_dung", first(has("NOI DUNG", "VU AN"), F.col("trial_date")))
    parties = (has("QUYEN LOI", "LIEN QUAN") | F.col("n").rlike(PARTIES)) & F.col("trial_date").isNotNull()
    rows = rows.withColumn("lien_quan", first(parties, F.col("trial_date")))
    forms = [first(c, F.col("noi_dung")) for c in (has("NHAN DINH", "TOA AN"), has("NHAN DINH", "HOI DONG"), has("NHAN DINH") & F.col("heading"), has("NHAN DINH NHU SAU"))]
    rows = rows.withColumn("nhan_dinh", F.coalesce(*forms))
    rows = rows.withColumn("quyet_dinh", first(decision, F.col("nhan_dinh")))
    names = ("trial_date", "lien_quan", "noi_dung", "nhan_dinh", "quyet_dinh")
    out = rows.groupBy("doc_id").agg(*[F.first(x).alias(x) for x in names])
    between = F.col("noi_dung").isNull() | ((F.col("trial_date") < F.col("lien_quan")) & (F.col("lien_quan") < F.col("noi_dung")))
    missing = F.array_compact(F.array(*[F.when(F.col(x).isNull(), F.lit(shown)) for x, shown in MISSING]))
    return out.withColumn("lien_quan", F.when(between, F.col("lien_quan"))).withColumn("missing", missing)


def section_texts(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, section, text): what stands between the boundaries of the documents that miss none."""
    ends = bounds.where(F.size("missing") == 0)
    rows = lines.join(ends, "doc_id")
    at = F.col("line_no")
    section = (
        F.when(at >= F.col("quyet_dinh"), "QUYET_DINH")
        .when(at >= F.col("nhan_dinh"), "NHAN_DINH")
        .when(at >= F.col("noi_dung"), "NOI_DUNG_VU_AN")
        .when(at >= F.col("lien_quan"), "Lien_quan")
        .when(at >= F.col("trial_date"), "Bi_cao")
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = rows.withColumn("section", section).where("section is not null").groupBy("doc_id", "section").agg(strip(text).alias("text"))
    return out.where("text <> ''")


# Fixed value: how a reasoning point begins.
POINT = r"^\s*(?:#{1,6}\s*)?(?:[-*+]\s*)?(?:\*\*)?\[\s*(\d+)\s*\](?:\*\*)?\s*(?:[.)\-:]\s*)?"


def reasoning_points(lines: DataFrame) -> DataFrame:
    """(doc_id, no, text) of reasoning lines (doc_id, line_no, line); a text without markers is point [1].

    Points without text are dropped, repeated numbers appended.
    """
    marked = slices(lines, POINT).select("doc_id", F.col("start_line").alias("pos"), F.concat(F.lit("["), "item", F.lit("]")).alias("no"), strip(F.regexp_replace("body", POINT, "")).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    plain = lines.groupBy("doc_id").agg(F.bool_or(F.col("line").rlike(POINT)).alias("any"), strip(whole).alias("text")).where("not any and text <> ''")
    return point_map(marked.where("text <> ''")).unionByName(plain.select("doc_id", F.lit("[1]").alias("no"), "text"))


def slices(lines: DataFrame, marker: str) -> DataFrame:
    """(doc_id, item, start_line, end_line, body): what stands from one marked line to the next.

    ``marker`` is a pattern whose first group is the item's name; lines before the first marker are dropped.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumn("mark", F.col("line").rlike(marker))
    rows = rows.withColumn("seg", F.sum(F.col("mark").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("seg > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    out = rows.groupBy("doc_id", "seg").agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), body.alias("body"))
    return out.select("doc_id", F.regexp_extract("head", marker, 1).alias("item"), "start_line", "end_line", "body")


def point_map(points: DataFrame) -> DataFrame:
    """(doc_id, no, text) with the texts of repeated numbers appended in order, separated by a blank line."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return points.groupBy("doc_id", "no").agg(F.array_join(parts, "\n\n").alias("text"))


def case_type(header: Column, narrative: Column) -> Column:
    """phuc_tham, so_tham or unknown, by the header; without one, by the first 3000 characters of the narrative."""
    h, n = heading_norm(header), heading_norm(F.substring(narrative, 1, 3000))

    def has(c: Column, word: str) -> Column:
        return F.contains(c, F.lit(word))

    by_header = F.when(has(h, "PHUC THAM"), "phuc_tham").when(has(h, "SO THAM"), "so_tham").when(has(h, "KHANG CAO") | has(h, "KHANG NGHI"), "phuc_tham").otherwise("unknown")
    by_narrative = F.when(has(n, "BAN AN") & has(n, "SO THAM"), "phuc_tham").otherwise("unknown")
    return F.when(F.coalesce(header, F.lit("")) != "", by_header).otherwise(by_narrative)


# How an entry of a defendant list begins, what shows a birth date, and the closing remark on all.
_NUMBERED = re.compile(r"^[-\s]*(?:\*\*)?\d+\s*[.)]\s*", re.M)
_BIRTH = re.compile(r"sinh\s+(?:ngày|năm)", re.I)
_ALL_OF_THEM = re.compile(r"\n\s*\(\s*[Cc]ác\s+bị\s+cáo\s+.*?\)\s*$")
_NAME = re.compile(r"^[-\s]*(?:\*\*)?(?:\d+\s*[.)]\s*)?(?:Họ\s+và\s+tên|Bị\s+cáo)?\s*:?\s*(?P<name>[^\n,;(*]+)", re.I)


def defendants(texts: DataFrame) -> DataFrame:
    """(doc_id, pos, entry, name): the defendants of a list (doc_id, t), numbered blocks with a birth date near by.

    Without numbers the whole text is one entry; a closing remark on all of them is dropped. Null and blank give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, text in zip(b["doc_id"], b["t"], strict=True):
                if not text or not text.strip():
                    continue
                text = text.strip()
                starts = [m.start() for m in _NUMBERED.finditer(text) if _BIRTH.search(text, m.start(), m.start() + 500)]
                blocks = [text[a:e] for a, e in zip(starts, [*starts[1:], len(text)], strict=True)] if starts else [text]
                entries = [e for x in blocks if (e := _ALL_OF_THEM.sub("", x.strip()).strip())]
                out += [(rid, k, e, m["name"].strip() if (m := _NAME.match(e)) else None) for k, e in enumerate(entries, 1)]
            yield pd.DataFrame(out, columns=["doc_id", "pos", "entry", "name"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "t").mapInPandas(run, f"doc_id {kind}, pos int, entry string, name string")


# Where the indictment begins, in order of preference; the second list is for folded text.
INDICTMENT = (
    r"(?:tại\s+)?(?:bản\s+)?cáo\s+trạng(?:\s+số)?\s*[:\.]?\s*\d",
    r"(?:tại\s+)?(?:bản\s+)?cáo\s+trạng(?:\s+của)?\s+viện\s+kiểm\s+sát",
    r"đại\s+di[ệễ]n\s+viện\s+kiểm\s+sát.*?(?:phát\s+biểu|thực\s+hành|có\s+ý\s+kiến|giữ\s+nguyên|rút|tham\s+gia)",
    r"tại\s+phiên\s+tò?a(?:.*?đại\s+di[ệễ]n)?\s+viện\s+kiểm\s+sát",
)
INDICTMENT_FOLDED = (
    r"(?:tai\s+)?(?:ban\s+)?cao\s+trang(?:\s+so)?\s*[:\. ]*\d",
    r"(?:tai\s+)?(?:ban\s+)?cao\s+trang(?:\s+cua)?\s+vien\s+kiem\s+sat",
    r"dai\s+dien\s+vien\s+kiem\s+sat.*?(?:phat\s+bieu|thuc\s+hanh|co\s+y\s+kien|giu\s+nguyen|rut|tham\s+gia)",
    r"tai\s+phien\s+toa(?:.*?dai\s+dien)?\s+vien\s+kiem\s+sat",
)


def narrative_parts(text: Column) -> Column:
    """struct(before, after) the indictment, each null where empty; without one all is before.

    The first pattern that occurs decides, accented ones before folded ones. Text must be composed (NFC).
    """
    title = F.regexp_replace(text, r"(?iu)^(?:#{1,6}\s*)?(?:\*{1,2})?N[ỘÔO]I\s+DUNG\s+V[ỤU]\s+[AÁ]N\s*:?\s*(?:\*{1,2})?\s*\n?", "")
    low = F.lower(strip_diacritics(title))
    places = [F.nullif(F.regexp_instr(title, F.lit(f"(?ius){p}")), F.lit(0)) for p in INDICTMENT]
    places += [F.nullif(F.regexp_instr(low, F.lit(f"(?s){p}")), F.lit(0)) for p in INDICTMENT_FOLDED]
    at = F.coalesce(*places)
    before = F.when(at.isNotNull(), F.substring(title, F.lit(1), at - 1)).otherwise(title)
    after = F.when(at.isNotNull(), F.substring(title, at, F.length(title)))
    return F.struct(F.nullif(strip(before), F.lit("")).alias("before"), F.nullif(strip(after), F.lit("")).alias("after"))


def label_sets(items: DataFrame) -> DataFrame:
    """(doc_id, signatures, articles, errors) of legal-basis items (doc_id, dieu, khoan, diem, source, n_verdicts, n_items, is_item).

    ``n_verdicts`` and ``n_items`` are null where what stands there is no list, ``is_item`` is false where an item is
    no object; it may be left out.

    One bad item spoils its document: ``errors`` lists the distinct codes, and only documents without any keep their
    labels. Items of other sources are passed over before their article is looked at.
    """
    penal = is_penal_code(F.col("source"))
    sigs = expand(F.col("dieu"), F.col("khoan"), F.col("diem"))
    is_item = F.coalesce("is_item", F.lit(False)) if "is_item" in items.columns else F.lit(True)
    error = (
        F.when(F.col("n_verdicts").isNull(), "verdict_invalid_type")
        .when(F.col("n_verdicts") == 0, "verdict_empty")
        .when(F.col("n_items").isNull(), "basis_invalid_type")
        .when(F.col("n_items") == 0, "basis_empty")
        .when(~is_item, "basis_item_not_object")
        .when(penal & (F.size(sigs) == 0), "missing_dieu")
    )
    rows = items.select("doc_id", error.alias("error"), F.when(penal & error.isNull(), sigs).otherwise(F.array().cast("array<string>")).alias("sigs"))
    grouped = rows.groupBy("doc_id").agg(F.collect_set("error").alias("errors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sigs")))).alias("signatures"))
    errors = F.when((F.size("errors") == 0) & (F.size("signatures") == 0), F.array(F.lit("no_labels_extracted"))).otherwise(F.array_sort("errors"))
    good = F.size(errors) == 0
    arts = F.array_sort(F.array_distinct(F.transform("signatures", article_of)))
    return grouped.select("doc_id", F.when(good, F.col("signatures")).alias("signatures"), F.when(good, arts).alias("articles"), errors.alias("errors"))


def count_mismatch(lists: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_c) where the numbers of distinct names of three lists (doc_id, list, name) are not equal."""
    named = lists.where(F.trim("name") != "").select("doc_id", "list", name_norm(F.col("name")).alias("name")).distinct()
    counts = named.groupBy("doc_id").agg(*[F.count_if(F.col("list") == x).alias(f"n_{x}") for x in "abc"])
    return counts.where("n_a <> n_b or n_b <> n_c")


def repeated_names(names: DataFrame) -> DataFrame:
    """(doc_id, name, n): names that one document (doc_id, name) lists more than once, case kept."""
    clean = names.select("doc_id", F.trim(F.regexp_replace("name", r"(?U)\s+", " ")).alias("name")).where("name <> ''")
    return clean.groupBy("doc_id", "name").agg(F.count("*").alias("n")).where("n > 1")


# Phrases of planning notes that a clean summary does not hold.
NOISE = (
    "role:",
    "audience:",
    "short/complete",
    "paragraph format",
    "no bullet points",
    "no bold text",
    "summarize the events",
    "defendant (",
    "drafting (",
    "refining for",
    "applying constraints",
    "vietnamese translation/polishing",
)
# Beginnings of lines that are planning notes.
NOISY_LINES = (
    r"[*-]\s+",
    r"Role\s*:",
    r"Audience\s*:",
    r"Short/Complete\s*\?",
    r"Paragraph format\s*\?",
    r"No bullet points\s*\?",
    r"No bold text\s*\?",
    r"Defendant\s*\(",
    r"Lawyer\.?$",
    r"Summarize the events",
    r"Tone\s*:",
    r"Drafting\s*\(",
    r"Refining for",
    r"Applying constraints",
    r"Vietnamese Translation/Polishing",
)


def summary_is_valid(text: Column) -> Column:
    """At least 80 characters after white space is collapsed, no planning phrase, star or fence; false for null."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    noisy = F.contains(flat, F.lit("*")) | F.contains(flat, F.lit("```"))
    for n in NOISE:
        noisy = noisy | F.contains(F.lower(flat), F.lit(n))
    return (F.length(flat) >= 80) & ~noisy


def line_classes(line: Column) -> list[Column]:
    """Six boolean classes of a statute line, which do not exclude each other."""
    s = strip(line)
    return [
        s.rlike(r"(?iu)(?:Điều này|Khoản này|Điểm này|Theo quy định)").alias("possible_footnotes"),
        (F.length(s) <= 3).alias("too_short"),
        s.rlike(r"^\d+[.)]?$").alias("numeric_only"),
        s.rlike(r"^[^a-zA-ZĐđ]+$").alias("weird_symbols"),
        (~s.rlike(r"^(?:Chương|Điều|Khoản|Điểm|[A-ZĐ])")).alias("missing_structure"),
        s.rlike(r"^[a-zđ]").alias("suspicious_lowercase_start"),
    ]


# Sentences in which a court sums up its findings, and the words of the three kinds of reasoning.
FINDINGS = (
    r"(?:đã\s+)?(?:có\s+)?đủ\s+(?:c[ơo]\s*s[ởo]|c[ăa]n\s*c[ứu]|chứng\s*cứ)\s+(?:để\s+)?(?:kết\s*lu[ậaâ]n|xác\s*định|khẳng\s*định)",
    r"(?:hội\s*đồng\s*xét\s*xử|hđxx)\s*(?:nhận|xét)?\s*thấy",
    r"xét\s*thấy\s*(?:có\s+)?đủ\s+(?:c[ơo]\s*s[ởo]|c[ăa]n\s*c[ứu])",
    r"(?:đã\s+|có\s+)?đủ\s*yếu\s*tố\s*cấu\s*thành",
    r"xét\s*(?:hành\s*vi\s*phạm\s*tội|lời\s*khai)",
)
MITIGATING, AGGRAVATING, EXHIBITS = "tình tiết giảm nhẹ", "tình tiết tăng nặng", "xử lý vật chứng"


def is_finding(text: Column) -> Column:
    """Whether any of the patterns of findings occurs; false for null."""
    return F.coalesce(text.rlike("(?iu)" + "|".join(FINDINGS)), F.lit(False))


def merge_words(pairs: DataFrame) -> DataFrame:
    """(id, merged): words of ``old`` replaced by those of ``new`` (id, old, new) where the change is trusted.

    Words are aligned; only one-to-one and one-to-two replacements with few edits are taken, insertions and deletions
    are ignored, and a suggestion with less than 60 % of the words is refused as a whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            out = []
            for rid, old, new in zip(b["id"], b["old"], b["new"], strict=True):
                a, c = (old or "").split(), (new or "").split()
                if len(c) < 0.6 * len(a):
                    out.append((rid, old))
                    continue
                words: list[str] = []
                for op, i1, i2, j1, j2 in SequenceMatcher(None, a, c, autojunk=False).get_opcodes():
                    if op == "replace" and i2 - i1 == j2 - j1:
                        words += [y if _few_edits(x, y) else x for x, y in zip(a[i1:i2], c[j1:j2], strict=True)]
                    elif op == "replace" and i2 - i1 == 1 and j2 - j1 == 2 and _few_edits(a[i1], c[j1] + c[j1 + 1], 0.35):
                        words += c[j1:j2]
                    else:
                        words += a[i1:i2]
                out.append((rid, " ".join(words)))
            yield pd.DataFrame(out, columns=["id", "merged"])

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "old", "new").mapInPandas(run, f"id {kind}, merged string")


def _few_edits(x: str, y: str, limit: float = 0.4) -> bool:
    if x.rstrip(".,;:!?") == y.rstrip(".,;:!?"):
        return False
    last = list(range(len(y) + 1))
    for i, p in enumerate(x.lower(), 1):
        now = [i]
        for j, q in enumerate(y.lower(), 1):
            now.append(min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (p != q)))
        last = now
    return last[-1] <= 2 and last[-1] / max(len(x), 1) < limit


def clean_summary(text: Column) -> Column:
    """A generated summary without fence, what stands before its last salutation, and planning notes; one line."""
    from lexspark.functions.text import collapse, unfence

    body = unfence(F.coalesce(text, F.lit("")))
    parts = F.split(body, "(?=Thưa luật sư)")
    last = F.when(F.contains(body, F.lit("Thưa luật sư")), F.element_at(parts, -1)).otherwise(body)
    noisy = r"(?iu)^\s*(?:" + "|".join(NOISY_LINES) + ")"
    return collapse(F.array_join(F.filter(F.split(last, "\n"), lambda x: ~x.rlike(noisy)), " "))
