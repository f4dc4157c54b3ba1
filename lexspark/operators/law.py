"""Statutes: lines to a hierarchy, ancestor texts, citations looked up by level, cross-references."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.signatures import lookup_key, parse

# How a line begins a chapter, an article, a clause and a point.
CHAPTER = r"(?iu)^Chương\s*(?:([IVXLCDM]+)(?:\s+|-|:|\.|$))?(.*)$"
ARTICLE = r"(?iu)^Điều\s+(\d+[a-zđ]*)\.?\s*(.*)$"
CLAUSE = r"^(\d{1,2})\.(?!\d)\s*(.*)$"
POINT = r"^([a-zđ])\)(?:\d+)?\s*(.*)$"
# Where a paragraph of a statute breaks into lines, and lines that are footnotes.
BREAKS = (
    (r"(?iu)\s*\t\s*(?=Điều\s+\d+|Chương\s+[IVXLCDM]+)", "\n"),
    (r"\s*\t\s*(?=\d{1,2}\.(?!\d)\s|[a-zđ]\)(?:\d+)?\s)", "\n"),
    (r"(?<=[.;:])\s+(?=\d{1,2}\.(?!\d)\s|[a-zđ]\)(?:\d+)?\s)", "\n"),
    (r"(?iu)(?<!\bđiều)(?<!\bkhoản)(?<!\bchương)(?<!\bđiểm)(?<=\p{L})\s+(?=\d{1,2}\.(?!\d)\s)", "\n"),
    (r"(?iu)(^|\n)(Chương|Điều|Khoản|Điểm)\s*\n\s*", "$1$2 "),
)
FOOTNOTE = r"(?iu)^(?:\d+\s*(?:Điều này|Khoản này|Điểm này|Cụm từ|Từ|Chữ|Bãi bỏ|Sửa đổi|Bổ sung|Thay thế|Theo quy định).*|\d+)$"


def clean_lines(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of statute paragraphs (doc_id, para_no, t): merged lines cut, footnotes dropped.

    Reference marks in brackets go; blank and null paragraphs give no lines. ``line_no`` follows the order of the
    paragraphs and need not be dense.
    """
    text = F.regexp_replace("t", r"\[\d+\]", "")
    for pattern, into in BREAKS:
        text = F.regexp_replace(text, pattern, into)
    lines = paragraphs.select("doc_id", "para_no", F.posexplode(F.split(text, "\n")).alias("part", "line"))
    kept = lines.select("doc_id", (F.col("para_no").cast("long") * (1 << 20) + F.col("part")).alias("line_no"), F.trim("line").alias("line"))
    return kept.where((F.col("line") != "") & ~F.col("line").rlike(FOOTNOTE))


def hierarchy(lines: DataFrame) -> DataFrame:
    """(doc_id, chuong, dieu, khoan, diem, level, start_line, own_text) of lines (doc_id, line_no, line).

    A marker opens a node and closes the nodes below its level; any other line continues the deepest open node. A
    clause outside an article and a point outside a clause are continuations; lines before the first chapter or
    article are dropped; an article before any chapter belongs to chapter Unknown. Nested running sums replace the
    line-by-line state; a document is one window partition.
    """
    line = F.trim("line")
    kind = F.when(line.rlike(CHAPTER), 1).when(line.rlike(ARTICLE), 2).when(line.rlike(CLAUSE), 3).when(line.rlike(POINT), 4).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.trim("line") != "").withColumn("kind", kind)
    rows = rows.withColumn("c", F.sum((F.col("kind") == 1).cast("int")).over(order)).withColumn("cd", F.sum(F.col("kind").isin(1, 2).cast("int")).over(order))
    rows = rows.withColumn("in_d", F.max((F.col("kind") == 2).cast("int")).over(Window.partitionBy("doc_id", "cd")))
    inner = Window.partitionBy("doc_id", "cd").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ks", F.sum(((F.col("kind") == 3) & (F.col("in_d") == 1)).cast("int")).over(inner))
    last = Window.partitionBy("doc_id", "cd", "ks").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ds", F.sum(((F.col("kind") == 4) & (F.col("ks") > 0)).cast("int")).over(last))
    rows = rows.where((F.col("c") > 0) | (F.col("in_d") == 1))
    text = F.when(F.col("kind") == 2, F.regexp_extract(line, ARTICLE, 2)).when((F.col("kind") == 3) & (F.col("in_d") == 1), F.regexp_extract(line, CLAUSE, 2)).when((F.col("kind") == 4) & (F.col("ks") > 0), F.regexp_extract(line, POINT, 2)).when(F.col("kind") == 1, F.regexp_replace(F.regexp_extract(line, CHAPTER, 2), r"^[ \-.:\t]+|[ \-.:\t]+$", "")).otherwise(line)
    rows = rows.withColumn("body", F.trim(text))
    index = F.when(F.col("kind") == 1, F.coalesce(F.nullif(F.upper(F.regexp_extract(line, CHAPTER, 1)), F.lit("")), F.lit("Unknown"))).when(F.col("kind") == 2, F.regexp_extract(line, ARTICLE, 1)).when(F.col("kind") == 3, F.regexp_extract(line, CLAUSE, 1)).when(F.col("kind") == 4, F.regexp_extract(line, POINT, 1))
    nodes = rows.withColumn("index", index).groupBy("doc_id", "c", "cd", "in_d", "ks", "ds").agg(
        F.min("line_no").alias("start_line"),
        F.min_by("index", "line_no").alias("index"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]).alias("texts"),
    )
    own_text = F.array_join(F.filter("texts", lambda x: x != ""), "\n").alias("own_text")
    level = F.when(F.col("ds") > 0, "diem").when(F.col("ks") > 0, "khoan").when(F.col("in_d") == 1, "dieu").otherwise("chuong")
    nodes = nodes.withColumn("level", level)

    def carried(name: str, *keys: str) -> Column:
        return F.max(F.when(F.col("level") == name, F.col("index"))).over(Window.partitionBy("doc_id", *keys))

    nodes = nodes.withColumn("chuong", F.coalesce(carried("chuong", "c"), F.lit("Unknown")))
    nodes = nodes.withColumn("dieu", F.when(F.col("in_d") == 1, carried("dieu", "cd"))).withColumn("khoan", F.when(F.col("ks") > 0, carried("khoan", "cd", "ks")))
    return nodes.select("doc_id", "chuong", "dieu", "khoan", F.when(F.col("ds") > 0, F.col("index")).alias("diem"), "level", "start_line", own_text)


def _shown(kind: str, index: Column, text: Column) -> Column:
    return F.when(F.trim(text) != "", F.concat(F.lit(f"[{kind} "), index, F.lit("] "), F.trim(text)))


def level_texts(nodes: DataFrame) -> DataFrame:
    """(dieu, khoan, diem, text, level, pos): the labelled text of every article, clause and point with its context.

    ``nodes``: (pos, dieu, khoan, diem, level, own_text) and, where there are several statutes, law_id, which the
    result then has too. An article shows all below it in order, a clause its article's heading and its points, a
    point its ancestors. Of equal indexes the last one wins.
    """
    if "law_id" not in nodes.columns:
        return level_texts(nodes.withColumn("law_id", F.lit(""))).drop("law_id")
    last = Window.partitionBy("law_id", "dieu", "khoan", "diem").orderBy(F.desc("pos"))
    n = nodes.where("dieu is not null").withColumn("n", F.row_number().over(last)).where("n = 1")
    shown = F.when(F.col("level") == "dieu", _shown("dieu", F.col("dieu"), F.col("own_text"))).when(F.col("level") == "khoan", _shown("khoan", F.col("khoan"), F.col("own_text"))).otherwise(_shown("diem", F.col("diem"), F.col("own_text")))
    n = n.select("law_id", "pos", "dieu", "khoan", "diem", "level", shown.alias("shown"))

    def joined(*keys: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("pos", "shown"))))
        return F.array_join(F.transform(parts, lambda x: x["shown"]), "\n")

    def absent(name: str) -> Column:
        return F.lit(None).cast("string").alias(name)

    article, inner = ["law_id", "dieu"], ["law_id", "dieu", "khoan"]
    heads = n.where("level = 'dieu'").select(*article, F.col("shown").alias("head"), F.col("pos").alias("head_pos"))
    clause = n.where("level = 'khoan'").select(*inner, F.col("shown").alias("clause"), F.col("pos").alias("clause_pos"))
    whole = n.groupBy(*article).agg(joined().alias("text")).join(heads, article)
    whole = whole.select(*article, absent("khoan"), absent("diem"), "text", F.lit("dieu").alias("level"), F.col("head_pos").alias("pos"))
    clauses = n.where("khoan is not null").groupBy(*inner).agg(joined().alias("body")).join(clause.drop("clause"), inner).join(heads, article, "left")
    clauses = clauses.select(*inner, absent("diem"), F.concat_ws("\n", "head", F.nullif("body", F.lit(""))).alias("text"), F.lit("khoan").alias("level"), F.col("clause_pos").alias("pos"))
    points = n.where("level = 'diem'").join(heads, article, "left").join(clause, inner, "left")
    points = points.select(*inner, "diem", F.concat_ws("\n", "head", "clause", "shown").alias("text"), F.lit("diem").alias("level"), "pos")
    return whole.unionByName(clauses).unionByName(points)


def node_texts(nodes: DataFrame) -> DataFrame:
    """(dieu, khoan, diem, level, pos, full_text, inherited, chosen) of nodes (pos, dieu, khoan, diem, level, own_text).

    ``full_text`` is a node's own text and all below it in order, ``inherited`` its ancestors' texts and its own, both
    made from the original texts; ``chosen`` is the full text, or the own text where that is blank.
    """
    own = F.nullif(F.trim("own_text"), F.lit(""))
    n = nodes.where("dieu is not null").withColumn("own", own)

    def below(*keys: str) -> Column:
        parts = F.collect_list(F.when(F.col("own").isNotNull(), F.struct("pos", "own"))).over(Window.partitionBy(*keys))
        return F.array_join(F.transform(F.array_sort(parts), lambda x: x["own"]), "\n")

    def above(level: str, *keys: str) -> Column:
        return F.max_by(F.when(F.col("level") == level, F.col("own")), F.when(F.col("level") == level, F.col("pos"))).over(Window.partitionBy(*keys))

    full = F.when(F.col("level") == "dieu", below("dieu")).when(F.col("level") == "khoan", below("dieu", "khoan")).otherwise(F.coalesce("own", F.lit("")))
    head = F.when(F.col("level") != "dieu", above("dieu", "dieu"))
    clause = F.when(F.col("level") == "diem", above("khoan", "dieu", "khoan"))
    out = n.withColumn("full_text", full).withColumn("inherited", F.concat_ws("\n", head, clause, "own"))
    return out.select("dieu", "khoan", "diem", "level", "pos", "full_text", "inherited", F.coalesce(F.nullif("full_text", F.lit("")), F.trim("own_text")).alias("chosen"))


def lookup(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(pos, query, normalized, found, level, reason, dieu, khoan, diem, text) of free-form citations (pos, query).

    ``reason`` is the first level that fails, or the parse error. Input order and repeats stay through ``pos``. The
    three level tables are joined by equality; Spark broadcasts them where they are small. Of indexes that fold to one
    key the last one wins. With a law_id in both, citations and texts of one statute meet.
    """
    if "law_id" not in queries.columns:
        return lookup(queries.withColumn("law_id", F.lit("")), texts.withColumn("law_id", F.lit(""))).drop("law_id")
    q = queries.select("law_id", "pos", "query", parse(F.col("query").cast("string")).alias("p")).select("law_id", "pos", "query", "p.*")
    keyed = texts.select(F.col("law_id").alias("kl"), lookup_key(F.col("dieu")).alias("kd"), lookup_key(F.col("khoan")).alias("kk"), lookup_key(F.col("diem")).alias("km"), "level", "text", F.col("pos").alias("kp"))
    by = {
        "d": keyed.where("level = 'dieu'").groupBy("kl", "kd").agg(F.max_by("text", "kp").alias("td")),
        "k": keyed.where("level = 'khoan'").groupBy("kl", "kd", "kk").agg(F.max_by("text", "kp").alias("tk")),
        "m": keyed.where("level = 'diem'").groupBy("kl", "kd", "kk", "km").agg(F.max_by("text", "kp").alias("tm")),
    }
    j = q.join(by["d"], (q.law_id == by["d"].kl) & (q.dieu == by["d"].kd), "left").drop("kl", "kd")
    j = j.join(by["k"], (j.law_id == by["k"].kl) & (j.dieu == by["k"].kd) & (j.khoan == by["k"].kk), "left").drop("kl", "kd", "kk")
    j = j.join(by["m"], (j.law_id == by["m"].kl) & (j.dieu == by["m"].kd) & (j.khoan == by["m"].kk) & (j.diem == by["m"].km), "left").drop("kl", "kd", "kk", "km")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("td").isNull(), "dieu_not_found").when(F.col("khoan").isNotNull() & F.col("tk").isNull(), "khoan_not_found").when(F.col("diem").isNotNull() & F.col("tm").isNull(), "diem_not_found")
    found = reason.isNull()
    level = F.when(found, F.when(F.col("diem").isNotNull(), "diem").when(F.col("khoan").isNotNull(), "khoan").otherwise("dieu"))
    return j.select("law_id", "pos", "query", "normalized", found.alias("found"), level.alias("level"), reason.alias("reason"), "dieu", "khoan", "diem", F.when(found, F.coalesce("tm", "tk", "td")).alias("text"))


# Levels of a cross-reference from the lowest to the highest, and what may stand between linked ones.
_RANK = {"điểm": 0, "khoản": 1, "điều": 2, "chương": 3}
_MENTION = re.compile(r"(điểm|khoản|điều|chương)\s+((?:\d+[a-zđ]?|[a-zđ](?!\w)|[IVXLC]+(?!\w))(?:\s*(?:,|và|hoặc)\s*(?:\d+[a-zđ]?(?!\w)|[a-zđ](?!\w)|[IVXLC]+(?!\w)))*)", re.I)
_BETWEEN = re.compile(r"\s*(?:của|thuộc|tại|,|và|hoặc|-)?\s*", re.I)


def mentions(texts: DataFrame) -> DataFrame:
    """(id, chain, ord, kind, index): cross-references of texts (id, t), linked ones under one chain number.

    Neighbouring references are linked if only a connecting word stands between them and the level does not fall;
    several indexes after one label word give several rows. Null and empty texts give none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rid, text in zip(b["id"], b["t"], strict=True):
                chain, end, rank = -1, None, None
                for m in _MENTION.finditer(text or ""):
                    kind = m.group(1).lower()
                    linked = end is not None and _BETWEEN.fullmatch(text, end, m.start()) and _RANK[kind] >= rank
                    if not linked:
                        chain, order = chain + 1, 0
                    for index in re.split(r"\s*(?:,|và|hoặc)\s*", m.group(2)):
                        out.append((rid, chain, order, kind, index))
                        order += 1
                    end, rank = m.end(), _RANK[kind]
            yield pd.DataFrame(out, columns=["id", "chain", "ord", "kind", "index"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "t").mapInPandas(run, f"id {kind}, chain int, ord int, kind string, index string")


def citations(text: Column) -> Column:
    """Array of the article numbers that a text cites, in order, with repeats."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?iu)điều\s+(\d+[a-zA-Z]*)"), F.lit(1))


def leaf_chunks(nodes: DataFrame, law_id: str, limit: int = 1500) -> DataFrame:
    """Chunk records of the lowest nodes of a statute, each with the texts of its ancestors.

    ``nodes``: (pos, chuong, chuong_title, dieu, khoan, diem, level, own_text). An article without clauses and a
    clause without points are lowest nodes too. The running number in the id follows reading order, so repeated
    signatures keep ids of their own; it is a window over one statute, not over the collection.
    """
    from lexspark.functions.chunk import sentence_chunks

    def flag(*keys: str) -> Column:
        return F.max(F.col("level") == F.lit("khoan" if keys == ("dieu",) else "diem")).over(Window.partitionBy(*keys))

    n = nodes.where("dieu is not null").withColumn("has_khoan", flag("dieu")).withColumn("has_diem", flag("dieu", "khoan"))
    heads = n.where("level = 'dieu'").select("dieu", F.trim(F.split("own_text", "\n")[0]).alias("head"))
    clause = n.where("level = 'khoan'").select("dieu", "khoan", F.trim("own_text").alias("clause"))
    lowest = n.where("level = 'diem' or (level = 'khoan' and not has_diem) or (level = 'dieu' and not has_khoan)")
    lowest = lowest.join(heads, "dieu", "left").join(clause, ["dieu", "khoan"], "left")
    label = F.concat(F.lit(f"[LAW:{law_id}] [Chuong "), F.coalesce("chuong", F.lit("")), F.lit("] [Dieu "), "dieu", F.lit("]"), F.coalesce(F.concat(F.lit(" [Khoan "), "khoan", F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(" [Diem "), "diem", F.lit("]")), F.lit("")))
    text = F.concat_ws("\n", label, "chuong_title", F.when(F.col("level") == "dieu", F.trim("own_text")).otherwise(F.col("head")), F.when(F.col("level") == "diem", F.col("clause")), F.when(F.col("level") != "dieu", F.trim("own_text")))
    sig = F.concat_ws("-", "dieu", "khoan", "diem")
    parts = lowest.select("pos", "level", "chuong", "dieu", "khoan", "diem", sig.alias("law_signature_full"), F.posexplode(sentence_chunks(text, limit)).alias("chunk_index", "text"))
    ordinal = F.row_number().over(Window.orderBy("pos", "chunk_index")) - 1
    chunk_id = F.format_string(f"law::{law_id}::%s::%s::chuong-%s::%02d::%06d", "level", "law_signature_full", F.coalesce("chuong", F.lit("")), F.col("chunk_index"), ordinal)
    return parts.select(chunk_id.alias("id"), "text", F.lit("law").alias("source_type"), F.lit(law_id).alias("law_id"), F.col("level").alias("law_level"), "dieu", "khoan", "diem", "law_signature_full", "chunk_index")


def mention_signatures(found: DataFrame, fold_kinds: bool = False) -> DataFrame:
    """(id, signatures) of mentions (id, kind, index, default_dieu, default_khoan): sorted, distinct, joined by |.

    Kinds are compared with their unaccented names, as in the reference, so accented ones yield nothing unless
    ``fold_kinds``; clauses and points take their missing ancestors from the defaults.
    """
    from lexspark.functions.text import plain_token, strip_diacritics

    kind = plain_token(strip_diacritics(F.col("kind")) if fold_kinds else F.col("kind"))
    index = plain_token(F.col("index"))
    d, k = F.nullif(F.col("default_dieu"), F.lit("")), F.nullif(F.col("default_khoan"), F.lit(""))
    sig = F.when(kind == "dieu", index).when((kind == "khoan") & d.isNotNull(), F.concat_ws("-", d, index)).when((kind == "diem") & d.isNotNull() & k.isNotNull(), F.concat_ws("-", d, k, index))
    return found.where(index != "").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(sig)), "|").alias("signatures"))
