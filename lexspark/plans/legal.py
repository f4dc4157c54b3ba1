"""Statutes, citations, label sets and set covers over the judgment tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import signatures as sg
from lexspark.operators import cover, documents, law
from lexspark.plans.retrieval import LABELS_SQL, labels
from lexspark.runtime import cut, latest_delivery, table

VERDICTS_SQL = "SELECT DISTINCT ON (mention_id) * FROM phan_quyet_toa_so_tham ORDER BY mention_id, loaded_at DESC"


def verdicts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return latest_delivery(table(spark, sf_dir, "phan_quyet_toa_so_tham").select("mention_id", "loaded_at", *columns), "mention_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, dieu, khoan, diem, source): legal-basis items of all verdicts."""
    rows = verdicts(spark, sf_dir, "record_id", "can_cu_dieu_luat").select("record_id", F.explode("can_cu_dieu_luat").alias("c"))
    return rows.select("record_id", "c.dieu", "c.khoan", "c.diem", F.col("c.bo_luat_va_van_ban_khac").alias("source"))


_ITEMS_SQL = f"SELECT record_id, c.dieu AS dieu, c.khoan AS khoan, c.diem AS diem, c.bo_luat_va_van_ban_khac AS source FROM (SELECT record_id, unnest(can_cu_dieu_luat) AS c FROM ({VERDICTS_SQL}))"


def q_signature_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir)


def _clause_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, sig) in the zero-filled format."""
    sig = sg.zero_filled(F.col("dieu"), F.col("khoan"), F.col("diem"))
    return _items(spark, sf_dir).select(F.col("record_id").alias("case_id"), sig.alias("sig")).where("sig is not null").distinct()


_CLAUSES_SQL = f"""SELECT DISTINCT record_id AS case_id, trim(dieu) || '-' || coalesce(nullif(trim(khoan), ''), '0') || '-' || lower(coalesce(nullif(trim(diem), ''), '0')) AS sig
  FROM ({_ITEMS_SQL}) WHERE coalesce(trim(dieu), '') <> ''"""


def q_clause_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clause_sets(spark, sf_dir)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query sets: every 20th record; training sets: all others."""
    sets = cut(_clause_sets(spark, sf_dir))
    return sets.where("case_id % 20 = 0").withColumnRenamed("case_id", "query"), sets.where("case_id % 20 <> 0")


_SIDES_SQL = f"WITH c AS ({_CLAUSES_SQL}), q AS (SELECT case_id AS query, sig FROM c WHERE case_id % 20 = 0), t AS (SELECT * FROM c WHERE case_id % 20 <> 0)"


def q_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.overlaps(*_sides(spark, sf_dir))


_GREEDY_SQL = _SIDES_SQL + """,
  z AS (SELECT case_id, count(*) AS size FROM t GROUP BY 1), n AS (SELECT query, count(*) AS n FROM q GROUP BY 1),
  g1 AS (SELECT n.query, z.case_id, z.size, count(q.sig) AS gain FROM n CROSS JOIN z LEFT JOIN t ON t.case_id = z.case_id LEFT JOIN q ON q.query = n.query AND q.sig = t.sig GROUP BY 1, 2, 3),
  p1 AS (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY query ORDER BY gain DESC, size, case_id) = 1),
  q2 AS (SELECT q.* FROM q JOIN p1 USING (query) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = p1.case_id AND t.sig = q.sig)),
  g2 AS (SELECT n.query, z.case_id, z.size, count(q2.sig) AS gain FROM n CROSS JOIN z JOIN p1 ON p1.query = n.query AND p1.case_id <> z.case_id LEFT JOIN t ON t.case_id = z.case_id LEFT JOIN q2 ON q2.query = n.query AND q2.sig = t.sig GROUP BY 1, 2, 3),
  p2 AS (SELECT * FROM g2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY gain DESC, size, case_id) = 1),
  q3 AS (SELECT q2.* FROM q2 JOIN p2 USING (query) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = p2.case_id AND t.sig = q2.sig)),
  g3 AS (SELECT n.query, z.case_id, z.size, count(q3.sig) AS gain FROM n CROSS JOIN z JOIN p1 ON p1.query = n.query AND p1.case_id <> z.case_id JOIN p2 ON p2.query = n.query AND p2.case_id <> z.case_id LEFT JOIN t ON t.case_id = z.case_id LEFT JOIN q3 ON q3.query = n.query AND q3.sig = t.sig GROUP BY 1, 2, 3),
  p3 AS (SELECT * FROM g3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY gain DESC, size, case_id) = 1),
  u AS (SELECT query, 1 AS iteration, case_id, size, gain FROM p1 UNION ALL SELECT query, 2, case_id, size, gain FROM p2 UNION ALL SELECT query, 3, case_id, size, gain FROM p3),
  o AS (SELECT u.*, n.n, CAST(sum(gain) OVER (PARTITION BY u.query ORDER BY iteration) AS BIGINT) AS covered FROM u JOIN n USING (query))"""


def q_greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cover.greedy(*_sides(spark, sf_dir), 3)
    return out.select("query", F.col("iteration").cast("long").alias("iteration"), "case_id", "subset_size", "gain", "covered", F.round("coverage", 6).alias("coverage"))


def q_greedy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro and micro coverage, full covers, and the first pick without gain."""
    picks = cover.greedy(*_sides(spark, sf_dir), 3)
    last = picks.groupBy("query").agg(F.max("covered").alias("covered"), F.max("n_clauses").alias("n"), F.min(F.when(F.col("gain") == 0, F.col("iteration"))).alias("onset"))
    return last.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.round(F.col("covered") / F.col("n"), 6)), 4).alias("macro_coverage"),
        F.round(F.coalesce(F.sum("covered") / F.nullif(F.sum("n"), F.lit(0)), F.lit(1.0)), 6).alias("micro_coverage"),
        F.count_if(F.col("covered") == F.col("n")).alias("full"),
        F.min("onset").cast("long").alias("first_onset"),
    )


def q_lp_cover_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.linear_cover(*_sides(spark, sf_dir), 15)


def q_label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict label validation per verdict row: error codes, or the number of labels."""
    rows = verdicts(spark, sf_dir, "can_cu_dieu_luat")
    n = F.when(F.col("can_cu_dieu_luat").isNotNull(), F.size("can_cu_dieu_luat"))
    items = rows.select(F.col("mention_id").alias("doc_id"), F.lit(1).alias("n_verdicts"), n.alias("n_items"), F.explode_outer("can_cu_dieu_luat").alias("c"))
    items = items.select("doc_id", "n_verdicts", "n_items", F.col("c").isNotNull().alias("is_item"), "c.dieu", "c.khoan", "c.diem", F.col("c.bo_luat_va_van_ban_khac").alias("source"))
    out = documents.label_sets(items)
    return out.select("doc_id", F.array_join("errors", "|").alias("errors"), F.coalesce(F.size("articles"), F.lit(0)).cast("long").alias("n")).select("doc_id", "errors", F.greatest("n", F.lit(0)).alias("n_articles"))


_LABEL_ERRORS_SQL = f"""WITH v AS ({VERDICTS_SQL}), i AS (SELECT mention_id AS doc_id, unnest(CASE WHEN coalesce(len(can_cu_dieu_luat), 0) = 0 THEN [NULL] ELSE can_cu_dieu_luat END) AS c, len(can_cu_dieu_luat) AS n FROM v),
  e AS (SELECT doc_id, coalesce(regexp_matches(lower(strip_accents(c.bo_luat_va_van_ban_khac)), 'blhs|bo luat hinh su'), false) AS penal, nullif(trim(c.dieu), '') AS dieu, c, n FROM i),
  k AS (SELECT doc_id, penal, dieu, CASE WHEN n IS NULL THEN 'basis_invalid_type' WHEN n = 0 THEN 'basis_empty' WHEN c IS NULL THEN 'basis_item_not_object' WHEN penal AND dieu IS NULL THEN 'missing_dieu' END AS error FROM e),
  g AS (SELECT doc_id, string_agg(DISTINCT error, '|' ORDER BY error) AS errors, count(DISTINCT CASE WHEN penal THEN dieu END) AS arts FROM k GROUP BY 1)
  SELECT doc_id, coalesce(errors, CASE WHEN arts = 0 THEN 'no_labels_extracted' ELSE '' END) AS errors, CASE WHEN errors IS NULL THEN arts ELSE 0 END AS n_articles FROM g"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """law_nodes with a position in reading order."""
    n = table(spark, sf_dir, "law_nodes")
    place = Window.orderBy("chapter_pos", F.expr("try_cast(regexp_extract(dieu, '^[0-9]+', 0) as int)"), "dieu", F.expr("coalesce(try_cast(regexp_extract(khoan, '^[0-9]+', 0) as int), 0)"), F.expr("coalesce(khoan, '')"), F.expr("coalesce(diem, '')"))
    return n.select(F.row_number().over(place).alias("pos"), "chapter_pos", "chuong", "chuong_title", "dieu", "khoan", "diem", F.col("law_level").alias("level"), "own_text")


def q_hierarchy_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statute written out as lines and parsed again by markers and carry-forward."""
    n = _nodes(spark, sf_dir)
    marker = F.when(F.col("level") == "dieu", F.concat(F.lit("Điều "), "dieu", F.lit(". "))).when(F.col("level") == "khoan", F.concat("khoan", F.lit(". "))).when(F.col("level") == "diem", F.concat("diem", F.lit(") "))).otherwise("")
    body = F.regexp_replace(F.regexp_replace("own_text", r"^Điều [0-9]+[a-zđ]*\.\s*", ""), "\n", " ")
    lines = n.select((F.col("pos") * 2).alias("line_no"), F.concat(marker, body).alias("line"))
    heads = n.groupBy("chapter_pos").agg((F.min("pos") * 2 - 1).alias("line_no"), F.first("chuong").alias("chuong")).select("line_no", F.concat(F.lit("Chương "), "chuong", F.lit(" . ")).alias("line"))
    parsed = law.hierarchy(lines.unionByName(heads).withColumn("doc_id", F.lit(1)))
    return parsed.where("level <> 'chuong'").select("chuong", "dieu", "khoan", "diem", "level", F.length("own_text").cast("long").alias("n"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return law.level_texts(_nodes(spark, sf_dir).where("level in ('dieu', 'khoan', 'diem')"))


def q_ancestor_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).where("level <> 'dieu'").select("dieu", "khoan", "diem", "text")


_NODES_SQL = """SELECT *, row_number() OVER (ORDER BY chapter_pos, try_cast(regexp_extract(dieu, '^[0-9]+') AS INT), dieu, coalesce(try_cast(regexp_extract(khoan, '^[0-9]+') AS INT), 0), coalesce(khoan, ''), coalesce(diem, '')) AS pos FROM law_nodes"""
_LAST_SQL = f"SELECT * FROM ({_NODES_SQL}) WHERE law_level IN ('dieu', 'khoan', 'diem') QUALIFY row_number() OVER (PARTITION BY dieu, khoan, diem ORDER BY pos DESC) = 1"


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, record_id, pos, query): every citation of every verdict in its order, multi-valued items written out."""
    rows = verdicts(spark, sf_dir, "record_id", "can_cu_dieu_luat").select("mention_id", "record_id", F.posexplode("can_cu_dieu_luat").alias("item", "c"))
    sigs = rows.select("mention_id", "record_id", "item", F.posexplode(sg.expand(F.col("c.dieu"), F.col("c.khoan"), F.col("c.diem"))).alias("part", "query"))
    return sigs.select("mention_id", "record_id", (F.col("item").cast("long") * 1000 + F.col("part")).alias("pos"), "query")


def _looked_up(cited: DataFrame, texts: DataFrame) -> DataFrame:
    """Every distinct citation looked up by level."""
    return law.lookup(cited.select("query").distinct().select(F.lit(0).alias("pos"), "query"), texts).drop("pos")


def q_hier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct citation of the verdicts looked up by level."""
    return _looked_up(_citations(spark, sf_dir), cut(_texts(spark, sf_dir))).select("query", "normalized", "found", "level", "reason")


def q_lookup_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The citations of every verdict in their order, repeats kept, each looked up once."""
    cited = _citations(spark, sf_dir)
    found = _looked_up(cited, cut(_texts(spark, sf_dir)))
    place = Window.partitionBy("mention_id").orderBy("pos")
    return cited.join(found.select("query", "found", "level"), "query").select("mention_id", F.row_number().over(place).cast("long").alias("place"), "query", "found", "level")


def q_law_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By record: the signatures whose text was found, those that are missing, and a warning reason:signature for each."""
    cited = _citations(spark, sf_dir).select("record_id", "query").distinct()
    rows = cited.join(_looked_up(cited, cut(_texts(spark, sf_dir))).select("query", "found", "reason"), "query")

    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(c)), "|")

    missing = F.when(~F.col("found"), F.col("query"))
    warning = F.when(~F.col("found"), F.concat_ws(":", "reason", "query"))
    return rows.groupBy("record_id").agg(F.count_if("found").alias("n_found"), joined(F.when(F.col("found"), F.col("query"))).alias("found"), joined(missing).alias("missing"), joined(warning).alias("warnings"))


def q_explicit_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cited articles that the statute has, with the length of their full text."""
    cited = _items(spark, sf_dir).select(sg.article_of(F.trim("dieu")).alias("dieu")).where("dieu <> ''").distinct()
    return cited.join(_texts(spark, sf_dir).where("level = 'dieu' and trim(text) <> ''"), "dieu").select("dieu", F.length("text").cast("long").alias("n"))


def q_referential_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited articles of the penal code that are missing or unknown to the statute."""
    from lexspark.functions.text import is_penal_code_literal

    items = _items(spark, sf_dir).where(is_penal_code_literal(F.col("source"))).select("record_id", F.trim("dieu").alias("dieu"))
    known = table(spark, sf_dir, "law_nodes").select("dieu").distinct()
    missing = items.where("coalesce(dieu, '') = ''").select("record_id", F.lit("missing").alias("problem"), F.lit("").alias("dieu"))
    unknown = items.where("dieu <> ''").join(known, "dieu", "left_anti").select("record_id", F.lit("unknown").alias("problem"), "dieu")
    return missing.unionByName(unknown).groupBy("record_id", "problem", "dieu").agg(F.count("*").alias("n"))


def _chapter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "law_nodes").where("dieu is not null")
    return n.groupBy("dieu").agg(F.max_by("chuong", "chapter_pos").alias("chuong"))


def _case_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("record_id", F.trim("dieu").alias("dieu")).where("dieu <> ''").distinct()


def q_chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many cases each chapter is cited; unmapped articles count under one name."""
    mapped = _case_articles(spark, sf_dir).join(_chapter_map(spark, sf_dir), "dieu", "left").select("record_id", F.coalesce("chuong", F.lit("Unknown/Unmapped")).alias("chuong"))
    return mapped.groupBy("chuong").agg(F.countDistinct("record_id").alias("n_cases"))


def q_article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most cited articles, each once per case."""
    return _case_articles(spark, sf_dir).groupBy("dieu").agg(F.count("*").alias("n_cases")).orderBy(F.desc("n_cases"), "dieu").limit(20)


def q_zero_filled_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of every article of chapter II in statute order, zeros kept."""
    arts = _nodes(spark, sf_dir).where("chuong = 'II'").groupBy("dieu").agg(F.min("pos").alias("pos"))
    counts = _case_articles(spark, sf_dir).groupBy("dieu").agg(F.count("*").alias("n"))
    order = Window.orderBy("pos")
    return arts.join(counts, "dieu", "left").select(F.row_number().over(order).cast("long").alias("place"), "dieu", F.coalesce("n", F.lit(0)).alias("n"))


def q_semi_chapter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an article of chapter II."""
    wanted = _case_articles(spark, sf_dir).join(_chapter_map(spark, sf_dir).where("chuong = 'II'"), "dieu", "left_semi").select("record_id").distinct()
    return table(spark, sf_dir, "extracted_fields").select("record_id", "filename").join(wanted, "record_id", "left_semi")


def q_cooccurrence_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of the presence of two articles in a case, from pair counts alone.

    With n cases, n_a and n_b holders and n_ab holders of both, the correlation of the 0/1 columns has a closed
    form, so no matrix is filled in; articles that every case holds have no variance and no pairs.
    """
    held = cut(_case_articles(spark, sf_dir))
    n = held.select("record_id").distinct().count()
    single = held.groupBy("dieu").agg(F.count("*").alias("n")).where(F.col("n") < n)
    pairs = held.alias("a").join(held.alias("b"), (F.col("a.record_id") == F.col("b.record_id")) & (F.col("a.dieu") < F.col("b.dieu")))
    both = pairs.groupBy(F.col("a.dieu").alias("dieu_a"), F.col("b.dieu").alias("dieu_b")).agg(F.count("*").alias("n_both"))
    # All pairs of the statute's articles, as one sorted list of them is written out twice.
    listed = single.agg(F.array_sort(F.collect_list(F.struct("dieu", "n"))).alias("all")).select("all", F.explode("all").alias("a"))
    listed = listed.select("a", F.explode(F.filter("all", lambda x: x["dieu"] > F.col("a.dieu"))).alias("b"))
    grid = listed.select(F.col("a.dieu").alias("dieu_a"), F.col("b.dieu").alias("dieu_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    rows = grid.join(both, ["dieu_a", "dieu_b"], "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    r = (F.lit(float(n)) * F.col("n_both") - F.col("na") * F.col("nb")) / F.sqrt(F.col("na") * (n - F.col("na")) * F.col("nb").cast("double") * (n - F.col("nb")))
    return rows.select("dieu_a", "dieu_b", "n_both", F.round(r, 6).alias("corr"))


def q_citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each article number is cited in the running text."""
    cited = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(law.citations(F.col("text")))).alias("dieu"))
    return cited.groupBy("dieu").agg(F.count("*").alias("n_docs"))


def q_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-references inside the statute, linked ones under one chain."""
    texts = table(spark, sf_dir, "law_nodes").select(F.col("law_signature_full").alias("id"), F.col("own_text").alias("t"))
    return law.mentions(texts)


def q_law_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the statute's lowest nodes with their ancestors' texts."""
    out = law.leaf_chunks(_nodes(spark, sf_dir).where("level in ('dieu', 'khoan', 'diem')"), "doc_hinh_su")
    return out.select("id", "law_level", "law_signature_full", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("text").cast("long").alias("n"))


def q_law_chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_law_chunks(spark, sf_dir).groupBy("law_level").agg(F.count("*").alias("n"))


def q_mention_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the cross-references of every node, missing ancestors from the node itself."""
    nodes = table(spark, sf_dir, "law_nodes").select(F.col("law_signature_full").alias("id"), F.col("own_text").alias("t"), F.col("dieu").alias("default_dieu"), F.col("khoan").alias("default_khoan"))
    found = law.mentions(nodes.select("id", "t")).join(nodes.select("id", "default_dieu", "default_khoan"), "id")
    return law.mention_signatures(found, fold_kinds=True)


def q_split_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of cases by the split of their judgment, which all chunks of a case share."""
    split = latest_delivery(table(spark, sf_dir, "thong_tin_chung").select("record_id", "split_name", "loaded_at"), "record_id")
    chunks = table(spark, sf_dir, "chunk_vectors").where("coalesce(source_type, '') <> 'law'").select("vec_id", F.col("doc_id").alias("doc"))
    return chunks.join(split.select(F.col("record_id").cast("string").alias("doc"), "split_name"), "doc").groupBy("split_name").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc").alias("n_docs"))


QUERIES = {
    f.__name__: f
    for f in (q_signature_expand, q_clause_signatures, q_overlap_join, q_greedy_cover, q_greedy_summary, q_lp_cover_value, q_label_errors, q_hierarchy_carry_forward, q_ancestor_text, q_hier_lookup, q_lookup_many, q_law_context, q_explicit_lookup, q_referential_check, q_chapter_counts, q_article_counts, q_zero_filled_hist, q_semi_chapter_filter, q_cooccurrence_corr, q_citation_counts, q_mentions, q_law_chunks, q_law_chunk_types, q_mention_signatures, q_split_propagation)
}
_ARTS_SQL = f"SELECT DISTINCT record_id, trim(dieu) AS dieu FROM ({_ITEMS_SQL}) WHERE coalesce(trim(dieu), '') <> ''"
_MAP_SQL = "SELECT dieu, arg_max(chuong, chapter_pos) AS chuong FROM law_nodes WHERE dieu IS NOT NULL GROUP BY 1"
_FULL_SQL = f"""WITH n AS ({_LAST_SQL}), s AS (SELECT *, '[' || law_level || ' ' || CASE law_level WHEN 'dieu' THEN dieu WHEN 'khoan' THEN khoan ELSE diem END || '] ' || trim(own_text) AS shown FROM n WHERE trim(coalesce(own_text, '')) <> ''),
  h AS (SELECT dieu, shown AS head FROM s WHERE law_level = 'dieu'), k AS (SELECT dieu, khoan, shown AS clause FROM s WHERE law_level = 'khoan')"""
_LEAF_SQL = f"""WITH n AS (SELECT * FROM ({_NODES_SQL}) WHERE law_level IN ('dieu', 'khoan', 'diem')),
  m AS (SELECT *, bool_or(law_level = 'khoan') OVER (PARTITION BY dieu) AS hk, bool_or(law_level = 'diem') OVER (PARTITION BY dieu, khoan) AS hd FROM n),
  l AS (SELECT * FROM m WHERE law_level = 'diem' OR (law_level = 'khoan' AND NOT hd) OR (law_level = 'dieu' AND NOT hk)),
  t AS (SELECT l.*, concat_ws(chr(10), '[LAW:doc_hinh_su] [Chuong ' || coalesce(l.chuong, '') || '] [Dieu ' || l.dieu || ']' || coalesce(' [Khoan ' || l.khoan || ']', '') || coalesce(' [Diem ' || l.diem || ']', ''), l.chuong_title,
      CASE WHEN l.law_level = 'dieu' THEN trim(l.own_text) ELSE trim(split_part(h.own_text, chr(10), 1)) END, CASE WHEN l.law_level = 'diem' THEN trim(k.own_text) END, CASE WHEN l.law_level <> 'dieu' THEN trim(l.own_text) END) AS text
    FROM l LEFT JOIN n h ON h.law_level = 'dieu' AND h.dieu = l.dieu LEFT JOIN n k ON k.law_level = 'khoan' AND k.dieu = l.dieu AND k.khoan = l.khoan)"""
_LOOKED_SQL = f"""WITH v AS ({VERDICTS_SQL}), i AS (SELECT mention_id, record_id, unnest(can_cu_dieu_luat) AS c, generate_subscripts(can_cu_dieu_luat, 1) AS item FROM v),
  s AS (SELECT mention_id, record_id, item, trim(c.dieu) AS d, list_transform(list_filter(regexp_split_to_array(coalesce(c.khoan, ''), ',|;|/| và '), lambda x: trim(x) <> ''), lambda x: replace(trim(x), ' ', '')) AS ks,
          list_transform(list_filter(regexp_split_to_array(coalesce(c.diem, ''), ',|;|/| và '), lambda x: trim(x) <> ''), lambda x: lower(replace(trim(x), ' ', ''))) AS ms FROM i WHERE coalesce(trim(c.dieu), '') <> ''),
  f AS (SELECT *, unnest(CASE WHEN len(ks) = 0 THEN [NULL] ELSE ks END) AS k, generate_subscripts(CASE WHEN len(ks) = 0 THEN [NULL] ELSE ks END, 1) AS ki FROM s),
  h AS (SELECT *, unnest(CASE WHEN len(ms) = 0 THEN [NULL] ELSE ms END) AS m, generate_subscripts(CASE WHEN len(ms) = 0 THEN [NULL] ELSE ms END, 1) AS mi FROM f),
  p AS (SELECT mention_id, record_id, item, ki, mi, concat_ws('-', d, k, m) AS query FROM h),
  l AS ({_LAST_SQL}), y AS (SELECT DISTINCT query, string_split(lower(query), '-') AS x FROM p),
  r AS (SELECT query, x, EXISTS (SELECT 1 FROM l WHERE law_level = 'dieu' AND lower(l.dieu) = x[1]) AS fd,
    EXISTS (SELECT 1 FROM l WHERE law_level = 'khoan' AND lower(l.dieu) = x[1] AND lower(l.khoan) = x[2]) AS fk, EXISTS (SELECT 1 FROM l WHERE law_level = 'diem' AND lower(l.dieu) = x[1] AND lower(l.khoan) = x[2] AND lower(l.diem) = x[3]) AS fm FROM y),
  w AS (SELECT *, CASE WHEN NOT fd THEN 'dieu_not_found' WHEN x[2] IS NOT NULL AND NOT fk THEN 'khoan_not_found' WHEN x[3] IS NOT NULL AND NOT fm THEN 'diem_not_found' END AS reason FROM r),
  z AS (SELECT query, array_to_string(x, '-') AS normalized, reason IS NULL AS found, CASE WHEN reason IS NULL THEN CASE len(x) WHEN 3 THEN 'diem' WHEN 2 THEN 'khoan' ELSE 'dieu' END END AS level, reason FROM w)"""
SQL = {
    "q_law_chunks": _LEAF_SQL + """ SELECT 'law::doc_hinh_su::' || law_level || '::' || concat_ws('-', dieu, khoan, diem) || '::chuong-' || coalesce(chuong, '') || '::00::' || lpad((row_number() OVER (ORDER BY pos) - 1)::VARCHAR, 6, '0') AS id, law_level, concat_ws('-', dieu, khoan, diem) AS law_signature_full, 0::BIGINT AS chunk_index, length(trim(text)) AS n FROM t""",
    "q_law_chunk_types": _LEAF_SQL + " SELECT law_level, count(*) AS n FROM t GROUP BY 1",
    "q_split_propagation": "SELECT split_name, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM chunk_vectors c JOIN (SELECT DISTINCT ON (record_id) record_id, split_name FROM thong_tin_chung ORDER BY record_id, loaded_at DESC) s ON s.record_id::VARCHAR = c.doc_id WHERE coalesce(source_type, '') <> 'law' GROUP BY 1",
    "q_signature_expand": LABELS_SQL,
    "q_clause_signatures": _CLAUSES_SQL,
    "q_overlap_join": _SIDES_SQL + " SELECT query, case_id, count(*) AS common FROM q JOIN t USING (sig) GROUP BY 1, 2",
    "q_greedy_cover": _GREEDY_SQL + " SELECT query, iteration::BIGINT AS iteration, case_id, size AS subset_size, gain, covered, round(covered / n, 6) AS coverage FROM o",
    "q_greedy_summary": _GREEDY_SQL + """, l AS (SELECT query, max(covered) AS covered, max(n) AS n, min(CASE WHEN gain = 0 THEN iteration END) AS onset FROM o GROUP BY 1)
        SELECT count(*) AS n_queries, round(avg(round(covered / n, 6)), 4) AS macro_coverage, round(sum(covered) / sum(n), 6) AS micro_coverage, CAST(sum(CASE WHEN covered = n THEN 1 ELSE 0 END) AS BIGINT) AS "full", min(onset)::BIGINT AS first_onset FROM l""",
    "q_label_errors": _LABEL_ERRORS_SQL,
    "q_hierarchy_carry_forward": "SELECT chuong, dieu, khoan, diem, law_level AS level, length(trim(replace(regexp_replace(own_text, '^Điều [0-9]+[a-zđ]*\\.\\s*', ''), chr(10), ' '))) AS n FROM law_nodes WHERE law_level IN ('dieu', 'khoan', 'diem')",
    "q_ancestor_text": _FULL_SQL + """ SELECT s.dieu, s.khoan, NULL::VARCHAR AS diem, concat_ws(chr(10), max(head), string_agg(shown, chr(10) ORDER BY pos)) AS text FROM s LEFT JOIN h USING (dieu)
        WHERE s.khoan IS NOT NULL AND (s.dieu, s.khoan) IN (SELECT (dieu, khoan) FROM n WHERE law_level = 'khoan') GROUP BY 1, 2
        UNION ALL SELECT s.dieu, s.khoan, s.diem, concat_ws(chr(10), head, clause, shown) FROM s LEFT JOIN h USING (dieu) LEFT JOIN k ON k.dieu = s.dieu AND k.khoan = s.khoan WHERE law_level = 'diem'""",
    "q_hier_lookup": _LOOKED_SQL + " SELECT DISTINCT query, normalized, found, level, reason FROM z",
    "q_lookup_many": _LOOKED_SQL + " SELECT mention_id, row_number() OVER (PARTITION BY mention_id ORDER BY item, ki, mi) AS place, query, found, level FROM p JOIN z USING (query)",
    "q_law_context": _LOOKED_SQL + """ SELECT record_id, count(*) FILTER (found) AS n_found, coalesce(string_agg(query, '|' ORDER BY query) FILTER (found), '') AS found, coalesce(string_agg(query, '|' ORDER BY query) FILTER (NOT found), '') AS missing,
        coalesce(string_agg(reason || ':' || query, '|' ORDER BY reason || ':' || query) FILTER (NOT found), '') AS warnings FROM (SELECT DISTINCT record_id, query FROM p) JOIN z USING (query) GROUP BY 1""",
    "q_explicit_lookup": _FULL_SQL + f""" SELECT dieu, length(string_agg(shown, chr(10) ORDER BY pos)) AS n FROM s WHERE dieu IN (SELECT split_part(dieu, '-', 1) FROM ({_ARTS_SQL})) AND dieu IN (SELECT dieu FROM n WHERE law_level = 'dieu') GROUP BY 1""",
    "q_referential_check": f"""WITH i AS (SELECT record_id, trim(dieu) AS dieu FROM ({_ITEMS_SQL}) WHERE contains(lower(coalesce(source, '')), 'bộ luật hình sự'))
        SELECT record_id, 'missing' AS problem, '' AS dieu, count(*) AS n FROM i WHERE coalesce(dieu, '') = '' GROUP BY 1 UNION ALL
        SELECT record_id, 'unknown', dieu, count(*) FROM i WHERE dieu <> '' AND dieu NOT IN (SELECT dieu FROM law_nodes WHERE dieu IS NOT NULL) GROUP BY 1, 3""",
    "q_chapter_counts": f"SELECT coalesce(chuong, 'Unknown/Unmapped') AS chuong, count(DISTINCT record_id) AS n_cases FROM ({_ARTS_SQL}) LEFT JOIN ({_MAP_SQL}) USING (dieu) GROUP BY 1",
    "q_article_counts": f"SELECT dieu, count(*) AS n_cases FROM ({_ARTS_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "q_zero_filled_hist": f"""WITH a AS (SELECT dieu, min(pos) AS pos FROM ({_NODES_SQL}) WHERE chuong = 'II' GROUP BY 1), c AS (SELECT dieu, count(*) AS n FROM ({_ARTS_SQL}) GROUP BY 1)
        SELECT row_number() OVER (ORDER BY pos) AS place, dieu, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (dieu)""",
    "q_semi_chapter_filter": f"SELECT record_id, filename FROM extracted_fields WHERE record_id IN (SELECT record_id FROM ({_ARTS_SQL}) JOIN ({_MAP_SQL}) USING (dieu) WHERE chuong = 'II')",
    "q_cooccurrence_corr": f"""WITH a AS ({_ARTS_SQL}), s AS (SELECT dieu, count(*) AS n FROM a GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT record_id) FROM a)), r AS (SELECT DISTINCT record_id FROM a),
        m AS (SELECT r.record_id, s.dieu, CASE WHEN a.dieu IS NULL THEN 0 ELSE 1 END AS x FROM r CROSS JOIN s LEFT JOIN a ON a.record_id = r.record_id AND a.dieu = s.dieu)
        SELECT p.dieu AS dieu_a, q.dieu AS dieu_b, CAST(sum(p.x * q.x) AS BIGINT) AS n_both, round(corr(p.x, q.x), 6) AS corr FROM m p JOIN m q ON p.record_id = q.record_id AND p.dieu < q.dieu GROUP BY 1, 2""",
    "q_citation_counts": "SELECT dieu, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)điều\\s+(\\d+[a-zA-Z]*)', 1)) AS dieu FROM documents) GROUP BY 1",
}
