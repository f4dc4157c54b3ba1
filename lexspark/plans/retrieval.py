"""Retrieval over the chunk vectors: nearest chunks and documents, labels, per-document and macro metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.metrics import prf, prf_zero
from lexspark.functions.signatures import article_of, expand
from lexspark.operators import documents
from lexspark.operators.cover import ranked_trials
from lexspark.operators.vector_topk import exact_topk
from lexspark.runtime import cut, latest_delivery, table, wide_table

K = 5


def _vectors(spark: SparkSession, sf_dir: str, law: bool = False) -> DataFrame:
    rows = wide_table(spark, sf_dir, "chunk_vectors", "vec_id", "doc_id", "source_type", "law_signature_full", "embedding")
    is_law = F.coalesce("source_type", F.lit("")) == "law"
    return rows.where(is_law if law else ~is_law).select(F.col("vec_id").alias("id"), F.col("doc_id").alias("doc"), F.col("embedding").alias("v"), "law_signature_full")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).where(F.col("id") % 20 == 0).select("id", "doc", "v")


def _topk(spark: SparkSession, sf_dir: str, k: int = K, per_doc: bool = False) -> DataFrame:
    return exact_topk(_vectors(spark, sf_dir).select("id", "doc", "v"), _queries(spark, sf_dir), k, per_doc)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, sig): distinct penal-code signatures of each record's verdicts; one bad item spoils its record."""
    rows = latest_delivery(table(spark, sf_dir, "phan_quyet_toa_so_tham").select("mention_id", "record_id", "can_cu_dieu_luat", "loaded_at"), "mention_id")
    items = rows.select(F.col("record_id").cast("string").alias("doc_id"), F.lit(1).alias("n_verdicts"), F.size("can_cu_dieu_luat").alias("n"), F.col("can_cu_dieu_luat").isNull().alias("none"), F.explode_outer("can_cu_dieu_luat").alias("c"))
    n_items = F.when(~F.col("none"), F.col("n"))
    items = items.select("doc_id", "n_verdicts", n_items.alias("n_items"), F.col("c").isNotNull().alias("is_item"), "c.dieu", "c.khoan", "c.diem", F.col("c.bo_luat_va_van_ban_khac").alias("source"))
    return documents.label_sets(items).where("size(errors) = 0").select(F.col("doc_id").alias("doc"), F.explode("signatures").alias("sig"))


#: Items of the penal code, by their source; a record with a missing or empty list, a null item or a penal item without an article has no labels.
LABELS_SQL = """
  SELECT DISTINCT doc, d || coalesce('-' || k, '') || coalesce('-' || m, '') AS sig FROM (
    SELECT doc, d, unnest(CASE WHEN len(ks) = 0 THEN [NULL] ELSE ks END) AS k, m FROM (
      SELECT doc, trim(c.dieu) AS d, list_transform(list_filter(regexp_split_to_array(coalesce(c.khoan, ''), ',|;|/| và '), lambda x: trim(x) <> ''), lambda x: replace(trim(x), ' ', '')) AS ks,
             CASE WHEN coalesce(trim(c.diem), '') = '' THEN NULL ELSE lower(trim(c.diem)) END AS m
      FROM (SELECT CAST(record_id AS VARCHAR) AS doc, unnest(can_cu_dieu_luat) AS c FROM (SELECT DISTINCT ON (mention_id) * FROM phan_quyet_toa_so_tham ORDER BY mention_id, loaded_at DESC))
      WHERE regexp_matches(lower(strip_accents(c.bo_luat_va_van_ban_khac)), 'blhs|bo luat hinh su')
        AND doc NOT IN (
          SELECT CAST(record_id AS VARCHAR) FROM phan_quyet_toa_so_tham WHERE coalesce(len(can_cu_dieu_luat), 0) = 0
          UNION SELECT CAST(record_id AS VARCHAR) FROM (SELECT record_id, unnest(can_cu_dieu_luat) AS x FROM phan_quyet_toa_so_tham)
            WHERE x IS NULL OR (regexp_matches(lower(strip_accents(x.bo_luat_va_van_ban_khac)), 'blhs|bo luat hinh su') AND coalesce(trim(x.dieu), '') = ''))))"""

_PAIRS_SQL = """
  WITH v AS (SELECT vec_id AS id, doc_id AS doc, embedding::DOUBLE[] AS v FROM chunk_vectors
             WHERE coalesce(source_type, '') {what} AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
  q AS (SELECT vec_id AS id, doc_id AS doc, embedding::DOUBLE[] AS v FROM chunk_vectors
        WHERE coalesce(source_type, '') <> 'law' AND vec_id % 20 = 0 AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0),
  p AS (SELECT q.id AS query_id, v.id AS other_id, v.doc AS doc, q.doc AS qdoc, 1 - list_cosine_similarity(q.v, v.v) AS distance FROM q, v WHERE q.doc <> v.doc),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, other_id) AS rank FROM p)"""
PAIRS_SQL = _PAIRS_SQL.format(what="<> 'law'")
LAW_PAIRS_SQL = _PAIRS_SQL.format(what="= 'law'")
_DOCS_SQL = PAIRS_SQL + """,
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY distance, other_id) AS n FROM p),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, other_id) AS rank FROM f WHERE n = 1)"""


def q_retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir).select("query_id", "other_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def q_retrieval_doc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, per_doc=True).select("query_id", "doc", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def q_law_filter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = _vectors(spark, sf_dir, law=True)
    found = exact_topk(law.select("id", "doc", "v"), _queries(spark, sf_dir), 10)
    named = found.join(law.select(F.col("id").alias("other_id"), "law_signature_full"), "other_id")
    dieu = F.when(F.coalesce("law_signature_full", F.lit("")) != "", article_of(F.col("law_signature_full")))
    return named.select("query_id", "other_id", F.col("rank").cast("long").alias("rank"), dieu.alias("dieu"))


def _per_query(spark: SparkSession, sf_dir: str, k: int = K, law: bool = False) -> DataFrame:
    """(query_id, truth, guess): articles of a query's own record, and of what was retrieved for it.

    Queries are chunks of records with labels. With ``law`` also (both): the guess with the articles of the law found.
    """
    own = cut(labels(spark, sf_dir).select("doc", article_of(F.col("sig")).alias("dieu")).distinct())
    sets = own.groupBy("doc").agg(F.array_sort(F.collect_set("dieu")).alias("truth"))
    guess = _topk(spark, sf_dir, k).select("query_id", "doc").distinct().join(own, "doc").select("query_id", "dieu", F.lit(True).alias("case"))
    if law:
        guess = guess.unionByName(q_law_filter_topk(spark, sf_dir).where("dieu is not null").select("query_id", "dieu", F.lit(False).alias("case")))
    guess = guess.groupBy("query_id").agg(F.array_sort(F.collect_set(F.when(F.col("case"), F.col("dieu")))).alias("guess"), F.array_sort(F.collect_set("dieu")).alias("both"))
    q = _queries(spark, sf_dir).where("v is not null and exists(v, x -> x <> 0)").select(F.col("id").alias("query_id"), "doc")
    joined = q.join(sets, "doc").join(guess, "query_id", "left")
    empty = F.array().cast("array<string>")
    return joined.select("query_id", "truth", F.coalesce("guess", empty).alias("guess"), F.coalesce("both", empty).alias("both"))


def _measured(rows: DataFrame) -> DataFrame:
    p, r, f = prf(F.col("truth"), F.col("guess"))
    return rows.select("*", F.round(p, 4).alias("p"), F.round(r, 4).alias("r"), F.round(f, 4).alias("f1"))


def q_retrieval_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _measured(_per_query(spark, sf_dir).drop("both"))
    missed, extra = F.array_except("truth", "guess"), F.array_except("guess", "truth")
    return rows.select("query_id", F.array_join(F.array_sort(F.array_intersect("truth", "guess")), "|").alias("matched"), F.array_join(F.array_sort(missed), "|").alias("missed"), F.array_join(F.array_sort(extra), "|").alias("extra"), "p", "r", "f1")


def q_retrieval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(_per_query(spark, sf_dir)).agg(F.count("*").alias("n"), *[F.round(F.avg(x), 4).alias(f"macro_{x}") for x in ("p", "r", "f1")])


def q_prf_zero_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _per_query(spark, sf_dir)
    p, r, f = prf_zero(F.col("truth"), F.col("guess"))
    return rows.select("query_id", p.alias("p"), r.alias("r"), f.alias("f1"))


def q_with_without_law_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search of the cases and one of the law give both sides of the comparison."""
    rows = _per_query(spark, sf_dir, law=True)
    sides = [[F.round(m, 4) for m in prf(F.col("truth"), F.col(guess))] for guess in ("guess", "both")]
    return rows.agg(*[F.round(F.avg(b) - F.avg(a), 4).alias(f"delta_{x}") for x, a, b in zip(("p", "r", "f1"), *sides, strict=True)])


def q_clause_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles by how often they were missed, found in excess, and true."""
    rows = cut(_per_query(spark, sf_dir))
    kinds = (("missed", F.array_except("truth", "guess")), ("extra", F.array_except("guess", "truth")), ("true", F.col("truth")))
    named = rows.select(F.explode(F.create_map(*[x for name, c in kinds for x in (F.lit(name), c)])).alias("kind", "articles")).select("kind", F.explode("articles").alias("dieu"))
    return named.groupBy("dieu").agg(*[F.count_if(F.col("kind") == name).alias(f"n_{name}") for name, _ in kinds])


def q_similar_case_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of every similar record of a query; a record without labels stays, with an empty list."""
    sets = labels(spark, sf_dir).groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("sig")), "|").alias("clauses"))
    found = _topk(spark, sf_dir, per_doc=True).select("query_id", "doc", F.col("rank").cast("long").alias("rank"))
    return found.join(sets, "doc", "left").select("query_id", "rank", "doc", F.coalesce("clauses", F.lit("")).alias("clauses"))


def q_k_sweep_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search to the largest k; every k reads its prefix of the ranks."""
    ks = (3, 5, 8, 10, 15)
    own = cut(labels(spark, sf_dir).select("doc", article_of(F.col("sig")).alias("dieu")).distinct())
    sets = own.groupBy("doc").agg(F.array_sort(F.collect_set("dieu")).alias("truth"))
    ranked = cut(_topk(spark, sf_dir, max(ks)).select("query_id", "doc", "rank"))
    grid = F.array(*[F.struct(F.lit(i).cast("long").alias("trial"), F.lit(k).cast("long").alias("k")) for i, k in enumerate(ks)])
    within = ranked.select("query_id", "doc", F.explode(F.filter(grid, lambda g: g["k"] >= F.col("rank"))).alias("g")).select("query_id", "doc", "g.*")
    guess = within.join(own, "doc").groupBy("trial", "k", "query_id").agg(F.array_sort(F.collect_set("dieu")).alias("guess"))
    q = _queries(spark, sf_dir).where("v is not null and exists(v, x -> x <> 0)").select(F.col("id").alias("query_id"), "doc").join(sets, "doc").select("query_id", "truth", F.explode(grid).alias("g")).select("query_id", "truth", "g.*")
    empty = F.array().cast("array<string>")
    rows = q.join(guess, ["trial", "k", "query_id"], "left").select("trial", "k", F.coalesce("truth", empty).alias("truth"), F.coalesce("guess", empty).alias("guess"))
    trials = _measured(rows).groupBy("trial", "k").agg(F.round(F.avg("r"), 4).alias("recall"), F.round(F.avg("f1"), 4).alias("f1"))
    return ranked_trials(trials).select("trial", "k", "recall", "f1", F.col("place").cast("long").alias("place"), "best_recall", "best_k")


def q_embed_stub_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest documents by the stand-in encoder for every 20th document."""
    from lexspark.operators.vector_topk import hashed_embedding

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), hashed_embedding(F.col("text")).alias("v"))
    return exact_topk(docs, docs.where(F.col("id") % 20 == 0), 3).select("query_id", "other_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


SETS_SQL = """,
  lab AS (SELECT DISTINCT doc, split_part(sig, '-', 1) AS dieu FROM (""" + LABELS_SQL + """)),
  truth AS (SELECT q.id AS query_id, list(DISTINCT lab.dieu) AS truth FROM q JOIN lab ON lab.doc = q.doc GROUP BY 1),
  g AS (SELECT DISTINCT query_id, lab.dieu FROM (SELECT DISTINCT query_id, doc FROM r WHERE rank <= {k}) JOIN lab USING (doc) {more}),
  guess AS (SELECT query_id, list(dieu) AS guess FROM g GROUP BY 1),
  s AS (SELECT query_id, truth, coalesce(guess, []) AS guess FROM truth LEFT JOIN guess USING (query_id)),
  c AS (SELECT *, len(list_intersect(truth, guess)) AS hit, len(truth) AS nt, len(guess) AS ng FROM s),
  m AS (SELECT *, CASE WHEN nt = 0 AND ng = 0 THEN 1.0 WHEN ng = 0 THEN 0.0 ELSE hit / ng END AS p0, CASE WHEN nt = 0 AND ng = 0 THEN 1.0 WHEN nt = 0 THEN 0.0 ELSE hit / nt END AS r0 FROM c),
  e AS (SELECT *, round(p0::DOUBLE, 4) AS p, round(r0::DOUBLE, 4) AS r, round(CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END::DOUBLE, 4) AS f1 FROM m)"""


def _sets_sql(k: int = K, more: str = "", pairs: str = PAIRS_SQL) -> str:
    return pairs + SETS_SQL.format(k=k, more=more)


_LAW_MORE = """UNION SELECT query_id, split_part(law_signature_full, '-', 1) FROM (
    SELECT l.query_id, l.other_id, row_number() OVER (PARTITION BY l.query_id ORDER BY l.distance, l.other_id) AS rank
    FROM (SELECT q.id AS query_id, x.vec_id AS other_id, 1 - list_cosine_similarity(q.v, x.embedding::DOUBLE[]) AS distance FROM q, chunk_vectors x
          WHERE x.source_type = 'law' AND x.embedding IS NOT NULL AND list_aggregate(list_transform(x.embedding, lambda y: abs(y)), 'max') > 0 AND x.doc_id <> q.doc) l) z
    JOIN chunk_vectors c ON c.vec_id = z.other_id WHERE rank <= 10 AND coalesce(law_signature_full, '') <> ''"""

QUERIES = {f.__name__: f for f in (q_retrieval_topk, q_retrieval_doc_topk, q_law_filter_topk, q_retrieval_per_doc, q_retrieval_macro, q_prf_zero_convention, q_with_without_law_delta, q_clause_counters, q_similar_case_context, q_k_sweep_ranking, q_embed_stub_topk)}
SQL = {
    "q_retrieval_topk": PAIRS_SQL + " SELECT query_id, other_id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5",
    "q_retrieval_doc_topk": _DOCS_SQL + " SELECT query_id, doc, round(distance, 6) AS distance, rank FROM t WHERE rank <= 5",
    "q_law_filter_topk": LAW_PAIRS_SQL + " SELECT query_id, other_id, rank, CASE WHEN coalesce(law_signature_full, '') <> '' THEN split_part(law_signature_full, '-', 1) END AS dieu FROM r JOIN chunk_vectors c ON c.vec_id = r.other_id WHERE rank <= 10",
    "q_retrieval_per_doc": _sets_sql() + """ SELECT query_id, array_to_string(list_sort(list_intersect(truth, guess)), '|') AS matched,
        array_to_string(list_sort(list_filter(truth, lambda x: NOT list_contains(guess, x))), '|') AS missed, array_to_string(list_sort(list_filter(guess, lambda x: NOT list_contains(truth, x))), '|') AS extra, p, r, f1 FROM e""",
    "q_retrieval_macro": _sets_sql() + " SELECT count(*) AS n, round(avg(p), 4) AS macro_p, round(avg(r), 4) AS macro_r, round(avg(f1), 4) AS macro_f1 FROM e",
    "q_prf_zero_convention": _sets_sql() + """ SELECT query_id, round(CASE WHEN ng > 0 THEN hit / ng ELSE 0 END::DOUBLE, 6) AS p, round(CASE WHEN nt > 0 THEN hit / nt ELSE 0 END::DOUBLE, 6) AS r,
        round(CASE WHEN hit > 0 THEN 2.0 * (hit / ng) * (hit / nt) / (hit / ng + hit / nt) ELSE 0 END::DOUBLE, 6) AS f1 FROM c""",
    "q_with_without_law_delta": "SELECT round(b.p - a.p, 4) AS delta_p, round(b.r - a.r, 4) AS delta_r, round(b.f1 - a.f1, 4) AS delta_f1 FROM ("
    + _sets_sql() + " SELECT avg(p) AS p, avg(r) AS r, avg(f1) AS f1 FROM e) a, (" + _sets_sql(more=_LAW_MORE) + " SELECT avg(p) AS p, avg(r) AS r, avg(f1) AS f1 FROM e) b",
    "q_clause_counters": _sets_sql() + """, x AS (SELECT unnest(list_filter(truth, lambda y: NOT list_contains(guess, y))) AS dieu, 'missed' AS kind FROM c UNION ALL SELECT unnest(list_filter(guess, lambda y: NOT list_contains(truth, y))), 'extra' FROM c UNION ALL SELECT unnest(truth), 'true' FROM c)
        SELECT dieu, count(*) FILTER (kind = 'missed') AS n_missed, count(*) FILTER (kind = 'extra') AS n_extra, count(*) FILTER (kind = 'true') AS n_true FROM x GROUP BY 1""",
    "q_similar_case_context": _DOCS_SQL + ", lab AS (SELECT doc, string_agg(sig, '|' ORDER BY sig) AS clauses FROM (" + LABELS_SQL + ") GROUP BY 1) SELECT query_id, rank, t.doc, coalesce(clauses, '') AS clauses FROM t LEFT JOIN lab ON lab.doc = t.doc WHERE rank <= 5",
    "q_k_sweep_ranking": "WITH t AS ("
    + " UNION ALL ".join(f"SELECT {i}::BIGINT AS trial, {k}::BIGINT AS k, * FROM (" + _sets_sql(k) + " SELECT round(avg(r), 4) AS recall, round(avg(f1), 4) AS f1 FROM e)" for i, k in enumerate((3, 5, 8, 10, 15)))
    + """) SELECT trial, k, recall, f1, row_number() OVER (ORDER BY recall DESC, f1 DESC, k) AS place,
        max(recall) OVER (ORDER BY trial) AS best_recall, (SELECT k FROM t u WHERE u.trial <= t.trial ORDER BY recall DESC, f1 DESC, k LIMIT 1) AS best_k FROM t""",
}
