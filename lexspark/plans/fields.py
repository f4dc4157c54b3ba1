"""Fields and small steps: JSON paths and flattening, texts of statute nodes, retries, sweeps, incremental reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.functions import chunk, jsonpath, text
from lexspark.functions.metrics import prf
from lexspark.functions.signatures import article_of
from lexspark.operators import documents, generation
from lexspark.operators.cover import ranked_trials
from lexspark.operators.law import node_texts
from lexspark.operators.sweep import sweep
from lexspark.operators.vector_topk import exact_topk
from lexspark.plans.legal import VERDICTS_SQL, verdicts
from lexspark.plans.retrieval import LABELS_SQL, PAIRS_SQL, SETS_SQL, labels
from lexspark.runtime import cut, ensure_checkpoint_dir, latest_delivery, table, wide_table
from lexspark.streaming import ingest


def q_path_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text under the first of several paths that is there; what is no text comes as compact JSON."""
    value = jsonpath.project(F.col("props"), "$.key", "$.data.k", "$.k")
    whole = jsonpath.project(F.col("props"), "$")
    return table(spark, sf_dir, "events").select("event_id", value.alias("k"), whole.alias("whole"), jsonpath.project(F.col("props"), "$.no.where").alias("none"))


def q_flat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's nested fields as one text: the texts at all depths in order, blank ones dropped."""
    e = wide_table(spark, sf_dir, "extracted_fields", "record_id", "noi_dung_vu_an", "nhan_dinh_cua_toa_an", "quyet_dinh")
    nested = F.to_json(F.struct("noi_dung_vu_an", "nhan_dinh_cua_toa_an", F.array(F.array("quyet_dinh")).alias("quyet_dinh")))
    return e.select("record_id", F.md5(jsonpath.flat_text(nested)).alias("digest"))


def q_few_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose reasoning has fewer than five points."""
    return table(spark, sf_dir, "extracted_fields").select("record_id", F.greatest(F.coalesce(F.size("nhan_dinh_cua_toa_an"), F.lit(0)), F.lit(0)).cast("long").alias("n")).where("n < 5")


def q_node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full text (from below), inherited text (from above) and the text chosen of every node of the statute."""
    nodes = table(spark, sf_dir, "law_nodes").where("law_level in ('dieu', 'khoan', 'diem')")
    place = Window.partitionBy("dieu").orderBy("chapter_pos", F.coalesce("khoan", F.lit("")), F.coalesce("diem", F.lit("")))
    nodes = nodes.select("dieu", "khoan", "diem", F.col("law_level").alias("level"), "own_text", F.row_number().over(place).alias("pos"))
    out = node_texts(nodes)
    return out.select("dieu", "pos", F.md5("full_text").alias("full_text"), F.md5("inherited").alias("inherited"), F.md5("chosen").alias("chosen"))


def q_case_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in verdicts with their letter case, and a folded copy brought back to that case."""
    rows = verdicts(spark, sf_dir, "bi_cao").select("bi_cao").distinct().where("bi_cao is not null")
    kind = text.letter_case(F.col("bi_cao"))
    return rows.select("bi_cao", kind.alias("kind"), text.apply_case(F.lower("bi_cao"), kind).alias("applied")).where("kind in ('upper', 'lower', 'none')")


def q_text_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line, text without page separators, and header segments of every document."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(text.first_line(F.col("text"))).alias("first_line"), F.length(text.drop_page_breaks(F.col("text"))).cast("long").alias("n"), F.size(chunk.segments(F.col("text"))).cast("long").alias("n_segments"))


def q_map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasoning of every record as one text in the order of its keys."""
    return table(spark, sf_dir, "extracted_fields").select("record_id", F.md5(text.map_text(F.col("nhan_dinh_cua_toa_an"))).alias("digest"))


def q_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defendants of every record, each once, at the place where it first stands."""
    return table(spark, sf_dir, "extracted_fields").select("record_id", F.posexplode(F.array_distinct("danh_sach_bi_cao")).alias("i", "name")).select("record_id", (F.col("i") + 1).cast("long").alias("place"), "name")


def q_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the test split with their labels; those without are skipped with a reason, twenty of them named."""
    test = latest_delivery(table(spark, sf_dir, "thong_tin_chung").select("record_id", "split_name", "loaded_at"), "record_id").where("split_name = 'test'")
    sets = labels(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n"))
    rows = test.select("record_id", F.col("record_id").cast("string").alias("doc")).join(sets, "doc", "left").select("record_id", F.coalesce("n", F.lit(0)).alias("n_labels"))
    skipped = rows.where("n_labels = 0").orderBy("record_id").limit(20).select("record_id", "n_labels", F.lit("missing_eval_row").alias("reason"))
    return rows.where("n_labels > 0").select("record_id", "n_labels", F.lit("").alias("reason")).unionByName(skipped)


def q_chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document with their number and the total of their text."""
    parts = chunk.sentence_chunks(F.col("text"), 1500)
    d = table(spark, sf_dir, "documents").select("doc_id", parts.alias("c")).where("size(c) > 0")
    return d.select("doc_id", F.posexplode("c").alias("i", "t"), F.size("c").cast("long").alias("total")).select("doc_id", F.col("i").cast("long").alias("chunk_index"), "total")


def q_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts through the generation port; an answer without a penalty is asked for once more, with a warning."""
    rows = verdicts(spark, sf_dir, "bi_cao", "phat_tu").select(F.col("mention_id").alias("id"), "bi_cao", generation.prompt(name=F.col("bi_cao"), hint=F.col("phat_tu")).alias("prompt"))
    empty = F.col("response").contains('"Phat_Tu": ""')
    out = generation.with_retry(rows, [("offline", generation.offline)], empty, generation.prompt(name=F.col("bi_cao"), hint=F.lit("asked again")))
    return out.select("id", "retried", F.array_join("warnings", "|").alias("warnings"), F.expr("try_variant_get(try_parse_json(response), '$.defendants[0].Phat_Tu', 'string')").alias("phat_tu"))


def q_stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream, each file once, stored by id, a second run adding nothing; counted by type."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    kinds = table(spark, sf_dir, "events").select("event_id", "event_type").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    for run in ("first", "again"):
        ingest(spark, f"{sf_dir}/events.parquet*", schema, f"{base}/table", f"{base}/{run}", key="event_id", files_per_batch=4).awaitTermination()
    return spark.read.schema(kinds).parquet(f"{base}/table").groupBy("event_type").agg(F.count("*").alias("n"))


FIELDS = {"all": ("NOI_DUNG_VU_AN", "NHAN_DINH_CUA_TOA_AN", "Summary"), "narrative": ("NOI_DUNG_VU_AN",)}
TARGET = 0.45
_GRID = [(t, q, k) for t in FIELDS for q in FIELDS for k in (3, 5, 10)]


def q_field_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials over the fields searched, the fields asked and k, at most ten, ended by the first that reaches the target."""
    v = wide_table(spark, sf_dir, "chunk_vectors", "vec_id", "doc_id", "source_type", "field", "embedding").where("coalesce(source_type, '') <> 'law'")
    v = v.select(F.col("vec_id").alias("id"), F.col("doc_id").alias("doc"), F.col("embedding").alias("v"), "field")
    own = cut(labels(spark, sf_dir).select("doc", article_of(F.col("sig")).alias("dieu")).distinct())
    sets = cut(own.groupBy("doc").agg(F.array_sort(F.collect_set("dieu")).alias("truth")))
    ranked: dict[tuple[str, str], DataFrame] = {}

    def recall(trial: tuple) -> float:
        train, asked, k = trial
        queries = v.where(F.col("field").isin(*FIELDS[asked]) & (F.col("id") % 20 == 0))
        if (train, asked) not in ranked:  # one search for all k
            ranked[train, asked] = cut(exact_topk(v.where(F.col("field").isin(*FIELDS[train])), queries, 10).select("query_id", "doc", "rank"))
        guess = ranked[train, asked].where(F.col("rank") <= k).join(own, "doc").groupBy("query_id").agg(F.array_sort(F.collect_set("dieu")).alias("guess"))
        q = queries.where("v is not null and exists(v, x -> x <> 0)").select(F.col("id").alias("query_id"), "doc").join(sets, "doc").join(guess, "query_id", "left")
        _, r, _ = prf(F.col("truth"), F.coalesce("guess", F.array().cast("array<string>")))
        return q.agg(F.round(F.avg(F.round(r, 4)), 3)).first()[0] or 0.0

    trials = sweep(_GRID, recall, TARGET, max_trials=10)
    rows = [(i, *t, score, reached) for i, (t, score, reached) in enumerate(trials)]
    return spark.createDataFrame(rows, "trial long, train string, asked string, k long, recall double, reached boolean")


QUERIES = {
    f.__name__: f
    for f in (q_path_aliases, q_flat_text, q_few_points, q_node_texts, q_case_applied, q_text_steps, q_map_text, q_ordered_distinct, q_eval_rows, q_chunk_totals, q_retry, q_stream_counts, q_field_sweep)
}


def _trial_sql(i: int, train: str, asked: str, k: int) -> str:
    def listed(name: str) -> str:
        return ", ".join(f"'{f}'" for f in FIELDS[name])

    pairs = PAIRS_SQL.replace("WHERE coalesce(source_type, '') <> 'law' AND embedding", f"WHERE field IN ({listed(train)}) AND coalesce(source_type, '') <> 'law' AND embedding", 1)
    pairs = pairs.replace("AND vec_id % 20 = 0", f"AND field IN ({listed(asked)}) AND vec_id % 20 = 0")
    return f"SELECT {i} AS trial, '{train}' AS train, '{asked}' AS asked, {k}::BIGINT AS k, * FROM (" + pairs + SETS_SQL.format(k=k, more="") + " SELECT round(avg(r), 3) AS recall FROM e)"


_BLANK = "[\\s\\x{85}\\x{a0}]+"
_TRIM = "regexp_replace({c}, '^[\\s\\x{{85}}\\x{{a0}}]+|[\\s\\x{{85}}\\x{{a0}}]+$', '', 'g')"
SQL = {
    "q_path_aliases": "SELECT event_id, json_extract_string(props, '$.k') AS k, replace(replace(props, ': ', ':'), ', ', ',') AS whole, NULL::VARCHAR AS none FROM events",
    "q_flat_text": "SELECT record_id, md5(array_to_string(list_filter(list_transform(list_concat([noi_dung_vu_an.qua_trinh_dieu_tra, noi_dung_vu_an.ket_luan_cac_ben], map_values(nhan_dinh_cua_toa_an), [quyet_dinh]), lambda x: "
    + _TRIM.format(c="x") + "), lambda x: coalesce(x, '') <> ''), chr(10) || chr(10))) AS digest FROM extracted_fields",
    "q_few_points": "SELECT record_id, coalesce(cardinality(nhan_dinh_cua_toa_an), 0)::BIGINT AS n FROM extracted_fields WHERE coalesce(cardinality(nhan_dinh_cua_toa_an), 0) < 5",
    "q_node_texts": """WITH n AS (SELECT dieu, khoan, diem, law_level AS l, own_text AS t, row_number() OVER (PARTITION BY dieu ORDER BY chapter_pos, coalesce(khoan, ''), coalesce(diem, '')) AS pos FROM law_nodes WHERE law_level IN ('dieu', 'khoan', 'diem')),
        x AS (SELECT a.dieu, a.pos, a.t, coalesce(string_agg(trim(b.t), chr(10) ORDER BY b.pos) FILTER (trim(coalesce(b.t, '')) <> ''), '') AS full_text
              FROM n a JOIN n b ON a.dieu = b.dieu AND (a.l = 'dieu' OR (a.l = 'khoan' AND b.khoan = a.khoan) OR b.pos = a.pos) GROUP BY 1, 2, 3),
        h AS (SELECT dieu, arg_max(t, pos) AS t FROM n WHERE l = 'dieu' GROUP BY 1), c AS (SELECT dieu, khoan, arg_max(t, pos) AS t FROM n WHERE l = 'khoan' GROUP BY 1, 2),
        y AS (SELECT n.dieu, n.pos, concat_ws(chr(10), CASE WHEN l <> 'dieu' THEN nullif(trim(h.t), '') END, CASE WHEN l = 'diem' THEN nullif(trim(c.t), '') END, nullif(trim(n.t), '')) AS inherited FROM n LEFT JOIN h USING (dieu) LEFT JOIN c ON c.dieu = n.dieu AND c.khoan = n.khoan)
        SELECT dieu, pos, md5(full_text) AS full_text, md5(inherited) AS inherited, md5(coalesce(nullif(full_text, ''), trim(t))) AS chosen FROM x JOIN y USING (dieu, pos)""",
    "q_case_applied": f"""SELECT bi_cao, kind, CASE kind WHEN 'upper' THEN upper(bi_cao) ELSE lower(bi_cao) END AS applied FROM (SELECT DISTINCT bi_cao, CASE WHEN NOT regexp_matches(l, '\\pL') THEN 'none' WHEN l = upper(l) THEN 'upper' WHEN l = lower(l) THEN 'lower' END AS kind
        FROM (SELECT bi_cao, regexp_replace(bi_cao, '[^\\pL\\s]', '', 'g') AS l FROM ({VERDICTS_SQL}) WHERE bi_cao IS NOT NULL)) WHERE kind IS NOT NULL""",
    "q_text_steps": "WITH d AS (SELECT doc_id, text AS t, list_filter(list_transform(string_split(text, chr(10)), lambda x: " + _TRIM.format(c="x") + """), lambda x: x <> '') AS ls FROM documents WHERE text IS NOT NULL),
        s AS (SELECT doc_id, t, ls, string_split(regexp_replace(t, '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM d)
        SELECT doc_id, md5(coalesce(ls[1], '')) AS first_line, length(regexp_replace(t, '\\n*\\s*\\{?\\d+\\}?-{3,}\\s*\\n*', chr(10) || chr(10), 'g')) AS n,
          len(list_filter(flatten(list_transform(p, lambda x: CASE WHEN length(x) <= 300 THEN [x] ELSE string_split(regexp_replace(x, ',\\s+', ',' || chr(1), 'g'), chr(1)) END)), lambda x: """ + _TRIM.format(c="x") + " <> '')) AS n_segments FROM s",
    "q_map_text": "SELECT record_id, md5(coalesce(array_to_string(list_filter(list_transform(list_sort(map_entries(nhan_dinh_cua_toa_an)), lambda e: " + _TRIM.format(c="e.value") + "), lambda x: x <> ''), chr(10) || chr(10)), '')) AS digest FROM extracted_fields",
    "q_ordered_distinct": "SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY i) AS place, name FROM (SELECT record_id, name, min(i) AS i FROM (SELECT record_id, unnest(danh_sach_bi_cao) AS name, generate_subscripts(danh_sach_bi_cao, 1) AS i FROM extracted_fields) GROUP BY 1, 2)",
    "q_eval_rows": "WITH t AS (SELECT record_id FROM (SELECT DISTINCT ON (record_id) * FROM thong_tin_chung ORDER BY record_id, loaded_at DESC) WHERE split_name = 'test'), r AS (SELECT record_id, count(sig) AS n_labels FROM t LEFT JOIN (" + LABELS_SQL
    + ") ON doc = record_id::VARCHAR GROUP BY 1) SELECT record_id, n_labels, '' AS reason FROM r WHERE n_labels > 0 UNION ALL (SELECT record_id, n_labels, 'missing_eval_row' FROM r WHERE n_labels = 0 ORDER BY record_id LIMIT 20)",
    "q_retry": f"SELECT mention_id AS id, phat_tu IS NULL OR phat_tu = '' AS retried, CASE WHEN phat_tu IS NULL OR phat_tu = '' THEN 'empty answer, asked again' ELSE '' END AS warnings, coalesce(nullif(phat_tu, ''), 'asked again') AS phat_tu FROM ({VERDICTS_SQL})",
    "q_stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "q_field_sweep": "WITH t AS (" + " UNION ALL ".join(_trial_sql(i, *t) for i, t in enumerate(_GRID[:10]))
    + f"), z AS (SELECT *, recall >= {TARGET} AS reached FROM t) SELECT * FROM z WHERE trial <= coalesce((SELECT min(trial) FROM z WHERE reached), 9)",
}
