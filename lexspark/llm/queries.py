"""Queries of the training-data operators; ``__spark_entry__`` adds them where this subpackage can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import chunking, encoding, mixing, names, neighbours, overlap, packing, scanned, tokens, topics
from lexspark.runtime import cut, latest_delivery, table, wide_table


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, states, n_tokens, restored): garbled documents with the encoding pairs and the restored text."""
    found = encoding.find_garbled(wide_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id").selectExpr("doc_id", "array_join(states, '|') AS states", "n_tokens", "restored")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents that hold a garbled sequence."""
    return p10_restored(spark, sf_dir).select("doc_id").distinct()


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, other_id, cosine, rank): the five most similar other vectors of every vector."""
    found = neighbours.nearest(wide_table(spark, sf_dir, "chunk_vectors", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return found.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), "cosine", "rank")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id_a, vec_id_b): pairs of which one is among the five most similar to the other."""
    found = p2_neighbours(spark, sf_dir)
    return found.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()


def _scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("noi_dung_vu_an"), F.col("noi_dung_vu_an.qua_trinh_dieu_tra"), F.lit("quyet_dinh"), F.col("quyet_dinh"))
    return wide_table(spark, sf_dir, "extracted_fields", "record_id", "noi_dung_vu_an", "quyet_dinh").select(F.col("record_id").alias("id"), F.explode(fields).alias("field", "t"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field, kind): the kinds of scan noise in narratives and decisions."""
    return scanned.find_noise(_scanned_texts(spark, sf_dir)).withColumnRenamed("id", "record_id")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field, repaired): narratives and decisions in whole paragraphs."""
    return scanned.repair(_scanned_texts(spark, sf_dir)).withColumnRenamed("id", "record_id")


#: Number of a judgment inside its identifier, however the rest is written.
_CASE_NUMBER = r"(?i)(\d+\s*ta\s*\d+\s*t)"


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split_name, source, number): one row per record with a split."""
    rows = table(spark, sf_dir, "thong_tin_chung").select("record_id", "split_name", "source", "ma_ban_an", "filename", "loaded_at")
    rows = latest_delivery(rows, "record_id").where("split_name is not null")
    name = F.coalesce("ma_ban_an", "filename")
    number = F.nullif(F.lower(F.regexp_replace(F.regexp_extract(name, _CASE_NUMBER, 1), r"\s", "")), F.lit(""))
    return rows.select(F.col("record_id").alias("id"), "split_name", "source", number.alias("number"))


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_table(spark, sf_dir, "extracted_fields", "record_id", "noi_dung_vu_an").select(F.col("record_id").alias("id"), F.col("noi_dung_vu_an.qua_trinh_dieu_tra").alias("t"))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, text_class, in_train, n_links): the class of equal texts of every record of a split, and how many
    classes of the other side are near it; copies are not written out as pairs."""
    judgments = cut(_judgments(spark, sf_dir)).withColumn("side", F.col("split_name") == "train")
    near, members = overlap.near_pairs(_narratives(spark, sf_dir), judgments.select("id", "side"))
    near = cut(near)
    links = near.groupBy(F.col("text_a").alias("doc")).agg(F.count("*").alias("n")).withColumn("side", F.lit(True))
    links = links.unionByName(near.groupBy(F.col("text_b").alias("doc")).agg(F.count("*").alias("n")).withColumn("side", F.lit(False)))
    both = members.select("doc", "side").distinct().groupBy("doc").agg((F.count("*") - 1).alias("same"))  # an equal text on the other side
    rows = members.join(links, ["doc", "side"], "left").join(both, "doc")
    return rows.select(F.col("id").alias("record_id"), F.col("doc").alias("text_class"), F.col("side").alias("in_train"), (F.coalesce("n", F.lit(0)) + F.col("same")).alias("n_links"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id_a, record_id_b): judgments of validation and test that stand also in train."""
    judgments = cut(_judgments(spark, sf_dir)).withColumn("side", F.col("split_name") == "train")
    pairs = overlap.cross_split_pairs(_narratives(spark, sf_dir), judgments.select("id", "side", "number"))
    return pairs.select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(split_name, source, n_pairs, n_records): overlaps with train by the split and source of the other record."""
    judgments = _judgments(spark, sf_dir)
    pairs = p7_found(spark, sf_dir)
    ends = pairs.select("record_id_a", "record_id_b", F.explode(F.array("record_id_a", "record_id_b")).alias("id"))
    other = ends.join(judgments.where("split_name <> 'train'"), "id")
    return other.groupBy("split_name", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("id").alias("n_records"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field, part_key, piece, n_pieces, overlap, piece_text): oversized texts in pieces."""
    rows = wide_table(spark, sf_dir, "extracted_fields", "record_id", "noi_dung_vu_an", "nhan_dinh_cua_toa_an")
    story = F.create_map(F.lit("qua_trinh_dieu_tra"), F.col("noi_dung_vu_an.qua_trinh_dieu_tra"), F.lit("ket_luan_cac_ben"), F.col("noi_dung_vu_an.ket_luan_cac_ben"))
    keys = ("record_id", "field", "part_key")
    parts = rows.select("record_id", F.lit("noi_dung_vu_an").alias("field"), F.explode(story).alias("part_key", "t"))
    points = rows.select("record_id", F.lit("nhan_dinh_cua_toa_an").alias("field"), F.explode("nhan_dinh_cua_toa_an").alias("part_key", "t"))
    return chunking.split_texts(parts.unionByName(points), keys)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field, part_key): the texts that came out in more than one piece."""
    return p4_pieces(spark, sf_dir).where("piece = 2").select("record_id", "field", "part_key").distinct()


#: Labels of an address that may be left out or shortened.
_LABELS = r"(?<![a-z0-9])(?:thon|xa|x|huyen|h|tinh|t)(?![a-z0-9])"


def _plain(column: Column) -> Column:
    """Lower case without accents; letters and digits of an address between single blanks, without its labels."""
    letters = F.translate(F.lower(column), _ACCENTED, _BARE)
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(letters, "[^a-z0-9]+", " "), _LABELS, " "), " +", " "))


_ACCENTED = "".join(c for c in encoding.VIET.lower()) + "\u031b\u0323\u0300\u0301\u0303\u0309\u0302\u0306"
_BARE = "".join(names.fold(c) for c in encoding.VIET.lower())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id_a, mention_id_b): mentions of one person under different written names."""
    people = latest_delivery(table(spark, sf_dir, "thong_tin_bi_cao").select("mention_id", "record_id", "ho_ten", "ngay_sinh", "noi_cu_tru", "loaded_at"), "mention_id")
    people = cut(people)
    block = F.concat(F.lit("r"), F.col("record_id").cast("string"))
    listed = [people.select(F.col("mention_id").alias("id"), block.alias("block"), F.col("ho_ten").alias("name"), F.lit(True).alias("centre"), F.lit("bi_cao").alias("list"))]
    for name in ("de_nghi_vien_kiem_sat", "phan_quyet_toa_so_tham"):
        rows = latest_delivery(table(spark, sf_dir, name).select("mention_id", "record_id", "bi_cao", "loaded_at"), "mention_id")
        listed.append(rows.select(F.col("mention_id").alias("id"), block.alias("block"), F.col("bi_cao").alias("name"), F.lit(False).alias("centre"), F.lit(name).alias("list")))
    born = F.regexp_replace("ngay_sinh", "[^0-9]+", "/")
    again = people.where("ngay_sinh is not null and noi_cu_tru is not null")
    again = again.select(F.col("mention_id").alias("id"), F.concat_ws("|", F.lit("p"), born, _plain(F.col("noi_cu_tru"))).alias("block"), F.col("ho_ten").alias("name"), F.lit(False).alias("centre"), F.lit("bi_cao").alias("list"))
    mentions = listed[0].unionByName(listed[1]).unionByName(listed[2]).unionByName(again)
    pairs = names.same_person(mentions)
    return pairs.select(F.col("id_a").alias("mention_id_a"), F.col("id_b").alias("mention_id_b"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, n_tokens, container, capacity): the place of every document or part of one."""
    sizes = tokens.token_table(wide_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").select("id", F.col("n_tokens").alias("size"))
    return packing.pack_items(sizes).select(F.col("id").alias("doc_id"), "part", F.col("size").alias("n_tokens"), "container", "capacity")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capacity, n_containers, n_items, n_tokens, fill): how full the containers of each capacity are."""
    bins = p8_packed(spark, sf_dir).groupBy("container", "capacity").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return bins.groupBy("capacity").agg(F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / F.sum("capacity"), 6).alias("fill"))


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mix and how often each is used."""
    documents = wide_table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    counts = topics.counted(documents, "text", ("doc_id", "source", "lang"), tokens.count)
    records = topics.labelled(counts, topics.fit_counts(counts), ("doc_id", "source", "lang", "size")).withColumnRenamed("doc_id", "id")
    mixed = mixing.mix(records, table(spark, sf_dir, "mix_targets"))
    return mixed.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target_share, actual_share, n_records, n_copies, tokens, max_copies): the shares reached."""
    return mixing.shares(p9_mixed(spark, sf_dir).withColumnRenamed("n_tokens", "size"), table(spark, sf_dir, "mix_targets"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_neighbours, p3_found, p3_repaired, p4_found, p4_pieces, p5_found, p7_found, p7_classes, p7_counts, p8_packed, p8_fill, p9_mixed, p9_shares, p10_found, p10_restored)}
ORACLE_SQL: dict[str, str] = {
    "p4_found": """SELECT record_id, 'noi_dung_vu_an' AS field, 'qua_trinh_dieu_tra' AS part_key FROM extracted_fields WHERE length(noi_dung_vu_an.qua_trinh_dieu_tra) > 1500
        UNION ALL SELECT record_id, 'noi_dung_vu_an', 'ket_luan_cac_ben' FROM extracted_fields WHERE length(noi_dung_vu_an.ket_luan_cac_ben) > 1500
        UNION ALL SELECT record_id, 'nhan_dinh_cua_toa_an', e.key FROM (SELECT record_id, unnest(map_entries(nhan_dinh_cua_toa_an)) AS e FROM extracted_fields) WHERE length(e.value) > 1500""",
}
