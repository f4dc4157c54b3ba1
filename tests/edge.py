"""Odd versions of the driver's tables: without rows, and with rows that are null but for their ids."""

from pyspark.sql import functions as F

TABLES = ("extracted_fields", "thong_tin_chung", "thong_tin_bi_cao", "de_nghi_vien_kiem_sat", "phan_quyet_toa_so_tham", "raw_extractions", "chunk_vectors", "law_nodes", "toi_danh", "mix_targets", "documents")
IDS = ("record_id", "mention_id", "raw_id", "vec_id", "doc_id", "chapter_pos", "crime_id", "source", "target_share", "max_repeats")
CLASHES = ("id", "t", "k", "n", "block", "name", "field", "item", "pos", "side", "size", "label", "v")


def write(spark, sf, path, kind):
    for name in TABLES:
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if kind == "empty":
            rows = rows.limit(0)
        elif kind == "nulls" and name != "mix_targets":
            kept = [c for c in rows.columns if c in IDS and not (name == "documents" and c == "source")]
            rows = rows.select(*[F.col(c) if c in kept else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        elif kind == "clash":
            rows = rows.union(rows).select("*", *[F.lit("clash").alias(c) for c in CLASHES if c not in rows.columns])
        rows.write.parquet(f"{path}/{name}.parquet")
    return str(path)
