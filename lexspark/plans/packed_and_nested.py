"""Queries of the two general record operators: packed fields (p1) and nested records (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.operators.packed import unpack
from lexspark.operators.shred import Repeated, assemble, shred_json
from lexspark.runtime import cut, latest_delivery, table

CAN_CU = Repeated("can_cu", (("Can_Cu_Dieu_Luat",),), ("Diem", "Khoan", "Dieu", "Bo_Luat_Va_Van_Ban_Khac"))
BI_CAO = Repeated("bi_cao", (("THONG_TIN_CHUNG", "Thong_Tin_Bi_Cao"), ("Thong_Tin_Bi_Cao",)), ("Ho_Ten",))
PHAN_QUYET = Repeated("phan_quyet", (("PHAN_QUYET_CUA_TOA_SO_THAM",),), ("Bi_Cao", "Pham_Toi", "Phat_Tu"), (CAN_CU,))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, rel, parent_pos, pos, val): defendants, verdicts and legal-basis items of every readable payload."""
    shredded = shred_json(table(spark, sf_dir, "raw_extractions"), "raw_id", "payload", (BI_CAO, PHAN_QUYET))
    shredded = cut(shredded.where(F.col("leaf").isin("bi_cao.Ho_Ten", "phan_quyet.Bi_Cao", "phan_quyet.can_cu.Dieu")))

    def one(leaf: str, rel: str) -> DataFrame:
        flat = assemble(shredded, leaf)
        nested = "pos2" in flat.columns
        return flat.select(
            F.col("id").alias("raw_id"),
            F.lit(rel).alias("rel"),
            F.col("pos1").alias("parent_pos") if nested else F.lit(0).alias("parent_pos"),
            F.col("pos2" if nested else "pos1").alias("pos"),
            F.coalesce("val", F.lit("")).alias("val"),
        )

    parts = one("bi_cao.Ho_Ten", "bi_cao"), one("phan_quyet.Bi_Cao", "phan_quyet"), one("phan_quyet.can_cu.Dieu", "can_cu")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: How a value's key is made: numbers, numbers in words and the offence of a penalty do not matter.
KEYS = {
    "pham_toi": ((r"^tội\s+", ""),),
    "phat_tu": (
        (r"\((?:[^\W\d]+\s?)+\)", ""),
        (r"\d+", "#"),
        (r"về tội (?:(?!\btù\b|về tội|tổng hợp|;|\||#).)+$", "về tội"),
        (r"\s+", " "),
    ),
}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, field, pos, item): the values of every cell of pham_toi and phat_tu that holds two or more."""
    rows = latest_delivery(table(spark, sf_dir, "phan_quyet_toa_so_tham").select("mention_id", "pham_toi", "phat_tu", "loaded_at"), "mention_id")
    values = unpack(rows, "mention_id", ["pham_toi", "phat_tu"], KEYS)
    return values.where("n_values > 1").select(F.col("id").alias("mention_id"), "field", "pos", "item")


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw_id, leaf, n_entries, n_values, max_rep, max_def): the shredded columns of every payload in summary."""
    shredded = shred_json(table(spark, sf_dir, "raw_extractions"), "raw_id", "payload", (BI_CAO, PHAN_QUYET))
    n = F.size(F.filter("val", lambda x: x.isNotNull())).cast("long")
    return shredded.select(F.col("id").alias("raw_id"), "leaf", F.size("rep").cast("long").alias("n_entries"), n.alias("n_values"), F.array_max("rep").alias("max_rep"), F.array_max("def").alias("max_def"))


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, field, pos, n_values, item): the values of every cell, also of cells that hold one."""
    rows = latest_delivery(table(spark, sf_dir, "phan_quyet_toa_so_tham").select("mention_id", "pham_toi", "phat_tu", "loaded_at"), "mention_id")
    return unpack(rows, "mention_id", ["pham_toi", "phat_tu"], KEYS).withColumnRenamed("id", "mention_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p6_found, p6_tables)}
