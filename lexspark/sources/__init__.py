"""Readers: JSON folders with and without tolerance, whole texts, reports, file lists, and ports to external tools."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_folder(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """One row per JSON file with its ``file`` name; with ``strict`` a broken file aborts, else it goes to ``_corrupt``."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        wanted = T.StructType([*wanted.fields, T.StructField("_corrupt", T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
    return reader.schema(wanted).json(f"{path}/*.json").withColumn("file", F.col("_metadata.file_name"))


def scan_counters(cases: DataFrame) -> DataFrame:
    """One row of counters over a tolerant scan (file, case_id, n_sigs, _corrupt)."""
    ok = F.col("_corrupt").isNull()
    return cases.agg(
        F.count("*").alias("files_seen"),
        F.count_if(~ok).alias("json_errors"),
        F.count_if(ok & F.col("n_sigs").isNull()).alias("skipped_missing_articles"),
        F.count_if(ok & (F.col("n_sigs") == 0)).alias("skipped_empty_clause_set"),
        F.count_if(ok & (F.col("n_sigs") > 0)).alias("loaded_cases"),
        (F.count(F.when(ok, F.col("case_id"))) - F.countDistinct(F.when(ok, F.col("case_id")))).alias("duplicate_case_ids"),
    )


def law_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Chapters of a statute file, which must be a list; another root raises an error when read."""
    raw = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    checked = raw.select(F.when(F.startswith("value", F.lit("[")), F.col("value")).otherwise(F.raise_error(F.lit("the statute file must hold a list"))).alias("value"))
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return checked.select(F.posexplode(F.from_json("value", T.ArrayType(wanted))).alias("chapter_pos", "chapter")).select("chapter_pos", "chapter.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of every text file of a folder."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def report_rows(report: DataFrame, rows: str = "per_doc") -> DataFrame:
    """One row per doc_id of a report's array column; of repeated ids the last, blank ids dropped."""
    flat = report.select(F.posexplode(rows).alias("pos", "r")).where(F.trim(F.col("r.doc_id")) != "")
    return flat.groupBy(F.col("r.doc_id").alias("doc_id")).agg(F.max_by("r", "pos").alias("row"))


def select_files(files: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of a list (pos, name) in the order of first mention, and the names that no file has."""
    wanted = names.select("pos", F.trim("name").alias("file")).where("file <> ''").groupBy("file").agg(F.min("pos").alias("pos"))
    return files.join(wanted, "file").orderBy("pos"), wanted.join(files, "file", "left_anti").orderBy("pos")


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n files by name; n must be positive."""
    if n < 1:
        raise ValueError("first_files needs at least one file")
    return files.orderBy("file").limit(n)


def external(files: DataFrame, convert: Callable[[bytes], str], suffix: str = "") -> DataFrame:
    """Port for converters (DOCX paragraphs, OCR): (file, text, status) of binary files (path, content).

    ``convert`` runs in Arrow batches on the executors; status is OK, EMPTY or FAIL, and failures stay rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    text = convert(content)
                    out.append((path, text, "OK" if text.strip() else "EMPTY"))
                except Exception as e:  # a broken file must not end the job
                    out.append((path, str(e), "FAIL"))
            yield pd.DataFrame(out, columns=["file", "text", "status"])

    return files.select("path", "content").where(F.endswith("path", F.lit(suffix))).mapInPandas(run, "file string, text string, status string")
