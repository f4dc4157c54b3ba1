"""Writers: reports, one JSON per record, vector upserts, split lists, quarantine, resume."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.runtime import path_exists, write_text


def write_report(summary: DataFrame, path: str) -> None:
    """A one-row summary as indented JSON text."""
    row = summary.limit(1).toJSON().collect()[0]
    write_text(summary.sparkSession, path, json.dumps(json.loads(row), ensure_ascii=False, indent=2))


def write_records(records: DataFrame, path: str, by: str) -> None:
    """One JSON file per value of ``by``, in a folder of its name: a record each where ``by`` is unique."""
    records.repartition(F.col(by)).write.partitionBy(by).mode("overwrite").json(path)


def new_version(table: DataFrame, path: str) -> str:
    """Write a table as the next version under ``path`` (v1, v2, ...) beside the ones that are there; gives its path."""
    spark, n = table.sparkSession, 1
    while path_exists(spark, f"{path}/v{n}"):
        n += 1
    table.write.parquet(f"{path}/v{n}")
    return f"{path}/v{n}"


def not_done(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return new.join(done.select(key), key, "left_anti")


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose id the stored table lacks, one per id; gives their number."""
    fresh = new.dropDuplicates([key])
    if path_exists(spark, path):
        fresh = not_done(fresh, spark.read.parquet(path), key)
    fresh = fresh.persist()
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def write_split(split: DataFrame, path: str) -> None:
    """Two sorted lists of stems of (stem, is_test)."""
    for name, part in (("test", split.where("is_test")), ("train", split.where("not is_test"))):
        part.orderBy("stem").select("stem").coalesce(1).write.mode("overwrite").text(f"{path}_{name}")


def quarantine(files: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good files, and bad ones with a name that is free: a repeated stem gets __dup_1, __dup_2 ..."""
    names = bad.select("file").distinct()
    order = Window.partitionBy("file").orderBy("path")
    moved = files.join(names, "file", "left_semi").withColumn("n", F.row_number().over(order) - 1)
    stem, end = F.regexp_replace("file", r"\.[^.]*$", ""), F.regexp_extract("file", r"(\.[^.]*)$", 1)
    moved = moved.withColumn("target", F.when(F.col("n") == 0, F.col("file")).otherwise(F.concat(stem, F.lit("__dup_"), F.col("n").cast("string"), end))).drop("n")
    return files.join(names, "file", "left_anti"), moved


def text_report(summary: DataFrame, title: str, width: int = 28, most: int = 200) -> str:
    """A small table as fixed-width text; at most ``most`` rows reach the driver."""
    rows = summary.limit(most).collect()
    lines = [title, "=" * len(title), "".join(c.ljust(width) for c in summary.columns)]
    lines += ["".join(("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)).ljust(width) for v in r) for r in rows]
    return "\n".join(line.rstrip() for line in lines) + "\n"
