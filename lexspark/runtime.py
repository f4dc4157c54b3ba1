"""Session helpers shared by every operator: table access, lineage cuts, partition counts."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a table is a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder named by ``spark.checkpoint.dir``; in local mode alone one is made where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexspark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks worth having for compute-bound stages: three per core of the cluster, at least eight."""
    return max(8, 3 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` for compute-bound Python work, where partitions by size would leave cores idle."""
    return df.repartition(parallelism(df.sparkSession), *keys)


def latest_delivery(df: DataFrame, key: str, at: str = "loaded_at") -> DataFrame:
    """One row per ``key``: the delivery with the greatest ``at`` (null counts as oldest).

    Rows are ranked by hashes of fixed size, never compared column by column, so columns may have any type, maps too.
    The first rank of each task is taken before the shuffle, so a key that was delivered very often moves one row per
    task.
    """
    plain = [F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in df.dtypes]
    order = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.xxhash64(*plain))
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1).drop("_place")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as compressed Parquet in the shared folder and read it back: for frames with long texts.

    The folder is removed when the application ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever it was imported from."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexspark-code-")) / "lexspark_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, Path(package.name) / source.relative_to(package))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def wide_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for Python work, dealt to all cores where the files give less than half as many splits.

    Large tables have splits enough and are not shuffled; a small file would be worked on by one core.
    """
    rows = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows
