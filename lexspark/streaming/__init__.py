"""Incremental runs as Structured Streaming: a folder is read once per file, stored ids are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexspark.sources.sinks import upsert


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, key: str = "id", files_per_batch: int | None = None, every: float | None = None) -> StreamingQuery:
    """Read the Parquet files of a folder that are new since the last run and append the rows whose id is new.

    A new checkpoint folder reads everything again; ids that are stored stay as they are. ``files_per_batch`` limits
    the rate. The query ends by itself when all files are read, or, with ``every`` (seconds between batches), runs on.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = transform(reader.parquet(source))
    write = stream.writeStream.foreachBatch(lambda batch, _: upsert(batch.sparkSession, batch, target, key))
    trigger = {"availableNow": True} if every is None else {"processingTime": f"{int(every * 1000)} milliseconds"}
    return write.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stop_when(query: StreamingQuery, met: Callable[[], bool], look: float = 1.0) -> bool:
    """Watch a running query and stop it as soon as ``met`` holds; whether it did before the query ended."""
    while query.isActive:
        if met():
            query.stop()
            return True
        query.awaitTermination(look)
    return met()
