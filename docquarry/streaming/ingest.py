"""The batch transformation over arriving files: each micro-batch is written whole, so a crash loses nothing that
was finished."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import doc_id_from_path
from ..sources.documents import BATCH_SUFFIXES, suffix

FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
RESPONSES = "doc_id STRING, raw STRING, arrived TIMESTAMP"


def stream_files(spark: SparkSession, path: str, suffixes: list[str] | None = None, per_trigger: int = 100) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", per_trigger).load(path)
    return files.where(suffix(F.col("path")).isin(suffixes or BATCH_SUFFIXES)).withColumn("doc_id", doc_id_from_path(F.col("path")))


def stream_responses(spark: SparkSession, path: str, late: str = "10 minutes") -> DataFrame:
    """Raw model responses as JSON lines, one for each document within the watermark."""
    raw = spark.readStream.schema(RESPONSES).json(path)
    return raw.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["doc_id"])


def run_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """``transform`` over each micro-batch, written to a folder of its own, so that a repeated batch replaces
    itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by tumbling window and type; works on batch and streaming input alike."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
