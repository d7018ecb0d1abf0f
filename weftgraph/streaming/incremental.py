"""Incremental work: new documents chunked as they arrive, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_texts


def chunk_new_files(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, size: int = 1000, overlap: int = 200) -> StreamingQuery:
    """Chunk the documents of every new Parquet file of a folder, exactly once, then stop."""
    docs = spark.readStream.schema(schema).parquet(folder)
    return chunk_texts(docs, size=size, overlap=overlap).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and mean values by window and type; with a watermark on a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
