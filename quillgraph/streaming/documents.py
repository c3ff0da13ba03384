"""Documents as a stream of files: an extension, as incremental runs by Structured Streaming.

The stream's checkpoint remembers which files are done; exact copies within the watermark
are dropped by the hash of their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions.text import content_hash, section_chunks


def read_documents(spark: SparkSession, path: str, schema: str = "id long, content_text string, arrived timestamp") -> DataFrame:
    """A stream of Parquet files of documents."""
    return spark.readStream.schema(schema).parquet(path)


def distinct_texts(docs: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The first of each text that arrives within the lateness."""
    return docs.withColumn("hash", content_hash(F.col("content_text"))).withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["hash"])


def chunk_stream(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of each document as it arrives."""
    return section_chunks(docs, size, overlap)


def start(docs: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], available_now: bool = True) -> StreamingQuery:
    """Runs ``on_batch`` over each batch of documents."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """``start, claim_type, n`` per window, late rows within the watermark."""
    counts = events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")
