"""Incremental ingest: passages arrive as files, are chunked once per id, and are appended.

State is the target itself: each micro-batch is deduplicated and anti-joined with the ids already there, so no
operator state grows, and a replayed batch appends nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarrion.operators.chunking import ChunkConfig, chunk_table
from quarrion.sources.sinks import append_unprocessed


def stream_chunks(
    spark: SparkSession, source: str, fields: T.StructType, target: str, checkpoint: str, config: ChunkConfig | None = None, most_files: int = 1000
) -> StreamingQuery:
    """Start the ingest of new Parquet files of ``source`` into chunks at ``target``; ends when all are read."""
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", most_files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        texts = batch.where(F.col("passage_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["passage_id"])
        append_unprocessed(chunk_table(texts, config), target, "passage_id")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Counts and sums per window and key, rows later than ``late`` left out in a stream. Works on batches too."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, width).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
