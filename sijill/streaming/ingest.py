"""Continuous ingest of chunk records; an extension, batches of files are all that searching needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

STREAM_SCHEMA = "row_id long, chunk_id string, text string, source_file string, indexed_at timestamp, is_deleted boolean"


def chunk_stream(spark: SparkSession, path: str, late: str = "7 days") -> DataFrame:
    """Chunk rows as their parquet files arrive, each row once within the time that rows may be late."""
    rows = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", "100").parquet(path)
    return rows.withWatermark("indexed_at", late).dropDuplicatesWithinWatermark(["row_id"])


def monthly_counts(stream: DataFrame) -> DataFrame:
    """Rows and deletions of thirty days, as event time tells them."""
    return stream.groupBy(F.window("indexed_at", "30 days")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_deleted").alias("n_deleted"))


def write_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to a parquet table; the checkpoint folder makes each row count once across restarts."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
