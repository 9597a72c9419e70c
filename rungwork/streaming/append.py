"""Streaming append: segments that arrive as files are deduplicated and counted by collection while the crawl is live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def segment_stream(spark: SparkSession, path: str, schema: T.StructType, late: str = "400 days") -> DataFrame:
    """Segments of Parquet files as they arrive, each key once within the watermark of ``harvested_at``."""
    stream = spark.readStream.schema(schema).parquet(path)
    timed = stream.withColumn("harvested_at", F.col("harvested_at").cast("timestamp"))
    return timed.withWatermark("harvested_at", late).dropDuplicatesWithinWatermark(["segment_id"])


def counts_by_day(segments: DataFrame) -> DataFrame:
    """Segments of each collection and day of arrival."""
    return segments.groupBy(F.window("harvested_at", "1 day").alias("w"), "collection_id").agg(F.count(F.lit(1)).alias("n_segments")).select(F.col("w.start").alias("day"), "collection_id", "n_segments")


def append_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet, exactly once, with what is there now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
