"""Structured Streaming: pairs scored against the catalogue as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def pair_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of pairs as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """J1 as a stream-static join: every pair stays, missing texts are empty."""
    a = texts.select(F.col("id").alias("id1"), F.col("text").alias("text1"))
    b = texts.select(F.col("id").alias("id2"), F.col("text").alias("text2"))
    out = pairs.join(a, "id1", "left").join(b, "id2", "left")
    return out.withColumns({"text1": F.coalesce("text1", F.lit("")), "text2": F.coalesce("text2", F.lit(""))})


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there into Parquet, then stop; offsets survive restarts."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_counts(events: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts per window and key with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
