"""Structured Streaming forms of the stateless transforms: documents as they arrive, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_hash, tokens


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fresh_documents(docs: DataFrame, time: str, delay: str) -> DataFrame:
    """Documents whose content was not seen within the delay, with hash and number of tokens; state is dropped after it."""
    hashed = docs.withColumn("text_hash", text_hash(F.col("text"))).withColumn("n_tokens", F.size(tokens(F.col("text"))))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_hash"])


def windowed_counts(events: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by event time; late events beyond the delay are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
