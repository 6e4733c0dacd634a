"""Structured Streaming over arriving transcripts and events. The batch operators are the same columns and functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.functions.text import detect_signals, redact


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def signal_events(texts: DataFrame) -> DataFrame:
    """id, safe text and signals of texts (id, text) worth an event."""
    return texts.withColumn("s", detect_signals(F.col("text"))).filter("s.logged").select("id", redact(F.col("text")).alias("safe"), F.col("s.fast_score.score").alias("score"), F.size("s.entities").alias("entities"))


def counts_by_window(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, key, n: closed by the watermark, so that state is bounded."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, at: str, *keys: str, late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def into(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appended to a table of files, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """A sink of the caller's: a message service, a merge into a store."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
