"""Corrections that models propose: sightings, suggestions, promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, SOURCES = 3, 20


def valid_sightings(seen: DataFrame) -> DataFrame:
    """seen (seq, original, corrected, source, reason) with both sides trimmed, different and not empty."""
    a, b = F.trim("original"), F.trim("corrected")
    return seen.withColumns({"original": a, "corrected": b}).filter("original <> '' and corrected <> '' and original <> corrected")


def suggestions(seen: DataFrame, sources: int = SOURCES) -> DataFrame:
    """original, corrected, count, first_seen, last_seen, and the last distinct sources in the order of their first sight.

    Sources are first made distinct by a shuffle of their own, and only the last `sources` of a suggestion are collected.
    """
    seen = valid_sightings(seen)
    key = ["original", "corrected"]
    counts = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("first_seen"), F.max("seq").alias("last_seen"))
    first = seen.filter("source <> ''").groupBy(*key, "source").agg(F.min("seq").alias("seq"))
    last = first.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("seq")))).filter(F.col("k") <= sources)
    listed = last.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("sources"))
    return counts.join(listed, key, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def promotions(seen: DataFrame, rules: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Rules to add, disabled: suggestions sighted often enough whose original no rule (old) has; of several for one original the
    first to get there."""
    key = ["original", "corrected"]
    ranked = valid_sightings(seen).withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("seq")))
    reached = ranked.filter(F.col("k") == threshold).join(rules.select(F.trim("old").alias("original")).distinct(), "original", "left_anti")
    first = reached.withColumn("n", F.row_number().over(Window.partitionBy("original").orderBy("seq"))).filter("n = 1")
    note = F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit("auto-promoted ("), F.col("reason"), F.lit(")"))).otherwise("auto-promoted")
    return first.select("original", "corrected", F.col("seq").alias("promoted_at"), note.alias("note"), F.lit(False).alias("enabled"))
