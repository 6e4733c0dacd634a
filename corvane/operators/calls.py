"""Calls: speakers, rendering, chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import strip

# Polite endings, and by how much a speaker must talk more.
HONORIFICS = ("습니다", "입니다", "하십시오", "드리", "올리", "여쭤", "모시")
RATIO = 1.3


def speaker_stats(segments: DataFrame, honorifics: Sequence[str] = HONORIFICS) -> DataFrame:
    """call_id, speaker, seconds, polite (segments with a polite ending), first_pos."""
    polite = F.exists(F.array(*map(F.lit, honorifics)), lambda h: F.contains(F.coalesce("text", F.lit("")), h))
    spoken = segments.filter(F.coalesce("speaker", F.lit("")) != "")
    return spoken.groupBy("call_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count_if(polite).alias("polite"), F.min("pos").alias("first_pos"))


def speaker_names(segments: DataFrame, callers: DataFrame, me: str, honorifics: Sequence[str] = HONORIFICS) -> DataFrame:
    """call_id, speaker, name: for calls of exactly two labels, one of them unresolved, with a caller (call_id, caller)."""
    per = speaker_stats(segments, honorifics).groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("speaker", "seconds", "polite", "first_pos"))).alias("s"))
    two = per.filter((F.size("s") == 2) & F.exists("s", lambda x: F.contains(F.upper(x["speaker"]), F.lit("SPEAKER")))).join(callers.filter("caller <> ''"), "call_id")
    a, b = F.col("s")[0], F.col("s")[1]
    score = (
        F.when(a["seconds"] > b["seconds"] * RATIO, 1).when(b["seconds"] > a["seconds"] * RATIO, -1).otherwise(0)
        + F.when(a["polite"] > b["polite"], 2).when(b["polite"] > a["polite"], -2).otherwise(0)
        + F.when(a["first_pos"] < b["first_pos"], 1).otherwise(-1)
    )
    first_calls = F.when(score != 0, score > 0).otherwise(a["first_pos"] < b["first_pos"])
    names = F.array(
        F.struct(a["speaker"].alias("speaker"), F.when(first_calls, F.col("caller")).otherwise(F.lit(me)).alias("name")),
        F.struct(b["speaker"].alias("speaker"), F.when(first_calls, F.lit(me)).otherwise(F.col("caller")).alias("name")),
    )
    return two.select("call_id", F.inline(names))


def with_names(segments: DataFrame, names: DataFrame) -> DataFrame:
    return segments.join(names, ["call_id", "speaker"], "left").withColumn("speaker", F.coalesce("name", "speaker")).select(*segments.columns)


def rendered(segments: DataFrame) -> DataFrame:
    """call_id, text: a line for each segment that says something, in order."""
    said = segments.withColumn("t", strip(F.coalesce("text", F.lit("")))).filter("t <> ''")
    who = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit(" "), F.col("speaker"), F.lit(":"))).otherwise("")
    line = F.concat(F.format_string("[%.1f-%.1f]", F.bround(F.coalesce("start", F.lit(0.0)), 1), F.bround(F.coalesce("end", F.lit(0.0)), 1)), who, F.lit(" "), F.col("t"))
    lines = said.groupBy("call_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lines.select("call_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def serialised(segments: DataFrame) -> DataFrame:
    """Times to two places, texts stripped."""
    return segments.withColumns({"start": F.bround("start", 2), "end": F.bround("end", 2), "text": strip(F.coalesce("text", F.lit("")))})


def merged_chunks(chunks: DataFrame) -> DataFrame:
    """call_id, pos, start, end, text of chunks (call_id, chunk, offset, pos, start, end, text): times in the whole call."""
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("chunk", "pos")) - 1
    return chunks.select("call_id", place.alias("pos"), (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "text")


def quality(segments: DataFrame) -> DataFrame:
    """call_id, mean_log_prob, mean_language_prob: zero where nothing is known."""
    return segments.groupBy("call_id").agg(F.coalesce(F.avg("log_prob"), F.lit(0.0)).alias("mean_log_prob"), F.coalesce(F.avg("language_prob"), F.lit(0.0)).alias("mean_language_prob"))


def contacts(book: DataFrame) -> DataFrame:
    """phone, name: phones without hyphens and spaces, named ones only."""
    return book.select(F.regexp_replace("phone", "[- ]", "").alias("phone"), "name").filter("name <> '' and phone <> ''")


def resolved(calls: DataFrame, book: DataFrame, generic: str) -> DataFrame:
    """calls (phone, counterparty, speaker, ...): where the speaker is the counterparty or the generic label, the contact's name."""
    c = calls.join(contacts(book).withColumnRenamed("name", "_name"), "phone", "left")
    hit = F.col("_name").isNotNull() & ((F.col("speaker") == F.col("counterparty")) | (F.col("speaker") == generic))
    return c.withColumn("speaker", F.when(hit, F.col("_name")).otherwise(F.col("speaker"))).select(*calls.columns)


def to_diarize(segment_files: DataFrame, results: DataFrame, audio: DataFrame) -> DataFrame:
    """stem, why: segments without a result, or with one that failed, whose audio is there."""
    there = segment_files.select("stem").distinct().join(audio.select("stem"), "stem", "left_semi")
    none = there.join(results.select("stem"), "stem", "left_anti").withColumn("why", F.lit("missing"))
    bad = there.join(results.filter(~F.coalesce("diarize_ok", F.lit(True))).select("stem"), "stem", "left_semi").withColumn("why", F.lit("failed"))
    return none.unionByName(bad)


def duration_path(seconds: Column) -> Column:
    return F.when(seconds > 3600, "skip").when(seconds >= 1800, "fast").when(seconds > 300, "chunks").otherwise("whole")


def too_short(text: Column) -> Column:
    return F.when(F.length(strip(text)) < 10, "error").when(F.octet_length(text) < 200, "too_short").otherwise("ok")
