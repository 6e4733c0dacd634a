"""Runs, steps and state files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.names import hours_between
from corvane.functions.text import strip
from corvane.session import beside

# Signatures in the order in which they are looked for, ages in hours, which states count as processed.
SIGNATURES = ("ModuleNotFoundError", "ImportError", "FileNotFoundError", "PermissionError", "ConnectionError", "TimeoutError", "RuntimeError", "429", "503", "500")
STALE_HOURS = {"pipeline_state.json": 72, "persistent_todos.json": 48, "events.jsonl": 168, "correction_rules.json": 168}
STALE_DEFAULT, SAME_ERRORS = 48, 3
PROCESSED = ("ok", "fallback", "skipped_fast_score")


def error_signature(stderr: Column) -> Column:
    """The first line with the first known signature, else the whole, 200 characters at most."""
    text = F.coalesce(stderr, F.lit(""))
    lines = F.split(text, r"\r\n|\n|\r")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in SIGNATURES:
        first = F.get(F.filter(lines, _contains(s)), F.lit(0))
        out = out.when(_contains(s)(text), F.left(strip(first), F.lit(200)))
    return out.otherwise(F.coalesce(F.nullif(F.left(strip(text), F.lit(200)), F.lit("")), F.lit("unknown")))


def _contains(s: str):
    return lambda x: F.contains(F.lower(x), F.lit(s.lower()))


def error_streaks(runs: DataFrame) -> DataFrame:
    """step, signature, count of the errors of the same signature that each step ends with, over runs (seq, step, returncode,
    stderr). A success or another signature begins anew."""
    r = runs.withColumn("sig", F.when(F.col("returncode") != 0, error_signature(F.col("stderr"))))
    last = r.groupBy("step").agg(F.max_by(F.struct("sig"), "seq").alias("l")).select("step", F.col("l.sig").alias("last"))
    broken = r.join(last, "step").groupBy("step", "last").agg(F.max(F.when(~F.col("sig").eqNullSafe(F.col("last")), F.col("seq"))).alias("since"))
    tail = r.join(broken.filter("last is not null"), "step").filter("since is null or seq > since")
    return tail.groupBy("step", F.col("last").alias("signature")).agg(F.count(F.lit(1)).alias("count"))


def paused(runs: DataFrame, most: int = SAME_ERRORS) -> DataFrame:
    return error_streaks(runs).filter(F.col("count") >= most)


def last_results(runs: DataFrame, most: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("seq")).limit(most)


def run_steps(steps: DataFrame, paused_steps: DataFrame) -> DataFrame:
    """steps (run, pos, step, upstream, returncode) with what becomes of each: -3 if an upstream step before it in its run failed,
    -2 if it is paused, else its own code."""
    s = steps.join(paused_steps.select("step", F.lit(True).alias("_paused")), "step", "left")
    s = s.withColumn("own", F.when(F.col("_paused"), -2).otherwise(F.col("returncode")))
    # The first upstream failure of a run decides for all that come behind it: an aggregate, not a sort of a run's steps.
    failed = s.groupBy("run").agg(F.min(F.when(F.col("upstream") & (F.col("own") != 0), F.col("pos"))).alias("failed"))
    blocked = ~F.col("upstream") & F.coalesce(F.col("failed") < F.col("pos"), F.lit(False))
    return beside(s, failed, "run").withColumn("outcome", F.when(blocked, -3).otherwise(F.col("own"))).select("run", "pos", "step", "upstream", "outcome")


def run_status(steps: DataFrame, code: str = "returncode") -> DataFrame:
    bad, good = F.count_if(F.col(code) != 0), F.count_if(F.col(code) == 0)
    return steps.groupBy("run").agg(F.when((bad > 0) & (good > 0), "partial_success").when(bad > 0, "failed").otherwise("succeeded").alias("status"))


def recent_gaps(files: DataFrame, transcripts: DataFrame, blacklist: DataFrame, now: Column) -> DataFrame:
    """stem, state of audio (stem, mtime) of the last three hours without a transcript: pending under 30 minutes, else missing."""
    new = files.filter(F.col("mtime") >= now - F.expr("interval 3 hours")).join(blacklist.select("stem"), "stem", "left_anti").join(transcripts.select("stem"), "stem", "left_anti")
    return new.select("stem", F.when(F.col("mtime") >= now - F.expr("interval 30 minutes"), "pending").otherwise("missing").alias("state"))


def processed_stems(batches: DataFrame) -> DataFrame:
    """Distinct stems of batches (results: array of (file, status)) that were dealt with."""
    return batches.select(F.explode("results").alias("r")).filter(F.col("r.status").isin(*PROCESSED) & (F.coalesce("r.file", F.lit("")) != "")).select(F.col("r.file").alias("stem")).distinct()


def orphans(todos: DataFrame) -> DataFrame:
    return todos.agg(F.count_if(F.col("status").isNull()).alias("orphans"))


def check_files(files: DataFrame, now: Column) -> DataFrame:
    """file, present, stale, age_hours, parse_ok, parse_error of files (file, present, mtime, content as text)."""
    most = F.coalesce(F.create_map(*[F.lit(x) for kv in STALE_HOURS.items() for x in kv])[F.col("file")], F.lit(STALE_DEFAULT))
    age = hours_between(F.col("mtime"), now)
    text = F.regexp_replace("content", "^﻿", "")
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    bad_line = F.get(F.filter(lines, lambda x: (strip(x["line"]) != "") & F.try_parse_json(x["line"]).isNull()), F.lit(0))["n"]
    error = (
        F.when(~F.col("present") | (F.coalesce(F.length("content"), F.lit(0)) == 0), F.lit(None).cast("string"))
        .when(F.contains("content", F.lit("\0")), "null byte found")
        .when(F.col("file").endswith(".jsonl") & bad_line.isNotNull(), F.concat(F.lit("line "), bad_line.cast("string")))
        .when(F.col("file").endswith(".json") & F.try_parse_json(F.col("content")).isNull(), "no JSON")
    )
    return files.select(
        "file", "present", F.when(F.col("present"), age > most).otherwise(True).alias("stale"), F.when(F.col("present"), F.bround(age, 1)).otherwise(-1.0).alias("age_hours"), error.isNull().alias("parse_ok"), error.alias("parse_error")
    )


def state_ok(checked: DataFrame) -> DataFrame:
    return checked.agg(F.bool_and(F.col("present") & ~F.col("stale") & F.col("parse_ok")).alias("ok"))
