"""The retry queue: entries from gaps, merging, what is due, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.names import backoff
from corvane.functions.text import queue_id

# What is done about a cause, in what order, and when an entry is over.
ACTIONS = {"missing_transcript": "transcribe", "transcription_failed": "transcribe", "diarization_failed": "diarize", "entity_pending": "entity", "rag_pending": "rag", "obsidian_pending": "obsidian"}
ACTION_ORDER = ("transcribe", "diarize", "entity", "rag", "obsidian")
TERMINAL = ("succeeded", "terminal_failure")
HISTORY = "array<struct<at:timestamp,outcome:string,error:string>>"
PRESERVED = ("created_at", "status", "attempts", "terminal_failure", "history")


def action_rank(action: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ACTION_ORDER)), action), F.lit(0)) - 1, F.lit(9))


def build(gaps: DataFrame, now: Column, once: bool = False) -> DataFrame:
    """An entry for each gap (reason, file, stem, priority) that can be acted on; of equal stems and causes, which is what an id is
    made of, the last file's. once: gaps have none, as recon.gaps(once=True) makes them, and needn't be sorted to find the last."""
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("reason")]
    e = gaps.withColumn("next_action", action).filter("next_action is not null")
    # By stem and cause, not by id: gaps are dealt by their stems already, and ids are made of what stays.
    last = e if once else e.withColumn("k", F.row_number().over(Window.partitionBy("stem", "reason").orderBy(F.desc("file")))).filter("k = 1")
    last = last.withColumn("queue_id", queue_id(F.col("stem"), F.col("reason"), F.col("next_action")))
    return last.select(
        "queue_id", "stem", "file", "reason", "next_action", F.coalesce("priority", F.lit("P3")).alias("priority"), F.lit("pending").alias("status"),
        F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("next_retry_at"),
        F.lit(None).cast("timestamp").alias("lease_expires_at"), F.lit(False).alias("terminal_failure"), F.array().cast(HISTORY).alias("history"), now.alias("created_at"), now.alias("updated_at"),
    )


def ordered(queue: DataFrame, with_reason: bool = True) -> DataFrame:
    keys = [F.coalesce("priority", F.lit("P9")), action_rank(F.col("next_action")), F.col("stem")]
    return queue.orderBy(*keys, *([F.col("reason")] if with_reason else []))


def merge(existing: DataFrame, generated: DataFrame, now: Column) -> DataFrame:
    """Terminal entries stay as they are; others take the new fields and keep their state; both sides' lone entries stay."""
    o, n = existing.alias("o"), generated.alias("n")
    old, new = F.col("o.queue_id").isNotNull(), F.col("n.queue_id").isNotNull()
    frozen = old & (~new | F.col("o.status").isin(*TERMINAL))

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == "updated_at":
            return F.when(frozen, a).when(old, now).otherwise(b)
        if c in ("last_error", "next_retry_at", "lease_expires_at"):
            return F.when(old, a).otherwise(b)
        if c in PRESERVED:
            return F.when(old, F.coalesce(a, F.when(~frozen, b))).otherwise(b)
        return F.when(frozen, a).otherwise(F.coalesce(b, a))

    return o.join(n, F.col("o.queue_id") == F.col("n.queue_id"), "full").select(*[pick(c).alias(c) for c in existing.columns])


def is_due(now: Column) -> Column:
    status = F.coalesce("status", F.lit("pending"))
    return (
        F.when(F.coalesce("terminal_failure", F.lit(False)) | status.isin(*TERMINAL), False)
        .when(status == "running", F.coalesce(F.col("lease_expires_at") <= now, F.lit(False)))
        .when(F.col("next_retry_at").isNotNull(), F.col("next_retry_at") <= now)
        .otherwise(status.isin("pending", "failed"))
    )


def work(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next entries that a worker takes: a top-k, not a global sort."""
    return ordered(queue.filter(is_due(now))).limit(limit)


def apply_outcomes(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """queue after outcomes (queue_id, ok, error, at), one for each entry at most."""
    q = queue.join(outcomes.select("queue_id", "ok", "error", "at"), "queue_id", "left")
    done, attempts = F.col("ok").isNotNull(), F.col("attempts") + 1
    over = attempts >= F.coalesce("max_attempts", F.lit(3))
    state = F.when(F.col("ok"), "succeeded").when(over, "terminal_failure").otherwise("pending")
    event = F.struct(F.col("at").alias("at"), F.when(F.col("ok"), "succeeded").otherwise("failed").alias("outcome"), F.when(~F.col("ok"), F.col("error")).alias("error"))
    new = {
        "attempts": attempts, "status": state, "last_error": F.when(~F.col("ok"), F.col("error")), "terminal_failure": ~F.col("ok") & over,
        "next_retry_at": F.when(~F.col("ok") & ~over, backoff(F.col("at"), attempts)), "updated_at": F.col("at"), "history": F.concat("history", F.array(event).cast(HISTORY)),
    }
    return q.select(*[F.when(done, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in queue.columns])


def plan(queue: DataFrame) -> DataFrame:
    """queue_id, step, arguments, error: what a worker is to run for each entry; running it is the worker's own. A failed transcription,
    and every separation of speakers, is forced; both need source_path. arguments: of step, in order."""
    action, path, bare = F.col("next_action"), F.coalesce("source_path", F.lit("")), F.array().cast("array<string>")
    audio = F.array(F.lit("--file"), path)
    forced = F.concat(audio, F.array(F.lit("--force")))
    folder = F.regexp_extract(F.regexp_replace(F.coalesce("transcript_path", F.lit("")), r"\\", "/"), "^(.*)/[^/]*$", 1)
    arguments = (
        F.when((action == "transcribe") & (F.col("reason") != "transcription_failed"), audio).when(action.isin("transcribe", "diarize"), forced)
        .when(action == "entity", F.array(F.lit("--base-dir"), F.when(folder == "", ".").otherwise(folder))).when(action == "rag", F.array(F.lit("--json"))).otherwise(bare)
    )
    error = F.when(~F.coalesce(action.isin(*ACTION_ORDER), F.lit(False)), F.concat(F.lit("unsupported next_action: "), F.coalesce(action, F.lit("none"))))
    error = error.when(action.isin("transcribe", "diarize") & (path == ""), F.concat(F.lit("missing source_path for "), action))
    return queue.select("queue_id", action.alias("step"), F.when(error.isNull(), arguments).otherwise(bare).alias("arguments"), error.alias("error"))
