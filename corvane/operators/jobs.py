"""The job store as tables: a job's latest state, guarded transitions, claims, fan-out, clean-up.

Each function takes tables and returns what they become; joblog keeps them as a log that several drivers may write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# From which states a transition may start, and where it leads.
TRANSITIONS = {
    "complete": (("running",), "completed"),
    "cancel": (("pending", "running", "paused"), "cancelled"),
    "pause": (("pending", "running"), "paused"),
    "resume": (("paused",), "pending"),
}
FINISHED = ("completed", "failed", "cancelled")
FAR = "9999-12-31 00:00:00"


def submit(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """jobs and those of new whose idempotency_key neither a job nor an earlier new one has; without a key, all."""
    first = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("id")) == 1
    keyed = new.filter("idempotency_key is not null").withColumn("first", first).filter("first").drop("first")
    fresh = keyed.join(jobs.filter("idempotency_key is not null").select("idempotency_key"), "idempotency_key", "left_anti")
    return jobs.unionByName(fresh.select(*jobs.columns)).unionByName(new.filter("idempotency_key is null").select(*jobs.columns))


def next_jobs(jobs: DataFrame, now: Column, per_queue: int = 1) -> DataFrame:
    """Of each queue the pending jobs that are due: by priority, then age."""
    due = jobs.filter((F.col("status") == "pending") & (F.coalesce("scheduled_at", now) <= now))
    return due.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("priority"), "created_at", "id"))).filter(F.col("place") <= per_queue)


def claim(jobs: DataFrame, now: Column, per_queue: int = 1) -> DataFrame:
    """jobs with the next ones running."""
    got = next_jobs(jobs, now, per_queue).select("id", F.lit(True).alias("got"))
    j = jobs.join(got, "id", "left")
    new = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "started_at": F.coalesce("started_at", now)}
    return j.select(*[F.when(F.col("got"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def transition(jobs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """jobs after asked (id, kind), where the state allows it; another state stays."""
    j = jobs.join(asked.select("id", F.col("kind").alias("_asked")), "id", "left")
    to = F.lit(None).cast("string")
    for kind, (start, end) in TRANSITIONS.items():
        to = F.when((F.col("_asked") == kind) & F.col("status").isin(*start), end).otherwise(to)
    j = j.withColumn("_to", to)
    ended = F.col("_to").isin("completed", "cancelled")
    new = {"status": F.coalesce("_to", "status"), "completed_at": F.when(ended, now).otherwise(F.col("completed_at"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in jobs.columns])


def fail(jobs: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Running jobs with errors (id, error): failed after their last attempt, else pending at once."""
    j = jobs.join(errors.select("id", F.col("error").alias("_error")), "id", "left")
    hit = F.col("_error").isNotNull() & (F.col("status") == "running")
    over = F.col("attempts") >= F.col("max_attempts")
    new = {"status": F.when(over, "failed").otherwise("pending"), "error": F.col("_error"), "completed_at": F.when(over, now).otherwise(F.col("completed_at"))}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def with_progress(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """jobs with the progress of reports (id, progress), whatever their state; of several reports of a job the greatest."""
    told = reports.groupBy("id").agg(F.max("progress").alias("_told"))
    return jobs.join(told, "id", "left").select(*[F.coalesce("_told", c).alias(c) if c == "progress" else F.col(c) for c in jobs.columns])


def replay(jobs: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """New jobs like those asked for (id, new_id, override): the payload map with the override on top, without a key."""
    j = jobs.join(asked.select("id", "new_id", "override"), "id")
    payload = F.map_concat(F.map_filter("payload", lambda k, v: ~F.map_contains_key(F.coalesce("override", F.create_map().cast("map<string,string>")), k)), F.coalesce("override", F.create_map().cast("map<string,string>")))
    return j.select(F.col("new_id").alias("id"), F.lit("pending").alias("status"), "queue", "priority", payload.alias("payload"), F.lit(None).cast("string").alias("idempotency_key"), now.alias("created_at"))


def unread(messages: DataFrame, receipts: DataFrame) -> DataFrame:
    """Messages (id, job_id, ...) without a receipt (id); reading appends theirs to receipts."""
    return messages.join(receipts.select("id"), "id", "left_anti")


def logs(entries: DataFrame) -> DataFrame:
    """Log rows of entries (job_id, level, message, metadata as a map or null), for a table that they are appended to."""
    none = F.create_map().cast("map<string,string>")
    return entries.select("job_id", "level", "message", F.to_json(F.coalesce("metadata", none)).alias("metadata"))


def fan_out(parents: DataFrame, aggregator: bool = True) -> DataFrame:
    """Children of parents (id, children), numbered, and an aggregator that isn't due before it is woken."""
    kids = parents.select(F.col("id").alias("parent_id"), F.explode(F.sequence(F.lit(1), F.greatest("children", F.lit(1)))).alias("n"), "children").filter("n <= children")
    rows = kids.select("parent_id", F.concat_ws("-", "parent_id", "n").alias("name"), F.lit("child").alias("kind"), F.lit(None).cast("timestamp").alias("scheduled_at"))
    if not aggregator:
        return rows
    waits = parents.select(F.col("id").alias("parent_id"), F.concat_ws("-", "id", F.lit("aggregate")).alias("name"), F.lit("aggregator").alias("kind"), F.lit(FAR).cast("timestamp").alias("scheduled_at"))
    return rows.unionByName(waits)


def families(jobs: DataFrame, count_aggregators: bool = False) -> DataFrame:
    """parent_id, total, done, complete over children (parent_id, kind, status). Aggregators don't count: they wait for the others."""
    c = jobs.filter("parent_id is not null")
    c = c if count_aggregators else c.filter("kind <> 'aggregator'")
    done = F.count_if(F.col("status").isin(*FINISHED))
    return c.groupBy("parent_id").agg(F.count(F.lit(1)).alias("total"), done.alias("done"), (done == F.count(F.lit(1))).alias("complete"))


def woken(jobs: DataFrame, now: Column) -> DataFrame:
    """Aggregators of complete families, due now."""
    ready = families(jobs).filter("complete").select("parent_id")
    return jobs.filter("kind = 'aggregator' and status = 'pending'").join(ready, "parent_id", "left_semi").withColumn("scheduled_at", now)


def requeued(jobs: DataFrame, parents: DataFrame) -> DataFrame:
    """jobs with these parents (id) pending again and one attempt given back."""
    j = jobs.join(parents.select("id", F.lit(True).alias("again")), "id", "left")
    new = {"status": F.lit("pending"), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0))}
    return j.select(*[F.when(F.col("again"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def cleaned(jobs: DataFrame, before: Column) -> DataFrame:
    """Without finished jobs completed before then; children of those that go lose their parent."""
    gone = F.coalesce(F.col("status").isin(*FINISHED) & (F.col("completed_at") < before), F.lit(False))
    ids = jobs.filter(gone).select(F.col("id").alias("parent_id"), F.lit(True).alias("lost"))
    left = jobs.filter(~gone).join(ids, "parent_id", "left")
    return left.withColumn("parent_id", F.when(F.col("lost").isNull(), F.col("parent_id"))).select(*jobs.columns)


def cascade(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Messages or logs (job_id) of jobs that are still there."""
    return rows.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def status_counts(jobs: DataFrame) -> DataFrame:
    """queue, counts: a map from status to number."""
    c = jobs.groupBy("queue", "status").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("queue").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("counts"))


def listed(jobs: DataFrame, limit: int, status: str | None = None) -> DataFrame:
    j = jobs.filter(F.col("status") == status) if status else jobs
    return j.orderBy(F.desc("priority"), F.desc("created_at"), F.desc("id")).limit(limit)
