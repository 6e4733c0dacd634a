"""Queries of reconciliation, the retry queue and the job store, over stems made from orders and jobs made from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import export, joblog, jobs, recon, retry
from corvane.plans.names import STEMS, stems
from corvane.session import shared_folder, staged, table



def now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")



def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(stems(spark, sf_dir).select("o_orderkey", "stem").groupBy("stem").agg(F.min("o_orderkey").alias("k")))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stems(spark, sf_dir)
    k = F.col("o_orderkey")
    # Of four recordings one has no transcript, one a derived one, one a caller that is spelt otherwise.
    stem = F.when(k % 4 == 1, F.concat("stem", F.lit("_120000"))).when(k % 4 == 2, F.concat(F.lit("X"), "stem")).otherwise(F.col("stem"))
    return staged(s.filter("o_orderkey % 4 <> 0").select(stem.alias("stem")).distinct())


AUDIO = f"{STEMS}, audio AS MATERIALIZED (SELECT stem, min(o_orderkey) AS k FROM stems GROUP BY stem)"
TRANSCRIPTS = """transcripts AS MATERIALIZED (SELECT DISTINCT CASE o_orderkey % 4 WHEN 1 THEN stem || '_120000' WHEN 2 THEN 'X' || stem ELSE stem END AS stem FROM stems WHERE o_orderkey % 4 <> 0)"""
PART = """SELECT stem, CASE WHEN regexp_matches(stem, '^(.+_\\d{14})_\\d{6}$') THEN regexp_extract(stem, '^(.+_\\d{14})_\\d{6}$', 1) ELSE stem END AS canonical,
    CASE WHEN regexp_matches(stem, '^(.+?)_(\\d{10,11})_(\\d{14})$') THEN regexp_extract(stem, '^(.+?)_(\\d{10,11})_(\\d{14})$', 2) WHEN regexp_matches(stem, '^(\\d{10,11})_(\\d{14})$') THEN regexp_extract(stem, '^(\\d{10,11})_(\\d{14})$', 1) ELSE '' END AS phone,
    CASE WHEN regexp_matches(stem, '^(.+?)_(\\d{10,11})_(\\d{14})$') THEN regexp_extract(stem, '^(.+?)_(\\d{10,11})_(\\d{14})$', 1) WHEN regexp_matches(stem, '^(\\d{10,11})_(\\d{14})$') THEN '' ELSE regexp_extract(stem, '^(.+?)_(\\d{14})$', 1) END AS caller,
    CASE WHEN regexp_matches(stem, '_?\\d{14}$') AND regexp_matches(stem, '^(.+?)_(\\d{14})$') THEN right(stem, 14) ELSE '' END AS date FROM """
MATCHED = f"""pa AS MATERIALIZED ({PART} audio), pt AS MATERIALIZED ({PART} transcripts), matched AS MATERIALIZED (SELECT stem FROM pa SEMI JOIN pt USING (stem)
    UNION SELECT pa.stem FROM pa SEMI JOIN pt ON pa.stem = pt.canonical UNION SELECT pa.stem FROM pa SEMI JOIN pt ON pa.date = pt.date AND pa.phone = pt.phone WHERE pa.date <> '' AND pa.phone <> ''
    UNION SELECT pa.stem FROM pa SEMI JOIN pt ON pa.date = pt.date AND pa.caller = pt.caller AND pa.phone = pt.phone WHERE pa.date <> '' AND pa.phone = '')"""


def states(spark: SparkSession, sf_dir: str, counted: bool = True) -> dict[str, DataFrame]:
    """What reconciliation looks at, each made once. counted: what matches is counted, too, so that it is made; gaps alone don't need it."""
    a, t = audio(spark, sf_dir), transcripts(spark, sf_dir)
    k = F.col("k")
    return {
        "audio": a, "transcripts": t, "matched": staged(recon.matched_audio(a, t)) if counted else None,
        "blacklist": a.filter("k % 3 = 0").select("stem", (k % 5).cast("int").alias("failures"), F.when(k % 9 == 0, "2024-01-01").alias("blacklisted_at")),
        "indexed": t.filter(F.length("stem") % 2 == 0).select(F.concat(F.lit("C:\\data\\"), "stem", F.lit(".txt")).alias("path")),
        "exported": t.filter(F.length("stem") % 3 == 0).select(F.concat("stem", F.lit(".txt")).alias("name")), "extracted": t.filter(F.length("stem") % 5 == 0).select("stem"),
    }


def found(spark: SparkSession, sf_dir: str, known: dict[str, DataFrame] | None = None, once: bool = False) -> DataFrame:
    known = known or states(spark, sf_dir, counted=False)
    return recon.gaps(**known, diarization_failed=known["audio"].filter("k % 50 = 0").select("stem"), once=once)


FOUND = f"""WITH {AUDIO}, {TRANSCRIPTS}, {MATCHED}, g AS MATERIALIZED (
    SELECT CASE WHEN k % 9 = 0 THEN 'blacklisted' WHEN k % 3 = 0 AND k % 5 > 0 THEN 'transcription_failed' ELSE 'missing_transcript' END AS reason, stem || '.m4a' AS file, stem FROM audio WHERE stem NOT IN (SELECT stem FROM matched)
    UNION ALL SELECT 'derived_excluded', stem || '.txt', stem FROM pt WHERE canonical <> stem AND canonical IN (SELECT stem FROM audio)
    UNION ALL SELECT 'rag_pending', stem || '.txt', stem FROM transcripts WHERE length(stem) % 2 <> 0 UNION ALL SELECT 'obsidian_pending', stem || '.txt', stem FROM transcripts WHERE length(stem) % 3 <> 0
    UNION ALL SELECT 'entity_pending', stem || '.txt', stem FROM transcripts WHERE length(stem) % 5 <> 0 UNION ALL SELECT 'diarization_failed', stem || '.m4a', stem FROM audio WHERE k % 50 = 0),
    p(reason, priority, pos) AS (VALUES ('missing_sync', 'P0', 0), ('missing_transcript', 'P0', 1), ('blacklisted', 'P3', 2), ('transcription_failed', 'P1', 3), ('diarization_failed', 'P2', 4), ('entity_pending', 'P2', 5), ('rag_pending', 'P2', 6), ('obsidian_pending', 'P2', 7), ('derived_excluded', 'P4', 8))"""


def gap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("reason", "file", "stem", "priority")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.cause_counts(found(spark, sf_dir))


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.health(counts(spark, sf_dir))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.action_queue(found(spark, sf_dir)).limit(30).select("priority", "reason", "file")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = states(spark, sf_dir)
    return recon.report(found=found(spark, sf_dir, known), **known)


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = states(spark, sf_dir)
    gaps = found(spark, sf_dir, known)
    return export.report_text(recon.cause_counts(gaps), recon.report(found=gaps, **known), gaps)


def report_text_sql() -> str:
    """The report's lines put together from the same counts; the counts themselves are the sums of gap_report's SQL."""
    steps = "n(reason, next) AS (VALUES " + ", ".join(f"('{k}', '{n.replace(chr(39), chr(39) * 2)}')" for k, (_, n) in recon.CAUSES.items()) + ")"
    nl = "chr(10)"
    return f"""{FOUND}, {steps}, c AS (SELECT pos, p.reason, next, count(g.stem) AS files FROM p JOIN n ON p.reason = n.reason LEFT JOIN g ON p.reason = g.reason GROUP BY ALL),
        k AS (SELECT (SELECT count(*) FROM audio) AS a, (SELECT count(*) FROM transcripts) AS t, (SELECT count(*) FROM matched) AS m, (SELECT files FROM c WHERE reason = 'blacklisted') AS b, (SELECT files FROM c WHERE reason = 'missing_transcript') AS x, (SELECT files FROM c WHERE reason = 'transcription_failed') AS f,
            (SELECT files FROM c WHERE reason = 'diarization_failed') AS d, (SELECT sum(files) FROM c WHERE reason <> 'derived_excluded') AS o),
        q AS (SELECT priority, g.reason, file, next FROM g JOIN p USING (reason) JOIN n ON n.reason = g.reason WHERE g.reason NOT IN ('blacklisted', 'derived_excluded', 'entity_pending', 'obsidian_pending') ORDER BY 1, 2, 3 LIMIT 30)
        SELECT '# Recordings and what became of them' || {nl} || {nl} || '- health: ' || CASE WHEN x + f > 0 THEN 'danger (exit_code=2)' WHEN o > 0 THEN 'warning (exit_code=1)' ELSE 'normal (exit_code=0)' END || {nl} || {nl} || '## Conclusion' || {nl} || {nl}
            || '- by number of files: ' || t || '/' || a || ' (gap ' || (a - t) || ')' || {nl} || '- by stem: ' || m || '/' || a || ' (gap ' || (a - m) || ')' || {nl} || '- of that gap: blacklisted ' || b || ', missing_transcript ' || x || ', transcription_failed ' || f || {nl}
            || '- to be processed again: ' || (x + f + d) || {nl} || {nl} || '## Causes' || {nl} || {nl} || '| category | count | next_action |' || {nl} || '|---|---:|---|' || {nl} || (SELECT string_agg('| ' || reason || ' | ' || files || ' | ' || next || ' |', {nl} ORDER BY pos) FROM c)
            || {nl} || {nl} || '## To be done at once, the first 30' || {nl} || {nl} || '| priority | reason | file | next_action |' || {nl} || '|---|---|---|---|' || {nl}
            || coalesce((SELECT string_agg('| ' || priority || ' | ' || reason || ' | `' || file || '` | ' || next || ' |', {nl} ORDER BY priority, reason, file) FROM q), '| - | - | - | nothing to be done at once |') AS markdown FROM k"""


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notification: parts are to-dos, every 97th a new one, orders of the dearest kind appointments; active ones repeat new titles."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(
        k.alias("seq"), F.concat("p_name", F.lit(" "), k).alias("title"), F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), (k % 4 + 1).cast("int")).alias("priority"), F.when(k % 3 > 0, F.col("p_brand")).alias("counterparty"),
        F.when(k % 2 == 0, F.concat(F.lit("010"), F.lpad(k.cast("string"), 8, "0"))).alias("phone"), F.when(k % 5 > 0, F.concat(F.lit("2024-03-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T10:20:00"))).alias("called_at"),
    )
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    met = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("order "), "o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.lit("10:00").alias("time"), F.concat(F.lit("c"), "o_custkey").alias("counterparty"))
    return export.message(part.filter("seq % 97 = 1"), part.filter("seq % 50 = 0 or seq % 97 = 1"), met)


MESSAGE = """WITH t AS (SELECT p_partkey AS k, '  ' || ['🔴', '🟡', '🟢', ''][p_partkey % 4 + 1] || ' ' || p_name || ' ' || p_partkey AS head, CASE WHEN p_partkey % 3 > 0 THEN p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' (010-' || substr(lpad(p_partkey::varchar, 8, '0'), 1, 4) || '-' || substr(lpad(p_partkey::varchar, 8, '0'), 5) || ')' ELSE '' END END AS who,
            CASE WHEN p_partkey % 5 > 0 THEN '3/' || (p_partkey % 28 + 1) || ' 10:20' END AS called FROM part),
        l AS (SELECT k, head || CASE WHEN who IS NULL AND called IS NULL THEN '' ELSE chr(10) || '    • 통화: ' || concat_ws(' / ', who, called) END AS line FROM t),
        n AS (SELECT * FROM l WHERE k % 97 = 1), o AS (SELECT * FROM l WHERE k % 50 = 0 AND k % 97 <> 1), m AS (SELECT count(*) AS c FROM o),
        p AS (SELECT 0 AS i, 0 AS k, '🆕 새 TODO' AS line UNION ALL SELECT 1, * FROM (SELECT * FROM n ORDER BY k LIMIT 8) UNION ALL SELECT 2, 0, chr(10) || '📋 미완료 TODO (' || c || '건)' FROM m WHERE c > 0 UNION ALL SELECT 3, * FROM (SELECT * FROM o ORDER BY k LIMIT 10)
            UNION ALL SELECT 4, 0, '  ... 외 ' || (c - 10) || '건' FROM m WHERE c > 10 UNION ALL SELECT 5, 0, chr(10) || '📅 새 스케줄'
            UNION ALL SELECT 6, * FROM (SELECT o_orderkey, '  - order ' || o_orderkey || ' / ' || CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '미정' END || ' 10:00 / c' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 5))
        SELECT string_agg(line, chr(10) ORDER BY i, k) AS body FROM p"""


def unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("stem"), F.md5("text").alias("hash"))
    done = d.filter("cast(stem as int) % 2 = 0").withColumn("hash", F.when(F.col("stem").cast("int") % 10 == 0, "old").otherwise(F.col("hash")))
    return recon.unchanged(d, done)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    left = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("left").alias("state"))
    return recon.merged_index(left, c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("right").alias("state")), "c_custkey", "state")


# ── the retry queue ──

def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.build(found(spark, sf_dir, once=True), now(), once=True)


RID = "'rq_' || left(sha256(stem || chr(0) || g.reason || chr(0) || action), 16)"
ACT = "a(reason, action, rank) AS (VALUES ('missing_transcript', 'transcribe', 0), ('transcription_failed', 'transcribe', 0), ('diarization_failed', 'diarize', 1), ('entity_pending', 'entity', 2), ('rag_pending', 'rag', 3), ('obsidian_pending', 'obsidian', 4))"


def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).select("queue_id", "stem", "reason", "next_action", "priority", "status")


def old_queue(spark: SparkSession, sf_dir: str, q: DataFrame | None = None) -> DataFrame:
    """An older queue in every state."""
    q = q or built(spark, sf_dir)
    h = F.length("stem")
    return q.filter(h % 4 != 0).withColumns({
        "status": F.when(h % 7 == 0, "succeeded").when(h % 7 == 1, "running").when(h % 7 == 2, "failed").when(h % 7 == 3, "terminal_failure").otherwise("pending"), "priority": F.lit("P8"),
        "attempts": (h % 3).cast("int"), "last_error": F.when(h % 2 == 0, "e"), "next_retry_at": F.when(h % 5 == 0, now() + F.make_interval(hours=(h % 3).cast("int") - 1)),
        "lease_expires_at": F.when(h % 2 == 0, now() - F.expr("interval 1 hour")), "terminal_failure": h % 7 == 3, "updated_at": now() - F.expr("interval 1 day"),
    })


def queue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = staged(built(spark, sf_dir))
    m = retry.merge(old_queue(spark, sf_dir, q), q.filter(F.length("stem") % 3 != 0), now())
    return m.select("queue_id", "priority", "status", "attempts", "last_error", F.col("updated_at") == now())


def queue_merge_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue_merge(spark, sf_dir).toDF("queue_id", "priority", "status", "attempts", "last_error", "is_new")


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retry.work(old_queue(spark, sf_dir), now(), 50).select("queue_id", "status")


def worker_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.length("stem")
    q = built(spark, sf_dir).select("queue_id", "reason", F.when(h % 11 == 0, "dance").otherwise(F.col("next_action")).alias("next_action"), F.when(h % 3 != 0, F.concat(F.lit("/a/"), "file")).alias("source_path"), F.concat(F.lit("/t/"), "stem", F.lit("/x.txt")).alias("transcript_path"))
    return retry.plan(q).select("queue_id", "step", F.array_join("arguments", " ").alias("arguments"), "error")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written once: outcomes are of the queue's own entries, so that it would be built for each side of their join.
    q = staged(old_queue(spark, sf_dir).filter(retry.is_due(now())).select("queue_id", "stem", "status", "attempts", "max_attempts", "last_error", "next_retry_at", "terminal_failure", "history", "updated_at"))
    o = q.select("queue_id", (F.length("stem") % 2 == 0).alias("ok"), F.lit("boom").alias("error"), now().alias("at"))
    r = retry.apply_outcomes(q, o)
    return r.groupBy("status", "attempts", "terminal_failure", F.date_format("next_retry_at", "yyyy-MM-dd HH:mm:ss").alias("next_retry"), F.size("history").alias("events")).agg(F.count(F.lit(1)).alias("entries"))


OLD = f"""{FOUND}, {ACT}, q AS MATERIALIZED (SELECT {RID} AS queue_id, stem, g.reason, action, rank, p.priority AS new_priority, length(stem) AS h FROM g JOIN a ON g.reason = a.reason JOIN p ON g.reason = p.reason),
    o AS MATERIALIZED (SELECT *, CASE h % 7 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'terminal_failure' ELSE 'pending' END AS status, h % 3 AS attempts,
        CASE WHEN h % 5 = 0 THEN h % 3 - 1 END AS retry_in FROM q WHERE h % 4 <> 0),
    d AS (SELECT * FROM o WHERE CASE WHEN status IN ('succeeded', 'terminal_failure') THEN false WHEN status = 'running' THEN h % 2 = 0 WHEN retry_in IS NOT NULL THEN retry_in <= 0 ELSE true END)"""


# ── jobs ──

def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of events: queues are event types, states and attempts follow the ids."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "failed", "paused", "cancelled"))), (k % 6 + 1).cast("int")).alias("status"), (F.col("user_id") % 5).cast("int").alias("priority"),
        F.col("event_type").alias("queue"), F.create_map(F.lit("k"), k.cast("string"), F.lit("a"), F.lit("1")).alias("payload"), (k % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.when(k % 3 == 0, F.concat(F.lit("key"), (k % 500).cast("string"))).alias("idempotency_key"), F.when(k % 7 != 0, F.floor(k / 7) * 7).cast("long").alias("parent_id"), F.when(k % 49 == 1, "aggregator").otherwise("child").alias("kind"),
        F.when(k % 5 == 0, F.col("ts")).alias("scheduled_at"), F.col("ts").alias("created_at"), F.lit(None).cast("timestamp").alias("started_at"),
        F.when((k % 6).isin(2, 3, 5), F.col("ts") + F.expr("interval 1 hour")).alias("completed_at"), F.lit(None).cast("string").alias("error"),
    )


JOBS = """j AS (SELECT event_id AS id, ['pending', 'running', 'completed', 'failed', 'paused', 'cancelled'][event_id % 6 + 1] AS status, user_id % 5 AS priority, event_type AS queue, event_id % 4 AS attempts, 3 AS max_attempts,
    CASE WHEN event_id % 3 = 0 THEN 'key' || (event_id % 500) END AS idempotency_key, CASE WHEN event_id % 7 <> 0 THEN event_id // 7 * 7 END AS parent_id, CASE WHEN event_id % 49 = 1 THEN 'aggregator' ELSE 'child' END AS kind,
    CASE WHEN event_id % 5 = 0 THEN ts END AS scheduled_at, ts AS created_at, CASE WHEN event_id % 6 IN (2, 3, 5) THEN ts + INTERVAL 1 HOUR END AS completed_at FROM events)"""


def mid() -> Column:
    return F.lit("2024-01-15 00:00:00").cast("timestamp")



def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job_rows(spark, sf_dir)
    return jobs.submit(j.filter("id % 2 = 0"), j.filter("id % 2 = 1")).select("id", "idempotency_key")


def claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = jobs.claim(job_rows(spark, sf_dir), mid(), 3)
    return c.filter("started_at is not null").select("id", "queue", "status", "attempts")


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job_rows(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ("complete", "cancel", "pause", "resume", "none"))), (F.col("id") % 5 + 1).cast("int"))
    m = jobs.transition(j, j.select("id", kind.alias("kind")), mid())
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("completed_at") == mid()).alias("ended_now"))


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job_rows(spark, sf_dir)
    f = jobs.fail(j, j.filter("id % 2 = 1").select("id", F.lit("boom").alias("error")), mid())
    return f.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.count("error").alias("errors"))


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job_rows(spark, sf_dir)
    asked = j.filter("status = 'failed'").select("id", (F.col("id") + 1_000_000).alias("new_id"), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3")).alias("override"))
    r = jobs.replay(j, asked, mid())
    return r.select("id", "status", F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("payload"))


def family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.families(job_rows(spark, sf_dir))


def woken(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job_rows(spark, sf_dir).withColumn("status", F.when(F.col("kind") == "aggregator", "pending").when(F.col("id") % 49 < 7, "completed").otherwise(F.col("status")))
    return jobs.woken(j, mid()).select("id", "parent_id")


def fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).cast("int").alias("children"))
    return jobs.fan_out(p).select("parent_id", "name", "kind", F.year("scheduled_at").alias("due_year"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.cleaned(job_rows(spark, sf_dir), mid()).select("id", "parent_id")


def unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("job_id"), "role")
    return jobs.cascade(jobs.unread(m, m.filter("role = 'user'")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


def by_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = jobs.status_counts(job_rows(spark, sf_dir))
    return c.select("queue", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.listed(job_rows(spark, sf_dir), 20, "pending").select("id", "priority")


def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = job_rows(spark, sf_dir)
    return jobs.requeued(j, j.filter("id % 7 = 0 and status = 'running'").select("id")).groupBy("status").agg(F.sum("attempts").alias("attempts"))


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' jobs through a log: submitted, claimed, moved, failed, reported on and cleaned up, a version each; then its fold."""
    j = job_rows(spark, sf_dir).withColumn("progress", F.lit(None).cast("string"))
    log = joblog.JobLog(spark, f"{shared_folder(spark)}/jobs", j.schema, every=4)
    log.submit(j, mid())
    log.claim(mid(), 3)
    kind = F.element_at(F.array(*map(F.lit, ("complete", "cancel", "pause", "resume", "none"))), (F.col("id") % 5 + 1).cast("int"))
    log.transition(j.select("id", kind.alias("kind")), mid())
    log.fail(j.filter("id % 2 = 1").select("id", F.lit("boom").alias("error")), mid())
    log.progress(j.filter("id % 11 = 0").select("id", F.concat(F.lit('{"done":'), "id", F.lit("}")).alias("progress")), mid())
    log.clean(mid(), mid())
    return log.state().select("id", "status", "attempts", "error", "progress", "parent_id", (F.col("completed_at") == mid()).alias("ended_now"), F.col("started_at").isNotNull().alias("started"))


JOB_LOG = f"""WITH {JOBS}, t AS (SELECT TIMESTAMP '2024-01-15' AS now), s0 AS (SELECT j.*, now FROM j, t QUALIFY idempotency_key IS NULL OR row_number() OVER (PARTITION BY idempotency_key ORDER BY id) = 1),
    due AS (SELECT id FROM s0 WHERE status = 'pending' AND (scheduled_at IS NULL OR scheduled_at <= now) QUALIFY row_number() OVER (PARTITION BY queue ORDER BY priority DESC, created_at, id) <= 3),
    s1 AS (SELECT s0.* REPLACE (CASE WHEN due.id IS NULL THEN status ELSE 'running' END AS status, CASE WHEN due.id IS NULL THEN attempts ELSE attempts + 1 END AS attempts), due.id IS NOT NULL AS started FROM s0 LEFT JOIN due ON s0.id = due.id),
    m AS (SELECT *, CASE WHEN id % 5 = 0 AND status = 'running' THEN 'completed' WHEN id % 5 = 1 AND status IN ('pending', 'running', 'paused') THEN 'cancelled' WHEN id % 5 = 2 AND status IN ('pending', 'running') THEN 'paused' WHEN id % 5 = 3 AND status = 'paused' THEN 'pending' END AS move FROM s1),
    s2 AS (SELECT * REPLACE (coalesce(move, status) AS status, CASE WHEN move IN ('completed', 'cancelled') THEN now ELSE completed_at END AS completed_at), id % 2 = 1 AND coalesce(move, status) = 'running' AS hit FROM m),
    s3 AS (SELECT * REPLACE (CASE WHEN hit THEN CASE WHEN attempts >= max_attempts THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN hit AND attempts >= max_attempts THEN now ELSE completed_at END AS completed_at), CASE WHEN hit THEN 'boom' END AS error FROM s2),
    gone AS (SELECT id FROM s3 WHERE status IN ('completed', 'failed', 'cancelled') AND completed_at < now)
    SELECT id, status, attempts, error, CASE WHEN id % 11 = 0 THEN '{{"done":' || id || '}}' END AS progress, CASE WHEN parent_id IN (SELECT id FROM gone) THEN NULL ELSE parent_id END AS parent_id, completed_at = now AS ended_now, started
    FROM s3 WHERE id NOT IN (SELECT id FROM gone)"""

QUERIES = {
    "job_event_log": (job_log, JOB_LOG),
    "gap_report_text": (report_text, report_text_sql()),
    "notice_message": (message, MESSAGE),
    "gap_rows": (gap_rows, f"{FOUND} SELECT g.reason, file, stem, priority FROM g JOIN p USING (reason)"),
    "gap_counts": (counts, f"{FOUND} SELECT pos, p.reason, count(g.stem) AS files FROM p LEFT JOIN g ON p.reason = g.reason GROUP BY ALL"),
    "gap_health": (health, f"""{FOUND} SELECT CASE WHEN bad > 0 THEN 'danger' WHEN open > 0 THEN 'warning' ELSE 'normal' END AS health, CASE WHEN bad > 0 THEN 2 WHEN open > 0 THEN 1 ELSE 0 END AS exit_code
        FROM (SELECT count(*) FILTER (reason IN ('missing_transcript', 'transcription_failed')) AS bad, count(*) FILTER (reason <> 'derived_excluded') AS open FROM g)"""),
    "gap_action_queue": (actions, f"{FOUND} SELECT priority, g.reason, file FROM g JOIN p USING (reason) WHERE g.reason NOT IN ('blacklisted', 'derived_excluded', 'entity_pending', 'obsidian_pending') ORDER BY 1, 2, 3 LIMIT 30"),
    "gap_report": (summary, f"""{FOUND}, c AS (SELECT reason, count(*) AS n FROM g GROUP BY 1), v AS (SELECT (SELECT count(*) FROM audio) AS audio, (SELECT count(*) FROM transcripts) AS transcripts, (SELECT count(*) FROM matched) AS complete,
            (SELECT count(*) FROM audio WHERE k % 3 = 0) AS blacklist_entries, (SELECT count(*) FROM transcripts WHERE length(stem) % 2 = 0) AS indexed_files, (SELECT count(*) FROM transcripts WHERE length(stem) % 3 = 0) AS exported_files, (SELECT count(*) FROM transcripts WHERE length(stem) % 5 = 0) AS extracted_stems)
        SELECT audio, transcripts, transcripts AS complete_by_count, audio - transcripts AS gap_by_count, complete, audio - complete AS gap, blacklist_entries, indexed_files, exported_files, extracted_stems, {", ".join(f"(SELECT n FROM c WHERE reason = '{r}') AS {r}" for r in ("derived_excluded", "rag_pending", "obsidian_pending", "entity_pending", "diarization_failed"))},
        (SELECT sum(n) FROM c WHERE reason IN ('missing_transcript', 'transcription_failed', 'diarization_failed')) AS reprocess FROM v"""),
    "unchanged_skip": (unchanged, "SELECT cast(doc_id AS varchar) AS stem, md5(text) AS hash FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0"),
    "index_merge": (index, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'left' ELSE 'right' END AS state FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"),
    "retry_queue_build": (queue_rows, f"{OLD} SELECT queue_id, stem, reason, action AS next_action, new_priority AS priority, 'pending' AS status FROM q"),
    "retry_queue_merge": (queue_merge_, f"""{FOUND}, {ACT}, q AS (SELECT {RID} AS queue_id, p.priority, length(stem) AS h, length(stem) % 4 <> 0 AS old FROM g JOIN a ON g.reason = a.reason JOIN p ON g.reason = p.reason),
        m AS (SELECT *, h % 7 IN (0, 3) OR h % 3 = 0 AS frozen FROM q WHERE old OR h % 3 <> 0)
        SELECT queue_id, CASE WHEN old AND frozen THEN 'P8' ELSE priority END AS priority, CASE WHEN NOT old THEN 'pending' ELSE CASE h % 7 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'terminal_failure' ELSE 'pending' END END AS status,
        CASE WHEN old THEN h % 3 ELSE 0 END AS attempts, CASE WHEN old AND h % 2 = 0 THEN 'e' END AS last_error, NOT (old AND frozen) AS is_new FROM m"""),
    "retry_worker_plan": (worker_plan, f"""{OLD}, s AS (SELECT queue_id, stem, reason, h, CASE WHEN h % 11 = 0 THEN 'dance' ELSE action END AS step FROM q)
        SELECT queue_id, step, CASE WHEN step IN ('transcribe', 'diarize') AND h % 3 <> 0 THEN '--file /a/' || stem || '.m4a' || CASE WHEN step = 'diarize' OR reason = 'transcription_failed' THEN ' --force' ELSE '' END WHEN step = 'entity' THEN '--base-dir /t/' || stem WHEN step = 'rag' THEN '--json' ELSE '' END AS arguments,
        CASE WHEN step = 'dance' THEN 'unsupported next_action: dance' WHEN step IN ('transcribe', 'diarize') AND h % 3 = 0 THEN 'missing source_path for ' || step END AS error FROM s"""),
    "retry_queue_due": (due, f"{OLD} SELECT queue_id, status FROM d ORDER BY rank, stem, reason LIMIT 50"),
    "retry_queue_outcomes": (outcomes, f"""{OLD} SELECT CASE WHEN h % 2 = 0 THEN 'succeeded' WHEN attempts + 1 >= 3 THEN 'terminal_failure' ELSE 'pending' END AS status, attempts + 1 AS attempts, h % 2 <> 0 AND attempts + 1 >= 3 AS terminal_failure,
        CASE WHEN h % 2 <> 0 AND attempts + 1 < 3 THEN strftime(TIMESTAMP '2024-02-01' + to_minutes(15 * (CASE attempts WHEN 0 THEN 1 ELSE 2 END)), '%Y-%m-%d %H:%M:%S') END AS next_retry, 1 AS events, count(*) AS entries FROM d GROUP BY ALL"""),
    "job_submit": (submitted, f"""WITH {JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key ORDER BY id) AS r FROM j WHERE id % 2 = 1)
        SELECT id, idempotency_key FROM j WHERE id % 2 = 0 UNION ALL SELECT id, idempotency_key FROM n WHERE idempotency_key IS NULL OR (r = 1 AND idempotency_key NOT IN (SELECT idempotency_key FROM j WHERE id % 2 = 0 AND idempotency_key IS NOT NULL))"""),
    "job_claim": (claimed, f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY priority DESC, created_at, id) AS r FROM j WHERE status = 'pending' AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '2024-01-15'))
        SELECT id, queue, 'running' AS status, attempts + 1 AS attempts FROM r WHERE r <= 3"""),
    "job_transitions": (moved, f"""WITH {JOBS}, t AS (SELECT CASE WHEN id % 5 = 0 AND status = 'running' THEN 'completed' WHEN id % 5 = 1 AND status IN ('pending', 'running', 'paused') THEN 'cancelled' WHEN id % 5 = 2 AND status IN ('pending', 'running') THEN 'paused'
        WHEN id % 5 = 3 AND status = 'paused' THEN 'pending' END AS t, status, completed_at FROM j) SELECT coalesce(t, status) AS status, count(*) AS jobs, count(*) FILTER (t IN ('completed', 'cancelled') OR completed_at = TIMESTAMP '2024-01-15') AS ended_now FROM t GROUP BY 1"""),
    "job_fail": (failed, f"""WITH {JOBS} SELECT CASE WHEN id % 2 = 1 AND status = 'running' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, count(*) AS jobs, count(*) FILTER (id % 2 = 1 AND status = 'running') AS errors FROM j GROUP BY 1"""),
    "job_replay": (replayed, f"WITH {JOBS} SELECT id + 1000000 AS id, 'pending' AS status, 'a=2,b=3,k=' || id AS payload FROM j WHERE status = 'failed'"),
    "job_families": (family, f"WITH {JOBS} SELECT parent_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS done, count(*) = count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) AS complete FROM j WHERE parent_id IS NOT NULL AND kind <> 'aggregator' GROUP BY 1"),
    "job_aggregators": (woken, f"WITH {JOBS} SELECT id, parent_id FROM j WHERE kind = 'aggregator' AND parent_id IN (SELECT parent_id FROM j WHERE parent_id IS NOT NULL AND kind <> 'aggregator')"),
    "job_fan_out": (fanned, "SELECT c_custkey AS parent_id, c_custkey || '-' || n AS name, 'child' AS kind, cast(NULL AS int) AS due_year FROM (SELECT c_custkey, unnest(range(1, c_custkey % 4 + 1)) AS n FROM customer) UNION ALL SELECT c_custkey, c_custkey || '-aggregate', 'aggregator', 9999 FROM customer"),
    "job_cleanup": (cleaned, f"WITH {JOBS}, g AS (SELECT id FROM j WHERE completed_at < TIMESTAMP '2024-01-15') SELECT id, CASE WHEN parent_id IN (SELECT id FROM g) THEN NULL ELSE parent_id END AS parent_id FROM j WHERE id NOT IN (SELECT id FROM g)"),
    "job_messages": (unread, "SELECT conv_id AS job_id, conv_id * 100 + turn AS id, role FROM conversations WHERE role <> 'user' AND conv_id IN (SELECT doc_id FROM documents)"),
    "job_status_counts": (by_queue, f"WITH {JOBS} SELECT queue, string_agg(status || '=' || n, ',' ORDER BY status) AS counts FROM (SELECT queue, status, count(*) AS n FROM j GROUP BY ALL) GROUP BY 1"),
    "job_list": (top, f"WITH {JOBS} SELECT id, priority FROM j WHERE status = 'pending' ORDER BY priority DESC, created_at DESC, id DESC LIMIT 20"),
    "job_requeue": (requeue, f"WITH {JOBS} SELECT CASE WHEN id % 7 = 0 AND status = 'running' THEN 'pending' ELSE status END AS status, sum(CASE WHEN id % 7 = 0 AND status = 'running' THEN greatest(attempts - 1, 0) ELSE attempts END) AS attempts FROM j GROUP BY 1"),
}
