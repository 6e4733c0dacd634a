"""Queries of persisted state, of whole runs, and of smaller operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import extraction as ex
from corvane.functions import names
from corvane.operators import export, health, stages, state
from corvane.operators.rank import global_rank
from corvane.plans.corrections import responses
from corvane.plans.recon import FOUND, counts
from corvane.plans.text import BAND_SQL, LEXICON, score_sql
from corvane.session import rows, table
from corvane.sources import files


def now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("seq"), F.concat(F.lit("s"), (F.col("user_id") % 80).cast("string")).alias("stem"), F.concat(F.lit("e"), k.cast("string")).alias("error"), k.alias("at"), (k % 3 == 0).alias("counted"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = rows(spark, "stem string, failures int, last_error string, blacklisted_at long", ("s1", 2, "old", None), ("s2", 5, "old", -1), ("gone", 1, "old", None))
    return state.blacklist_after(old, failures(spark, sf_dir))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("stem"), F.col("ts").alias("mtime"))
    return state.pending(e, e.filter("stem % 5 = 0"), e.filter("stem % 2 = 0"), e.filter("stem % 7 = 0")).select("stem")


def notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    todos = e.filter("event_id % 2 = 0").select(F.col("event_type").alias("title"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".m4a")).alias("source"))
    told = e.filter("event_id % 2 = 1").select(F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.lit("10:00").alias("time"), F.lit("s.txt").alias("source"))
    old = rows(spark, "kind string, key string, title string, updated_at timestamp", ("todo", "old|s", "old", None)).withColumn("updated_at", now() - F.expr("interval 1 day"))
    return state.notified(old, todos, told, now()).select("kind", "key", (F.col("updated_at") == now()).alias("is_new"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = rows(spark, "pos int, old string, new string, note string, enabled boolean", (0, "a", "b", "n", True), (1, "c", "d", None, False))
    added = rows(spark, "seq int, old string, new string, note string", (1, " c ", "e", "again"), (2, "x", "y", None), (3, "w", "v", "n"), (4, "x", "z", "last"))
    return state.exact_rules_after(old, added)


def alias_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = rows(spark, "canonical string, variants array<string>, category string", ("A", ["a1", "a2"], "c"), ("B", ["b"], None))
    new = rows(spark, "canonical string, variants array<string>, category string", ("A", ["a2", " a3 ", "A", ""], None), ("C", ["c1"], "k"))
    return state.aliases_after(old, new).select("canonical", F.array_join("variants", ",").alias("variants"), "category")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.orphans(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("status")))


def recents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("n"))
    return export.with_recent(d.filter("n % 3 = 0 and path <> 'src1'"), d.filter("n % 3 = 1")).select("path", "n")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by name in batches of seven."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.lpad(((F.col("doc_id") * 7919) % 10007).cast("string"), 5, "0"), F.lit("-"), F.col("doc_id").cast("string")).alias("name"))
    return files.numbered(d, 7, "name").select("doc_id", "batch_index", "place")


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_rank(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey").select("o_orderkey", "rank")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.cause_table(counts(spark, sf_dir)).select("pos", F.split(F.col("line"), r" \| ")[0].alias("reason"), F.split(F.col("line"), r" \| ")[1].cast("int").alias("files"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, "id int, path string", (1, "C:\\a b\\c.txt"), (2, "/mnt/d/x/y"), (3, "rel/x"), (4, "/mnt/d"), (5, "d:\\"))
    return r.select("id", names.drive_to_mount(F.col("path")).alias("mount"), names.mount_to_drive(F.col("path")).alias("drive"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", names.next_batch((F.col("event_id") % 9).cast("int"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("20240105")).alias("next_batch"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir).select("doc_id", F.explode(F.array(ex.two_lists(F.col("response"), "entities", "todos"))).alias("r"))
    return r.select("doc_id", F.size("r.entities").alias("entities"), F.size("r.todos").alias("todos"), "r.parse_error")


def day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"))
    return files.day_events(e, "2024-01-10").agg(F.count(F.lit(1)).alias("events"))


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("name"), F.col("ts").alias("mtime"))
    return files.newest_first(e, ranked=True).select("name", "rank")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole extraction run over documents, with responses from a table: gate, call, validation, fallback."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), "text")
    r = responses(spark, sf_dir).filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("stem"), "response")
    out = stages.extract(t, stages.ResponseTable(r), lexicon=LEXICON)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("record.todos")).alias("todos"))


def waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.range(0, 28).select(F.element_at(F.array(*map(F.lit, (200, 400, 403, 404, 429, 500, 503))), (F.col("id") % 7 + 1).cast("int")).alias("status"), F.floor(F.col("id") / 7).cast("int").alias("attempt"))
    return r.select("status", "attempt", stages.retry_wait(F.col("status"), F.col("attempt")).alias("wait"))


QUERIES = {
    "blacklist_update": (blacklist, """WITH f AS (SELECT event_id AS seq, 's' || (user_id % 80) AS stem, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS c FROM events), o(stem, b, e, t) AS (VALUES ('s1', 2, 'old', NULL), ('s2', 5, 'old', -1), ('gone', 1, 'old', NULL)),
        n AS (SELECT f.*, coalesce(b, 0) + sum(c) OVER (PARTITION BY f.stem ORDER BY seq) AS n FROM f LEFT JOIN o ON f.stem = o.stem), g AS (SELECT stem, max(n) AS n, 'e' || max(seq) AS error, min(CASE WHEN n >= 3 THEN seq END) AS a FROM n GROUP BY stem)
        SELECT coalesce(g.stem, o.stem) AS stem, coalesce(n, b) AS failures, coalesce(error, e) AS last_error, coalesce(t, a) AS blacklisted_at FROM g FULL JOIN o ON g.stem = o.stem"""),
    "pending_audio": (pending, "SELECT event_id AS stem FROM events WHERE event_id % 2 = 1 AND event_id % 5 <> 0 AND event_id % 7 <> 0"),
    "notification_state": (notified, """SELECT DISTINCT 'todo' AS kind, event_type || '|u' || user_id AS key, true AS is_new FROM events WHERE event_id % 2 = 0
        UNION ALL SELECT DISTINCT 'appointment', event_type || '|' || strftime(ts, '%Y-%m-%d') || '|10:00|s', true FROM events WHERE event_id % 2 = 1 UNION ALL SELECT 'todo', 'old|s', false"""),
    "exact_rule_update": (rules, "SELECT * FROM (VALUES (0, 'a', 'b', 'n', true), (1, 'c', 'e', 'again', true), (2, 'x', 'z', 'last', true), (3, 'w', 'v', 'n', true)) AS t(pos, old, new, note, enabled)"),
    "alias_rule_update": (alias_rules, "SELECT * FROM (VALUES ('A', 'a1,a2,a3', 'c'), ('B', 'b', NULL), ('C', 'c1', 'k')) AS t(canonical, variants, category)"),
    "orphan_todos": (orphans, "SELECT count(*) AS orphans FROM events WHERE event_id % 4 = 0"),
    "recent_union": (recents, "WITH f AS (SELECT source AS path, doc_id AS n FROM documents WHERE doc_id % 3 = 0 AND source <> 'src1') SELECT * FROM f UNION ALL SELECT source, doc_id FROM documents WHERE doc_id % 3 = 1 AND source NOT IN (SELECT path FROM f)"),
    "batch_numbers": (batches, "SELECT doc_id, (r - 1) // 7 AS batch_index, (r - 1) % 7 AS place FROM (SELECT doc_id, row_number() OVER (ORDER BY 'f' || lpad(cast((doc_id * 7919) % 10007 AS varchar), 5, '0') || '-' || doc_id) AS r FROM documents)"),
    "global_ranks": (ranks, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rank FROM orders"),
    "gap_report_lines": (report_lines, f"{FOUND} SELECT pos, '| ' || p.reason AS reason, count(g.stem) AS files FROM p LEFT JOIN g ON p.reason = g.reason GROUP BY ALL"),
    "path_conversion": (paths, "SELECT * FROM (VALUES (1, '/mnt/c/a b/c.txt', 'C:\\a b\\c.txt'), (2, '/mnt/d/x/y', 'D:\\x\\y'), (3, 'rel/x', 'rel/x'), (4, '/mnt/d', '/mnt/d'), (5, '/mnt/d/', 'd:\\')) AS t(id, mount, drive)"),
    "checkpoint_batches": (checkpoints, "SELECT event_id, CASE WHEN strftime(ts, '%Y%m%d') = '20240105' THEN event_id % 9 + 1 ELSE 0 END AS next_batch FROM events"),
    "response_lists": (lists, "SELECT doc_id, CASE WHEN doc_id % 6 <> 3 THEN 1 ELSE 0 END AS entities, CASE WHEN doc_id % 6 <> 3 THEN 3 ELSE 0 END AS todos, doc_id % 6 = 3 AS parse_error FROM documents"),
    "events_of_a_day": (day, "SELECT count(*) AS events FROM events WHERE cast(ts + INTERVAL 9 HOUR AS date) = DATE '2024-01-10'"),
    "newest_files": (newest, "SELECT cast(event_id AS varchar) AS name, row_number() OVER (ORDER BY ts DESC, cast(event_id AS varchar)) - 1 AS rank FROM events"),
    "extraction_run": (run, score_sql(LEXICON) + f"""SELECT CASE WHEN {BAND_SQL} = 'definite_drop' THEN 'skipped_fast_score' WHEN doc_id % 7 = 0 OR doc_id % 6 IN (3, 4) THEN 'fallback' ELSE 'ok' END AS status, count(*) AS documents,
        CASE WHEN count(*) FILTER ({BAND_SQL} <> 'definite_drop' AND doc_id % 7 <> 0 AND doc_id % 6 NOT IN (3, 4)) > 0 THEN count(*) END AS todos FROM t GROUP BY 1"""),
    "retry_waits": (waits, """SELECT s AS status, a AS attempt, CASE WHEN a >= 3 OR s IN (400, 403, 404) THEN NULL WHEN s = 429 THEN cast(30 * pow(2, a) AS int) WHEN s >= 500 THEN [5, 15, 45, 90][a + 1] END AS wait
        FROM (SELECT unnest([200, 400, 403, 404, 429, 500, 503]) AS s), (SELECT unnest(range(0, 4)) AS a)"""),
}
