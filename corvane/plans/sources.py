"""Queries of scans, state and sinks (S1 to S13, S20 to S24, Q14): tables become files in the shared folder, which are read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.names import basename
from corvane.operators import jobs
from corvane.plans.health import EXPORTED, notes
from corvane.session import rows, shared_folder, table
from corvane.sources import files, versions


def folder_of(contents: DataFrame) -> str:
    """A fresh folder with a file for each row (name, content)."""
    path = shared_folder(contents.sparkSession)
    files.write_files(contents, path)
    return path


def text(c: str) -> Column:
    return F.col(c).cast("string")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as transcripts, some of them too short, among files of other kinds."""
    p = table(spark, sf_dir, "pages")
    content = F.when(F.col("page_id") % 10 == 0, "short").otherwise(F.col("html"))
    name = F.concat(F.lit("p"), text("page_id"), F.when(F.col("page_id") % 7 == 0, ".log").otherwise(".txt"))
    t = files.transcripts(spark, folder_of(p.select(name.alias("name"), content.alias("content"))))
    return t.select("name", "stem", F.md5("text").alias("md5"), "size_bytes", F.col("mtime").isNotNull().alias("dated"))


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    a = files.audio(spark, folder_of(p.select(F.concat(F.lit("p"), text("page_id"), F.lit(".m4a")).alias("name"), F.encode("html", "utf-8").alias("content"))))
    return a.select("name", "stem", "size_bytes")


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files, named by their times."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("call_"), F.date_format("ts", "yyyyMMddHHmmss")).alias("stem"), F.col("ts").cast("timestamp").alias("mtime"), F.repeat(F.lit("w "), (F.col("event_id") % 60).cast("int")).alias("text"))


def today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.of_day(listed(spark, sf_dir), F.lit("2024-01-10 20:00:00").cast("timestamp")).select("event_id", "stem")


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.recent(listed(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp"), 3).select("event_id")


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of one word in UTF-8 and in a Korean code page, and some of neither."""
    r = rows(spark, "id int, hex string", (1, "ED959CEAB880"), (2, "C7D1B1DB"), (3, "61FF62"), (4, ""), (5, None))
    return r.select("id", files.decoded(F.unhex("hex")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as JSON documents, some of them broken."""
    s = table(spark, sf_dir, "supplier")
    content = F.when(F.col("s_suppkey") % 5 == 0, "{broken").otherwise(F.concat(F.lit("\ufeff"), F.to_json(F.struct("s_suppkey", "s_name"))))
    good, bad = files.json_documents(spark, folder_of(s.select(F.concat(text("s_suppkey"), F.lit(".json")).alias("name"), content.alias("content"))))
    return good.select(basename(F.col("path")).alias("name"), F.try_variant_get("v", "$.s_name", "string").alias("s_name"), F.lit(None).cast("string").alias("error")).unionByName(bad.select(basename(F.col("path")).alias("name"), F.lit(None).cast("string").alias("s_name"), "error"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSONL files, a turn to a line, a blank line behind each."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.to_json(F.struct("turn", "role", "text")).alias("line")))).alias("l"))
    content = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\r\n\n"))), "")
    v = files.json_lines(spark, folder_of(turns.select(F.concat(text("conv_id"), F.lit(".jsonl")).alias("name"), content.alias("content"))))
    return v.select(basename(F.col("path")).alias("name"), "line", F.try_variant_get("v", "$.turn", "int").alias("turn"), F.md5(F.try_variant_get("v", "$.text", "string")).alias("md5"))


def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in buckets after new rows for some of them, others of repeated keys, and a deletion."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    kept = versions.BucketTable(spark, f"{shared_folder(spark)}/customers", c.schema, "c_custkey")
    kept.upsert(c)
    more = c.filter("c_custkey % 100 = 7").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    kept.upsert(more.select("c_custkey", F.concat("c_name", F.lit("/"), "n").alias("c_name"), "c_acctbal", "n").unionByName(c.filter("c_custkey % 100 = 9").select(F.col("c_custkey") + 10_000_000, "c_name", "c_acctbal", F.lit(1).alias("n")).toDF("c_custkey", "c_name", "c_acctbal", "n")), "n")
    kept.delete(c.filter("c_custkey % 100 = 3"))
    return kept.read()


def bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files of lines: some turns are no JSON, some have a NUL byte."""
    c = table(spark, sf_dir, "conversations")
    k, turn = F.col("conv_id"), F.col("turn")
    line = F.when((k % 5 == 0) & (turn % 3 == 2), "no JSON").when((k % 7 == 0) & (turn == 1), F.lit("\0")).otherwise(F.to_json(F.struct("turn", "text")))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    content = F.array_join(F.transform("l", lambda x: F.concat(x["line"], F.lit("\n\r\n"))), "")
    found = files.bad_lines(files.numbered_lines(spark, folder_of(turns.select(F.concat(text("conv_id"), F.lit(".jsonl")).alias("name"), content.alias("content")))))
    return found.select(basename(F.col("path")).alias("name"), "bad_line", "nul")


def batch_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as documents of batches."""
    o = table(spark, sf_dir, "orders")
    b = o.groupBy((F.col("o_custkey") % 40).alias("b")).agg(
        F.collect_list(F.concat(F.lit("s"), text("o_orderkey"))).alias("files"),
        F.collect_list(F.struct(F.concat(F.lit("s"), text("o_orderkey")).alias("file"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("status"))).alias("results"),
    )
    good, _ = files.json_documents(spark, folder_of(b.select(F.concat(F.lit("batch_"), text("b"), F.lit(".json")).alias("name"), F.to_json(F.struct("files", "results")).alias("content"))), "batch_*.json")
    return good


def batch_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.batch_files(batch_folder(spark, sf_dir))


def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.batch_results(batch_folder(spark, sf_dir)).select(F.explode("results").alias("r"))
    return r.groupBy("r.status").agg(F.count(F.lit(1)).alias("files"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems that lines of logs, one for each kind of event, name."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Speaker diarization JSON parse failed for u "), text("user_id"), F.lit(".m4a: bad"))).otherwise(F.concat(F.lit("done with u"), text("user_id"), F.lit(".m4a: ok")))
    logs = e.groupBy("event_type").agg(F.array_join(F.collect_list(line), "\n").alias("content"))
    return files.failed_stems(spark, folder_of(logs.select(F.concat("event_type", F.lit(".log")).alias("name"), "content")))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    path = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("C:\\d\\x\\"), text("c_custkey"), F.lit(".txt"))).otherwise(F.concat(F.lit("/mnt/x/"), (F.col("c_custkey") % 50).cast("string"), F.lit(".txt")))
    return files.state_names(c.select(path.alias("path")))


def mapped(entries: DataFrame, spark: SparkSession) -> DataFrame:
    """A document that maps the keys of entries (k, v as JSON)."""
    whole = entries.agg(F.array_join(F.collect_list(F.concat(F.lit('"'), "k", F.lit('":'), "v")), ",").alias("x"))
    return files.json_documents(spark, folder_of(whole.select(F.lit("map.json").alias("name"), F.concat(F.lit('{"_meta":{},'), "x", F.lit("}")).alias("content"))))[0]


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    v = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('{"failures":'), text("n_nationkey"), F.lit(',"blacklisted_at":"t"}'))).otherwise(F.concat(F.lit('{"failures":'), text("n_nationkey"), F.lit("}")))
    return files.blacklist(mapped(n.select(F.col("n_name").alias("k"), v.alias("v")), spark))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    v = F.when(F.col("s_suppkey") % 4 == 0, "5").when(F.col("s_suppkey") % 4 == 1, '""').otherwise(F.concat(F.lit('"'), "s_name", F.lit('"')))
    return files.contacts(mapped(s.select(F.concat(F.lit("010-1 "), text("s_suppkey")).alias("k"), v.alias("v")), spark))


# ── sinks ──

def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced three times, read while a fourth version isn't whole."""
    path, c = shared_folder(spark), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for i in range(3):
        files.replace_table(c.withColumn("version", F.lit(i)), path)
    c.limit(0).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/version=000000000009")
    return files.read_table(spark, path)


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = shared_folder(spark), table(spark, sf_dir, "nation").select("n_name", "n_nationkey")
    for part in (0, 1):
        files.append_json(n.filter(F.col("n_nationkey") % 2 == part), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a run, one of them written again."""
    path = shared_folder(spark)
    b = table(spark, sf_dir, "customer").select(F.lit("r").alias("run_id"), (F.col("c_custkey") % 4).cast("int").alias("batch_index"), "c_custkey", F.lit("first").alias("state"))
    files.write_batches(b, path)
    files.write_batches(b.filter("batch_index = 2").withColumn("state", F.lit("again")), path)
    return spark.read.json(path).groupBy("batch_index", "state").agg(F.count(F.lit(1)).alias("files"))


def rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of a log over the limit, and all of one that is under it."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat_ws(" ", "event_type", text("user_id")).alias("line"))
    cut, whole = files.rotated(e, 70, most=1000), files.rotated(e, 70, most=files.LOG_BYTES << 10)
    return cut.withColumn("log", F.lit("cut")).unionByName(whole.withColumn("log", F.lit("whole"))).groupBy("log").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("lines"))


def written_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as files of their own, read back."""
    path = shared_folder(spark)
    n = notes(spark, sf_dir).select(F.concat("name", F.lit(".md")).alias("note"), F.concat(F.lit("# "), "note", F.lit("\n"), "date").alias("markdown"))
    files.write_notes(n, path)
    return files.read_notes(spark, path).select(F.md5("markdown").alias("md5"))


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, e = shared_folder(spark), table(spark, sf_dir, "events")
    new = jobs.logs(e.select(F.col("event_id").alias("job_id"), F.lit("info").alias("level"), F.col("event_type").alias("message"), F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("u"), text("user_id"))).alias("metadata")))
    for part in (0, 1):
        new.filter(F.col("job_id") % 2 == part).write.mode("append").parquet(path)
    return spark.read.parquet(path)


QUERIES = {
    "transcript_scan": (transcripts, "SELECT 'p' || page_id || '.txt' AS name, 'p' || page_id AS stem, md5(html) AS md5, strlen(html) AS size_bytes, true AS dated FROM pages WHERE page_id % 10 <> 0 AND page_id % 7 <> 0 AND strlen(html) > 50"),
    "audio_scan": (audio, "SELECT 'p' || page_id || '.m4a' AS name, 'p' || page_id AS stem, strlen(html) AS size_bytes FROM pages WHERE strlen(html) > 1024"),
    "files_of_today": (today, "SELECT event_id, 'call_' || strftime(ts, '%Y%m%d%H%M%S') AS stem FROM events WHERE strftime(ts, '%Y%m%d%H%M%S') LIKE '%20240111%'"),
    "recent_files": (recent, "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-12' AND event_id % 60 >= 26"),
    "legacy_encodings": (legacy, "SELECT * FROM (VALUES (1, '한글'), (2, '한글'), (3, 'a' || chr(65533) || 'b'), (4, ''), (5, NULL)) AS t(id, text)"),
    "json_documents": (documents, "SELECT s_suppkey || '.json' AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN 'no JSON' END AS error FROM supplier"),
    "json_lines": (lines, "SELECT conv_id || '.jsonl' AS name, 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, turn, md5(text) AS md5 FROM conversations"),
    "bucket_upsert": (bucket_upsert, """SELECT c_custkey, CASE WHEN c_custkey % 100 = 7 THEN c_name || '/2' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 100 <> 3
        UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 100 = 9"""),
    "bad_lines": (bad_lines, """WITH t AS (SELECT conv_id, turn, 2 * row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line FROM conversations)
        SELECT conv_id || '.jsonl' AS name, min(line) FILTER ((conv_id % 5 = 0 AND turn % 3 = 2) OR (conv_id % 7 = 0 AND turn = 1)) AS bad_line, bool_or(conv_id % 7 = 0 AND turn = 1 AND NOT (conv_id % 5 = 0 AND turn % 3 = 2)) AS nul FROM t GROUP BY conv_id"""),
    "batch_files": (batch_stems, "SELECT 's' || o_orderkey AS stem FROM orders"),
    "batch_statuses": (batch_states, "SELECT CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status, count(*) AS files FROM orders GROUP BY 1"),
    "log_scan": (log, "SELECT DISTINCT 'u ' || user_id AS stem FROM events WHERE event_id % 3 = 0"),
    "state_names": (state, "SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey % 50 END || '.txt' AS name FROM customer"),
    "blacklist_load": (blacklist, "SELECT n_name AS stem, n_nationkey::int AS failures, CASE WHEN n_nationkey % 3 = 0 THEN 't' END AS blacklisted_at FROM nation"),
    "contacts_load": (contacts, "SELECT '0101' || s_suppkey AS phone, s_name AS name FROM supplier WHERE s_suppkey % 4 > 1"),
    "table_replaced": (replaced, "SELECT c_custkey, c_name, 2 AS version FROM customer"),
    "lines_appended": (appended, """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS line FROM nation"""),
    "batches_written": (batches, "SELECT (c_custkey % 4)::int AS batch_index, CASE WHEN c_custkey % 4 = 2 THEN 'again' ELSE 'first' END AS state, count(*) AS files FROM customer GROUP BY ALL"),
    "log_rotation": (rotation, "SELECT 'whole' AS log, min(event_id) AS first, count(*) AS lines FROM events UNION ALL SELECT 'cut', min(event_id), count(*) FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 70)"),
    "notes_written": (written_notes, f"{EXPORTED} SELECT md5('# ' || note || chr(10) || date) AS md5 FROM e"),
    "job_logs": (job_logs, """SELECT event_id AS job_id, 'info' AS level, event_type AS message, CASE WHEN event_id % 2 = 0 THEN '{"u":"' || user_id || '"}' ELSE '{}' END AS metadata FROM events"""),
}
