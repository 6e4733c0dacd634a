"""Queries of mail, runs, state files, export and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import export, health, mail
from corvane.plans.names import STEMS, stems
from corvane.session import rows, table



def now() -> Column:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")



def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.when(k % 11 == 0, "Sent Messages").otherwise("INBOX").alias("folder"), k.cast("string").alias("uid"), F.concat(F.lit("About "), F.col("source"), F.when(k % 9 == 0, " free trial").otherwise("")).alias("subject"),
        F.concat(F.lit('"User '), F.col("source"), F.lit('" <'), F.initcap("source"), F.lit("@Example.com>")).alias("from"), F.when(k % 13 != 0, F.col("text")).alias("body"),
    )


MAILS = """m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Sent Messages' ELSE 'INBOX' END AS folder, cast(doc_id AS varchar) AS uid, 'About ' || source || CASE WHEN doc_id % 9 = 0 THEN ' free trial' ELSE '' END AS subject,
    source || '@example.com' AS address, CASE WHEN doc_id % 13 <> 0 THEN text END AS body FROM documents)"""
PROMO = "regexp_matches(subject || ' ' || substr(coalesce(body, ''), 1, 500), '(?i)(?:" + "|".join(mail.PROMO_PATTERNS) + ")') OR contains(lower(substr(coalesce(body, ''), 1, 500)), 'unsubscribe') OR contains(lower(substr(coalesce(body, ''), 1, 500)), 'promotional email')"
CLASS = lambda words: " + ".join(f"cast(contains(w, '{x}') AS int)" for x in words)


def promo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select("uid", mail.is_promotional(F.col("subject"), F.col("body")).alias("promotional"))


def promo_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, "id int, subject string, body string", (1, "[광고] 특별", ""), (2, "주간 소식", "이 메일은 발신전용 입니다"), (3, "weekly", "product UPDATE"), (4, "update", "now"), (5, "한정 수량 할인", ""), (6, "견적 요청", "회신 바랍니다"))
    return r.select("id", mail.is_promotional(F.col("subject"), F.col("body")).alias("promotional"), mail.classify(F.col("subject"), F.lit("a@b"), F.col("body")).alias("class"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select("uid", mail.classify(F.col("subject"), F.col("from"), F.col("body")).alias("class"))


def senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mail.without_senders(mails(spark, sf_dir), rows(spark, "address string", (" SRC3@example.com ",))).select("uid", mail.sender(F.col("from")).alias("s"))
    return s.select("uid", "s.address", "s.name")


def mail_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mails(spark, sf_dir)
    key = m.select(F.concat_ws(":", "folder", "uid").alias("uid_key"), F.col("uid").cast("int").alias("k"))
    s = mail.states(m, rows(spark, "address string", ("src3@example.com",)), key.filter("k % 8 = 0"), key.filter("k % 5 <> 0").select("uid_key", (F.col("k") % 2 == 0).alias("actionable")))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("mails"))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), F.col("event_id").alias("uid"))
    return mail.to_fetch(e, e.filter("uid % 3 = 0"), 10).select("folder", "uid")


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, "id int, raw string", (1, '{"from":"010","body":"hi","text":"no"}'), (2, '{"sender":"s","message":"m","thread_id":"t"}'), (3, "{}"), (4, '{"from":null,"sender":"s","text":"x"}'))
    return r.select("id", mail.sms(F.parse_json("raw")).alias("s")).select("id", "s.*")


def sms_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns of conversations as messages, a to-do from each second turn."""
    c = table(spark, sf_dir, "conversations")
    m = c.filter("turn = 0").select(F.col("conv_id").alias("id"), F.concat(F.lit("010"), F.col("conv_id").cast("string")).alias("sender"), F.concat(F.lit("t"), (F.col("conv_id") % 5).cast("string")).alias("thread_id"), F.lit("2024-01-01").alias("at"))
    t = c.filter("turn = 1").select(F.col("conv_id").alias("id"), F.md5("text").alias("title"), F.lit("call").alias("source"))
    return mail.sms_todos(m, t)


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("@X.com ")).alias("address"))
    return mail.excluded_after(d, rows(spark, "address string", ("New@x.com",)), rows(spark, "address string", ("SRC1@x.com",)))


def raw_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages as raw messages, parsed back."""
    p = table(spark, sf_dir, "pages")
    # base64() breaks lines, which an encoded word may not have.
    subject = F.regexp_replace(F.base64(F.encode("url", "utf-8")), "\\s", "")
    head = F.concat(F.lit("Subject: =?utf-8?B?"), subject, F.lit("?=\r\nFrom: a@b.c\r\nMessage-ID: <"), F.col("page_id").cast("string"), F.lit(">\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"))
    raw = p.select(F.lit("INBOX").alias("folder"), F.col("page_id").cast("string").alias("uid"), F.encode(F.concat(head, "html"), "utf-8").alias("raw"))
    return mail.parse_raw(raw).select("uid", "subject", "from", "message_id", F.md5("body").alias("body_md5"))


# ── runs ──

def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    stderr = F.when(F.col("event_type") == "view", F.concat(F.lit("Traceback\n  ImportError: no "), (k % 2).cast("string"), F.lit("\nend"))).when(F.col("event_type") == "click", "HTTP 503 busy").when(F.col("event_type") == "error", "  odd  ").otherwise("")
    return table(spark, sf_dir, "events").select(k.alias("seq"), F.concat(F.lit("step"), (F.col("user_id") % 20).cast("string")).alias("step"), F.when(k % 4 == 0, 0).otherwise(1).alias("returncode"), stderr.alias("stderr"))


RUNS = """r AS (SELECT event_id AS seq, 'step' || (user_id % 20) AS step, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS rc,
    CASE event_type WHEN 'view' THEN 'ImportError: no ' || (event_id % 2) WHEN 'click' THEN 'HTTP 503 busy' WHEN 'error' THEN 'odd' ELSE 'unknown' END AS sig FROM events),
    l AS (SELECT step, arg_max(CASE WHEN rc <> 0 THEN sig ELSE '' END, seq) AS last FROM r GROUP BY step),
    s AS (SELECT r.step, last, max(CASE WHEN rc = 0 OR sig <> last THEN seq END) AS since FROM r JOIN l ON r.step = l.step GROUP BY ALL)"""


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.error_streaks(runs(spark, sf_dir))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).filter("returncode <> 0").groupBy(health.error_signature(F.col("stderr")).alias("signature")).agg(F.count(F.lit(1)).alias("runs"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select((F.floor(k / 8)).cast("long").alias("run"), (k % 8).cast("int").alias("pos"), F.concat(F.lit("step"), (k % 8).cast("string")).alias("step"), (k % 8 < 3).alias("upstream"), F.when(F.col("user_id") % 7 == 0, 1).otherwise(0).alias("returncode"))


STEPS = "s AS (SELECT event_id // 8 AS run, event_id % 8 AS pos, 'step' || (event_id % 8) AS step, event_id % 8 < 3 AS upstream, CASE WHEN event_id % 8 = 5 THEN -2 WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS own FROM events), o AS (SELECT *, max(CASE WHEN upstream AND own <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s), f AS (SELECT run, pos, step, upstream, CASE WHEN NOT upstream AND coalesce(b, 0) = 1 THEN -3 ELSE own END AS outcome FROM o)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.run_steps(steps(spark, sf_dir), rows(spark, "step string", ("step5",)))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.run_status(outcomes(spark, sf_dir), "outcome")


def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.last_results(runs(spark, sf_dir)).select("seq", "step")


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    f = e.select(F.col("event_id").alias("stem"), F.col("ts").alias("mtime"))
    return health.recent_gaps(f, f.filter("stem % 2 = 0"), f.filter("stem % 3 = 0"), F.lit(now))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    b = table(spark, sf_dir, "events").select(F.array(F.struct(F.concat(F.lit("a"), (k % 300).cast("string")).alias("file"), F.when(k % 3 == 0, "ok").otherwise("error").alias("status")), F.struct(F.lit("").alias("file"), F.lit("ok").alias("status"))).alias("results"))
    return health.processed_stems(b)


def state_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(
        spark, "file string, present boolean, age int, content string",
        ("pipeline_state.json", True, 71, '{"a":1}'), ("persistent_todos.json", True, 49, '{"a":'), ("events.jsonl", True, 100, '{"a":1}\n\nnot json\n{"b":2}'), ("correction_rules.json", False, None, None), ("other.json", True, 1, "a\0b"), ("notes.txt", True, 48, "free"), ("empty.json", True, 2, ""),
    )
    return health.check_files(r.withColumn("mtime", now() - F.make_interval(hours=F.col("age"))), now())


def state_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.state_ok(state_files(spark, sf_dir))


# ── export ──

def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("transcript of "), F.col("stem"), F.lit(" "), F.repeat(F.lit("words "), (F.col("o_orderkey") % 40).cast("int")))
    return stems(spark, sf_dir).groupBy("stem").agg(F.min("o_orderkey").alias("o_orderkey")).select(F.concat("stem", F.lit(".txt")).alias("name"), "o_orderkey", text.alias("text")).withColumn("size_bytes", F.octet_length("text") + F.col("o_orderkey") % 3 * 30)


FILES = f"""WITH {STEMS}, g AS (SELECT stem, min(o_orderkey) AS k FROM stems GROUP BY 1), x AS (SELECT stem || '.txt' AS name, k, 'transcript of ' || stem || ' ' || repeat('words ', cast(k % 40 AS int)) AS text FROM g),
    f AS (SELECT *, strlen(text) + k % 3 * 30 AS size_bytes, regexp_extract(name, '^(.+?)_(\\d{{7,12}})_(\\d{{14}})\\.txt$', 1) AS cp0, regexp_extract(name, '^(.+?)_(\\d{{7,12}})_(\\d{{14}})\\.txt$', 2) AS p1, regexp_extract(name, '^(\\d{{7,12}})_(\\d{{14}})\\.txt$', 1) AS p2,
        try_strptime(regexp_extract(name, '(\\d{{14}})\\.txt$', 1), '%Y%m%d%H%M%S') AS t FROM x),
    p AS (SELECT *, CASE WHEN k % 6 = 5 AND false THEN 'x' WHEN k % 10 = 0 THEN 'processed' WHEN t IS NULL OR (cp0 = '' AND p2 = '') THEN 'unparsed' WHEN size_bytes < 100 THEN 'small' WHEN length(trim(text)) < 100 THEN 'short' END AS skip, CASE WHEN cp0 <> '' THEN cp0 ELSE p2 END AS party FROM f)"""


def skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return export.skip_reasons(f, f.filter("o_orderkey % 10 = 0")).groupBy(F.coalesce("skip", F.lit("export")).alias("skip")).agg(F.count(F.lit(1)).alias("files"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return export.notes(f, f.filter("o_orderkey % 10 = 0")).select("name", "note", "counterparty", "date")


def note_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = rows(spark, "name string, size_bytes int, text string", ("한빛 (주)_01012345678_20240102030405.txt", 200, "가" * 100), ("0212345678_20240102030405.txt", 200, "b" * 100))
    return export.notes(f, rows(spark, "name string", ("none",))).select("note", "markdown")


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = rows(spark, "counterparty string, note string, date string", ("A", "n1.md", "2024-01-01"), ("A", "n2.md", "2024-01-02"), ("B", "old.md", "2024-01-01"), ("B", "n3.md", "2024-01-03"), ("C", "n4.md", "2024-01-04"))
    old = rows(spark, "counterparty string, content string", ("B", "# B\n\n## 통화 기록\n- [2024-01-01] [[old.md]]\n"), ("C", "# C"))
    return export.party_files(w, old)


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rows(spark, "seq int, title string, priority string, counterparty string, phone string, called_at string", (1, "Call", "high", "Kim", "01012345678", "2024-01-02T03:04:05"), (2, "Mail", "x", "알 수 없음", "", None), (3, "Ship", "low", "Lee", "", "soon, they said so"), (4, "Old", "low", "", "", ""))
    return export.todo_lines(t, 3)


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.when(F.col("user_id") % 2 == 0, "10:00").alias("time"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("source"))
    sent = e.filter("date < '2024-01-20'").select(export.appointment_key(*map(F.col, ("title", "date", "time", "source"))).alias("key")).distinct()
    return export.unnotified(e, sent).groupBy("key").agg(F.count(F.lit(1)).alias("appointments"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc"), (F.col("vec_id") % 400).cast("string")).alias("source"), F.col("embedding").cast("array<double>").alias("v"))
    q = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("int").alias("query_pos"), F.col("embedding").cast("array<double>").alias("q"))
    return export.nearest(v, q, 20, 150.0).select("query_pos", "source", F.bround("dist", 4).alias("dist"))


EXPORTED = f"""{FILES}, c AS (SELECT *, count(*) OVER (PARTITION BY party, strftime(t, '%Y-%m-%d')) AS n FROM p WHERE skip IS NULL OR skip = 'short'),
    e AS (SELECT name, strftime(t, '%Y-%m-%d') || CASE WHEN n > 1 THEN '_' || strftime(t, '%H%M') ELSE '' END || '_' || party || '.md' AS note, nullif(cp0, '') AS counterparty, strftime(t, '%Y-%m-%d') AS date FROM c WHERE skip IS NULL)"""

QUERIES = {
    "promotional_mail": (promo, f"WITH {MAILS} SELECT uid, {PROMO} AS promotional FROM m"),
    "promotional_korean": (promo_korean, "SELECT * FROM (VALUES (1, true, 'normal'), (2, true, 'normal'), (3, true, 'normal'), (4, false, 'normal'), (5, true, 'normal'), (6, false, 'important')) AS t(id, promotional, class)"),
    "mail_classes": (classes, f"WITH {MAILS}, x AS (SELECT uid, lower(concat_ws(' ', subject, '\"User ' || substr(subject, 7) || '\" <' || address || '>', coalesce(body, ''))) AS w FROM m) SELECT uid, CASE WHEN {CLASS(mail.AD_WORDS)} >= 2 THEN 'ad' WHEN {CLASS(mail.IMPORTANT_WORDS)} >= 1 THEN 'important' ELSE 'normal' END AS class FROM x"),
    "mail_senders": (senders, f"WITH {MAILS} SELECT uid, address, 'User ' || split_part(address, '@', 1) AS name FROM m WHERE address <> 'src3@example.com'"),
    "mail_states": (mail_states, f"""WITH {MAILS} SELECT CASE WHEN doc_id % 11 = 0 THEN 'sent' WHEN address = 'src3@example.com' THEN 'excluded' WHEN doc_id % 8 = 0 THEN 'seen' WHEN body IS NULL THEN 'missing' WHEN {PROMO} THEN 'promo_skipped' WHEN doc_id % 5 = 0 THEN 'llm_failed'
        WHEN doc_id % 2 = 1 THEN 'no_actions' ELSE 'extracted' END AS status, count(*) AS mails FROM m GROUP BY 1"""),
    "mail_to_fetch": (fetches, "SELECT folder, uid FROM (SELECT event_type AS folder, event_id AS uid, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events WHERE event_id % 3 <> 0) WHERE r <= 10"),
    "sms_payloads": (sms, "SELECT * FROM (VALUES (1, '010', 'hi', ''), (2, 's', 'm', 't'), (3, '', '', ''), (4, NULL, 'x', '')) AS t(id, sender, message, thread_id)"),
    "sms_entries": (sms_entries, "SELECT a.conv_id AS id, md5(b.text) AS title, 'sms' AS source, '010' || a.conv_id AS source_phone, 't' || (a.conv_id % 5) AS sms_thread, '2024-01-01' AS sms_timestamp FROM conversations AS a JOIN conversations AS b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1"),
    "mail_exclusions": (exclusions, "SELECT DISTINCT source || '@x.com' AS address FROM documents WHERE source <> 'src1' UNION SELECT 'new@x.com'"),
    "raw_mail": (raw_mail, "SELECT cast(page_id AS varchar) AS uid, trim(url) AS subject, 'a@b.c' AS \"from\", '<' || page_id || '>' AS message_id, md5(html) AS body_md5 FROM pages"),
    "error_streaks": (streaks, f"WITH {RUNS} SELECT s.step, last AS signature, count(*) AS count FROM s JOIN r ON s.step = r.step AND (since IS NULL OR seq > since) WHERE last <> '' GROUP BY ALL"),
    "error_signatures": (signatures, f"WITH {RUNS} SELECT sig AS signature, count(*) AS runs FROM r WHERE rc <> 0 GROUP BY 1"),
    "run_steps": (outcomes, f"WITH {STEPS} SELECT * FROM f"),
    "run_status": (statuses, f"WITH {STEPS} SELECT run, CASE WHEN count(*) FILTER (outcome <> 0) > 0 AND count(*) FILTER (outcome = 0) > 0 THEN 'partial_success' WHEN count(*) FILTER (outcome <> 0) > 0 THEN 'failed' ELSE 'succeeded' END AS status FROM f GROUP BY run"),
    "last_results": (last_runs, "SELECT event_id AS seq, 'step' || (user_id % 20) AS step FROM events ORDER BY event_id DESC LIMIT 50"),
    "recent_gaps": (recent, "WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id AS stem, CASE WHEN ts >= now - INTERVAL 30 MINUTE THEN 'pending' ELSE 'missing' END AS state FROM events, n WHERE ts >= now - INTERVAL 3 HOUR AND event_id % 2 <> 0 AND event_id % 3 <> 0"),
    "processed_stems": (processed, "SELECT DISTINCT 'a' || (event_id % 300) AS stem FROM events WHERE event_id % 3 = 0"),
    "state_files": (state_files, "SELECT * FROM (VALUES ('pipeline_state.json', true, false, 71.0::double, true, NULL), ('persistent_todos.json', true, true, 49.0, false, 'no JSON'), ('events.jsonl', true, false, 100.0, false, 'line 3'), ('correction_rules.json', false, true, -1.0, true, NULL), ('other.json', true, false, 1.0, false, 'null byte found'), ('notes.txt', true, false, 48.0, true, NULL), ('empty.json', true, false, 2.0, true, NULL)) AS t(file, present, stale, age_hours, parse_ok, parse_error)"),
    "state_ok": (state_ok, "SELECT false AS ok"),
    "export_skips": (skips, f"{FILES} SELECT coalesce(skip, 'export') AS skip, count(*) AS files FROM p GROUP BY 1"),
    "export_notes": (notes, f"{EXPORTED} SELECT * FROM e"),
    "export_markdown": (note_text, """WITH f(note, cp, tag, phone, shown, day, file, body) AS (VALUES
            ('2024-01-02_한빛 (주).md', '한빛 (주)', '한빛', '01012345678', '010-1234-5678', '2024-01-02', '한빛 (주)_01012345678_20240102030405.txt', repeat('가', 100)), ('2024-01-02_0212345678.md', NULL, NULL, '0212345678', '021-234-5678', '2024-01-02', '0212345678_20240102030405.txt', repeat('b', 100)))
        SELECT note, concat_ws(chr(10), '---', 'type: transcript', 'counterparty: "' || coalesce(cp, '') || '"', 'phone: "' || phone || '"', 'date: ' || day, 'time: "03:04:05"', 'source_file: ' || file, 'tags: [' || concat_ws(', ', '통화전사', tag) || ']', '---', '',
            '# 통화 전사 — ' || coalesce(cp, shown) || ' (' || day || ' 03:04)', '', '> **거래처**: [[' || cp || ']]', '> **전화**: ' || shown, '', '---', '', body) AS markdown FROM f"""),
    "party_files": (parties, """SELECT 'A' AS counterparty, '---' || chr(10) || 'type: counterparty' || chr(10) || 'name: "A"' || chr(10) || '---' || chr(10) || chr(10) || '# A' || chr(10) || chr(10) || '## 통화 기록' || chr(10) || '- [2024-01-02] [[n2.md]]' || chr(10) || '- [2024-01-01] [[n1.md]]' || chr(10) AS content
        UNION ALL SELECT 'B', '# B' || chr(10) || chr(10) || '## 통화 기록' || chr(10) || '- [2024-01-03] [[n3.md]]' || chr(10) || '- [2024-01-01] [[old.md]]' || chr(10) UNION ALL SELECT 'C', '# C' || chr(10) || chr(10) || '## 통화 기록' || chr(10) || '- [2024-01-04] [[n4.md]]' || chr(10)"""),
    "notice_lines": (message, "SELECT * FROM (VALUES (1, '  🔴 Call' || chr(10) || '    • 통화: Kim (010-1234-5678) / 1/2 03:04'), (2, '   Mail'), (3, '  🟢 Ship' || chr(10) || '    • 통화: Lee / soon, they said ')) AS t(seq, line)"),
    "unnotified_appointments": (appointments, "SELECT key, count(*) AS appointments FROM (SELECT event_type || '|' || strftime(ts, '%Y-%m-%d') || '|' || CASE WHEN user_id % 2 = 0 THEN '10:00' ELSE '' END || '|u' || (user_id % 5) AS key FROM events WHERE ts >= TIMESTAMP '2024-01-20') GROUP BY 1"),
    "vector_top_k": (vectors, """WITH e AS (SELECT 'doc' || (vec_id % 400) AS source, embedding::double[] AS v FROM embeddings), q AS (SELECT vec_id::int AS query_pos, embedding::double[] AS q FROM embeddings WHERE vec_id % 20 = 0),
        d AS (SELECT query_pos, source, list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_pos ORDER BY dist, source) AS r FROM d),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY query_pos, dist) AS n FROM r WHERE r <= 20 AND dist <= 150) SELECT query_pos, source, round_even(dist, 4) AS dist FROM n WHERE n = 1"""),
}
