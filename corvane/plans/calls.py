"""Queries of orders and calls, over orders, customers and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import calls, orders
from corvane.session import rows, table

HINTS = {"URGENT": "delivery", "HIGH": "payment", "LOW": "quote"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_custkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("010-"), F.lpad(k.cast("string"), 4, "0"), F.lit(" 0000")))
    who = F.when(k % 5 != 0, F.concat(F.lit("Customer#"), k.cast("string")))
    party = orders.counterparty(F.lit(""), who, F.lit(None), F.array().cast("array<struct<type:string,name:string,value:string>>"))
    phone = orders.phone(F.lit(None).cast("string"), F.array(F.struct(F.lit("Phone").alias("type"), F.lit("").alias("name"), number.alias("value"))))
    stage = orders.infer_stage(F.col("o_orderpriority"), F.lit(""), F.col("o_totalprice") > 200_000, HINTS)
    return o.select(F.col("o_orderkey").alias("seq"), party.alias("counterparty"), phone.alias("phone"), stage.alias("stage")).withColumn("key", orders.order_key(F.col("counterparty"), F.col("phone")))


EVENTS = """e AS (SELECT o_orderkey AS seq, CASE WHEN o_custkey % 5 <> 0 THEN 'Customer#' || o_custkey END AS counterparty, CASE WHEN o_custkey % 3 = 0 THEN '010' || lpad(cast(o_custkey AS varchar), 4, '0') || '0000' END AS phone,
    CASE WHEN contains(o_orderpriority, 'URGENT') THEN 'delivery' WHEN contains(o_orderpriority, 'HIGH') THEN 'payment' WHEN contains(o_orderpriority, 'LOW') THEN 'quote' WHEN o_totalprice > 200000 THEN 'payment' ELSE 'order' END AS stage FROM orders),
    k AS (SELECT *, CASE WHEN phone IS NOT NULL THEN 'phone:' || phone WHEN counterparty IS NOT NULL THEN 'name:' || counterparty END AS key, CASE stage WHEN 'order' THEN 0 WHEN 'quote' THEN 1 WHEN 'po' THEN 2 WHEN 'delivery' THEN 3 ELSE 4 END AS i FROM e)"""
NAME = "CASE {0} WHEN 0 THEN 'order' WHEN 1 THEN 'quote' WHEN 2 THEN 'po' WHEN 3 THEN 'delivery' ELSE 'payment' END"


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.timeline(events(spark, sf_dir)).select("seq", "key", "stage", "current_stage")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.active(orders.orders(events(spark, sf_dir))).select("key", "counterparty", "phone", "current_stage", "first", "last", "events")


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rows(spark, "term string", ("010-0003 0000",), ("Customer#1",), ("mer#7",), ("0006",), ("nobody",))
    return orders.lookup(asked, orders.orders(events(spark, sf_dir)))


def stages_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, "id int, call_type string, todos string, money int", (1, "견적요청", "", 0), (2, "etc", "납기 확인", 1), (3, None, "", 2), (4, "", "", 0), (5, "발주 및 입금", "주문", 0))
    return r.select("id", orders.infer_stage(F.col("call_type"), F.col("todos"), F.col("money") > 0).alias("stage"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments: as many seconds as characters, users as one speaker, all others as another."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("double")
    return c.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("pos"), (F.col("turn") * 1000.0).alias("start"), (F.col("turn") * 1000.0 + n / 8).alias("end"), "text", F.when(F.col("role") == "user", "SPEAKER_01").otherwise("SPEAKER_00").alias("speaker"))


POLITE = ("the ", "que ")
SEGMENTS = "s AS (SELECT conv_id AS call_id, turn AS pos, turn * 1000.0::double AS start, turn * 1000.0::double + length(text) / 8.0::double AS \"end\", text, CASE WHEN role = 'user' THEN 'SPEAKER_01' ELSE 'SPEAKER_00' END AS speaker FROM conversations)"
STATS = f"""{SEGMENTS}, st AS (SELECT call_id, speaker, sum("end" - start) AS seconds, count(*) FILTER (contains(text, 'the ') OR contains(text, 'que ')) AS polite, min(pos) AS first_pos FROM s GROUP BY ALL)"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.speaker_stats(segments(spark, sf_dir), POLITE)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id"), F.concat(F.lit("Caller"), F.col("conv_id").cast("string")).alias("caller")).distinct()
    return calls.speaker_names(segments(spark, sf_dir), who, "me", POLITE)


NAMES = f"""{STATS}, p AS (SELECT a.call_id, a.first_pos < b.first_pos AS a_first, CASE WHEN a.seconds > b.seconds * 1.3::double THEN 1 WHEN b.seconds > a.seconds * 1.3::double THEN -1 ELSE 0 END
    + CASE WHEN a.polite > b.polite THEN 2 WHEN b.polite > a.polite THEN -2 ELSE 0 END + CASE WHEN a.first_pos < b.first_pos THEN 1 ELSE -1 END AS score
    FROM st a JOIN st b ON a.call_id = b.call_id AND a.speaker = 'SPEAKER_00' AND b.speaker = 'SPEAKER_01'), c AS (SELECT call_id, CASE WHEN score <> 0 THEN score > 0 ELSE a_first END AS a_calls FROM p),
    n AS (SELECT call_id, 'SPEAKER_00' AS speaker, CASE WHEN a_calls THEN 'Caller' || call_id ELSE 'me' END AS name FROM c UNION ALL SELECT call_id, 'SPEAKER_01', CASE WHEN a_calls THEN 'me' ELSE 'Caller' || call_id END FROM c)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = calls.rendered(calls.with_names(segments(spark, sf_dir), names(spark, sf_dir)))
    return text.select("call_id", F.md5("text").alias("md5"), F.length("text").alias("chars"))


def serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.serialised(segments(spark, sf_dir)).select("call_id", "pos", "start", "end", F.length("text").alias("chars"))


def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segments(spark, sf_dir).select("call_id", (F.col("pos") % 3).alias("chunk"), (F.col("pos") % 3 * 300.0).alias("offset"), "pos", "start", "end", "text")
    return calls.merged_chunks(c).select("call_id", "pos", "start", "end")


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).withColumns({"log_prob": F.when(F.col("call_id") % 3 != 0, -F.length("text") / 64.0), "language_prob": F.when(F.col("pos") % 2 == 0, F.lit(0.5))})
    q = calls.quality(s)
    return q.select("call_id", F.bround("mean_log_prob", 6).alias("mean_log_prob"), "mean_language_prob")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = F.concat(F.lit("010"), F.lpad(k.cast("string"), 8, "0"))
    book = c.select(F.concat(F.lit("010-"), F.lpad(k.cast("string"), 8, "0")).alias("phone"), F.when(k % 4 != 0, F.col("c_name")).otherwise("").alias("name"))
    called = c.select("c_custkey", number.alias("phone"), F.lit("cp").alias("counterparty"), F.when(k % 3 == 0, "cp").when(k % 3 == 1, "caller").otherwise("me").alias("speaker"))
    return calls.resolved(called, book, "caller").select("c_custkey", "speaker")


def undiarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"))
    results = d.filter("stem % 3 <> 0").select("stem", F.when(F.col("stem") % 5 == 0, False).alias("diarize_ok"))
    return calls.to_diarize(d, results, d.filter("stem % 7 <> 0"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(calls.duration_path(F.col("n_chars")).alias("path"), calls.too_short(F.col("text")).alias("size"))
    return d.groupBy("path", "size").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {
    "order_timeline": (timeline, f"WITH {EVENTS}, t AS (SELECT *, max(i) OVER (PARTITION BY key ORDER BY seq) AS m FROM k WHERE key IS NOT NULL) SELECT seq, key, stage, {NAME.format('m')} AS current_stage FROM t"),
    "active_orders": (order_rows, f"WITH {EVENTS} SELECT key, arg_min(counterparty, seq) FILTER (counterparty IS NOT NULL) AS counterparty, arg_min(phone, seq) FILTER (phone IS NOT NULL) AS phone, {NAME.format('max(i)')} AS current_stage, min(seq) AS first, max(seq) AS last, count(*) AS events FROM k WHERE key IS NOT NULL GROUP BY key"),
    "order_lookup": (lookups, f"""WITH {EVENTS}, o AS (SELECT key, any_value(counterparty) AS c, any_value(phone) AS p, min(seq) AS f FROM k WHERE key IS NOT NULL GROUP BY key), t(term) AS (VALUES ('010-0003 0000'), ('Customer#1'), ('mer#7'), ('0006'), ('nobody')),
        m AS (SELECT term, key, CASE WHEN key = 'phone:' || replace(replace(term, '-', ''), ' ', '') THEN 0 WHEN key = 'name:' || term THEN 1 ELSE 2 END AS r, f FROM t JOIN o ON key = 'phone:' || replace(replace(term, '-', ''), ' ', '') OR key = 'name:' || term OR contains(coalesce(c, ''), term) OR contains(coalesce(p, ''), term))
        SELECT term, key FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY r, f, key) AS n FROM m) WHERE n = 1"""),
    "order_stage_korean": (stages_korean, "SELECT * FROM (VALUES (1, 'quote'), (2, 'delivery'), (3, 'payment'), (4, 'order'), (5, 'po')) AS t(id, stage)"),
    "speaker_stats": (stats, f"WITH {STATS} SELECT * FROM st"),
    "speaker_names": (names, f"WITH {NAMES} SELECT * FROM n"),
    "rendered_transcripts": (transcripts, f"""WITH {NAMES}, l AS (SELECT s.call_id, pos, printf('[%.1f-%.1f] ', start, "end") || coalesce(n.name, s.speaker) || ': ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line FROM s LEFT JOIN n ON s.call_id = n.call_id AND s.speaker = n.speaker WHERE trim(text) <> '')
        SELECT call_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS md5, length(string_agg(line, chr(10) ORDER BY pos)) AS chars FROM l GROUP BY 1"""),
    "serialised_segments": (serial, f"""WITH {SEGMENTS} SELECT call_id, pos, round_even(start, 2) AS start, round_even("end", 2) AS "end", length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS chars FROM s"""),
    "chunk_merge": (chunk_merge, f"""WITH {SEGMENTS} SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY pos % 3, pos) - 1 AS pos, start + pos % 3 * 300 AS start, "end" + pos % 3 * 300 AS "end" FROM s"""),
    "call_quality": (qualities, f"WITH {SEGMENTS} SELECT call_id, round_even(coalesce(avg(CASE WHEN call_id % 3 <> 0 THEN -length(text) / 64.0::double END), 0), 6) AS mean_log_prob, coalesce(avg(CASE WHEN pos % 2 = 0 THEN 0.5::double END), 0) AS mean_language_prob FROM s GROUP BY 1"),
    "contact_names": (resolved, "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 < 2 THEN c_name ELSE ['cp', 'caller', 'me'][c_custkey % 3 + 1] END AS speaker FROM customer"),
    "to_diarize": (undiarized, "SELECT doc_id AS stem, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'failed' END AS why FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0)"),
    "audio_gates": (gates, """SELECT CASE WHEN n_chars > 3600 THEN 'skip' WHEN n_chars >= 1800 THEN 'fast' WHEN n_chars > 300 THEN 'chunks' ELSE 'whole' END AS path,
        CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'error' WHEN strlen(text) < 200 THEN 'too_short' ELSE 'ok' END AS size, count(*) AS documents FROM documents GROUP BY ALL"""),
}
