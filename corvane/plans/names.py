"""Queries of file names and times, over stems made from orders and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import names
from corvane.session import rows, table


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, stem: names of six shapes, some with times that don't exist."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    clock = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k % 61).cast("string"), 2, "0"))
    phone = F.concat(F.lit("010"), F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    who = F.concat(F.lit("Cust.om_"), F.col("o_custkey").cast("string"))
    stem = (
        F.when(k % 6 == 0, F.concat_ws("_", who, phone, F.concat(day, clock)))
        .when(k % 6 == 1, F.concat_ws("_", phone, F.concat(day, clock)))
        .when(k % 6 == 2, F.concat_ws("_", who, F.concat(day, clock)))
        .when(k % 6 == 3, F.concat_ws("_", who, phone, F.concat(day, clock), F.lit("101500")))
        .when(k % 6 == 4, F.concat_ws("_", day, F.lit("1430"), who, phone))
        .otherwise(F.concat_ws("_", F.lit("note"), who))
    )
    # explode() of one element: the name is made once, not again in each pattern that reads it.
    return o.select("o_orderkey", F.explode(F.array(stem)).alias("stem"))


STEMS = """stems AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN who || '_' || phone || '_' || stamp WHEN 1 THEN phone || '_' || stamp WHEN 2 THEN who || '_' || stamp
    WHEN 3 THEN who || '_' || phone || '_' || stamp || '_101500' WHEN 4 THEN day || '_1430_' || who || '_' || phone ELSE 'note_' || who END AS stem FROM (
    SELECT o_orderkey, 'Cust.om_' || o_custkey AS who, '010' || lpad(cast(o_custkey AS varchar), 8, '0') AS phone, strftime(o_orderdate, '%Y%m%d') AS day,
    strftime(o_orderdate, '%Y%m%d') || lpad(cast(o_orderkey % 24 AS varchar), 2, '0') || lpad(cast(o_orderkey % 60 AS varchar), 2, '0') || lpad(cast(o_orderkey % 61 AS varchar), 2, '0') AS stamp FROM orders))"""


def sql(columns: str) -> str:
    return f"WITH {STEMS} SELECT o_orderkey, {columns} FROM stems"


def x(pattern: str, group: int, of: str = "stem") -> str:
    return f"regexp_extract({of}, '{pattern}', {group})"


def fits(pattern: str, of: str = "stem") -> str:
    return f"regexp_matches({of}, '{pattern}')"


#: Path.stem of a name with .m4a behind it is the name; without, the last suffix goes.
BASE = "CASE WHEN regexp_matches(stem, '^.+\\.[^.]+$') THEN regexp_extract(stem, '^(.+)\\.[^.]+$', 1) ELSE stem END"


def iso(t: str) -> str:
    return f"coalesce(strftime(try_strptime({t}, '%Y%m%d%H%M%S'), '%Y-%m-%dT%H:%M:%S') || '+09:00', '')"


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = names.call_context(F.concat(F.col("stem"), F.lit(".m4a")))
    return stems(spark, sf_dir).select("o_orderkey", c.alias("c")).select("o_orderkey", "c.*")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stems(spark, sf_dir).select("o_orderkey", names.stem_parts(F.col("stem")).alias("p"), names.canonical_stem(F.col("stem")).alias("canonical")).select("o_orderkey", "canonical", "p.*")


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stems(spark, sf_dir).select("o_orderkey", names.export_name(F.concat(F.col("stem"), F.lit(".txt"))).alias("e"))
    return e.select("o_orderkey", F.col("e").isNotNull().alias("parsed"), "e.counterparty", "e.phone", F.date_format("e.at", "yyyy-MM-dd HH:mm:ss").alias("called"))


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stems(spark, sf_dir).select("o_orderkey", "stem", names.caller_info(F.col("stem")).alias("i"), names.schedule_name(F.col("stem")).alias("s"))
    return s.select("o_orderkey", "i.caller", F.col("i.phone").alias("caller_phone"), "s.counterparty", "s.phone", "s.called_at")


def resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("stem"), F.lit(".wav"))
    return stems(spark, sf_dir).select("o_orderkey", names.resolver_phone(name).alias("phone"), names.resolver_counterparty(name).alias("counterparty"))


def backoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    attempts = (F.col("event_id") % 12).cast("int")
    return e.select("event_id", F.date_format(names.backoff(F.col("ts"), attempts), "yyyy-MM-dd HH:mm:ss").alias("next_retry_at"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(names.chunk_offsets(F.col("n_chars"))).alias("start"))
    return d


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("t")
    r = rows(spark, "id int, t string, elapsed double", (1, "Duration: 01:02:03.50, start", 10.0), (2, "00:00:07", 0.0), (3, "none", 1.0), (4, "2:3:4.25", -1.0))
    s = names.clock_seconds(text)
    return r.select("id", s.alias("seconds"), names.real_time_factor(F.coalesce(s, F.lit(0.0)), F.col("elapsed")).alias("factor"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("some day next week "), F.col("event_type"))).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", names.notice_time(text).alias("notice"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", names.safe_file_name(F.col("url")).alias("file_name"), names.slug(F.col("url")).alias("slug"), names.stem(F.col("url")).alias("stem"))


CTX, A, B, C = r"^(.*?)_(\d+)_(\d{14})(?:_(\d{6}))?$", r"^(.+?)_(\d{10,11})_(\d{14})$", r"^(\d{10,11})_(\d{14})$", r"^(.+?)_(\d{14})$"
D, E, G, H, M = r"^(.+_\d{14})_\d{6}$", r"^(.+?)_(\d{7,12})_(\d{14})$", r"^(\d{7,12})_(\d{14})$", r"^\d{8}_\d{4}_(.+?)_(0(?:1[0-6789]|10)\d{7,8})$", r"^(.+?)_(0(?:1[0-6789]|10)\d{7,8})$"
EXPORT_AT = f"try_strptime(CASE WHEN {fits(E)} THEN {x(E, 3)} ELSE {x(G, 2)} END, '%Y%m%d%H%M%S')"

QUERIES = {
    "call_context": (context, sql(f"CASE WHEN {fits(CTX)} THEN {x(CTX, 1)} ELSE stem END AS caller, {x(CTX, 2)} AS phone, CASE WHEN {fits(CTX)} THEN {iso(x(CTX, 3))} ELSE '' END AS called_at, {x(CTX, 4)} AS suffix")),
    "stem_parts": (parts, sql(f"""CASE WHEN {fits(D)} THEN {x(D, 1)} ELSE stem END AS canonical, CASE WHEN {fits(A)} THEN {x(A, 1)} WHEN {fits(B)} THEN '' WHEN {fits(C)} THEN {x(C, 1)} ELSE '' END AS caller,
        CASE WHEN {fits(A)} THEN {x(A, 2)} WHEN {fits(B)} THEN {x(B, 1)} ELSE '' END AS phone, CASE WHEN {fits(A)} THEN {x(A, 3)} WHEN {fits(B)} THEN {x(B, 2)} WHEN {fits(C)} THEN {x(C, 2)} ELSE '' END AS date""")),
    "export_name": (export, f"""WITH {STEMS}, p AS (SELECT *, {EXPORT_AT} AS t FROM stems) SELECT o_orderkey, t IS NOT NULL AS parsed, CASE WHEN t IS NOT NULL AND {fits(E)} THEN {x(E, 1)} END AS counterparty,
        CASE WHEN t IS NOT NULL THEN CASE WHEN {fits(E)} THEN {x(E, 2)} ELSE {x(G, 1)} END END AS phone, strftime(t, '%Y-%m-%d %H:%M:%S') AS called FROM p"""),
    "caller_and_schedule": (callers, f"""WITH {STEMS}, p AS (SELECT *, string_split(stem, '_') AS p FROM stems), q AS (SELECT *, len(p) >= 3 AND regexp_matches(p[-1], '^\\d{{14}}$') AS dated FROM p)
        SELECT o_orderkey, CASE WHEN {fits(A)} THEN {x(A, 1)} END AS caller, CASE WHEN {fits(A)} THEN {x(A, 2)} END AS caller_phone, CASE WHEN dated THEN array_to_string(p[1:len(p) - 2], '_') ELSE 'Unknown' END AS counterparty,
        CASE WHEN dated AND regexp_matches(p[-2], '^\\d{{10,}}$') THEN p[-2] ELSE '' END AS phone,
        CASE WHEN dated THEN substr(p[-1], 1, 4) || '-' || substr(p[-1], 5, 2) || '-' || substr(p[-1], 7, 2) || ' ' || substr(p[-1], 9, 2) || ':' || substr(p[-1], 11, 2) END AS called_at FROM q"""),
    "speaker_resolver_names": (resolver, sql(f"""nullif({x('(0(?:1[0-6789]|10)' + chr(92) + 'd{7,8})', 1)}, '') AS phone, CASE WHEN {fits(H)} THEN {x(H, 1)} WHEN {fits(M)} AND NOT regexp_matches({x(M, 1)}, '^\\d{{8}}_\\d{{4}}$') THEN {x(M, 1)} END AS counterparty""")),
    "retry_backoff": (backoffs, "SELECT event_id, strftime(ts + to_minutes(cast(least(1440, 15 * pow(2, greatest(0, event_id % 12 - 1))) AS bigint)), '%Y-%m-%d %H:%M:%S') AS next_retry_at FROM events"),
    "chunk_offsets": (chunks, "SELECT doc_id, unnest(range(0, n_chars, 300))::int AS start FROM documents WHERE n_chars > 0"),
    "clock_and_rtf": (clocks, "SELECT * FROM (VALUES (1, 3723.5::double, 372.35::double), (2, 7.0, 0.0), (3, NULL, 0.0), (4, 7384.25, 0.0)) AS t(id, seconds, factor)"),
    "notice_time": (notices, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr('some day next week ' || event_type, 1, 16) ELSE strftime(ts, '%-m/%-d %H:%M') END AS notice FROM events"),
    "file_names": (slugs, """SELECT page_id, trim(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g')) AS file_name, substr(regexp_replace(trim(url), '[^\\w.-]', '_', 'g'), 1, 80) AS slug,
        CASE WHEN regexp_matches(b, '^.+\\.[^.]+$') THEN regexp_extract(b, '^(.+)\\.[^.]+$', 1) ELSE b END AS stem FROM (SELECT *, regexp_extract(replace(url, '\\', '/'), '([^/]*)/*$', 1) AS b FROM pages)"""),
}
