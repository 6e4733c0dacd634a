"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions import text as tx
from corvane.functions.lexicon import ScoreLexicon
from corvane.session import rows, spread, table



def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: Words that occur in the driver's tables; the default lexicon is for business calls.
LEXICON = ScoreLexicon(keywords=("the", "and", "que", "der", "les", "con"), products=("fan", "motor", "tion"), interactions=("when", "where", "how", "idiot"))


def score_sql(lexicon: ScoreLexicon) -> str:
    n = "len(w)"
    found = " + ".join(
        [f"len(regexp_extract_all(text, {quoted(lexicon.phone)}))", f"len(regexp_extract_all(text, {quoted(lexicon.amount)}))"]
        + [f"len(regexp_extract_all(text, '{p}'))" for p in lexicon.products]
    )
    asked = " + ".join(f"cast(regexp_matches(text, '{p}') AS int)" for p in lexicon.interactions)
    return f"""
        WITH w AS (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT *, round_even(least({n} / 200.0::double, 1), 4) AS token_count,
                round_even(len(list_distinct(w)) / greatest({n}, 1)::double, 4) AS unique_words,
                CASE WHEN {n} > 0 THEN round_even(least(({found})::double / {n} / 0.01::double, 1), 4) ELSE 0 END AS entity_density,
                round_even(least((SELECT sum(cast(contains(text, k) AS int)) FROM (SELECT unnest({sql_list(lexicon.keywords)}) AS k)) / 5.0::double, 1), 4) AS keyword_signal,
                round_even(least(({asked}) / 3.0::double, 1), 4) AS interaction FROM w),
        t AS (SELECT *, round_even((token_count + unique_words + entity_density * 1.5::double + keyword_signal * 2.0::double + interaction * 3.0::double) / 8.5::double, 4) AS score FROM s)
    """


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tx.fast_score(F.col("text"), LEXICON)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.array(s)).alias("s")).select("doc_id", "s.score", "s.band", "s.should_process", "s.signals.*")


def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and band. Scores have four places, so they are summed as integers: in any order the mean is the same."""
    out = spread(table(spark, sf_dir, "documents")).select("lang", F.explode(F.array(tx.fast_score(F.col("text"), LEXICON))).alias("s"))
    return out.groupBy("lang", F.col("s.band").alias("band")).agg(F.count(F.lit(1)).alias("documents"), F.bround(F.sum(F.round(F.col("s.score") * 10_000).cast("long")) / (F.count(F.lit(1)) * 10_000), 6).alias("mean_score"))


def default_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.array(tx.fast_score(F.col("text")))).alias("s"))
    r = F.col("s.drop_reason")
    return out.select("doc_id", "s.score", "s.band", *[F.coalesce(r.contains(k), F.lit(False)).alias(k) for k in ("no_entities", "no_keywords", "no_interaction")])


BAND_SQL = "CASE WHEN score >= 0.85 THEN 'definite_keep' WHEN score <= 0.15 THEN 'definite_drop' ELSE 'borderline' END"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(tx.detect_entities(F.col("text"))).alias("e"))
    return found.groupBy("doc_id", F.col("e.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("names"), F.min("e.name").alias("first_name"), F.max("e.name").alias("last_name"))


KOREAN = (
    (1, "아이디어는: 새 송풍기 케이스를 만들자. 그리고 주문 500개"),
    (2, "주식회사 한빛 그리고 Acme산업 견적 010-1234-5678 1,500만원"),
    (3, "만약 가격이 오르면 발주를 늘리자고 했습니다."),
    (4, "The Idea: use fewer vendors next year. hypothesis short."),
    (5, "네"),
    (6, "새로운 방법은 택배 대신 직접 배송이다"),
    (7, " ok "),
    (8, ""),
)
KOREAN_SQL = "(VALUES " + ", ".join(f"({i}, {quoted(t)})" for i, t in KOREAN) + ") AS k(id, text)"


def ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows(spark, "id int, text string", *KOREAN).select("id", F.posexplode(tx.detect_ideas(F.col("text"))).alias("pos", "i"))
    return found.select("id", "i.content")


def operational(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return texts.select("conv_id", "turn", tx.is_operational(F.col("text"), lexicon=LEXICON).alias("operational"))


def signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be appended to the event log."""
    s = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.array(tx.detect_signals(F.col("text"), LEXICON))).alias("s")).filter("s.logged")
    return s.select("doc_id", F.size("s.ideas").alias("ideas"), F.size("s.entities").alias("entities"), F.col("s.fast_score.score").alias("score"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spread(table(spark, sf_dir, "documents")).select("doc_id", F.col("text"), F.explode(F.array(tx.redact(F.col("text")))).alias("safe")).filter("safe <> text")
    return out.select("doc_id", F.md5("safe").alias("safe_md5"), F.regexp_count("safe", F.lit(r"\*\*\*@")).alias("emails"))


def redact_sql(text: str) -> str:
    """Without lookaround: a phone's neighbours are consumed and put back."""
    phone = "(^|[^0-9])(?:" + "|".join(lx.PHONE_FORMS) + ")($|[^0-9])"
    out = text
    for pattern, by in (
        (lx.BEARER, r"\1[REDACTED_BEARER]"), (phone, r"\1[REDACTED_PHONE]\2"), (lx.EMAIL, r"\1***\3"), (lx.TOKEN, "[REDACTED_TOKEN]"),
        (lx.SECRET, r"\1=[REDACTED]"), (lx.USER_PATH, "[REDACTED_PATH]"),
    ):
        out = f"regexp_replace({out}, {quoted(pattern)}, '{by}', 'g')"
    return out


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tx.compress(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.length(c).alias("chars"), F.md5(c).alias("md5"))


def compress_sql() -> str:
    out = "text"
    for pattern, by in lx.NOISE:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
    out = f"array_to_string(list_transform(string_split({out}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10))"
    return f"SELECT doc_id, length(c) AS chars, md5(c) AS md5 FROM (SELECT doc_id, substr(regexp_replace({out}, '^\\s+|\\s+$', '', 'g'), 1, {lx.BUDGET_CHARS}) AS c FROM documents)"


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tx.fallback_summary(F.col("text"), LEXICON.keywords)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", f["one_line"].alias("one_line"), f["details"][0].alias("detail"))


def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To-do keys of conversation turns as titles, customers' recordings as sources."""
    c = table(spark, sf_dir, "conversations")
    source = F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.when(F.col("turn") % 3 == 0, ".m4a").when(F.col("turn") % 3 == 1, ".txt").otherwise(".m4a.txt"))
    return c.select("conv_id", "turn", tx.todo_key(F.col("text"), source).alias("key"))


def role_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram similarity of each whole turn to the next of its conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.bround(tx.bigram_similarity(F.col("text"), F.col("next")), 6).alias("similarity"))


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last characters of documents, masked, and what an error report would say of them."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.array(F.concat("text", F.lit("\r\nfailed for a.person@example.com\n")))).alias("text"))
    return d.select("doc_id", F.md5(tx.redact(F.col("text"), 200)).alias("tail_md5"), tx.error_report((F.col("doc_id") % 3).cast("int"), F.lit(""), F.col("text")).alias("summary"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, "id int, code int, stderr string, stdout string", (1, 1, "Trace\n  at x\nto a.person@example.com\r\n", "out"), (2, 2, "", "done\nlast " + "y" * 600), (3, -9, None, None), (4, 1, " \n", "from stdout"))
    return r.select("id", tx.error_report(F.col("code"), F.col("stderr"), F.col("stdout")).alias("summary"))


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.md5("text").alias("file_md5"), tx.queue_id(F.concat(F.lit("stem"), F.col("doc_id").cast("string")), F.col("lang"), F.col("source")).alias("queue_id"))


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    digits = F.concat(F.lit("010"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    cut = F.when(F.col("c_custkey") % 3 == 0, F.substring(digits, 1, 10)).when(F.col("c_custkey") % 3 == 1, digits).otherwise(F.substring(digits, 1, 7))
    return c.select("c_custkey", tx.phone_display(cut).alias("phone"))


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.md5(tx.wrap_untrusted(F.col("source"), F.col("text"))).alias("md5"))


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).select("lang", tx.hits(F.col("text"), LEXICON.keywords).alias("hits"))
    return d.groupBy("lang", "hits").agg(F.count(F.lit(1)).alias("documents"))


HITS_SQL = " + ".join(f"cast(contains(text, '{k}') AS int)" for k in LEXICON.keywords)
STRIP_SQL = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
IDEA_SQL = " UNION ALL ".join(
    f"SELECT id, unnest(regexp_extract_all(text, {quoted('(?i)' + p)}, 1)) AS content FROM {KOREAN_SQL}" for p in lx.IDEA_PATTERNS
)
ENTITY_SQL = f"""
    SELECT doc_id, 'company' AS entity_type, unnest(list_distinct(regexp_extract_all(text, {quoted(lx.COMPANY_PATTERN)}))) AS name FROM documents
    UNION ALL SELECT doc_id, 'product', unnest(list_distinct(regexp_extract_all(text, {quoted(lx.PRODUCT_PATTERN)}))) FROM documents"""
BIGRAM_SQL = "list_distinct(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)))"

QUERIES = {
    "fast_score": (scored, score_sql(LEXICON) + f"SELECT doc_id, score, {BAND_SQL} AS band, score > 0.15 AS should_process, token_count, unique_words, entity_density, keyword_signal, interaction FROM t"),
    "score_bands": (score_bands, score_sql(LEXICON) + f"SELECT lang, {BAND_SQL} AS band, count(*) AS documents, round_even(sum(cast(round(score * 10000) AS bigint))::double / (count(*) * 10000), 6) AS mean_score FROM t GROUP BY ALL"),
    "fast_score_default_lexicon": (default_score, score_sql(ScoreLexicon()) + f"""SELECT doc_id, score, {BAND_SQL} AS band, score <= 0.15 AND entity_density = 0 AS no_entities,
        score <= 0.15 AND keyword_signal = 0 AS no_keywords, score <= 0.15 AND interaction = 0 AS no_interaction FROM t"""),
    "entity_detect": (entities, f"SELECT doc_id, entity_type, count(*) AS names, min(name) AS first_name, max(name) AS last_name FROM ({ENTITY_SQL}) WHERE length(name) >= 2 GROUP BY ALL"),
    "idea_detect": (ideas, f"SELECT id, {STRIP_SQL.format('content')} AS content FROM ({IDEA_SQL}) WHERE length({STRIP_SQL.format('content')}) > 5"),
    "operational_messages": (operational, score_sql(LEXICON).replace("FROM documents", "FROM conversations") + f"""SELECT conv_id, turn, length({STRIP_SQL.format('text')}) < 5
        OR lower({STRIP_SQL.format('text')}) IN ({sql_list(lx.OPERATIONAL_MESSAGES)[1:-1]}) OR score <= 0.15 AS operational FROM t"""),
    "signal_log": (signal_log, score_sql(LEXICON) + f""", e AS (SELECT doc_id, count(*) AS n FROM ({ENTITY_SQL}) WHERE length(name) >= 2 GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted('(?i)' + p)}, 1)) AS c FROM documents" for p in lx.IDEA_PATTERNS)}) WHERE length({STRIP_SQL.format('c')}) > 5 GROUP BY doc_id)
        SELECT doc_id, coalesce(i.n, 0) AS ideas, coalesce(e.n, 0) AS entities, score FROM t LEFT JOIN e USING (doc_id) LEFT JOIN i USING (doc_id)
        WHERE coalesce(i.n, 0) + coalesce(e.n, 0) > 0 AND NOT (length({STRIP_SQL.format('text')}) < 5 OR lower({STRIP_SQL.format('text')}) IN ({sql_list(lx.OPERATIONAL_MESSAGES)[1:-1]}) OR score <= 0.15)"""),
    "redaction": (redacted, f"SELECT doc_id, md5(safe) AS safe_md5, len(regexp_extract_all(safe, '\\*\\*\\*@')) AS emails FROM (SELECT doc_id, text, {redact_sql('text')} AS safe FROM documents) WHERE safe <> text"),
    "compress_transcript": (compressed, compress_sql()),
    "fallback_summary": (fallback, f"""SELECT doc_id, coalesce(substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP_SQL.format('x')}), lambda x: length(x) > 10)[1], 1, 100), '{lx.FALLBACK_LINE}') AS one_line,
        replace('{lx.FALLBACK_DETAIL}', '%d', cast({HITS_SQL} AS varchar)) AS detail FROM documents"""),
    "todo_keys": (title_keys, f"""SELECT conv_id, turn, substr(replace(replace(lower({STRIP_SQL.format('text')}), ' ', ''), '_', ''), 1, 100) || '|call_' || conv_id || CASE WHEN turn % 3 = 2 THEN '.m4a' ELSE '' END AS key FROM conversations"""),
    "bigram_similarity": (role_similarity, f"""WITH c AS (SELECT conv_id, turn, lower(replace(text, ' ', '')) AS s FROM conversations),
        b AS (SELECT conv_id, turn, {BIGRAM_SQL.format('s')} AS g FROM c)
        SELECT a.conv_id, a.turn, round_even(CASE WHEN len(a.g) = 0 OR len(b.g) = 0 THEN 0 ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::double END, 6) AS similarity
        FROM b AS a JOIN b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"""),
    "redacted_tails": (tails, f"""WITH t AS (SELECT doc_id, {redact_sql("(text || chr(13) || chr(10) || 'failed for a.person@example.com' || chr(10))")} AS safe FROM documents) SELECT doc_id, md5(right(safe, 200)) AS tail_md5, 'exit ' || (doc_id % 3) || ': failed for a***@example.com' AS summary FROM t"""),
    "error_summaries": (summaries, "SELECT * FROM (VALUES (1, 'exit 1: to a***@example.com'), (2, 'exit 2: last ' || repeat('y', 487)), (3, 'exit -9: no output'), (4, 'exit 1: no output')) AS t(id, summary)"),
    "digests": (digests, "SELECT doc_id, md5(text) AS file_md5, 'rq_' || left(sha256('stem' || doc_id || chr(0) || lang || chr(0) || source), 16) AS queue_id FROM documents"),
    "phone_display": (phones, """WITH d AS (SELECT c_custkey, '010' || lpad(cast(c_custkey AS varchar), 8, '0') AS d FROM customer)
        SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7, 4) WHEN 1 THEN substr(d, 1, 3) || '-' || substr(d, 4, 4) || '-' || substr(d, 8, 4) ELSE substr(d, 1, 7) END AS phone FROM d"""),
    "wrap_untrusted": (wrapped, f"SELECT doc_id, md5({quoted(lx.UNTRUSTED_HEADER)} || chr(10) || 'Source: ' || source || chr(10) || chr(10) || '<<<UNTRUSTED_SOURCE_DATA>>>' || chr(10) || text || chr(10) || '<<<END_UNTRUSTED_SOURCE_DATA>>>') AS md5 FROM documents"),
    "keyword_hits": (keyword_hits, f"SELECT lang, {HITS_SQL} AS hits, count(*) AS documents FROM documents GROUP BY ALL"),
}
