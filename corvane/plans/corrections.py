"""Queries of correction rules and of extraction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import corrections as cx
from corvane.functions import extraction as ex
from corvane.operators import feedback, rulebook
from corvane.session import rows, spread, table

EXACT = (cx.Exact("the", "THE"), cx.Exact("THE and", "T&A"), cx.Exact(" que ", " q "), cx.Exact("off", "on", enabled=False), cx.Exact("", "x"), cx.Exact(" der ", " der "))


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cx.corrected(F.col("text"), EXACT, ())
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", c.alias("c"))
    return d.select("doc_id", F.md5("c.text").alias("md5"), F.size("c.changes").alias("rules_hit"), F.aggregate("c.changes", F.lit(0), lambda a, x: a + x["count"]).alias("changes"))


ALIASES = (cx.Alias("Kim & Co", ("kim", "kim co", "Kim & Co", "kim")), cx.Alias("팬", ("환풍기",)), cx.Alias("off", ("on",), enabled=False))
ALIAS_TEXTS = ((1, "kim co, kim; kims akim kim-co 환풍기 환풍기가"), (2, "no match"), (3, "kim"), (4, "(kim co)kim"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cx.corrected(F.col("text"), (), ALIASES)
    r = rows(spark, "id int, text string", *ALIAS_TEXTS).select("id", c.alias("c"))
    return r.select("id", F.col("c.text").alias("text"), F.array_join(F.transform("c.changes", lambda x: F.concat_ws(":", x["from"], x["to"], x["count"].cast("string"))), "|").alias("changes"))


TERMS = {"the": "THE", "and": "AND", "que": "QUE", "of THE": "of-the"}


def quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(cx.correct(F.col("text"), "llm", TERMS)).alias("md5"), F.md5(cx.correct(F.col("text"), "none")).alias("same"))


def quick_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, "id int, text string", (1, "리엑트 컴포넌트 만들어야"), (2, "새리엑트 뷰, 노드. 도커"), (3, "서버서버 서버 서버"), (4, "no hangul"))
    return r.select("id", cx.quick_fix(F.col("text")).alias("text"))


def quick_sql() -> str:
    """No lookaround: a term's left neighbour is put back, and its right one is left in place by doubling it first."""
    out = "' ' || regexp_replace(text, '([\\s,.!?])', '\\1\\1', 'g') || ' '"
    for old, new in TERMS.items():
        out = f"regexp_replace({out}, '([\\s,.!?])({old.replace(' ', '  ')})([\\s,.!?])', '\\1{new.replace(' ', '  ')}\\3', 'g')"
    return out


# ── rules in tables ──

def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after rules that the benchmark's texts give: exact ones, whose words meet each other, and aliases."""
    b = table(spark, sf_dir, "benchmark")
    w = lambda k: F.regexp_replace(F.split_part("text", F.lit(" "), F.lit(k)), "[^0-9A-Za-z]", "")
    exact = b.select(F.col("item_id").alias("pos"), w(1).alias("from"), w(2).alias("to"), F.concat(F.lit("n"), "item_id").alias("note"), (F.col("item_id") % 5 != 0).alias("enabled"))
    alias = b.select(F.col("item_id").alias("pos"), F.upper(w(3)).alias("canonical"), F.array(w(4), w(5), w(6)).alias("variants"), F.concat(F.lit("c"), "item_id").alias("category"), F.lit(True).alias("enabled"))
    fix = rulebook.corrector(rulebook.exact_steps(exact), rulebook.alias_steps(alias))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.array(fix(F.col("text")))).alias("c"))
    fired = F.array_join(F.transform("c.changes", lambda x: F.coalesce(x["note"], x["category"])), ";")
    return d.select("doc_id", F.md5("c.text").alias("md5"), fired.alias("fired"))


def rule_table_sql() -> str:
    """Each rule in turn. For aliases whatever is no word character is there twice, so that one of the two can be taken by a match."""
    w = lambda k: f"regexp_replace(split_part(text, ' ', {k}), '[^0-9A-Za-z]', '', 'g')"
    no = f"[^{cx.WORD}]"
    fold = "list_reduce(r, lambda a, x: {{'f': '', 'o': '', 'k': '', 't': {0}, 'n': CASE WHEN {0} <> a.t THEN a.n || x.k || ';' ELSE a.n END}}, {{'f': '', 'o': '', 'k': '', 't': {1}, 'n': ''}})"
    one = "replace(a.t, x.f, x.o)"
    two = f"regexp_replace(a.t, '({no})' || x.f || '({no})', '\\1' || x.o || '\\2', 'g')"
    return f"""WITH e AS (SELECT coalesce(list({{'f': f, 'o': o, 'k': 'n' || item_id, 't': '', 'n': ''}} ORDER BY item_id), []) AS r FROM (SELECT item_id, {w(1)} AS f, {w(2)} AS o FROM benchmark WHERE item_id % 5 <> 0) WHERE f <> '' AND f <> o),
        v AS (SELECT item_id, c, unnest([a, b, d]) AS f, unnest([1, 2, 3]) AS p FROM (SELECT item_id, upper({w(3)}) AS c, {w(4)} AS a, {w(5)} AS b, {w(6)} AS d FROM benchmark)),
        s AS (SELECT item_id, c, f, min(p) AS p FROM v WHERE c <> '' AND f <> '' AND f <> c GROUP BY ALL),
        l AS (SELECT list({{'f': f, 'o': c, 'k': 'c' || item_id, 't': '', 'n': ''}} ORDER BY item_id, length(f) DESC, p) AS r FROM s),
        x AS MATERIALIZED (SELECT doc_id, {fold.format(one, 'text')} AS q FROM documents, e),
        y AS MATERIALIZED (SELECT doc_id, q.n AS n, {fold.format(two, f"' ' || regexp_replace(q.t, '({no})', '\\1\\1', 'g') || ' '")} AS b FROM x, l)
        SELECT doc_id, md5(regexp_replace(substr(b.t, 2, length(b.t) - 2), '({no}){no}', '\\1', 'g')) AS md5, rtrim(n || b.n, ';') AS fired FROM y"""


SPOKEN = {" the ": " 리엑트 ", " and ": " 도커, ", " of ": " 노드! ", " de ": " 디비 ", " que ": " 파이썬.", " der ": " 뷰\n"}


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with spoken terms in them after the whole dictionary."""
    text = F.col("text")
    for old, new in SPOKEN.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    fix = rulebook.corrector(rulebook.term_steps(spark))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.array(fix(text))).alias("c"))
    return d.select("doc_id", F.md5("c.text").alias("md5"), F.size("c.changes").alias("terms"))


def dictionary_sql() -> str:
    text = "text"
    for old, new in SPOKEN.items():
        text = f"replace({text}, '{old}', '{new}')"
    terms = ", ".join(f"{{'f': '{a}', 'o': '{b}', 't': '', 'n': 0}}" for a, b in cx.SPOKEN_TERMS.items())
    now = "regexp_replace(a.t, '([\\s,.!?])' || x.f || '([\\s,.!?])', '\\1' || x.o || '\\2', 'g')"
    return f"""WITH d AS (SELECT doc_id, list_reduce([{terms}], lambda a, x: {{'f': '', 'o': '', 't': {now}, 'n': a.n + CASE WHEN {now} <> a.t THEN 1 ELSE 0 END}}, {{'f': '', 'o': '', 't': ' ' || regexp_replace({text}, '([\\s,.!?])', '\\1\\1', 'g') || ' ', 'n': 0}}) AS a FROM documents)
        SELECT doc_id, md5(regexp_replace(substr(a.t, 2, length(a.t) - 2), '([\\s,.!?])[\\s,.!?]', '\\1', 'g')) AS md5, a.n AS terms FROM d"""


# ── suggestions from what models corrected ──

SEEN_SQL = "SELECT event_id AS seq, event_type AS original, 'w' || (event_id % 40) AS corrected, cast(user_id AS varchar) AS source, 'alias' AS reason FROM events"


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS seq", "event_type AS original", "concat('w', event_id % 40) AS corrected", "cast(user_id AS string) AS source", "'alias' AS reason")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = feedback.suggestions(sightings(spark, sf_dir))
    return s.select("original", "corrected", "count", "first_seen", "last_seen", F.array_join("sources", ",").alias("sources"))


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = rows(spark, "old string, enabled boolean", ("view", True))
    return feedback.promotions(sightings(spark, sf_dir), known)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sort_array(F.collect_set((F.col("user_id") % 7).cast("string"))).alias("a"), F.sort_array(F.collect_set((F.col("user_id") % 11).cast("string"))).alias("b"))
    return e.select("event_type", F.array_join(F.sort_array(cx.merged_variants(F.lit("3"), F.col("a"), F.col("b"))), ",").alias("variants"))


# ── extraction records ──

def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, response: JSON of six shapes, some of it fenced, wrapped in prose, broken or with bad numbers."""
    k = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 6
    body = F.concat(
        F.lit('{"summary":{"one_line":"call '), k, F.lit('","details":["a","",null,"b"],"overall_confidence":0.5},"todos":[{"title":" T'), k,
        F.lit('","owner":"'), F.when(F.col("doc_id") % 4 == 0, "me").otherwise("boss"), F.lit('","priority":"'), F.when(F.col("doc_id") % 3 == 0, "high").otherwise("urgent"),
        F.lit('","due_date":"","confidence":'), F.when(m == 4, '"bad"').otherwise("0.25"), F.lit('},{"title":""},"x"],"money":[{"amount":"'), k, F.lit('"},{"amount":"many","kind":"price"},{"amount":12.7}],'
        '"products":[{"name":"fan","quantity":{"value":'), k, F.lit('},"action":"order"}],"entities":[{"name":"E","type":"Alien","attributes":{"a":1}}],"risks":[{"description":true}],"corrections":[{"original":"a"}]}'),
    )
    text = F.when(m == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).when(m == 3, F.concat(F.lit("broken {"), k)).otherwise(body)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.alias("response"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses(spark, sf_dir).select("doc_id", F.explode(F.array(ex.extraction_record(F.col("response")))).alias("r"))


def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select(
        "doc_id", "r.parse_error", "r.invalid_number", "r.summary.one_line", F.array_join("r.summary.details", "|").alias("details"), "r.summary.call_type",
        F.size("r.todos").alias("todos"), F.get("r.todos", F.lit(0))["title"].alias("title"), F.get("r.todos", F.lit(0))["owner"].alias("owner"), F.get("r.todos", F.lit(0))["priority"].alias("priority"),
        F.get("r.todos", F.lit(0))["due_date"].alias("due_date"), F.array_join(F.transform("r.money", lambda x: x["amount"].cast("string")), "|").alias("amounts"),
        F.get("r.products", F.lit(0))["quantity"]["value"].alias("quantity"), F.get("r.entities", F.lit(0))["type"].alias("entity_type"), F.get("r.risks", F.lit(0))["description"].alias("risk"),
        F.size("r.corrections").alias("corrections"), "r.raw",
    )


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run extracted, over records that are valid."""
    r = records(spark, sf_dir).filter("not r.parse_error and not r.invalid_number")
    return r.agg(F.count_if(F.col("r.summary.one_line") != "").alias("summaries"), *[F.sum(F.size(f"r.{k}")).alias(k) for k in ("todos", "money", "products", "entities", "risks", "corrections")])


def my_todos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each to-do that is mine, with its document."""
    t = records(spark, sf_dir).filter("not r.parse_error and not r.invalid_number").select("doc_id", F.explode("r.todos").alias("t"))
    return t.filter("t.owner = 'me' and t.title <> ''").select("doc_id", "t.title", "t.priority", "t.status")


def client_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of six dialects as a client reads them."""
    k, m = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    body = F.concat(F.lit('{"a":{"id":'), k, F.lit('},"b":[1,2]}'))
    text = (
        F.when(m == 0, body).when(m == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(m == 2, F.concat(F.lit(" ```"), body, F.lit("```\n\n")))
        .when(m == 3, F.concat(F.lit("Here is {it}: "), body)).when(m == 4, F.concat(F.lit("so\n"), body, F.lit("\nmore"))).otherwise("```json\n```")
    )
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(F.array(ex.client_object(text))).alias("v"))
    return d.select("doc_id", F.try_variant_get("v", "$.a.id", "bigint").alias("id"), F.col("v").isNull().alias("none"))


def client_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(
        spark, "id int, response string",
        (1, "```json```{}"), (2, "```{\"a\":1}"), (3, "``````"), (4, "[1, 2]"), (5, "x {\"a\":{\"b\":1}, \"c\":2} y"), (6, "}{"), (7, "  \n "), (8, None), (9, "이것은 JSON이 아닙니다"), (10, "```\n{\"a\":\"```\"}\n```"),
    )
    return r.select("id", F.to_json(ex.client_object(F.col("response"))).alias("object"))


OK = "doc_id % 6 <> 3"
VALID = "doc_id % 6 NOT IN (3, 4)"
QUERIES = {
    "exact_corrections": (exact, """WITH a AS (SELECT doc_id, text, replace(text, 'the', 'THE') AS t1, replace(replace(text, 'the', 'THE'), 'THE and', 'T&A') AS t2 FROM documents),
        n AS (SELECT doc_id, replace(t2, 'que', 'q') AS t3, (length(text) - length(replace(text, 'the', ''))) // 3 AS a, (length(t1) - length(replace(t1, 'THE and', ''))) // 7 AS b, (length(t2) - length(replace(t2, 'que', ''))) // 3 AS c FROM a)
        SELECT doc_id, md5(t3) AS md5, cast(a > 0 AS int) + cast(b > 0 AS int) + cast(c > 0 AS int) AS rules_hit, a + b + c AS changes FROM n"""),
    "alias_corrections": (aliases, """SELECT * FROM (VALUES (1, 'Kim & Co, Kim & Co; kims akim Kim & Co-co 팬 환풍기가', 'kim co:Kim & Co:1|kim:Kim & Co:2|환풍기:팬:1'), (2, 'no match', ''), (3, 'Kim & Co', 'kim:Kim & Co:1'), (4, '(Kim & Co)Kim & Co', 'kim co:Kim & Co:1|kim:Kim & Co:1')) AS t(id, text, changes)"""),
    "quick_fix": (quick, f"SELECT doc_id, md5(substr(r, 2, length(r) - 2)) AS md5, md5(text) AS same FROM (SELECT doc_id, text, ' ' || regexp_replace(substr(q, 2, length(q) - 2), '([\\s,.!?])([\\s,.!?])', '\\1', 'g') || ' ' AS r FROM (SELECT doc_id, text, {quick_sql()} AS q FROM documents))"),
    "quick_fix_korean": (quick_korean, "SELECT * FROM (VALUES (1, 'React component 만들어야'), (2, '새리엑트 Vue, Node. Docker'), (3, '서버서버 server server'), (4, 'no hangul')) AS t(id, text)"),
    "rule_table": (rule_table, rule_table_sql()),
    "quick_fix_dictionary": (dictionary, dictionary_sql()),
    "correction_suggestions": (suggestions, f"""WITH s AS ({SEEN_SQL}), g AS (SELECT original, corrected, count(*) AS count, min(seq) AS first_seen, max(seq) AS last_seen FROM s GROUP BY ALL),
        f AS (SELECT original, corrected, source, min(seq) AS seq FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY original, corrected ORDER BY seq DESC) AS k FROM f)
        SELECT g.*, (SELECT string_agg(source, ',' ORDER BY seq) FROM r WHERE r.original = g.original AND r.corrected = g.corrected AND k <= 20) AS sources FROM g"""),
    "correction_promotions": (promotions, f"""WITH s AS ({SEEN_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY original, corrected ORDER BY seq) AS k FROM s), t AS (SELECT * FROM r WHERE k = 3 AND original <> 'view')
        SELECT original, corrected, seq AS promoted_at, 'auto-promoted (' || reason || ')' AS note, false AS enabled FROM (SELECT *, row_number() OVER (PARTITION BY original ORDER BY seq) AS n FROM t) WHERE n = 1"""),
    "alias_variants": (variants, "SELECT event_type, string_agg(DISTINCT v, ',' ORDER BY v) AS variants FROM (SELECT event_type, cast(user_id % 7 AS varchar) AS v FROM events UNION SELECT event_type, cast(user_id % 11 AS varchar) FROM events) WHERE v <> '3' GROUP BY 1"),
    "client_responses": (client_objects, "SELECT doc_id, CASE WHEN doc_id % 6 NOT IN (3, 5) THEN doc_id END AS id, doc_id % 6 IN (3, 5) AS none FROM documents"),
    "client_dialects": (client_fixture, """SELECT * FROM (VALUES (1, '{}'), (2, '{"a":1}'), (3, NULL), (4, '[1,2]'), (5, '{"a":{"b":1},"c":2}'), (6, NULL), (7, NULL), (8, NULL), (9, NULL), (10, '{"a":"```"}')) AS t(id, object)"""),
    "extraction_run_totals": (run_totals, f"SELECT count(*) AS summaries, count(*) AS todos, 3 * count(*) AS money, count(*) AS products, count(*) AS entities, count(*) AS risks, 0 AS corrections FROM documents WHERE {VALID}"),
    "my_todos": (my_todos, f"SELECT doc_id, 'T' || doc_id AS title, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END AS priority, 'new' AS status FROM documents WHERE {VALID} AND doc_id % 4 = 0"),
}
QUERIES["extraction_records"] = (extraction, f"""
    SELECT doc_id, NOT ({OK}) AS parse_error, doc_id % 6 = 4 AS invalid_number, CASE WHEN {OK} THEN 'call ' || doc_id END AS one_line, CASE WHEN {OK} THEN 'a|b' END AS details,
        CASE WHEN {OK} THEN 'unknown' END AS call_type, CASE WHEN {OK} THEN 1 ELSE 0 END AS todos, CASE WHEN {OK} THEN 'T' || doc_id END AS title,
        CASE WHEN {OK} THEN CASE WHEN doc_id % 4 = 0 THEN 'me' ELSE 'unknown' END END AS owner, CASE WHEN {OK} THEN CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END END AS priority,
        cast(NULL AS varchar) AS due_date, CASE WHEN {OK} THEN doc_id || '|0|12' ELSE '' END AS amounts, CASE WHEN {OK} THEN doc_id END AS quantity, CASE WHEN {OK} THEN 'Other' END AS entity_type,
        CASE WHEN {OK} THEN 'True' END AS risk, 0 AS corrections, CASE WHEN NOT ({OK}) THEN 'broken {{' || doc_id END AS raw FROM documents""")
