"""Queries of the to-do store and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import bigram_similarity, bigrams
from corvane.operators import graph, todo
from corvane.plans.names import BASE, CTX, STEMS, fits, iso, stems, x
from corvane.session import rows, table


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, title, source: names and types of parts."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("long").alias("seq"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.concat(F.lit("s"), (F.col("p_size") % 9).cast("string"), F.lit(".m4a")).alias("source"))


TITLES = "titles AS MATERIALIZED (SELECT p_partkey::bigint AS seq, p_name || ' ' || p_type AS title, 's' || (p_size % 9) || '.m4a' AS source FROM part)"
STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
NORM = "substr(replace(replace(lower(" + STRIP + "), ' ', ''), '_', ''), 1, 100)"
GRAMS = "list_distinct(list_transform(range(1, greatest(length(replace({0}, ' ', '')), 1)), lambda i: lower(substr(replace({0}, ' ', ''), i, 2))))"
DONE = f"done AS MATERIALIZED (SELECT DISTINCT {NORM.format('p_name')} AS t FROM part WHERE p_brand = 'Brand#22')"
STORE = "store AS MATERIALIZED (SELECT p_partkey::bigint AS seq, p_name || ' ' || p_type AS title, 'b' AS source, 'b|' || p_partkey AS key FROM part WHERE p_brand = 'Brand#7' AND p_size < 9)"
SIM = "(len(list_intersect({0}, {1})) / greatest(len({0}) + len({1}) - len(list_intersect({0}, {1})), 1)::double)"


#: Greedy merging in order, as a recursion: row i of a source against the list of what is kept.
MERGED = f"""w AS MATERIALIZED (SELECT seq, title, source, {GRAMS.format('title')} AS g, row_number() OVER (PARTITION BY source ORDER BY seq) AS i FROM titles),
    steps AS (SELECT DISTINCT source, 0::bigint AS i, []::STRUCT(seq BIGINT, title VARCHAR, g VARCHAR[], place BIGINT)[] AS kept FROM w
        UNION ALL SELECT source, i, CASE WHEN hit IS NULL THEN list_append(kept, {{'seq': seq, 'title': title, 'g': g, 'place': seq}})
            WHEN length(title) > length(kept[hit].title) THEN list_concat(list_append(kept[:hit - 1], {{'seq': seq, 'title': title, 'g': g, 'place': kept[hit].place}}), kept[hit + 1:]) ELSE kept END
        FROM (SELECT w.*, kept, nullif(list_position(list_transform(kept, lambda k: len(k.g) > 0 AND len(w.g) > 0 AND {SIM.format('k.g', 'w.g')} >= 0.55), true), 0) AS hit FROM steps JOIN w ON steps.source = w.source AND w.i = steps.i + 1)),
    merged AS MATERIALIZED (SELECT k.seq, k.place FROM (SELECT unnest(kept) AS k FROM (SELECT kept, row_number() OVER (PARTITION BY source ORDER BY i DESC) AS n FROM steps) WHERE n = 1))"""


def known(store: str) -> str:
    """The bigrams of the store's titles."""
    return f"known AS MATERIALIZED (SELECT DISTINCT {GRAMS.format('title')} AS g FROM {store})"


def accepted(new: str) -> str:
    """Rows of new that resemble nothing that is completed or known, and, in order, nothing accepted before."""
    return f"""candidates AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM (SELECT seq, title, replace(source, '.m4a', '') AS source, {GRAMS.format('title')} AS g, {NORM.format('title')} AS t FROM {new})
            WHERE t NOT IN (SELECT x.t FROM (SELECT DISTINCT {NORM.format('title')} AS t FROM {new}) AS x, done WHERE x.t = done.t OR {SIM.format(GRAMS.format('x.t'), GRAMS.format('done.t'))} >= 0.45)
            AND title NOT IN (SELECT y.title FROM (SELECT DISTINCT title FROM {new}) AS y, known WHERE {SIM.format(GRAMS.format('y.title'), 'known.g')} >= 0.55)),
        taken AS (SELECT 0::bigint AS i, []::BIGINT[] AS seqs, []::VARCHAR[][] AS grams
            UNION ALL SELECT c.i, CASE WHEN {{near}} THEN seqs ELSE list_append(seqs, c.seq) END, CASE WHEN {{near}} THEN grams ELSE list_append(grams, c.g) END FROM taken JOIN candidates AS c ON c.i = taken.i + 1),
        accepted AS MATERIALIZED (SELECT c.* FROM candidates AS c WHERE c.seq IN (SELECT unnest(seqs) FROM (SELECT seqs FROM taken ORDER BY i DESC LIMIT 1)))""".format(
        near=f"len(list_filter(grams, lambda g: {SIM.format('g', 'c.g')} >= 0.55)) > 0"
    )


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts of one brand."""
    return table(spark, sf_dir, "part").filter("p_brand = 'Brand#22'").select(F.col("p_name").alias("title"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts of another brand."""
    key = F.concat(F.lit("b|"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").filter("p_brand = 'Brand#7' and p_size < 9").select(F.col("p_partkey").cast("long").alias("seq"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.lit("b").alias("source"), key.alias("key"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To-dos that no completed title equals or resembles."""
    return todo.not_completed(titles(spark, sf_dir), completed(spark, sf_dir)).select("seq", "title")


def near_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return todo.similar_titles(titles(spark, sf_dir), completed(spark, sf_dir), 0.35)


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return todo.merge_within_sources(titles(spark, sf_dir)).select("seq", "place", "title", "source")


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return todo.add_new(store(spark, sf_dir), titles(spark, sf_dir), completed(spark, sf_dir)).select("seq", "title", "source", "key")


def whole_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return todo.merged_store(store(spark, sf_dir), titles(spark, sf_dir), completed(spark, sf_dir))


def mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of calls named like stems, one to-do for each of the customer's orders' priorities."""
    k = F.col("o_orderkey")
    t = F.struct(F.concat(F.lit(" T"), k.cast("string")).alias("title"), F.when(k % 3 == 0, "me").when(k % 3 == 1, "partner").alias("owner"), F.when(k % 2 == 0, "high").alias("priority"), F.lit("ctx").alias("context"), F.when(k % 5 == 0, "2024-01-01").otherwise("").alias("due_date"))
    empty = t.withField("title", F.lit(" "))
    r = stems(spark, sf_dir).select(F.concat("stem", F.lit(".txt")).alias("file"), F.when(k % 7 == 0, "error").otherwise("ok").alias("status"), F.array(t, empty).alias("todos"))
    return todo.owned(r, "run1").drop("place")


def synchronisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after results of calls: ten parts to a call, three quarters of them mine, every seventh call failed."""
    k = F.col("p_partkey")
    t = F.struct(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_type").alias("title"), F.when(k % 4 == 1, "boss").when(k % 4 == 2, "me").alias("owner"), F.lit(None).cast("string").alias("priority"), F.lit("ctx").alias("context"), F.lit("").alias("due_date"))
    calls = table(spark, sf_dir, "part").groupBy(F.floor(k / 10).alias("call")).agg(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), t.alias("t")))), lambda x: x["t"]).alias("todos"))
    records = calls.select(F.concat(F.lit("f"), "call", F.lit(".m4a")).alias("file"), F.when(F.col("call") % 7 == 0, "error").otherwise("ok").alias("status"), "todos")
    return todo.synchronised(store(spark, sf_dir), records, completed(spark, sf_dir), "run1")


MINE = """titles AS MATERIALIZED (SELECT row_number() OVER (ORDER BY source || '.m4a', p_partkey) - 1 AS seq, title, source FROM (SELECT p_partkey, p_name || ' ' || p_type AS title, 'f' || (p_partkey // 10) AS source FROM part
    WHERE p_partkey // 10 % 7 <> 0 AND p_partkey % 4 <> 1))"""


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), "value")
    return todo.upsert(e.filter("seq % 3 = 0"), e.filter("seq % 3 <> 0"))


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 10 != 0, F.concat_ws("|", "event_type", F.col("user_id").cast("string"))).otherwise("").alias("k"))
    return todo.first_by_key(e, F.col("k"), "event_id")


def completed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), (F.col("o_orderkey") % 500).cast("string")).alias("title"), F.concat(F.lit("s"), (F.col("o_custkey") % 3).cast("string")).alias("source"),
        F.when(F.col("o_orderkey") % 500 < 250, "completed").otherwise("active").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("completed_at"),
    )
    old = table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), (F.col("c_custkey") % 400).cast("string")).alias("title"), F.when(F.col("c_custkey") % 2 == 0, "s0").alias("source"), F.lit("old").alias("status"), F.lit(None).cast("string").alias("completed_at"))
    return todo.completed_union(old, o)


# ── the graph of customers, nations, regions and their open orders ──

def todo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("order of "), F.col("c_mktsegment"), F.lit(" "), (F.col("o_orderkey") % 97).cast("string")).alias("title"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("source"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).otherwise("").alias("counterparty"), F.col("o_orderdate").cast("date").cast("string").alias("called_at"),
    )


TODO_ROWS = """t AS (SELECT o_orderkey AS seq, 'order of ' || c_mktsegment || ' ' || (o_orderkey % 97) AS title, 'f' || o_orderkey AS source, CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '' END AS counterparty,
    cast(cast(o_orderdate AS date) AS varchar) AS called_at FROM orders JOIN customer ON o_custkey = c_custkey)"""


def todo_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.merge_nodes(graph.from_todos(todo_rows(spark, sf_dir))[0])
    return n.select("id", "type", "label", F.coalesce(F.col("meta")["status"], F.lit("")).alias("status"))


def todo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_edges(graph.from_todos(todo_rows(spark, sf_dir))[1])


def whole_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """To-dos, then calendar drafts, then what is completed, in one order."""
    t = todo_rows(spark, sf_dir)
    drafts = t.filter("seq % 5 = 0").select("seq", F.concat(F.lit("visit "), F.col("title")).alias("title"), F.col("called_at").alias("date"), "source", F.when(F.col("seq") % 2 == 0, F.col("counterparty")).otherwise("").alias("counterparty"))
    done = t.select("seq", "title", F.concat_ws("_", F.col("counterparty"), F.col("source")).alias("source"))
    built = [graph.from_todos(t), graph.from_calendar(drafts), graph.from_completed(done)]
    after = lambda df, k: df.withColumn("seq", F.struct(F.lit(k).alias("part"), F.col("seq").cast("long").alias("seq")))
    nodes, edges = ([after(b[i], k) for k, b in enumerate(built)] for i in (0, 1))
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), edges[0].unionByName(edges[1]).unionByName(edges[2])


def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.type_counts(graph.merge_nodes(whole_graph(spark, sf_dir)[0]))


def active_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = graph.merge_nodes(whole_graph(spark, sf_dir)[0]).filter("type = 'todo'")
    return n.groupBy(F.col("meta")["status"].alias("status")).agg(F.count(F.lit(1)).alias("nodes"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between customers, nations, regions and suppliers."""
    c, s, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    of = lambda df, a, b, ka, kb: df.select(F.concat(F.lit(ka), F.col(a).cast("string")).alias("from"), F.concat(F.lit(kb), F.col(b).cast("string")).alias("to"), F.lit("in").alias("relation"))
    return of(c, "c_custkey", "c_nationkey", "c", "n").unionByName(of(s, "s_suppkey", "s_nationkey", "s", "n")).unionByName(of(n, "n_nationkey", "n_regionkey", "n", "r"))


PLACES = """e AS (SELECT 'c' || c_custkey AS f, 'n' || c_nationkey AS t FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
    b AS (SELECT f AS a, t AS b FROM e UNION SELECT t, f FROM e), d0 AS (SELECT 'r0' AS id), d1 AS (SELECT DISTINCT b AS id FROM b JOIN d0 ON a = id), d2 AS (SELECT DISTINCT b AS id FROM b JOIN d1 ON a = id),
    r AS (SELECT id, min(d) AS distance FROM (SELECT id, 0 AS d FROM d0 UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2) GROUP BY id)"""


def near_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances(places(spark, sf_dir), rows(spark, "id string", ("r0",)), 2)


def near_region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = places(spark, sf_dir)
    ids = e.select(F.col("from").alias("id")).unionByName(e.select(F.col("to").alias("id"))).distinct()
    _, edges = graph.related(ids, e, rows(spark, "id string", ("r0",)), 1)
    return edges.select(F.col("from").alias("source_id"), F.col("to").alias("target_id"))


def region_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = places(spark, sf_dir).select(F.col("from").alias("a"), F.col("to").alias("b"))
    return graph.components(e).groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rows(spark, "a string, b string", ("a", "a"), ("주문 확인", "주문확인 요청"), ("Call Kim", "call  kim!"), ("", "x"), ("ab", "AB"))
    return p.select("a", "b", F.bround(bigram_similarity(F.col("a"), F.col("b")), 4).alias("similarity"), F.size(bigrams(F.col("a"))).alias("grams"))


QUERIES = {
    "similarity_fixture": (similarity, "SELECT * FROM (VALUES ('a', 'a', 0.0::double, 0), ('주문 확인', '주문확인 요청', 0.6, 3), ('Call Kim', 'call  kim!', 0.8571, 6), ('', 'x', 0.0, 0), ('ab', 'AB', 1.0, 1)) AS t(a, b, similarity, grams)"),
    "active_todos": (active, f"""WITH {TITLES}, {DONE}, n AS (SELECT DISTINCT {NORM.format('title')} AS t FROM titles), ng AS (SELECT t, {GRAMS.format('t')} AS g FROM n), dg AS (SELECT t, {GRAMS.format('t')} AS g FROM done),
        x AS (SELECT DISTINCT ng.t FROM ng JOIN dg ON ng.t = dg.t OR (len(ng.g) > 0 AND len(dg.g) > 0 AND {SIM.format('ng.g', 'dg.g')} >= 0.45))
        SELECT seq, title FROM titles WHERE {NORM.format('title')} NOT IN (SELECT t FROM x)"""),
    "similar_titles": (near_titles, f"""WITH {TITLES}, a AS (SELECT DISTINCT title AS a, {GRAMS.format('title')} AS g FROM titles), b AS (SELECT DISTINCT p_name AS b, {GRAMS.format('p_name')} AS g FROM part WHERE p_brand = 'Brand#22')
        SELECT a, b FROM a JOIN b ON len(a.g) > 0 AND len(b.g) > 0 AND {SIM.format('a.g', 'b.g')} >= 0.35"""),
    "merge_within_sources": (merged, f"WITH RECURSIVE {TITLES}, {MERGED} SELECT m.seq, m.place, t.title, t.source FROM merged AS m JOIN titles AS t USING (seq)"),
    "add_new_todos": (added, f"WITH RECURSIVE {TITLES}, {DONE}, {STORE}, {known('store')}, {accepted('titles')} SELECT seq, title, source, {NORM.format('title')} || '|' || source AS key FROM accepted"),
    "merge_todo_store": (whole_merge, f"""WITH RECURSIVE {TITLES}, {DONE}, {STORE}, {MERGED}, mine AS MATERIALIZED (SELECT t.* FROM merged JOIN titles AS t USING (seq)),
        kept AS MATERIALIZED (SELECT s.* FROM store AS s WHERE {NORM.format('title')} NOT IN (SELECT x.t FROM (SELECT DISTINCT {NORM.format('title')} AS t FROM store) AS x, done WHERE x.t = done.t OR {SIM.format(GRAMS.format('x.t'), GRAMS.format('done.t'))} >= 0.45)),
        {known('kept')}, {accepted('mine')}, n AS (SELECT seq, title, source, {NORM.format('title')} || '|' || source AS key FROM accepted)
        SELECT * FROM n UNION ALL SELECT * FROM kept WHERE key NOT IN (SELECT key FROM n)"""),
    "todo_synchronisation": (synchronisation, f"""WITH RECURSIVE {MINE}, {DONE}, {STORE}, {MERGED}, mine AS MATERIALIZED (SELECT t.* FROM merged JOIN titles AS t USING (seq)),
        kept AS MATERIALIZED (SELECT s.* FROM store AS s WHERE {NORM.format('title')} NOT IN (SELECT x.t FROM (SELECT DISTINCT {NORM.format('title')} AS t FROM store) AS x, done WHERE x.t = done.t OR {SIM.format(GRAMS.format('x.t'), GRAMS.format('done.t'))} >= 0.45)),
        {known('kept')}, {accepted('mine')}, n AS (SELECT seq, title, source, {NORM.format('title')} || '|' || source AS key FROM accepted)
        SELECT * FROM n UNION ALL SELECT * FROM kept WHERE key NOT IN (SELECT key FROM n)"""),
    "my_todo_rows": (mine, f"""WITH {STEMS} SELECT stem || '.txt' AS file, 'T' || o_orderkey AS title, 'me' AS owner, stem AS source, CASE WHEN {fits(CTX, 'base')} THEN {x(CTX, 1, 'base')} ELSE base END AS counterparty, {x(CTX, 2, 'base')} AS phone,
        CASE WHEN {fits(CTX, 'base')} THEN {iso(x(CTX, 3, 'base'))} ELSE '' END AS called_at, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'medium' END AS priority, 'active' AS status, 'ctx' AS details,
        CASE WHEN o_orderkey % 5 = 0 THEN '2024-01-01' END AS due_date, 'run1' AS run_id FROM (SELECT *, {BASE} AS base FROM stems) WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 1"""),
    "key_upsert": (upserts, "SELECT seq, key, value FROM (SELECT event_id AS seq, event_type || '|' || user_id AS key, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 3 <> 0 DESC, event_id DESC) AS k FROM events) WHERE k = 1"),
    "first_by_key": (firsts, "SELECT min(event_id) AS event_id, event_type || '|' || user_id AS k FROM events WHERE user_id % 10 <> 0 GROUP BY 2"),
    "completed_union": (completed_rows, """WITH n AS (SELECT 't' || (o_orderkey % 500) AS title, 's' || (o_custkey % 3) AS source, 'completed' AS status, max(strftime(o_orderdate, '%Y-%m-%d')) AS completed_at FROM orders WHERE o_orderkey % 500 < 250 GROUP BY ALL),
        o AS (SELECT DISTINCT 't' || (c_custkey % 400) AS title, CASE WHEN c_custkey % 2 = 0 THEN 's0' ELSE '' END AS source, 'old' AS status, cast(NULL AS varchar) AS completed_at FROM customer)
        SELECT * FROM n UNION ALL SELECT * FROM o WHERE (title, source) NOT IN (SELECT title, source FROM n)"""),
    "graph_nodes_from_todos": (todo_nodes, f"""WITH {TODO_ROWS} SELECT DISTINCT 'cp:' || counterparty AS id, 'counterparty' AS type, counterparty AS label, '' AS status FROM t WHERE counterparty <> ''
        UNION ALL SELECT 'todo:' || substr(title, 1, 30), 'todo', arg_min(title, seq), 'active' FROM t WHERE counterparty <> '' GROUP BY 1"""),
    "graph_edges_from_todos": (todo_edges, f"""WITH {TODO_ROWS} SELECT 'cp:' || counterparty AS "from", 'todo:' || substr(title, 1, 30) AS "to", 'has_todo' AS relation, arg_min(source, seq) AS source, arg_min(called_at, seq) AS date FROM t WHERE counterparty <> '' GROUP BY 1, 2"""),
    "graph_node_types": (node_types, f"""WITH {TODO_ROWS}, last AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS k FROM t), n AS (SELECT 'counterparty' AS type, counterparty AS id FROM t WHERE counterparty <> '' UNION SELECT 'todo', substr(title, 1, 30) FROM t WHERE counterparty <> ''
        UNION SELECT 'event', substr('visit ' || title, 1, 30) FROM t WHERE seq % 5 = 0 UNION SELECT 'todo', substr(title, 1, 30) FROM last WHERE k <= 50) SELECT type, count(*) AS nodes FROM n GROUP BY 1"""),
    "graph_todo_status": (active_status, f"""WITH {TODO_ROWS}, last AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS k FROM t), c AS (SELECT DISTINCT substr(title, 1, 30) AS id FROM last WHERE k <= 50), a AS (SELECT DISTINCT substr(title, 1, 30) AS id FROM t WHERE counterparty <> '')
        SELECT 'completed' AS status, count(*) AS nodes FROM c UNION ALL SELECT 'active', count(*) FROM a WHERE id NOT IN (SELECT id FROM c)"""),
    "graph_bfs": (near_region, f"WITH {PLACES} SELECT * FROM r"),
    "graph_bfs_edges": (near_region_edges, f"WITH {PLACES}, q AS (SELECT id FROM r WHERE distance <= 1) SELECT DISTINCT f AS source_id, t AS target_id FROM e WHERE f <> t AND (f IN (SELECT id FROM q) OR t IN (SELECT id FROM q))"),
    "graph_components": (region_parts, """WITH m AS (SELECT 'c' || c_custkey AS id, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, n_regionkey FROM nation) SELECT min(id) AS root, count(*) AS nodes FROM m GROUP BY r"""),
}
