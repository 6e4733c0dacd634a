"""Relationship graph: building, traversal, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import beside, staged

HAS_TODO, INVOLVED_IN = "has_todo", "involved_in"
LABEL_CHARS, COMPLETED = 30, 50


def _node(seq: Column, node_id: Column, kind: str, label: Column, **meta: Column) -> Column:
    values = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), v)]) if meta else F.create_map().cast("map<string,string>")
    return F.struct(seq.alias("seq"), node_id.alias("id"), F.lit(kind).alias("type"), label.alias("label"), values.alias("meta"))


def _edge(seq: Column, a: Column, b: Column, relation: str, source: Column, date: Column) -> Column:
    return F.struct(seq.alias("seq"), a.alias("from"), b.alias("to"), F.lit(relation).alias("relation"), source.alias("source"), date.alias("date"))


def _short(kind: str, title: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(title, 1, LABEL_CHARS))


def _party(name: Column) -> Column:
    return F.concat(F.lit("cp:"), name)


def from_todos(todos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of to-dos (seq, title, source, counterparty, called_at); those without a counterparty have none."""
    t = todos.filter("counterparty <> ''")
    seq, cp, title = F.col("seq"), F.col("counterparty"), F.col("title")
    nodes = t.select(F.inline(F.array(_node(seq * 2, _party(cp), "counterparty", cp), _node(seq * 2 + 1, _short("todo", title), "todo", title, status=F.lit("active")))))
    edges = t.select(F.inline(F.array(_edge(seq, _party(cp), _short("todo", title), HAS_TODO, F.col("source"), F.coalesce("called_at", F.lit(""))))))
    return nodes, edges


def from_calendar(drafts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of drafts (seq, title, date, source, counterparty): an event each, and an edge where there is a counterparty."""
    seq, cp, title = F.col("seq"), F.col("counterparty"), F.col("title")
    event = _node(seq * 2, _short("event", title), "event", title, date=F.col("date"))
    known = F.coalesce(cp, F.lit("")) != ""
    nodes = drafts.select(F.inline(F.when(known, F.array(event, _node(seq * 2 + 1, _party(cp), "counterparty", cp).cast(_kind(drafts, event)))).otherwise(F.array(event))))
    edges = drafts.filter(known).select(F.inline(F.array(_edge(seq, _party(cp), _short("event", title), INVOLVED_IN, F.col("source"), F.col("date")))))
    return nodes, edges


def _kind(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("x")).schema["x"].dataType.simpleString()


def from_completed(done: DataFrame, last: int = COMPLETED) -> tuple[DataFrame, DataFrame]:
    """Of the last completed to-dos (seq, title, source); the counterparty is what stands before the first _ of the source."""
    newest = done.orderBy(F.desc("seq")).limit(last)
    cp = F.when(F.contains("source", F.lit("_")), F.split_part(F.col("source"), F.lit("_"), F.lit(1)))
    t = newest.withColumn("cp", F.when(F.length(cp) > 1, cp))
    seq, title = F.col("seq"), F.col("title")
    todo = _node(seq * 2, _short("todo", title), "todo", title, status=F.lit("completed"))
    both = F.array(todo, _node(seq * 2 + 1, _party(F.col("cp")), "counterparty", F.col("cp")).cast(_kind(t, todo)))
    nodes = t.select(F.inline(F.when(F.col("cp").isNotNull(), both).otherwise(F.array(todo))))
    edges = t.filter("cp is not null").select(F.inline(F.array(_edge(seq, _party(F.col("cp")), _short("todo", title), HAS_TODO, F.col("source"), F.lit("")))))
    return nodes, edges


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: type and label of the first, of each meta key the last value."""
    first = nodes.groupBy("id").agg(F.min_by("type", "seq").alias("type"), F.min_by("label", "seq").alias("label"))
    meta = nodes.select("id", "seq", F.explode("meta").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    maps = meta.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("meta"))
    return first.join(maps, "id", "left").withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row for each (from, to, relation), the first."""
    return edges.groupBy("from", "to", "relation").agg(F.min_by("source", "seq").alias("source"), F.min_by("date", "seq").alias("date"))


def distances(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """id, distance of all ids within depth of start.id, by level. Each level joins its frontier alone, and is staged."""
    both = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).unionByName(edges.select(F.col("to").alias("a"), F.col("from").alias("b"))).filter("a <> b").distinct()
    both = staged(both)
    seen = start.select("id").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(both, frontier["id"] == both["a"]).select(F.col("b").alias("id")).distinct()
        frontier = staged(new.join(seen, "id", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = staged(seen.unionByName(frontier))
    return seen


def related(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Known nodes within depth, with their distance, and each edge, but loops, that has an end within depth."""
    reach = distances(edges, start, depth)
    near = reach.select("id")
    hit = edges.filter(F.col("from") != F.col("to"))
    touching = hit.join(near, hit["from"] == near["id"], "left_semi").unionByName(hit.join(near, hit["to"] == near["id"], "left_semi")).distinct()
    return nodes.join(reach, "id"), touching


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"), "type")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of all nodes in edges (a, b), of any type that has an order; root is the least node of the component.

    Nodes are numbered, so that labels say nothing about neighbourhood, and the graph is contracted to stars: larger neighbours of a
    node point at the least of its neighbourhood, then the node and its smaller neighbours do, until nothing changes. Edges never
    become more, and rounds grow with the logarithm of the nodes: a shuffled chain of 10,000 takes 13.
    """
    e = staged(edges.select("a", "b").filter("a is not null and b is not null"))
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    numbered = staged(nodes.withColumn("n", F.monotonically_increasing_id()))
    number = lambda c: numbered.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    now = e.filter("a <> b").join(number("a"), "a").join(number("b"), "b")
    now = staged(now.select(F.greatest("n_a", "n_b").alias("high"), F.least("n_a", "n_b").alias("low")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.select(F.col("high").alias("a"), F.col("low").alias("b")).unionByName(now.select(F.col("low").alias("a"), F.col("high").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = beside(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = beside(large, least, "a").select(F.col("b").alias("high"), F.col("m").alias("low")).unionByName(least.select(F.col("a").alias("high"), F.col("m").alias("low")))
        now = staged(small.filter("high <> low").distinct())
        last, seen = seen, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if last == seen:
            named = numbered.join(now.select(F.col("high").alias("n"), "low"), "n", "left").select("node", F.coalesce("low", "n").alias("star"))
            # A star may have most of all nodes: its least node is an aggregate, and goes back over exchanges on both sides.
            return beside(named, named.groupBy("star").agg(F.min("node").alias("root")), "star").select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
