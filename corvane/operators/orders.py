"""Orders through their stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import beside

# Stages in order, hints in the order in which they are tried, entity types that name a party or a phone.
STAGES = ("order", "quote", "po", "delivery", "payment", "complete")
HINTS = {"주문": "order", "견적": "quote", "견적요청": "quote", "발주": "po", "납기": "delivery", "납품": "delivery", "결제": "payment", "입금": "payment", "수금": "payment"}
PARTY_TYPES, PHONE_TYPES = ("person", "company", "organization", "거래처", "회사"), ("phone", "전화번호")


def infer_stage(call_type: Column, todo_text: Column, has_money: Column, hints: dict[str, str] | None = None) -> Column:
    """The first hint in the call type, else in the to-do text; money alone means payment; else order."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for text in (call_type, todo_text):
        for hint, stage in (HINTS if hints is None else hints).items():
            out = out.when(F.contains(F.coalesce(text, F.lit("")), F.lit(hint)), stage)
    return out.when(has_money, "payment").otherwise("order")


def _named(entities: Column, types: Sequence[str], first: str, second: str) -> Column:
    of = lambda e: F.coalesce(F.nullif(e[first], F.lit("")), F.nullif(e[second], F.lit("")))
    return of(F.get(F.filter(entities, lambda e: F.lower(e["type"]).isin(*types) & of(e).isNotNull()), F.lit(0)))


def counterparty(own: Column, metadata: Column, summary: Column, entities: Column) -> Column:
    """The record's, its metadata's, its summary's, or the first person or company among entities (type, name, value)."""
    filled = [F.nullif(c, F.lit("")) for c in (own, metadata, summary)]
    return F.coalesce(*filled, _named(entities, PARTY_TYPES, "name", "value"))


def phone(metadata: Column, entities: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(metadata, F.lit("")), _named(entities, PHONE_TYPES, "value", "name")), r"(?U)[\-\s]", "")


def order_key(party: Column, number: Column) -> Column:
    """By phone, else by name; null if there is neither."""
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("phone:"), number)).when(F.coalesce(party, F.lit("")) != "", F.concat(F.lit("name:"), party))


def stage_index(stage: Column) -> Column:
    return F.greatest(F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1, F.lit(0))


def timeline(events: DataFrame) -> DataFrame:
    """key, seq, stage, current_stage at each event of events (seq, key, stage, ...): stages only go forward. An order's stage at an
    event is the number of stages first reached by then: an aggregate of a few numbers for each key, not a sort of a key's events."""
    e = events.filter("key is not null")
    reached = e.groupBy("key").agg(F.array(*[F.min(F.when(stage_index(F.col("stage")) >= i, F.col("seq"))) for i in range(1, len(STAGES))]).alias("_reached"))
    furthest = F.size(F.filter("_reached", lambda seq: seq <= F.col("seq")))
    return beside(e, reached, "key").withColumn("current_stage", F.element_at(F.array(*map(F.lit, STAGES)), furthest + 1)).drop("_reached")


def orders(events: DataFrame) -> DataFrame:
    """One row for each key: the first name and phone known, the furthest stage, first and last event. Partial sums, no windows."""
    known = lambda c: F.min_by(F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col(c)), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("seq")))
    o = events.filter("key is not null").groupBy("key").agg(
        known("counterparty").alias("counterparty"), known("phone").alias("phone"), F.max(stage_index(F.col("stage"))).alias("at"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("events")
    )
    return o.withColumn("current_stage", F.element_at(F.array(*map(F.lit, STAGES)), (F.col("at") + 1).cast("int"))).drop("at")


def active(found: DataFrame) -> DataFrame:
    return found.filter("current_stage <> 'complete'")


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """The distinct strings of `size` characters in a text."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def lookup(asked: DataFrame, found: DataFrame) -> DataFrame:
    """asked (term) with the key of its order: by phone, by name, else the first order whose name or phone contains it.

    Terms that the two equi joins leave are looked up in an inverted index: each by the rarest of its strings of GRAM characters (a
    shorter term by itself), which names and phones must have, too; what is found is verified. The empty term is in all orders.
    """
    t = asked.select("term").distinct()
    by_phone = t.join(found.select("key"), F.concat(F.lit("phone:"), F.regexp_replace("term", r"(?U)[\-\s]", "")) == F.col("key")).select("term", "key", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("first"))
    by_name = t.join(found.select("key"), F.concat(F.lit("name:"), F.col("term")) == F.col("key")).select("term", "key", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("first"))
    exact = by_phone.unionByName(by_name)
    left = t.join(exact, "term", "left_anti")
    wanted = left.select("term", F.explode(F.when(F.length("term") < GRAM, F.array("term")).otherwise(_grams(F.col("term"), GRAM))).alias("gram"))
    fields = F.array(F.coalesce("counterparty", F.lit("")), F.coalesce("phone", F.lit("")))
    every = F.array_distinct(F.flatten(F.transform(fields, lambda x: F.concat(*[_grams(x, n) for n in range(1, GRAM + 1)]))))
    index = found.select("key", F.col("first").cast("long").alias("first"), fields.alias("fields"), F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi")
    often = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(often, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    part = rarest.join(index, "gram").filter(F.exists("fields", lambda x: F.contains(x, F.col("term")))).select("term", "key", F.lit(2).alias("rank"), "first")
    # The empty term is made of the rows, so that it is a key of the join like others.
    all_ = found.agg(F.max(F.left("key", F.lit(0))).alias("term"), F.min_by("key", F.struct("first", "key")).alias("key"))
    empty = left.join(all_, "term").select("term", "key", F.lit(2).alias("rank"), F.lit(0).cast("long").alias("first"))
    return exact.unionByName(part).unionByName(empty).groupBy("term").agg(F.min_by("key", F.struct("rank", "first", "key")).alias("key"))
