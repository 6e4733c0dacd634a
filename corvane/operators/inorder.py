"""Decisions that are taken in order, without taking them one after the other.

A row in an order meets the kept rows before it that it resembles. If none does, it is kept, in a place of its own; else the
first of these places takes it in and, with `replace`, gives way to it if it is longer. So a row can be decided as soon as those it
depends on are: its earlier neighbours and, for each of them, the longer ones that came in between and may have taken its place.
These are known beforehand, so decisions are made in rounds over the edges, whatever component they belong to.

In each round the open edges are dealt out in blocks of BLOCK edges, in order, and a task decides, in one pass over its block, all
rows whose edges it has and whose dependencies are decided, be it before or in this pass. Random orders settle within few rounds. A
long chain in sorted order is decided a block at a time; after ROUNDS rounds blocks follow the components of what is left, so
that chains which are interleaved in the order don't wait for each other. The first open row is decided in each round at the latest.
No task gets more than a block; edges that are no more than one are decided at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import components
from corvane.operators.rank import global_rank
from corvane.session import staged

BLOCK, ROUNDS = 50_000, 3
FATE = "seq long, kept boolean, place long, until long"


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows that can be decided: seq, kept, place; and seq, until of kept rows that gave way."""
    place: dict[int, int | None] = {}  # decided here: the place if kept
    until: dict[int, int] = {}
    out: list[tuple] = []
    pdf = pdf.sort_values(["later", "earlier"], kind="stable").astype(object).where(lambda x: x.notna(), None)
    names = ("later", "earlier", "waits", "waits_known", "degree", "longer", "kept", "place", "until", "known")
    rows = list(zip(*[pdf[c].tolist() for c in names], strict=True))
    at = 0
    while at < len(rows):
        x, end = rows[at][0], at
        while end < len(rows) and rows[end][0] == x:
            end += 1
        best = None
        ready = end - at == rows[at][4]
        for _, y, waits, waits_known, _, longer, kept, slot, gone, known in rows[at:end] if ready else ():
            if y in place:
                kept, slot, gone = place[y] is not None, place[y], None
            elif not known:
                ready = False
                break
            if waits is not None and not waits_known and waits not in place:
                ready = False
                break
            gone = until.get(y, gone)
            # What is known to have given way by now did so before x, or to a row behind it.
            if kept and (gone is None or gone > x) and (best is None or slot < best[0]):
                best = slot, y, longer
        at = end
        if not ready:
            continue
        if best is None:
            place[x] = x
        elif best[2]:
            place[x] = best[0]
            until[best[1]] = x
            out.append((best[1], None, None, x))
        else:
            place[x] = None
        out.append((x, place[x] is not None, place[x], None))
    return pd.DataFrame({"seq": [r[0] for r in out], "kept": pd.array([r[1] for r in out], "boolean"), "place": pd.array([r[2] for r in out], "Int64"), "until": pd.array([r[3] for r in out], "Int64")})


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    """_block of all edges there are."""
    first = ~pdf["earlier"].isin(set(pdf["later"]))
    return _block(pdf.assign(waits_known=False, degree=pdf.groupby("later")["later"].transform("size"), kept=first, place=pdf["earlier"].where(first), until=None, known=first))


def _dealt(edges: DataFrame, *order: str) -> DataFrame:
    return global_rank(edges, *order).withColumn("block", F.floor(F.col("rank") / F.lit(BLOCK))).drop("rank")


def decided(rows: DataFrame, edges: DataFrame, replace: bool) -> DataFrame:
    """seq, kept, place, until of rows (seq, size), given edges (earlier, later) between rows that resemble each other, earlier <
    later, each once. kept: it was kept when it came; until: the seq of the longer row that it gave way to, if any. Staged."""
    if replace:
        size = rows.select("seq", "size")
        e = edges.join(size.select(F.col("seq").alias("earlier"), F.col("size").alias("size_e")), "earlier").join(size.select(F.col("seq").alias("later"), F.col("size").alias("size_l")), "later")
        e = e.select("earlier", "later", (F.col("size_l") > F.col("size_e")).alias("longer"))
        before = Window.partitionBy("earlier").orderBy("later").rowsBetween(Window.unboundedPreceding, -1)
        e = e.withColumn("waits", F.max(F.when(F.col("longer"), F.col("later"))).over(before))
    else:
        e = edges.select("earlier", "later", F.lit(False).alias("longer"), F.lit(None).cast("long").alias("waits"))
    e = staged(e)
    if e.limit(BLOCK + 1).count() <= BLOCK:
        made = e.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_whole, FATE)
        made = made.groupBy("seq").agg(F.max("kept").alias("kept"), F.max("place").alias("place"), F.max("until").alias("until"))
        # Rows without an earlier neighbour are kept; what they gave way to is among what was made.
        first = rows.join(e.select(F.col("later").alias("seq")), "seq", "left_anti").join(made.select("seq", "until"), "seq", "left")
        late = made.filter("kept is not null")
        return staged(late.unionByName(first.select("seq", F.lit(True).alias("kept"), F.col("seq").alias("place"), "until")))
    degree = e.groupBy("later").agg(F.count(F.lit(1)).alias("degree"))
    left = staged(_dealt(e.join(degree.hint("merge"), "later"), "later", "earlier"))
    first = rows.join(left.select(F.col("later").alias("seq")).distinct().hint("merge"), "seq", "left_anti")
    fates = staged(first.select("seq", F.lit(True).alias("kept"), F.col("seq").alias("place"), F.lit(None).cast("long").alias("until")))
    done = 0
    while not left.isEmpty():
        if done == ROUNDS:
            parts = components(left.select(F.col("earlier").alias("a"), F.col("later").alias("b")))
            left = staged(_dealt(left.drop("block").join(parts.withColumnRenamed("node", "later"), "later"), "root", "later", "earlier").drop("root"))
        known = fates.select(F.col("seq").alias("earlier"), "kept", "place", "until", F.lit(True).alias("known"))
        waits = fates.select(F.col("seq").alias("waits"), F.lit(True).alias("waits_known"))
        told = left.join(known, "earlier", "left").join(waits, "waits", "left")
        new = staged(told.groupBy("block").applyInPandas(_block, FATE))
        gone = new.filter("until is not null").select("seq", F.col("until").alias("now"))
        here = new.filter("kept is not null")
        fates = staged(fates.unionByName(here).join(gone, "seq", "left").select("seq", "kept", "place", F.coalesce("now", "until").alias("until")))
        left = staged(left.join(here.select(F.col("seq").alias("later")), "later", "left_anti"))
        done += 1
    return fates
