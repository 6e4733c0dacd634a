"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each bit of the 64-bit hashes of a text's word shingles, by majority. Two texts are linked if
their fingerprints differ in `distance` bits or fewer. The index holds each distinct fingerprint once for each of m
segments. By the pigeonhole principle with radii t_i that sum to distance - m + 1, linked fingerprints are within t_i in
some segment i; so each fingerprint enumerates the ball of radius t_i around its segment, fetches the table's matches,
and the whole distance of each is verified. Only the half of each ball in which the highest changed bit becomes 1 is
enumerated: of two linked fingerprints exactly one finds the other.

Table entries of over HEAVY fingerprints (and over four times the mean) are cut by a second index: linked fingerprints of an
entry differ in `distance` bits or fewer outside its segment, too, so the same holds for PARTS segments of the other bits. What is
still heavy there is alike in two places. Its pairs would grow with the square, so its rows are dealt into blocks, each pair of
blocks is one small task, and it emits a spanning forest of its links, not its pairs. So no link between different texts is lost
and no bucket is capped. Copies have the same fingerprint and never meet in a join.

Classes are the connected components of the links, found by alternating star contraction over DataFrames.

Joins of what grows with the documents are told to exchange both sides (the hint "merge"): Spark sizes a side by its files, and takes
an explode for one row each, so that whole balls would go through the driver as a table of which it thinks that it is small.

Cases. A null, empty or white-space text has no words and fingerprint zero, linked like any other; fewer words than a
shingle needs are one shingle. A component's id is its smallest doc_id, null only if all of them are. Rows that repeat an
id are rows of their own, and may be in different components: one row of each component is kept even if components share an
id or have none. Very long texts are hashed in blocks. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import drop_rows, keyed_text, row_key, staged, table

SHINGLE_WORDS, DISTANCE, SEED = 4, 4, 42
HEAVY, BLOCK, PARTS = 64, 1024, 4
#: Hashes whose bits are counted at once.
HASH_BLOCK = 1 << 15
#: Segments by the number of distinct fingerprints: a segment has about as many bits as that number.
SEGMENTS = ((1 << 14, 4), (1 << 28, 3), (1 << 63, 2))


def words_of(text: str) -> list[bytes]:
    # bytes.lower changes A-Z alone, and bytes.split without an argument splits at 0x20 and 0x09 to 0x0D.
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """Blocks of the hashes of a text's shingles, repeats included; of fewer words, of the whole sequence."""
    words = words_of(text or "")
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, size = xxhash.xxh64_intdigest, min(size, len(words))
    n = len(words) - size + 1
    for at in range(0, n, HASH_BLOCK):
        a, b = starts[at : min(at + HASH_BLOCK, n)].tolist(), ends[at + size - 1 : min(at + HASH_BLOCK, n) + size - 1].tolist()
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], dtype="<u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have; 0 of none."""
    counts, n = np.zeros(64, np.int64), 0
    for h in blocks:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """row, doc_id, fp (the 64 bits as a signed long) of documents (row, doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(fp)], ["row", "doc_id", "fp"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(each, f"row {kinds['row']}, doc_id {kinds['doc_id']}, fp bigint")


def segment_plan(n: int, distance: int = DISTANCE, bits: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment; the radii sum to distance - segments + 1."""
    m = min(next(m for most, m in SEGMENTS if n <= most), distance + 1)
    spare = distance - m + 1
    widths = [bits // m + (i >= m - bits % m) for i in range(m)]
    radii = [spare // m + (i < spare % m) for i in range(m)]
    firsts = [0, *itertools.accumulate(widths)]
    return list(zip(firsts, widths, radii, strict=False))


def ball(width: int, radius: int) -> list[int]:
    """All masks of up to radius bits; 0 first."""
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in itertools.combinations(range(width), k)]


def index_rows(fps: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """fp, key: a table entry for each segment."""
    keys = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)).bitwiseOR(F.lit(i << 40)) for i, (a, w, _) in enumerate(plan)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def probe_rows(fps: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """fp, key, exact: the table entries to look up. exact: the segment as it is."""

    def of_segment(i: int, first: int, width: int, radius: int) -> Column:
        seg = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        masks = F.array(*[F.lit(m).cast("long") for m in ball(width, radius)])
        near = F.filter(F.transform(masks, lambda m: seg.bitwiseXOR(m)), lambda x: x >= seg)
        return F.transform(near, lambda x: F.struct(x.bitwiseOR(F.lit(i << 40)).alias("key"), (x == seg).alias("exact")))

    parts = [of_segment(i, *segment) for i, segment in enumerate(plan)]
    return fps.select("fp", F.explode(F.concat(*parts)).alias("p")).select("fp", "p.key", "p.exact")


def second_keys(plan: list[tuple[int, int, int]], distance: int, balls: bool) -> Column:
    """Array of second keys of (fp, key): for each of PARTS segments of the bits outside the key's segment one or, with balls, one for
    each value within the segment's radius. Radii as in segment_plan."""
    m = min(PARTS, distance + 1)
    spare = distance - m + 1

    def outside(i: int, first: int, width: int) -> Column:
        # Turned so that the key's segment is on top, the other bits are the lower ones.
        by = (first + width) % 64
        turned = F.shiftrightunsigned("fp", by).bitwiseOR(F.shiftleft("fp", 64 - by)) if by else F.col("fp")
        bits, out, at = 64 - width, [], 0
        for j in range(m):
            w = bits // m + (j >= m - bits % m)
            seg = F.shiftrightunsigned(turned, at).bitwiseAND(F.lit((1 << w) - 1))
            radius = spare // m + (j < spare % m)
            masks = ball(w, radius) if balls else [0]
            out += [F.xxhash64("key", F.lit(j), seg.bitwiseXOR(F.lit(x).cast("long"))) for x in masks]
            at += w
        return F.array(*out)

    segment = F.shiftrightunsigned("key", 40)
    keys = F.when(segment == 0, outside(0, *plan[0][:2]))
    for i, (first, width, _) in enumerate(plan[1:], 1):
        keys = keys.when(segment == i, outside(i, first, width))
    return keys


def forest(pdf, distance: int):
    """Spanning stars of the links among one block pair's fingerprints."""
    import pandas as pd

    fp = np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
    left, out_a, out_b = np.ones(len(fp), bool), [], []
    for i in range(len(fp)):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            j = queue.pop()
            found = np.flatnonzero(left & (np.bitwise_count(fp ^ fp[j]) <= distance))
            left[found] = False
            queue += found.tolist()
            out_a += [fp[i]] * len(found)
            out_b += fp[found].tolist()
    return pd.DataFrame({"a": np.array(out_a, np.uint64).view(np.int64), "b": np.array(out_b, np.uint64).view(np.int64)})


def met(probes: DataFrame, entries: DataFrame, distance: int) -> DataFrame:
    """a, b: links between probes (fp, key, exact) and the entries (fp, key) that they look up."""
    p, t = probes.alias("p"), entries.alias("t")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= distance
    once = (~F.col("p.exact")) | (F.col("p.fp") < F.col("t.fp"))
    return p.join(t.hint("merge"), (F.col("p.key") == F.col("t.key")) & near & once).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))


def in_blocks(entries: DataFrame, asked: DataFrame, dense: DataFrame, distance: int) -> DataFrame:
    """a, b: links that connect what the links between asked (fp, key) and entries (fp, key, count) of dense keys (key, count) do: blocks
    of table rows against blocks of the rows that look them up."""
    asked = staged(asked.select("key", "fp").distinct())
    sizes = dense.join(asked.groupBy("key").agg(F.count(F.lit(1)).alias("asks")), "key").select(
        "key", F.ceil(F.col("count") / BLOCK).cast("long").alias("tn"), F.ceil(F.col("asks") / BLOCK).cast("long").alias("pn")
    )
    own = F.xxhash64("fp", F.lit(1))
    table_side = entries.join(sizes, "key").select("key", "fp", F.pmod(own, F.col("tn")).alias("tb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pn") - 1)).alias("pb"))
    probe_side = asked.join(sizes, "key").select("key", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tn") - 1)).alias("tb"), F.pmod(own, F.col("pn")).alias("pb"))
    blocks = table_side.unionByName(probe_side).groupBy("key", "tb", "pb")
    return blocks.applyInPandas(lambda pdf: forest(pdf, distance), "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: links among distinct fingerprints (fp), staged; where an entry is heavy, links that connect the same ones."""
    n = fps.count()
    plan = segment_plan(n, distance)
    entries, probes = staged(index_rows(fps, plan)), probe_rows(fps, plan)
    heavy = staged(entries.groupBy("key").count().filter(F.col("count") > max(HEAVY, 4 * n >> min(w for _, w, _ in plan))).select("key"))
    some = not heavy.isEmpty()
    if some:
        # They are used twice then: enumerate the balls once.
        probes = staged(probes)
    pairs = met(probes, entries.join(heavy, "key", "left_anti") if some else entries, distance)
    if some:
        again = staged(entries.join(heavy, "key", "left_semi").select("fp", F.explode(second_keys(plan, distance, False)).alias("key")))
        asked = staged(probes.join(heavy, "key", "left_semi").select("fp", F.explode(second_keys(plan, distance, True)).alias("key"), "exact"))
        dense = staged(again.groupBy("key").count().filter(F.col("count") > HEAVY))
        pairs = pairs.unionByName(met(asked, again.join(dense, "key", "left_anti"), distance))
        if not dense.isEmpty():
            pairs = pairs.unionByName(in_blocks(again.join(dense, "key"), asked.join(dense, "key", "left_semi"), dense, distance))
    return staged(pairs.distinct())


def with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (a, b) with m of least (a, m). The key is a number made of a, so that both sides are exchanged for the join: only then
    does adaptive execution split the partition of a hub."""
    key = F.col("a").bitwiseXOR(F.lit(SEED).cast("long"))
    return pairs.withColumn("key", key).join(least.select(key.alias("key"), "m").hint("merge"), "key").drop("key")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root of all nodes in edges (a, b): alternating large-star and small-star until nothing changes. Staged."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: each larger neighbour of a points at the least of a's neighbourhood
        now = with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a and its smaller neighbours point at the least of them
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        now = with_least(now, least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(now.filter("a <> b").distinct())
        last, seen = seen, state(now)
        if last == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, size: int = SHINGLE_WORDS) -> DataFrame:
    """row, doc_id, fp, root (of the component, a fingerprint), component_id: one row for each row of df."""
    docs = staged(fingerprints(keyed_text(df, id_col, text_col), size))
    fps = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps.select("fp"), distance))
    named = fps.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = staged(named.join(ids, "root").select("fp", "root", "component_id"))
    return docs.join(by_fp.hint("merge"), "fp").select("row", "doc_id", "fp", "root", "component_id")


def all_but_first(groups: DataFrame) -> DataFrame:
    """row of all rows of groups (row, doc_id, root, component_id) but one of each root: of those with the smallest id the first.
    Components are told apart by their root, for their ids may be null, or the same where rows of several repeat an id."""
    first = groups.filter("doc_id <=> component_id").groupBy("root").agg(F.min("row").alias("row"))
    return groups.select("row").join(first.hint("merge"), "row", "left_anti")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, size: int = SHINGLE_WORDS) -> DataFrame:
    """df with one row of each component, that with the smallest id; all its columns as they were."""
    df, _ = row_key(df)
    groups = staged(near_groups(df, id_col, text_col, distance, size))
    return drop_rows(df, all_but_first(groups))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
