"""Importance resampling towards a target: hashed n-gram gains, summed over each document, and a seeded draw without replacement.

Features are the runs of 1 to `runs` consecutive words; each falls into one of `buckets` by its CRC-32. Every task keeps a trie of
the words it meets: a node stands for a run, holds how often that occurred and the CRC state behind its bytes, so that a longer run
goes on from its prefix and no feature's string is ever joined or hashed twice. When a trie has NODES nodes its bucket totals are
passed on and it starts anew, which changes no sum. The totals of all tasks, `buckets` rows each, are merged, of the raw corpus and
of the target, and give each bucket's gain. The second walk goes along tries whose nodes hold the gain instead.

A draw takes the highest scores, a document's weight plus Gumbel noise from its seeded id, which is sampling without replacement by
weight. The least score drawn comes from counts of the scores, whole numbers of a bounded range; only rows from there on are
ordered, in ranges that are numbered by the counts of those before.

Cases. A null or empty text, or one without words, has no features, weight 0, and isn't drawn unless `least_words` is 0. Rows that
repeat an id have the same noise and are scored and drawn each, in the order of their places. A null id is the empty string to the
noise, and comes last among ties. Very long texts are walked word by word. Extra columns are ignored. Without target, or without
documents, counts are 0 and the gains are what the formula gives. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import staged, table

RUNS, BUCKETS, SEED, LEAST_WORDS, PERCENT = 1, 10_000, "2024", 20, 10
#: Nodes of a task's trie, some 250 bytes each.
NODES = 600_000
#: ASCII letters become lower case; all bytes below 0x80 but letters and digits are blanks.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(WORD_BYTES).split() if text else []


def word_runs(of: list[bytes], most: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """The distinct runs of 1 to `most` words and how often each occurs."""
    for k in range(1, most + 1):
        yield from Counter(zip(*[of[i:] for i in range(k)], strict=False)).items()


def n_features(n_words: int, most: int) -> int:
    return sum(max(0, n_words - k + 1) for k in range(1, most + 1))


class Node:
    __slots__ = ("children", "crc", "value")

    def __init__(self, crc: int, value: int):
        self.children: dict[bytes, Node] | None = None
        self.crc, self.value = crc, value


class Trie:
    """Nodes for runs of words, made when they are first met, with first(CRC of the run) as their value."""

    def __init__(self, first: Callable[[int], int]):
        self.first = first
        self.clear()

    def clear(self) -> None:
        self.root, self.size = Node(0, 0), 0

    def walk(self, run: tuple[bytes, ...]) -> Node:
        node = self.root
        for word in run:
            if node.children is None:
                node.children = {}
            child = node.children.get(word)
            if child is None:
                crc = zlib.crc32(word if node is self.root else b" " + word, node.crc)
                child = node.children[word] = Node(crc, self.first(crc))
                self.size += 1
            node = child
        return node

    def nodes(self) -> Iterator[Node]:
        left = list((self.root.children or {}).values())
        while left:
            node = left.pop()
            yield node
            if node.children:
                left += node.children.values()


def bucket_counts(df: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has one."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(lambda crc: 0), np.zeros(buckets, np.int64)

        def pass_on() -> None:
            found = [(node.crc, node.value) for node in trie.nodes()]
            if found:
                crc, n = np.array(found, np.int64).T
                np.add.at(totals, crc % buckets, n)
            trie.clear()

        for b in batches:
            for t in b.column("text"):
                for run, times in word_runs(words(t.as_py()), runs):
                    trie.walk(run).value += times
                if trie.size > nodes:
                    pass_on()
        pass_on()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], ["bucket", "n"])

    return df.select(df[text_col].alias("text")).mapInArrow(each, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, nodes: int = NODES) -> np.ndarray:
    """Each bucket's gain in thousandths: the log ratio of its smoothed shares in target and raw. `buckets` rows come to the driver."""

    def counts(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, text_col, runs, buckets, nodes).collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = counts(raw), counts(target)
    total_s, total_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(b) + 1) * total_s / ((float(a) + 1) * total_t))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(id_col: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def scored(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, seed: str = SEED, nodes: int = NODES) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score of each row of df; staged."""
    slim = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("doc_id"), df[text_col].alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    gain = df.sparkSession.sparkContext.broadcast(gains(df, target, text_col, runs, buckets, nodes).tolist())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = gain.value
        trie = Trie(lambda crc: of[crc % buckets])
        for b in batches:
            n_words, n, weight = [], [], []
            for t in b.column("text"):
                found = words(t.as_py())
                n_words.append(len(found))
                n.append(n_features(len(found), runs))
                total = sum(trie.walk(run).value * times for run, times in word_runs(found, runs))
                weight.append(total // n[-1] if n[-1] else 0)
                if trie.size > nodes:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n, weight))], ["row", "doc_id", "n_words", "n_features", "weight"])

    found = slim.mapInArrow(each, f"row bigint, doc_id {kind}, n_words bigint, n_features bigint, weight bigint")
    return staged(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))


def drawn(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scores (staged) with `rank`, from 1 by falling score and rising doc_id, of the rows that are drawn; null of all others."""
    able = F.col("n_words") >= least_words
    steps = sorted(scores.filter(able).groupBy("score").count().collect(), key=lambda r: -r["score"])
    take, reached, least = percent * sum(r["count"] for r in steps) // 100, 0, None
    for r in steps:
        if reached >= take:
            break
        least, reached = r["score"], reached + r["count"]
    if least is None:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    among = able & (F.col("score") >= least)
    # Ranges of the whole order: rows are distinct in it, so no range is larger for ties.
    ranges = staged(scores.filter(among).repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").count()
    ahead = sizes.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = ranges.withColumn("place", place).join(F.broadcast(ahead), "range").withColumn("rank", (F.col("ahead") + F.col("place")).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank"))).select(*scores.columns, "rank")
    return ranked.unionByName(scores.filter(~among).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, seed: str = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of df."""
    return drawn(scored(df, target, id_col, text_col, runs, buckets, seed), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def op12(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL: the table of bytes from the reflected polynomial, then a fold over each distinct word's bytes.
OP12_SQL = r"""
    WITH steps AS (SELECT list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v, i FROM range(256) t(i)),
    crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS v FROM steps),
    both_kinds AS MATERIALIZED (
        SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        UNION ALL
        SELECT 'b', item_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
    found AS MATERIALIZED (SELECT kind, r, word, count(*) AS n FROM (SELECT kind, r, unnest(w) AS word FROM both_kinds) GROUP BY ALL),
    hex_words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM found)),
    crcs AS MATERIALIZED (
        SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                     lambda c, b: xor(c >> 8, v[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
        FROM hex_words, crc_table),
    counts AS (SELECT bucket, sum(n) FILTER (kind = 'd')::BIGINT AS s, sum(n) FILTER (kind = 'b')::BIGINT AS t FROM found JOIN crcs USING (word) GROUP BY bucket),
    totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts),
    gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (tt + 10000))))::BIGINT AS g FROM counts, totals),
    weights AS (SELECT r, sum(n * g)::BIGINT AS total FROM found JOIN crcs USING (word) JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r),
    scored AS (
        SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END::BIGINT AS weight,
               floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
        FROM both_kinds LEFT JOIN weights USING (r) WHERE kind = 'd'),
    numbered AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM numbered"""
