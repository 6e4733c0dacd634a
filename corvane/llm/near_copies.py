"""Near copies by SimHash and the Jaccard similarity of word shingles: how the pipeline applies the SimHash operator.

A text is the set of its shingles of SIZE words. Two texts are linked if their similarity is SIMILARITY or more; a link is
always verified on the whole sets. Candidates come first from the multi-index hashing of `simhash`: texts whose fingerprints of
SIZE-word shingles differ in DISTANCE bits or fewer. That alone can't reach a similarity of 0.8, at which a share of 0.15 of the
bits differs, 9.7 of 64, with a deviation of 2.9: balls that catch 16 of 64 bits hold much of the index. So texts also are
candidates if they share one of BANDS bands of ROWS minima each: at a similarity of 0.8, one link in 140,000 shares none,
(1 - 0.8**5)**30; above it, fewer. A band's rows are dealt into blocks, each pair of blocks is one key of a join, so that no band
is capped.

Two bounds that lose no link rule candidates out before their texts are read: the ratio of the sizes, and the parities of
the shingles' hashes in 512 bits, which differ in no more places than the sets do. First the links of the fingerprints, and each
row of a band with its least, are verified; then pairs of a band that these links have not connected. Classes are the components
of the links.

Cases. Equal sets are linked as they are: null, empty and white-space texts, too. Fewer words than a shingle needs are one. Rows
that repeat an id, or have none, are rows of their own; of each class one row is kept, one with its smallest id. Very long texts
are hashed in blocks. Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.common import drop_rows, keyed_text, row_key, staged
from corvane.llm.simhash import SEED, all_but_first, components, majority, shingle_hashes

SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS, BLOCK, BITS = 30, 5, 1024, 512
_RANDOM = np.random.default_rng(SEED)
TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, size)]))


def band_keys(h: np.ndarray) -> np.ndarray:
    least = np.full(len(TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 256):
        np.minimum(least, (h[at : at + 256, None] * TIMES + PLUS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def parities(h: np.ndarray) -> np.ndarray:
    odd = np.bincount((h >> np.uint64(32)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def described(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest of the shingle set, fingerprint, n of distinct shingles, bits, keys of documents (row, doc_id, text)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, fp, n, bits, keys = [], [], [], [], []
            for t in b.column("text"):
                h = shingles(t.as_py())
                # Of the distinct ones: texts of equal sets have equal fingerprints.
                fp.append(np.uint64(majority([h])).astype(np.int64))
                digest.append(xxhash.xxh128_hexdigest(h.tobytes()))
                n.append(len(h))
                bits.append(parities(h))
                keys.append(band_keys(h) if len(h) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(digest), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["row", "doc_id", "digest", "fp", "n", "bits", "keys"])

    return docs.mapInArrow(each, f"row {kinds['row']}, doc_id {kinds['doc_id']}, digest string, fp bigint, n bigint, bits array<bigint>, keys array<bigint>")


def possible(a: str, b: str, similarity: float) -> Column:
    """Whether the bounds leave it open that two sets are similar enough."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(BITS // 64)), F.lit(0))
    return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6) & (differ * (1 + similarity) <= (n + m) * (1 - similarity) + 1e-6)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """a, b: those of pairs whose whole shingle sets are similar enough; staged."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, right = None, None
        for batch in batches:
            out = []
            for b, s, t in zip(batch.column("b").to_pylist(), batch.column("s"), batch.column("t"), strict=True):
                if b != last:
                    last, right = b, shingles(t.as_py())
                out.append(jaccard(shingles(s.as_py()), right) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "near"])

    return staged(both.select("a", "b", "s", "t").mapInArrow(each, "a bigint, b bigint, near boolean").filter("near").select("a", "b"))


def links(nodes: DataFrame, texts_of: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, root of all linked nodes (node, row, fp, n, bits, keys; staged). texts_of: row, text."""
    by_fp = staged(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("count")))
    alike = simhash.links(by_fp.select("fp"))
    to_least = nodes.select("node", "fp").join(by_fp.filter("count > 1"), "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    across = alike.join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    near = staged(to_least.unionByName(across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))))
    entries = staged(nodes.select("node", F.explode("keys").alias("key")))
    bands = entries.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("least")).filter("count > 1")
    met = staged(entries.join(bands, "key"))
    in_question = met.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node"))).distinct()
    sets = staged(nodes.join(in_question, "node").select("node", "row", "n", "bits"))
    texts = staged(sets.select("node", "row").join(texts_of, "row").select("node", "text"))
    sets = sets.drop("row")
    stars = met.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(near).distinct()
    stars = stars.join(sets.select(F.col("node").alias("a"), F.struct("n", "bits").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.struct("n", "bits").alias("y")), "b")
    edges = verified(stars.filter(possible("x", "y", similarity)).select("a", "b"), texts, similarity)
    roots = components(edges)
    # What the stars left apart: pairs of a band in different components.
    apart = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = apart.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    apart = staged(apart.join(mixed, "key").join(sets, "node").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")))
    own, others = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = apart.select("key", "node", "root", "n", "bits", own.alias("i"), others.alias("j")).alias("x")
    y = apart.select("key", "node", "root", "n", "bits", own.alias("j"), others.alias("i")).alias("y")
    met_again = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    pairs = x.join(y, met_again & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & possible("x", "y", similarity))
    more = verified(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), texts, similarity)
    return roots if more.isEmpty() else components(edges.unionByName(more))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, root (of the component), component_id: one row for each row of df, whose row keys it takes."""
    keyed = keyed_text(df, id_col, text_col)
    docs = staged(described(keyed))
    sets = docs.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("keys").alias("keys"))
    nodes = staged(sets.withColumn("node", F.monotonically_increasing_id()))
    roots = links(nodes, keyed.select("row", "text"), similarity)
    named = nodes.select("node", "digest", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = staged(named.join(ids, "root").select("digest", "root", "component_id"))
    return docs.select("row", "doc_id", "digest").join(by_set, "digest").select("row", "doc_id", "root", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """df with one row of each component, that with the smallest id; all its columns as they were."""
    df, _ = row_key(df)
    groups = staged(near_groups(df, id_col, text_col, similarity))
    return drop_rows(df, all_but_first(groups))
