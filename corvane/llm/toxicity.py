"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs between white space and ASCII punctuation, A-Z in lower case. A document's features are the presence of its
words, of their stems, of its word pairs and of pairs with one word between, hashed to 2**BITS. Each coordinate has its own learning rate,
and L1 keeps most weights at zero, so that the model is a short list of (feature, weight) of at most 2**BITS rows: that is
what is broadcast.

The model is fitted on a bounded sample of labelled rows: FIT_ROWS of each class are expected, chosen by a hash of the id;
classes keep their shares by weight. It is broadcast as ids before any text is read, so that only the sample's texts are
shuffled, one for each id. Their features are made in parallel; the one task that takes the steps, whose order matters, gets
the sorted numbers of distinct features alone, 2**BITS for a row at most. All documents are scored, whole. Rates, L1 and the
stem length were chosen by cross-validation among the three folds that are learned from, on tables of 10,000 and 51,000 documents.

Cases. A null text counts as empty and gets the bias alone; a very long one is taken in blocks of words. Labels other than 0
and 1 don't count, null among them, and of labels that repeat an id the largest counts. Documents that repeat an id teach once,
by their least text; each of their rows is scored. Without labels of both classes every score is 0. Extra columns are ignored
or kept, by the function. An empty table gives an empty result, and empty labels a score of 0.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import held_out, slices, staged

BITS, FIT_ROWS, EPOCHS = 20, 8_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
#: The first bytes of a word stand for its stem.
STEM = 4
#: Words taken at once, so that a very long text needs no more memory than this.
WORD_BLOCK = 1 << 18
TO_WORDS = bytes(32 if chr(b) in string.punctuation and b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def features(text: str | None, bits: int = BITS) -> Iterator[np.ndarray]:
    """Blocks of feature numbers, repeats included; 0 is the bias and comes first."""
    yield np.zeros(1, np.int64)
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()
    for at in range(0, len(words), WORD_BLOCK):
        part = words[at : at + WORD_BLOCK + 2]
        h = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
        own = min(WORD_BLOCK, len(part))
        stems = np.fromiter([zlib.crc32(w[:STEM]) for w in part[:own]], np.uint32, own) * MIX[2] + MIX[0]
        for x in (h[:own] * MIX[0], stems, (h[:-1] * MIX[1] + h[1:] * MIX[0])[:own], (h[:-2] * MIX[2] + h[2:] * MIX[0] + MIX[1])[:own]):
            yield 1 + ((x ^ (x >> np.uint32(15))) * MIX[1] >> np.uint32(32 - bits)).astype(np.int64) % ((1 << bits) - 1)


def score(text: str | None, weights: np.ndarray, bits: int = BITS) -> float:
    hit = [f[weights[f] != 0] for f in features(text, bits)]
    return float(1 / (1 + np.exp(-np.clip(weights[np.unique(np.concatenate(hit))].sum(), -35, 35))))


def fit(rows: list[tuple[np.ndarray, int, float]], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from (distinct features, label, weight) in this order; per-coordinate FTRL-proximal steps."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weight(f: np.ndarray) -> np.ndarray:
        # The bias is not held back by L1.
        most = np.where(f == 0, 0.0, L1)
        return -np.sign(z[f]) * np.maximum(np.abs(z[f]) - most, 0) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)

    for _ in range(epochs):
        for f, label, share in rows:
            w = weight(f)
            g = share * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label)
            root = np.sqrt(n[f])
            n[f] += g * g
            z[f] += g - (np.sqrt(n[f]) - root) / ALPHA * w
    return weight(np.arange(1 << bits))


def sample_labels(labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """doc_id, label, share: fit_rows of each class at most, by expectation; staged, to be broadcast."""
    ids = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    ids = staged(ids.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}
    part = {k: min(1.0, fit_rows / v) for k, v in counts.items()}
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) / 1_000_000
    if not {0, 1} <= part.keys():
        return ids.limit(0).withColumn("share", F.lit(1.0))
    most = max(part.values())
    # A row stands for 1 / p rows, by the class that is sampled least: the weighted classes have the ratio of all labels, at any size.
    kept = [ids.filter((F.col("label") == k) & (dealt < p)).withColumn("share", F.lit(most / p)) for k, p in part.items()]
    both = kept[0]
    for k in kept[1:]:
        both = both.unionByName(k)
    return staged(both)


def model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Weights fitted to the labels of documents outside the held-out fold."""
    chosen = sample_labels(labels, id_col, label_col, fit_rows)
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label", "share").agg(F.min("text").alias("text"))

    kind = texts.schema["doc_id"].dataType.simpleString()

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            found = [np.unique(np.concatenate(list(features(t.as_py())))).astype(np.int32) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*map(b.column, ("doc_id", "label", "share")), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "share", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for i, f, label, share in zip(b.column("doc_id").to_pylist(), b.column("features"), b.column("label").to_pylist(), b.column("share").to_pylist(), strict=True):
                rows.append((zlib.crc32(str(i).encode()), i, f.values.to_numpy(), label, share))
        rows.sort(key=lambda r: r[:2])
        if {r[3] for r in rows} >= {0, 1}:
            w = fit([r[2:] for r in rows])
            kept = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(w[kept])], ["feature", "weight"])

    found = texts.mapInArrow(featured, f"doc_id {kind}, label int, share double, features array<int>").repartition(1).mapInArrow(train, "feature bigint, weight double").toPandas()
    weights = np.zeros(1 << BITS)
    weights[found["feature"].to_numpy(np.int64)] = found["weight"].to_numpy(float)
    if not len(found):
        weights[0] = -35.0
    return weights


def scored(df: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """`doc`: the row of df as a struct, whatever its columns are named, and score."""
    spark = df.sparkSession
    kept = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast((kept, weights[kept]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[sent.value[0]] = sent.value[1]
        for b in batches:
            s = [score(t.as_py(), w) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(s, pa.float64())], ["doc", "score"])

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), df[text_col].alias("text"))
    return rows.mapInArrow(each, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of df."""
    w = model(df, labels, id_col, text_col, label_col, fit_rows)
    out = scored(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), w)
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """df without the rows predicted toxic; all its columns as they were."""
    w = model(df, labels, id_col, text_col, label_col)
    return scored(df, w, text_col).filter(F.col("score") < THRESHOLD).select("doc.*")
