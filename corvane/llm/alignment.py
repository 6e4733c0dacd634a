"""Alignment of two tokenizers over a corpus: groups between common byte offsets, links of ids, and each id's best counterpart.

Texts are cut into units where a character that isn't white space stands before a space, and where a letter stands before a mark:
there a token of either tokenizer ends, whatever stands around it (checked for the pieces of B when it is loaded). A unit is encoded
once for each worker, by both, and aligned; a document's groups are those of its units in order. Links of a unit are kept as distinct pairs of ids with how often they
occur, never as occurrences.

Links travel in chunks: up to CHUNK pairs of documents of one task, dealt into STRIPES by A's id, each pair once with the places of
the documents that hold it. A stripe has the ids that are equal modulo STRIPES, so that neighbouring, frequent ids are spread. For
each stripe the chunks' counts are added into a dense block of its A ids by all B ids with np.add.at, FAN chunks at a time, and blocks
of blocks beyond that; a row's maximum gives the best. The links of a stripe are scored beside its counts, again FAN chunks in a
group, so that a stripe that holds a third of all links is many groups; what a chunk's documents get from the stripes is summed
last. No group grows with the corpus: blocks are STRIPES-th parts of the vocabularies' product, groups are FAN chunks, sums a chunk.

Cases. Without tokens, all zeros and '': null or empty texts, and those whose bytes either tokenizer doesn't give back (U+2581 in the
text). Rows that repeat an id, or a text, count and are scored each. A very long text is a chunk of its own, and its longest unit
without a space is encoded whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from tokenizers import Tokenizer

from corvane.llm.bpe import as_bytes
from corvane.llm.common import shared_folder, slices, staged, table

STRIPES, CHUNK, CHUNK_DOCS, FAN = 128, 1 << 20, 1 << 14, 64
#: Units that a worker keeps.
KEPT = 300_000
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Letters on which Python and A's rules agree, and marks that no piece of B has behind one.
LETTER, MARKS = "A-Za-zÀ-ÖØ-öø-ɏА-я", ".,;:!?)'\"-"
UNIT = re.compile(f"(?s) ?[{LETTER}]+(?=[{re.escape(MARKS)} ]|\\Z)|.+?(?:(?<=\\S)(?= )|(?<=[{LETTER}])(?=[{re.escape(MARKS)}])|\\Z)")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as hold them, that width first."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(numbers) or numbers.max() < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def units_of(text: str) -> list[str]:
    """The text, behind a space, in parts that may be encoded alone. A single space at the end belongs to the part before."""
    units = UNIT.findall(" " + text)
    if units[-1] == " " and len(units) > 1:
        units[-2:] = [units[-2] + " "]
    return units


class Aligner:
    """The two tokenizers, and the units that have been met: numbers, text of groups, linked pairs."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [as_bytes(self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece of B has a space behind another character: units can't be encoded alone")
        if any(re.search(f"[{LETTER}][{re.escape(MARKS)}]", p) for p in pieces if not BYTE_PIECE.fullmatch(p)):
            raise ValueError("a piece of B has a mark behind a letter: units can't be encoded alone")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode("utf-8") for p in pieces]
        self.width = len(pieces)
        self.a_text, self.b_text = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(self.width)]
        self.clear()

    def clear(self) -> None:
        self.id_of: dict[str, int] = {}
        self.groups: list[str | None] = []
        self.counts, self.keys, self.times, self.ends = array("q"), array("q"), array("q"), array("q", [0])

    def add(self, units: list[str]) -> None:
        """Encodes and aligns units that are new."""
        ids_a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        # Behind a letter B puts no space before a unit, and the letter is the first piece.
        ids_b = self.b.encode([u[1:] if u[0] == " " else "a" + u for u in units], num_threads=1)
        for u, a, b in zip(units, ids_a, ids_b, strict=True):
            self.id_of[u] = len(self.groups)
            counts, text, pairs = self.aligned(u.encode("utf-8"), a, b if u[0] == " " else b[1:])
            self.groups.append(text)
            self.counts.extend(counts)
            self.keys.extend(pairs.keys())
            self.times.extend(pairs.values())
            self.ends.append(len(self.keys))

    def aligned(self, raw: bytes, a: list[int], b: list[int]) -> tuple[tuple[int, ...], str | None, dict[int, int]]:
        """Counts, text of the groups (None if the bytes differ), and how often each pair of ids, a * width + b, is linked."""
        of_a, of_b, pairs = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b], {}
        if b"".join(of_a) != raw or b"".join(of_b) != raw:
            return (0, 0, 0, 0), None, pairs
        names_a, names_b, w = [self.a_text[i] for i in a], [self.b_text[i] for i in b], self.width
        text, links, i, j, n = [], 0, 0, 0, len(a)
        while i < n:
            i0, j0, ahead = i, j, len(of_a[i]) - len(of_b[j])
            i, j = i + 1, j + 1
            while ahead:
                if ahead < 0:
                    ahead, i = ahead + len(of_a[i]), i + 1
                else:
                    ahead, j = ahead - len(of_b[j]), j + 1
            if i - i0 == 1 == j - j0:
                text.append(f"{names_a[i0]}|{names_b[j0]}")
                key, links = a[i0] * w + b[j0], links + 1
                pairs[key] = pairs.get(key, 0) + 1
                continue
            text.append(",".join(names_a[i0:i]) + "|" + ",".join(names_b[j0:j]))
            links += (i - i0) * (j - j0)
            # Distinct ids of the group, never its occurrences.
            other = list(Counter(b[j0:j]).items())
            for x, m in Counter(a[i0:i]).items():
                for y, k in other:
                    key = x * w + y
                    pairs[key] = pairs.get(key, 0) + m * k
        return (n, len(b), len(text), links), ";".join(text), pairs


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    return Aligner(a_path, b_path)


class Chunk:
    """Documents of a task, as the units that they have, until there are enough."""

    def __init__(self, of: Aligner):
        self.of, self.docs, self.pairs = of, 0, 0
        self.places, self.units, self.times = [], [], []

    def add(self, ids: np.ndarray) -> None:
        """The next document's units; none if it has no tokens."""
        units, times = np.unique(ids, return_counts=True)
        ends = np.frombuffer(self.of.ends, np.int64)
        self.pairs += int((ends[units + 1] - ends[units]).sum())
        del ends
        self.places.append(np.full(len(units), self.docs, np.int64))
        self.units.append(units)
        self.times.append(times)
        self.docs += 1

    def stripes(self, stripes: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """stripe, and packed: pairs' keys in the stripe's block, documents of each, their places, times in each document."""
        units, place, doc_times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.units, self.places, self.times))
        ends, w = np.array(self.of.ends, np.int64), self.of.width
        n = ends[units + 1] - ends[units]
        if not n.sum():
            return
        known, number = np.unique(np.array(self.of.keys, np.int64), return_inverse=True)
        a, b = np.divmod(known, w)
        stripe, local = a % stripes, a // stripes * w + b
        order = np.lexsort((local, stripe))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # The pairs of each unit of each document, one after the other, then those of a document that are the same together.
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[units], n)
        times = np.array(self.of.times, np.int64)[at] * np.repeat(doc_times, n)
        both = rank[number][at] * self.docs + np.repeat(place, n)
        sort = np.argsort(both)
        both = both[sort]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        total = np.add.reduceat(times[sort], first)
        pair, place = np.divmod(both[first], self.docs)
        docs = np.bincount(pair, minlength=len(order))
        # Of all pairs of the units kept those that this chunk has.
        used = np.flatnonzero(docs)
        stripe, local, docs = stripe[order][used], local[order][used], docs[used]
        first = np.concatenate(([0], np.cumsum(docs)))
        for s in np.unique(stripe).tolist():
            lo, hi = np.searchsorted(stripe, [s, s + 1])
            x, y = first[lo], first[hi]
            yield s, packed(local[lo:hi]), packed(docs[lo:hi]), packed(place[x:y]), packed(total[x:y])


def links(docs: DataFrame, a_path: str, b_path: str, stripes: int = STRIPES, chunk: int = CHUNK) -> DataFrame:
    """Of documents (doc_id, text), staged in two kinds: `links` 0, a row for each document (chunk, place, doc_id, the counts,
    groups_sha256), and 1, a row for each chunk and stripe (chunk, stripe, keys, docs, places, times)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"links int, chunk bigint, place int, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, stripe int, keys binary, docs binary, places binary, times binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(a_path, b_path)
        name, made, now = TaskContext.get().partitionId() << 32, 0, Chunk(of)
        types = None

        def batch(cols: dict[str, list | pa.Array], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([x if isinstance(x := cols.get(f.name), pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for f in types], schema=types)

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal made, now
            found = list(zip(*now.stripes(stripes), strict=True))
            if found:
                yield batch({"links": [1] * len(found[0]), "chunk": [name + made] * len(found[0]), **dict(zip(("stripe", "keys", "docs", "places", "times"), map(list, found), strict=True))}, len(found[0]))
            made, now = made + 1, Chunk(of)

        for b in (part for whole in batches for part in slices(whole)):
            if types is None:
                binary = [(c, pa.binary()) for c in ("keys", "docs", "places", "times")]
                types = pa.schema([("links", pa.int32()), ("chunk", pa.int64()), ("place", pa.int32()), ("doc_id", b.schema.field("doc_id").type), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("stripe", pa.int32()), *binary])
            cut = [units_of(t) if t else [] for t in b.column("text").to_pylist()]
            if len(of.groups) > KEPT:
                yield from written()
                of.clear()
                now = Chunk(of)
            if new := list(dict.fromkeys(u for units in cut for u in units if u not in of.id_of)):
                of.add(new)
            counts, digests, at, places = [], [], [], []
            per_unit = np.array(of.counts, np.int64).reshape(-1, 4)
            for units in cut:
                text = None
                if units:
                    ids = list(map(of.id_of.__getitem__, units))
                    found = [of.groups[i] for i in ids]
                    text, ids = None if None in found else ";".join(found), np.array(ids, np.int64)
                at.append(name + made)
                places.append(now.docs)
                if text is None:
                    now.add(np.zeros(0, np.int64))
                    counts.append((0, 0, 0, 0))
                else:
                    now.add(ids)
                    counts.append(per_unit[ids].sum(axis=0).tolist())
                digests.append("" if text is None else hashlib.sha256(text.encode()).hexdigest())
                if now.pairs >= chunk or now.docs >= CHUNK_DOCS:
                    yield from written()
            cols = dict(zip(COUNTS, map(list, zip(*counts, strict=True)), strict=True))
            yield batch({"links": [0] * b.num_rows, "chunk": at, "place": places, "doc_id": b.column("doc_id"), "groups_sha256": digests} | cols, b.num_rows)
        if types is not None:
            yield from written()

    folder = shared_folder(docs.sparkSession)
    made = docs.mapInArrow(each, schema)
    made.write.partitionBy("links").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema(StructType([*[f for f in made.schema if f.name != "links"], StructField("links", IntegerType())])).parquet(folder)


def pair_counts(linked: DataFrame, chunks: int, n_b: int, fan: int = FAN) -> DataFrame:
    """stripe, keys, docs, best (packed): the pairs of each stripe that occur, in order, how many documents hold each, and whether that
    is the most for its A id. A row for each stripe. Staged."""
    def added(group: pa.Table, last: bool) -> pa.Table:
        each = [(unpacked(k.as_py()), unpacked(d.as_py())) for k, d in zip(group.column("keys"), group.column("docs"), strict=True)]
        # The stripe's rows that occur, each as wide as B's vocabulary.
        rows = np.unique(np.concatenate([np.unique(keys // n_b) for keys, _ in each]))
        block = np.zeros((len(rows), n_b), np.int64)
        for keys, docs in each:
            np.add.at(block.reshape(-1), np.searchsorted(rows, keys // n_b) * n_b + keys % n_b, docs)
        found = np.flatnonzero(block)
        n = block.reshape(-1)[found]
        best = n == block.max(axis=1)[found // n_b]
        found = rows[found // n_b] * n_b + found % n_b
        cols = [group.column("stripe").slice(0, 1), pa.array([packed(found)]), pa.array([packed(n)])]
        return pa.table([*cols, pa.array([packed(best)])] if last else [*cols, group.column("part").slice(0, 1)], ["stripe", "keys", "docs", "best" if last else "part"])

    left, parts = chunks, linked.select("stripe", "keys", "docs", F.xxhash64("chunk").alias("part"))
    while left > fan:
        left = -(-left // fan)
        parts = parts.withColumn("part", F.pmod("part", F.lit(left))).groupBy("stripe", "part").applyInArrow(lambda g: added(g, False), "stripe int, keys binary, docs binary, part bigint")
        parts = parts.withColumn("part", F.xxhash64("part"))
    return staged(parts.groupBy("stripe").applyInArrow(lambda g: added(g, True), "stripe int, keys binary, docs binary, best binary"))


def shares(linked: DataFrame, counts: DataFrame, chunks: int, fan: int = FAN) -> DataFrame:
    """chunk, places, n_best, count_sum (packed): what the links of a stripe give the documents of a chunk."""
    groups = max(1, -(-chunks // fan))

    def scored(links: pa.Table, known: pa.Table) -> pa.Table:
        out: tuple[list, ...] = [], [], [], []
        if links.num_rows:
            keys, n, best = (unpacked(known.column(c)[0].as_py()) for c in ("keys", "docs", "best"))
            for r in links.to_batches(max_chunksize=1):
                mine, docs, places, times = (unpacked(r.column(c)[0].as_py()) for c in ("keys", "docs", "places", "times"))
                at = np.repeat(np.searchsorted(keys, mine), docs)
                n_best, total = np.zeros(places.max() + 1, np.int64), np.zeros(places.max() + 1, np.int64)
                np.add.at(n_best, places, best[at] * times)
                np.add.at(total, places, n[at] * times)
                some = np.flatnonzero(total)
                for col, x in zip(out, (r.column("chunk")[0].as_py(), packed(some), packed(n_best[some]), packed(total[some])), strict=True):
                    col.append(x)
        return pa.table([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], ["chunk", "places", "n_best", "count_sum"])

    dealt = linked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups))).select("stripe", "part", "chunk", "keys", "docs", "places", "times")
    beside = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("part"), "keys", "docs", "best")
    return dealt.groupBy("stripe", "part").cogroup(beside.groupBy("stripe", "part")).applyInArrow(scored, "chunk bigint, places binary, n_best binary, count_sum binary")


def summed(docs: DataFrame, of_stripes: DataFrame) -> DataFrame:
    """docs (chunk, place, ...) with n_best and count_sum."""
    kept = [f for f in docs.schema if f.name not in ("chunk", "place")]
    names = [f.name for f in kept]

    def joined(rows: pa.Table, parts: pa.Table) -> pa.Table:
        size = max([0, *rows.column("place").to_pylist()]) + 1
        n_best, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for r in parts.to_batches(max_chunksize=1):
            places, *values = (unpacked(r.column(c)[0].as_py()) for c in ("places", "n_best", "count_sum"))
            n_best[places] += values[0]
            total[places] += values[1]
        at = rows.column("place").to_numpy().astype(np.int64)
        return pa.table([*map(rows.column, names), pa.array(n_best[at]), pa.array(total[at])], [*names, "n_best", "count_sum"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return docs.groupBy("chunk").cogroup(of_stripes.groupBy("chunk")).applyInArrow(joined, f"{out}, n_best bigint, count_sum bigint")


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of df."""
    found = links(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")), a_path, b_path, stripes, chunk)
    linked = found.filter("links = 1")
    chunks = linked.select("chunk").distinct().count()
    counts = pair_counts(linked, chunks, aligner(a_path, b_path).width, fan)
    docs = found.filter("links = 0").select("chunk", "place", "doc_id", *COUNTS, "groups_sha256")
    return summed(docs, shares(linked, counts, chunks, fan)).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")


def best_pairs(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", stripes: int = STRIPES, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """a, b, docs: for each id of A that is linked, the ids of B that most documents link it to, ties included."""
    found = links(df.select(F.lit(None).cast("int").alias("doc_id"), df[text_col].alias("text")), a_path, b_path, stripes, chunk).filter("links = 1")
    width = aligner(a_path, b_path).width
    counts = pair_counts(found, found.select("chunk").distinct().count(), width, fan)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (row for b in batches for row in slices(b, 1)):
            keys, n, best = (unpacked(r.column(c)[0].as_py()) for c in ("keys", "docs", "best"))
            keys, n = keys[best > 0], n[best > 0]
            yield pa.RecordBatch.from_arrays([pa.array(keys // width * stripes + r.column("stripe")[0].as_py()), pa.array(keys % width), pa.array(n)], ["a", "b", "docs"])

    return counts.mapInArrow(each, "a bigint, b bigint, docs bigint")


def op13(spark, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
