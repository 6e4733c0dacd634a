"""Byte-pair encoding and decoding with a public tokenizer's file, in bounded memory.

Long unsplit text is encoded by tree concatenation, at two levels. A text of over SPREAD characters becomes rows of LEAF_TEXT
characters, which tasks encode in parallel; neighbours are then joined level by level. At a join the pre-tokens in a window
around it are cut anew, and the window grows until its first one is the left side's and its last one begins where the right
side's does: the cut reads forward only, so from there on both agree exactly. A pre-token of over LONG bytes is encoded in
the same way from leaves of LEAF bytes, by pieces; a sequence of pieces is the encoding exactly if each two neighbours are,
so one piece in common on either side is enough. The task that joins a text's leaves holds them as Arrow slices, some three
times the text's bytes, and digests them as a stream. `encoded` keeps each text in one task and joins leaves there.
For all other pre-tokens each worker keeps the pieces of those it has met, up to CACHE entries.

Cases. A null text counts as empty and has no pieces. Strings of special tokens inside a text are those tokens. Characters
beyond a plain set go through the tokenizer's own normaliser and splitter. Rows that repeat an id, or a text, are encoded each.
Extra columns are ignored or kept, by the function. An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.common import slices

CACHE, CACHED_LENGTH = 400_000, 64
LONG, LEAF, WINDOW = 4096, 1024, 8
SPREAD, LEAF_TEXT = 1 << 14, 1 << 13
#: Characters on which Python's classes, its lower() and the tokenizer's rules agree: those outside go the slower way.
UNUSUAL = re.compile(r"[^\t-\r -~\xa0-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-įı-ɏА-я]|<\|")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d|"
BYTE_CUT = re.compile(CONTRACTIONS + r" ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
WORD_CUT = re.compile(CONTRACTIONS + r"[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_chars() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


TO_CHARS = byte_chars()
TO_BYTES = {c: b for b, c in TO_CHARS.items()}


def as_chars(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_CHARS)


def as_bytes(chars: str) -> bytes:
    return chars.translate(TO_BYTES).encode("latin-1")


class Cutter:
    """Cuts texts into pre-tokens like the tokenizer in `path`, and gives the pieces of one."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bare = Tokenizer(self.model)
        self.lower = self.tokenizer.normalizer is not None
        self.cut_plain = (WORD_CUT if self.lower else BYTE_CUT).findall
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self._token_bytes: dict[int, bytes] = {}

    def cut(self, text: str) -> tuple[list[str], bool]:
        """Pre-tokens, normalised; whether special tokens (as their own strings) may be among them."""
        if not UNUSUAL.search(text):
            return self.cut_plain(text.lower() if self.lower else text), False
        out: list[str] = []
        for i, part in enumerate(self.cut_special(text)):
            if i % 2:
                out.append(part)
            elif part:
                whole = self.tokenizer.normalizer.normalize_str(part) if self.lower else part
                out += [as_bytes(chars).decode("utf-8") for chars, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole)]
        return out, any(p in self.special for p in out) if self.special else False

    def ids(self, pre_token: str, special: bool = False) -> list[int]:
        if special and pre_token in self.special:
            return [self.special[pre_token]]
        raw = pre_token.encode("utf-8")
        if len(raw) > LONG and not self.lower:
            return self.tree(raw)
        return [t.id for t in self.model.tokenize(as_chars(raw))]

    def token_bytes(self, i: int) -> bytes:
        found = self._token_bytes.get(i)
        if found is None:
            found = self._token_bytes[i] = as_bytes(self.tokenizer.id_to_token(i))
        return found

    def tree(self, raw: bytes, leaf: int = LEAF) -> list[int]:
        """The pieces of a long pre-token."""
        leaves = [as_chars(raw[i : i + leaf]) for i in range(0, len(raw), leaf)]
        level = [e.ids for e in self.bare.encode_batch(leaves, add_special_tokens=False)]
        while len(level) > 1:
            level = [self.joined(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        k = WINDOW
        while True:
            a, b = left[-k:], right[:k]
            window = [t.id for t in self.model.tokenize(as_chars(b"".join(map(self.token_bytes, a + b))))]
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return left[:-k] + window + right[k:]
            k *= 2


    def cut_tree(self, text: str, leaf: int) -> list[str]:
        """The pre-tokens of a long text, from leaves. Only for tokenizers that don't normalise."""
        level = [self.cut(text[i : i + leaf])[0] for i in range(0, len(text), leaf)]
        while len(level) > 1:
            level = [self.joined_cut(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def joined_cut(self, left: list[str], right: list[str]) -> list[str]:
        a, window, b = self.recut(left, right)
        return left[:a] + window + right[b:]

    def recut(self, left: Sequence, right: Sequence) -> tuple[int, list[str], int]:
        """(pre-tokens of left that stay, what stands between, pre-tokens of right that go). Of Arrow columns only windows are
        made Python's."""
        k = WINDOW
        while True:
            a, b = (x if isinstance(x, list) else x.to_pylist() for x in (left[-k:], right[:k]))
            window = self.cut("".join(a + b))[0]
            if (k >= len(left) or window[0] == a[0]) and (k >= len(right) or window[-1] == b[-1]):
                return max(0, len(left) - k), window, min(k, len(right))
            k *= 2


@lru_cache(maxsize=4)
def cutter(path: str) -> Cutter:
    """One for each worker process."""
    return Cutter(path)


class Kept(dict):
    """A bounded memo of make(key): what doesn't fit is made anew each time."""

    def __init__(self, make, most: int = CACHE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) <= CACHED_LENGTH:
            self[key] = value
        return value


@lru_cache(maxsize=4)
def memo_of_ids(path: str) -> Kept:
    c = cutter(path)
    return Kept(lambda p: ",".join(map(str, c.ids(p))))


@lru_cache(maxsize=4)
def memo_of_bytes(path: str) -> Kept:
    c = cutter(path)
    return Kept(lambda ids: b"".join([c.token_bytes(int(i)) for i in ids.split(",")]) if ids else b"")


def encode(text: str | None, path: str) -> list[str]:
    """The text's ids as decimal strings joined by commas, one for each pre-token."""
    c, text = cutter(path), text or ""
    if len(text) > LEAF_TEXT and not c.lower:
        return ids_of(c.cut_tree(text, LEAF_TEXT), path)
    pre, special = c.cut(text)
    return ids_of(pre, path) if special else list(map(memo_of_ids(path).__getitem__, pre))


def ids_of(pre: list[str], path: str) -> list[str]:
    """The ids of each pre-token, special tokens among them."""
    c, known = cutter(path), memo_of_ids(path)
    return [",".join(map(str, c.ids(p, True))) if p in c.special else known[p] for p in pre]


def decode(ids: list[str], path: str) -> str:
    """The text of ids as encode() gives them; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(memo_of_bytes(path).__getitem__, ids)).decode("utf-8", "replace")


def encoded(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """`doc`: the row of df as a struct, whatever its columns are named, and its ids. Each text is encoded in one task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            ids = [[int(i) for p in encode(t.as_py(), path) if p for i in p.split(",")] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(ids, pa.list_(pa.int32()))], ["doc", "ids"])

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), df[text_col].alias("text"))
    return rows.mapInArrow(each, f"doc {rows.schema['doc'].dataType.simpleString()}, ids array<int>")


def decoded(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`doc`: the row of df, but its ids, as a struct, and the text of its ids; of null the empty text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            text = [decode([str(i) for i in ids.as_py() or []], path) for ids in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(text, pa.string())], ["doc", "text"])

    rows = df.select(F.struct(*[df[c] for c in df.columns if c != ids_col]).alias("doc"), df[ids_col].alias("ids"))
    return rows.mapInArrow(each, f"doc {rows.schema['doc'].dataType.simpleString()}, text string")


class Digests:
    """Number and digest of ids, and digest of the text they decode to, part by part."""

    def __init__(self, path: str):
        self.of_ids, self.of_text, self.n = hashlib.sha256(), hashlib.sha256(), 0
        self.bytes_of, self.text_of = memo_of_bytes(path).__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: list[str]) -> None:
        """ids: strings of ids joined by commas."""
        if ids:
            joined = ",".join(ids)
            self.of_ids.update(("," + joined if self.n else joined).encode())
            self.n += joined.count(",") + 1
            self.of_text.update(self.text_of.decode(b"".join(map(self.bytes_of, ids))).encode("utf-8"))

    def done(self) -> tuple[int, str, str]:
        self.of_text.update(self.text_of.decode(b"", True).encode("utf-8"))
        return self.n, self.of_ids.hexdigest(), self.of_text.hexdigest()


def digests(ids: list[str], path: str) -> tuple[int, str, str]:
    out = Digests(path)
    out.add(ids)
    return out.done()


def lengths(of: Iterable) -> bytes:
    """The width of a number, and then the numbers in that many bytes each."""
    n = np.fromiter(map(len, of), "<u4")
    width = next(w for w in (1, 2, 4) if not len(n) or n.max() < 1 << 8 * w)
    return bytes([width]) + n.astype(f"<u{width}").tobytes()


def strings(raw: bytes, cut: bytes) -> pa.ChunkedArray:
    """raw, UTF-8, in parts of so many bytes, without a copy."""
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(cut, f"<u{cut[0]}", offset=1), dtype=np.int64))).astype(np.int32)
    return pa.chunked_array([pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw))])


def leaf_texts(text: Column, leaf: int) -> Column:
    """The text in parts of `leaf` characters, read once from front to back."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0))


def round_trip_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", spread: int = SPREAD, leaf: int = LEAF_TEXT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    slim = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    out = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [digests(encode(t.as_py(), path), path) for t in b.column("text")]
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            cut, ids, ends = [], [], []
            for t in b.column("leaf"):
                text = t.as_py()
                pre = cutter(path).cut(text)[0]
                of_pre = ids_of(pre, path)
                cut.append(lengths(pre if text.isascii() else [p.encode("utf-8") for p in pre]))
                ids.append("".join(of_pre))
                ends.append(lengths(of_pre))
            cols = [*map(b.column, ("row", "doc_id", "part", "leaf")), pa.array(cut, pa.binary()), pa.array(ids, pa.string()), pa.array(ends, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "part", "leaf", "cut", "ids", "ends"])

    def join(leaf_rows: pa.Table) -> pa.Table:
        c, leaf_rows = cutter(path), leaf_rows.sort_by("part")
        sides = [[strings(x.as_buffer(), y.as_py()) for x, y in zip(leaf_rows.column(of), leaf_rows.column(at), strict=True)] for of, at in (("leaf", "cut"), ("ids", "ends"))]
        level = list(zip(*sides, strict=True))
        while len(level) > 1:
            above = level[-1:] if len(level) % 2 else []
            pairs = []
            for (lp, li), (rp, ri) in zip(level[::2], level[1::2], strict=False):
                a, window, n = c.recut(lp, rp)
                pairs.append(tuple(pa.chunked_array([*x[:a].chunks, pa.array(w, pa.string()), *y[n:].chunks]) for x, w, y in ((lp, window, rp), (li, ids_of(window, path), ri))))
            level = pairs + above
        whole = Digests(path)
        for part in level[0][1].chunks:
            whole.add(part.to_pylist())
        n, of_ids, of_text = whole.done()
        return pa.table([leaf_rows.column("doc_id").slice(0, 1), pa.array([n], pa.int64()), pa.array([of_ids]), pa.array([of_text])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    if cutter(path).lower:
        return slim.mapInArrow(each, out)
    n = F.coalesce(F.length("text"), F.lit(0))
    short = slim.filter(n <= spread).mapInArrow(each, out)
    # row stands for a document from here to its join: the rows are dealt by it, so it is written down in the shuffle.
    long = slim.filter(n > spread).withColumn("row", F.monotonically_increasing_id())
    kind = slim.schema["doc_id"].dataType.simpleString()
    cut = long.select("row", "doc_id", F.posexplode(leaf_texts(F.col("text"), leaf)).alias("part", "leaf")).repartition("row", "part").mapInArrow(leaves, f"row bigint, doc_id {kind}, part int, leaf string, cut binary, ids string, ends binary")
    return short.unionByName(cut.groupBy("row").applyInArrow(join, out))
