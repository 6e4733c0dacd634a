"""Best-fit packing of token sequences after dominance reduction.

Only lengths matter to packing, and there are CAPACITY of them, so the instance is a histogram: its size doesn't depend on
the input. The driver reduces it by dominance (Martello and Toth): going down the lengths, a piece is fixed together with
the few pieces that dominate every other set it could share a sequence with, as many times as their counts allow. What
is left is packed best-fit decreasing, also by whole classes of equal sequences. The plan says for each length which ranks
go to which sequences and offsets; pieces are ranked within their length by distributed parts, and each finds its place
by a binary search in the plan, which has a bounded number of entries.

Cases. A null text counts as empty: it has the end id alone. Only a document of over CAPACITY ids is cut, into pieces of
CAPACITY ids and a rest. Rows that repeat an id are packed each. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.bpe import Kept, cutter
from corvane.llm.common import staged
from corvane.llm.sharding import ranked

CAPACITY, END_ID = 4096, 1
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]

#: multiplicity of a sequence, and its (length, times) in order
Pattern = tuple[int, tuple[tuple[int, int], ...]]


@lru_cache(maxsize=4)
def memo_of_words(path: str) -> Kept:
    c = cutter(path)
    return Kept(lambda p: np.array(c.ids(p), "<u4").tobytes())


def encoded(text: str | None, path: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers."""
    pre, special = cutter(path).cut(text or "")
    if special:
        c = cutter(path)
        return b"".join(np.array(c.ids(p, True), "<u4").tobytes() for p in pre)
    return b"".join(map(memo_of_words(path).__getitem__, pre))


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; with_ids: and the ids, as little-endian unsigned 32-bit integers."""
    end = np.array([end_id], "<u4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, piece, length, crc, kept = [], [], [], [], []
            for i, t in enumerate(b.column("text")):
                ids = encoded(t.as_py(), path) + end
                for k in range(-(-len(ids) // (4 * capacity))):
                    part = ids[4 * capacity * k : 4 * capacity * (k + 1)]
                    at.append(i)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(part)
            k = pa.array(piece, pa.int32())
            start = pa.array([capacity * p for p in piece], pa.int64())
            cols = [b.column("doc_id").take(pa.array(at, pa.int64())), k, start, pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.binary())] if with_ids else [])], [*PIECE, *(["ids"] if with_ids else [])])

    slim = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return slim.mapInArrow(each, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def best_pair(count: dict[int, int], lengths: list[int], room: int) -> tuple[int, int] | None:
    """The two pieces of the largest sum within room, larger first; lengths ascend."""
    best, i, j = None, 0, len(lengths) - 1
    while i <= j:
        a, b = lengths[j], lengths[i]
        if a + b > room or (i == j and count[a] < 2):
            j -= 1
        else:
            if best is None or a + b > sum(best) or (a + b == sum(best) and a > best[0]):
                best = (a, b)
            i += 1
    return best


def reduced(histogram: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some best packing has, and the histogram of the rest."""
    count = {k: v for k, v in histogram.items() if v}
    fixed: list[Pattern] = []

    def smallest(n: int, above: int = 0) -> list[int]:
        out: list[int] = []
        for k in sorted(x for x in count if x > above):
            out += [k] * min(count[k], n - len(out))
            if len(out) == n:
                break
        return out

    def fix(times: int, *partners: int) -> None:
        shape = defaultdict(int)
        for k in (j, *partners):
            shape[k] += 1
        for k, n in shape.items():
            count[k] -= n * times
            if count[k] <= 0:
                del count[k]
        fixed.append((times, tuple(sorted(shape.items(), reverse=True))))

    def times_for(*partners: int) -> int:
        need = defaultdict(int)
        for k in (j, *partners):
            need[k] += 1
        return min(count.get(k, 0) // n for k, n in need.items())

    for j in sorted(count, reverse=True):
        while count.get(j):
            room = capacity - j
            count[j] -= 1  # the piece itself isn't its own partner
            low = smallest(3)
            most = next((n for n in (3, 2, 1) if len(low) >= n and sum(low[:n]) <= room), 0)
            lengths = sorted(k for k, v in count.items() if v and k <= room)
            count[j] += 1
            if most == 0:
                fix(count[j])
                continue
            top = lengths[-1]
            if most == 1 or top == room:
                fix(times_for(top), top)
                continue
            if most == 3:
                break
            count[j] -= 1
            pair = best_pair(count, lengths, room)
            above = smallest(2, pair[1]) if pair else []
            count[j] += 1
            if not pair or top >= sum(pair):
                fix(times_for(top), top)
            elif pair[0] == top and (len(above) < 2 or sum(above) > room):
                fix(times_for(*pair), *pair)
            else:
                break
    return fixed, count


def best_fit(count: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, by classes of sequences that are equal so far."""
    by_room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, times: int, shape: tuple) -> None:
        if not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append([times, shape])

    for length in sorted(count, reverse=True):
        left = count[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, full, ((length, each),))
                if rest:
                    put(capacity - rest * length, 1, ((length, rest),))
                break
            room = rooms[i]
            times, shape = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(i)
            each = room // length
            full = min(times, left // each)
            left -= full * each
            if full:
                put(room - each * length, full, (*shape, (length, each)))
            if full < times and left:
                put(room - left * length, 1, (*shape, (length, left)))
                full, left = full + 1, 0
            if full < times:
                put(room, times - full, shape)
    return [(times, shape) for found in by_room.values() for times, shape in found]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = reduced(histogram, capacity)
    return fixed + best_fit(rest, capacity)


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, columns: first rank, first sequence, times in each sequence, first offset; ranks ascend."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, shape in patterns:
        offset = 0
        for length, each in shape:
            out[length].append((used[length], sequence, each, offset))
            used[length] += times * each
            offset += each * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def packed(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row for each piece."""
    # nth, written here, tells pieces apart that are alike in all else.
    cut = staged(pieces(df, path, id_col, text_col, capacity, end_id, with_ids).withColumn("nth", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    where = df.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    names = [*PIECE, *(["ids"] if with_ids else [])]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                rows = where.value[n]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                past = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + past // row[:, 2]
                offset[mine] = row[:, 3] + past % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    placed = ranked(cut, "length", ["doc_id", "piece", "nth"], ["doc_id", "piece", "nth"]).select(*names, F.col("cell_rank").alias("rank"))
    return placed.mapInArrow(each, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, " + "ids binary, " * with_ids + "sequence_id bigint, offset bigint")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, ids (little-endian unsigned 32-bit integers), documents of pieces with ids. A sequence is CAPACITY ids at most."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("documents"))
