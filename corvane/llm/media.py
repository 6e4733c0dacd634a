"""Media columns: members of archives as a Spark data source, and features of their samples.

The source `media_archive` writes each task's members to ZIP files of ARCHIVE_BYTES or MEMBERS at most; a manifest names the
files that count, so that repeated task attempts do no harm. Reading, the driver plans byte ranges from the files' sizes
alone, several for a task where there would be too many tasks. A task walks the archive's directory as a stream, takes the members that begin in its range, reads each at its own
offset, and passes them on as Arrow batches of BATCH_BYTES. A member that can't be read is tried again by its offset,
with the file opened anew, without reading its neighbours again; what fails TRIES times fails the task or, with
on_error = keep, becomes a row with `error`.

A text is stored as a WAV file of 8-bit samples: its UTF-8 bytes and then zeros up to a positive multiple of 64.

Cases. A null text counts as empty: 64 zeros. A null id stays null. Rows that repeat an id are members of their own. Extra
columns are ignored. A very long text is one member, held whole by its task. An empty table gives an archive folder without files
and an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from corvane.llm import files
from corvane.llm.common import shared_folder, slices, table

ARCHIVE_BYTES, MEMBERS, SPLIT_BYTES = 64 << 20, 50_000, 16 << 20
BATCH_BYTES, BATCH_ROWS, TRIES = 4 << 20, 512, 3
BLOCK, RATE = 64, 8000
#: The classic header of a WAV file: RIFF, a format chunk for one channel of 8-bit samples, the data chunk.
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")
#: Signatures and fixed parts of the ZIP format.
DIRECTORY_END, DIRECTORY_ENTRY, LOCAL_ENTRY = struct.Struct("<4s4H2IH"), struct.Struct("<4s6H3I5H2I"), struct.Struct("<4s5H3I2H")
SCHEMA = "id string, size bigint, archive string, offset bigint, media binary, error string"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def wav(payload: bytes) -> bytes:
    return HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a WAV file of 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def feature(payload: bytes) -> str:
    """Mean, root mean square around the middle, sign changes, and shares of eight equal bands of values."""
    x = np.frombuffer(payload, np.uint8)
    centred = x.astype(np.int64) - 128
    signs = np.count_nonzero((centred[1:] < 0) != (centred[:-1] < 0))
    bands = np.bincount(x >> 5, minlength=8) / len(x)
    return f"mean={centred.mean():.4f} rms={np.sqrt((centred * centred).mean()):.4f} turns={signs} bands=" + ",".join(f"{b:.4f}" for b in bands)


class Range:
    """Bytes of an archive."""

    def __init__(self, archive: str, size: int, start: int, end: int):
        self.archive, self.size, self.start, self.end = archive, size, start, end


class Ranges(InputPartition):
    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def directory(f, size: int) -> Iterator[tuple[int, int, int, int, int, str, bytes]]:
    """(offset, method, crc, stored bytes, whole bytes, name, comment) of each member of an open archive, in the order stored."""
    tail = min(size, DIRECTORY_END.size + 65_535)
    f.seek(size - tail)
    end = f.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise zipfile.BadZipFile("no directory")
    *_, count, _, start, _ = DIRECTORY_END.unpack_from(end, at)
    f.seek(start)
    for _ in range(count):
        x = DIRECTORY_ENTRY.unpack(f.read(DIRECTORY_ENTRY.size))
        if x[0] != b"PK\x01\x02":
            raise zipfile.BadZipFile("broken directory")
        name, _, comment = f.read(x[10]), f.read(x[11]), f.read(x[12])
        yield x[16], x[4], x[7], x[8], x[9], name.decode(), comment


def member(f, offset: int, method: int, crc: int, stored: int, whole: int) -> bytes:
    f.seek(offset)
    x = LOCAL_ENTRY.unpack(f.read(LOCAL_ENTRY.size))
    if x[0] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no member here")
    f.seek(offset + LOCAL_ENTRY.size + x[9] + x[10])
    raw = f.read(stored)
    if method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompress(raw, -15, max(whole, 1))
    if len(raw) != whole or zlib.crc32(raw) != crc:
        raise zipfile.BadZipFile("member differs from its checksum")
    return raw


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.keep = options["path"], options.get("on_error", "fail") == "keep"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        found = [Range(n, s, a, min(s, a + self.split)) for n, s in files.committed(self.path, (".zip",)) for a in range(0, s, self.split)]
        runs = files.together([r.end - r.start for r in found], self.split)
        return [Ranges([found[i] for i in run]) for run in runs] or [Ranges([])]

    def open(self, archive: str):
        fs, folder = files.opened(self.path)
        return fs.open_input_file(f"{folder}/{archive}")

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for r in part.ranges:
            yield from self.members(r)

    def members(self, part: Range) -> Iterator[pa.RecordBatch]:
        names = ["id", "size", "archive", "offset", "media", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        f = self.open(part.archive)
        with self.open(part.archive) as listing:
            for offset, method, crc, stored, whole, name, comment in directory(io.BufferedReader(listing, 1 << 16), part.size):
                if not part.start <= offset < part.end:
                    continue
                media, said = None, None
                for k in range(TRIES):
                    try:
                        media, said = member(f, offset, method, crc, stored, whole), None
                        break
                    except (OSError, ValueError, zipfile.BadZipFile, zlib.error, struct.error) as e:
                        said = f"{part.archive} at {offset}: {e}"
                        time.sleep(0.05 * 2**k)
                        f.close()
                        f = self.open(part.archive)
                if said and not self.keep:
                    raise OSError(said)
                rows.append((comment[1:].decode() if comment else None, int(name.split("-")[1]), part.archive, offset, media, said))
                held += len(media or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows, held = [], 0
        f.close()
        if rows:
            yield batch()


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most_bytes, self.most_members = int(options.get("archive_bytes", ARCHIVE_BYTES)), int(options.get("members", MEMBERS))

    def write(self, batches: Iterator[pa.RecordBatch]) -> files.Written:
        fs, folder = files.opened(self.path)
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        out = archive = name = None
        n = 0

        def close() -> None:
            archive.close()
            done.append((name, out.tell()))
            out.close()

        for b in batches:
            for i, size, media in zip(b.column("id").to_pylist(), b.column("size").to_pylist(), b.column("media"), strict=True):
                if archive and (n >= self.most_members or out.tell() >= self.most_bytes):
                    close()
                    archive = None
                if not archive:
                    name, n = files.new_name(".zip"), 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                info = zipfile.ZipInfo(f"{n:06d}-{size}-.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                info.comment = b"" if i is None else b"=" + i.encode()
                archive.writestr(info, media.as_py() or b"", compresslevel=1)
                n += 1
        if archive:
            close()
        return files.Written(done)

    def commit(self, messages) -> None:
        files.commit(self.path, messages)

    def abort(self, messages) -> None:
        files.abort(self.path, messages)


class MediaArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(dict(self.options))


def media_of_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, media: each text as a WAV file; size is that of the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            raw = [(t.as_py() or "").encode("utf-8") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(map(len, raw), pa.int64()), pa.array([wav(padded(x)) for x in raw], pa.binary())], ["id", "size", "media"])

    slim = df.select(df[id_col].cast("string").alias("id"), df[text_col].alias("text"))
    return slim.mapInArrow(each, "id string, size bigint, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """id, n_bytes and what the stored bytes say, of rows (id, size, media)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for b in batches:
            out = []
            for m in b.column("media"):
                whole = m.as_py()
                p = samples(whole)
                out.append((len(p), sha(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(whole), sha(whole).hexdigest(), feature(p)))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("size"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.select("id", "size", "media").mapInArrow(
        each, "id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )


def stored_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes df's texts as media to archives at path (in the shared folder, if not given) and reads them: rows of SCHEMA."""
    spark = df.sparkSession
    spark.dataSource.register(MediaArchive)
    path = path or shared_folder(spark)
    media_of_texts(df, id_col, text_col).write.format("media_archive").mode("append").save(path)
    return spark.read.format("media_archive").load(path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = media_features(stored_media(docs))
    return out.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *[c for c in out.columns if c != "id"])
