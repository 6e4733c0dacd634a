"""WARC archives as a Spark data source.

The source `warc` writes each task's records to files of FILE_BYTES at most, one gzip member for each record, whose extra
field `sl` holds the member's lengths. Reading, files are the partitions, several in one where there would be too many; the driver takes their names from a manifest.
Filters on record type and on header columns are pushed to the reader, which inflates a member as far as its headers,
tests them, and goes on to the next member by the recorded length, so that unwanted payloads are neither read nor decoded.
Files of other writers, without `sl` or without gzip, are read too; there a record's end is found from Content-Length. A file
that ends within a record fails the read: what is missing is never taken for the end.

`deduplicated_records` makes the records of pages: of equal payloads the largest page_id's is the response, the others are
revisits of it, without a payload. Payloads are compared by SHA-256 on thin rows; they themselves are joined by the row's key,
which no two rows share.

Cases. A null html counts as empty, like any other payload. A null page_id is smaller than every other, and if all of equal
payloads have none, all are responses. Rows that repeat both the largest page_id and the payload are all responses. A null
url leaves its header out. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from corvane.llm import files
from corvane.llm.common import row_key, shared_folder, staged, table

FILE_BYTES, BATCH_BYTES, BATCH_ROWS = 64 << 20, 4 << 20, 1024
WINDOW = 1 << 14
DATE = "1970-01-01T00:00:00Z"
URI_ENCODED = "X-Target-URI-Encoding"
RECORD_SCHEMA = "record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
#: Columns that headers alone decide.
HEADER_COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def uri_lines(uri: str | None) -> list[str]:
    """The header of a URI as it is; one that a header line can't hold is percent-encoded, and a line of its own says so."""
    if uri is None:
        return []
    if uri.isprintable() and uri == uri.strip() and not uri.startswith("<"):
        return [f"WARC-Target-URI: {uri}"]
    return [f"WARC-Target-URI: {quote(uri, safe='')}", f"{URI_ENCODED}: percent"]


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """A WARC record of an HTTP response; a revisit keeps the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", *uri_lines(uri),
        *([f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 4) -> bytes:
    """A gzip member with its compressed and whole lengths in the extra field `sl`."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parsed(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; angle brackets around ids go."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        value = value.strip(" \t")
        out[name.strip().lower()] = value[1:-1] if value.startswith("<") and value.endswith(">") else value
    return out


def column_values(h: dict[str, str]) -> dict[str, str | None]:
    out = {c: h.get(k) for c, k in HEADER_COLUMNS.items()}
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].rpartition(":")[2]
    if out["uri"] is not None and h.get(URI_ENCODED.lower()) == "percent":
        out["uri"] = unquote(out["uri"])
    return out


class Bytes:
    """Bytes of a record from a file, on demand."""

    def __init__(self, f, gzipped: bool, at: int):
        self.f, self.at, self.got, self.over = f, at, bytearray(), False
        self.inflater = zlib.decompressobj(-15) if gzipped else None
        if gzipped:
            f.seek(at)
            fixed = f.read(12)
            if len(fixed) < 12 or fixed[:3] != b"\x1f\x8b\x08":
                raise ValueError(f"no whole gzip member at {at}")
            flags, extra = fixed[3], b""
            here = at + 10
            if flags & 4:
                n = struct.unpack("<H", fixed[10:12])[0]
                extra, here = f.read(n), at + 12 + n
            for flag in (8, 16):
                if flags & flag:
                    f.seek(here)
                    while f.read(1) not in (b"\0", b""):
                        here += 1
                    here += 1
            here += 2 * bool(flags & 2)
            self.size = self.recorded(extra)
            self.next = here
        else:
            self.size, self.next = None, at

    @staticmethod
    def recorded(extra: bytes) -> int | None:
        i = 0
        while i + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, i + 2)[0]
            if extra[i : i + 2] == b"sl" and n >= 8:
                return struct.unpack_from("<I", extra, i + 4)[0]
            i += 4 + n
        return None

    def more(self, n: int = WINDOW) -> bool:
        if self.over:
            return False
        self.f.seek(self.next)
        raw = self.f.read(n)
        if not raw:
            self.over = True
            return False
        self.next += len(raw)
        if self.inflater is None:
            self.got += raw
        else:
            self.got += self.inflater.decompress(raw)
            if self.inflater.eof:
                self.over, self.next = True, self.next - len(self.inflater.unused_data)
        return True

    def until(self, mark: bytes) -> int:
        start = 0
        while (i := self.got.find(mark, start)) < 0:
            start = max(0, len(self.got) - len(mark))
            if not self.more():
                return -1
        return i

    def upto(self, n: int) -> None:
        while len(self.got) < n and self.more(max(WINDOW, (n - len(self.got)) // (4 if self.inflater else 1))):
            pass

    def end(self, whole: int) -> int:
        """Where the next record begins; whole: this one's bytes, uncompressed."""
        if self.inflater is None:
            return self.at + whole
        if self.size:
            return self.at + self.size
        while self.more():
            self.got.clear()
        if not self.inflater.eof:
            raise ValueError(f"the gzip member at {self.at} is cut off")
        return self.next + 8


def records(f, size: int, wanted: Callable[[dict], bool], payloads: bool) -> Iterator[tuple[dict, dict, bytes | None]]:
    """(columns, HTTP headers, payload) of the records for which wanted(columns); a payload only if asked for and there."""
    at = 0
    f.seek(0)
    gzipped = f.read(2) == b"\x1f\x8b"
    while at < size:
        b = Bytes(f, gzipped, at)
        i = b.until(b"\r\n\r\n")
        if i < 0:
            if not gzipped and not b.got.strip(b"\r\n"):
                return
            raise ValueError(f"the record at {at} is cut off in its headers")
        h = parsed(bytes(b.got[:i]))
        length, cols = int(h.get("content-length", 0)), column_values(h)
        first = i + 4

        def block() -> bytes:
            b.upto(first + length)
            if len(b.got) < first + length:
                raise ValueError(f"the record at {at} is cut off in its block")
            return bytes(b.got[first : first + length])

        if wanted(cols):
            http, payload = {}, None
            if "application/http" in h.get("content-type", ""):
                while (j := b.got.find(b"\r\n\r\n", first)) < 0 and b.more():
                    pass
                if first <= j < first + length:
                    http = parsed(bytes(b.got[first:j]))
                    if payloads and cols["record_type"] != "revisit":
                        payload = block()[j + 4 - first :]
            elif payloads:
                payload = block()
            yield cols, http, payload
        at = b.end(first + length + 4)
        # The line ends behind a plain record's block may be missing at the end of a file, but nothing else.
        if at > size + (0 if gzipped else 4):
            raise ValueError(f"the record before {at} is cut off: the file has {size} bytes")


def as_test(f: Filter) -> Callable[[dict], bool] | None:
    """A pushed filter as a test of header columns; None if headers don't decide it."""
    column = f.attribute[0] if len(f.attribute) == 1 else None
    if column not in HEADER_COLUMNS:
        return None
    if isinstance(f, EqualTo | EqualNullSafe):
        return lambda c: c[column] == f.value
    if isinstance(f, In):
        values = set(f.value)
        return lambda c: c[column] in values
    if isinstance(f, IsNull):
        return lambda c: c[column] is None
    if isinstance(f, IsNotNull):
        return lambda c: c[column] is not None
    if isinstance(f, StringStartsWith):
        return lambda c: c[column] is not None and c[column].startswith(f.value)
    return None


class Files(InputPartition):
    """(name, bytes) of each file of a task."""

    def __init__(self, found: list[tuple[str, int]]):
        self.found = found


class WarcReader(DataSourceReader):
    """Option payload: `keep`, `check` (decoded, held against its digest and let go) or `skip`."""

    def __init__(self, options: dict):
        self.path, self.payload, self.pushed = options["path"], options.get("payload", "keep"), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if as_test(f):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = files.committed(self.path, (".warc", ".warc.gz"))
        return [Files([found[i] for i in run]) for run in files.together([s for _, s in found], 0)] or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        for name, size in part.found:
            yield from self.records_of(name, size)

    def records_of(self, name: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
        names = [*HEADER_COLUMNS, "payload_bytes", "payload"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        tests = [as_test(f) for f in self.pushed]
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        fs, folder = files.opened(self.path)
        with fs.open_input_file(f"{folder}/{name}") as f:
            for cols, http, payload in records(f, file_bytes, lambda c: all(t(c) for t in tests), self.payload != "skip"):
                size = len(payload) if payload is not None else int(http["content-length"]) if "content-length" in http else None
                if payload is not None and cols["payload_digest"] not in (None, digest_of(payload)):
                    raise ValueError(f"{name}: the payload of {cols['record_id']} differs from its digest")
                rows.append((*(cols[c] for c in HEADER_COLUMNS), size, payload if self.payload == "keep" else None))
                held += len(payload or b"") if self.payload == "keep" else 0
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("file_bytes", FILE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> files.Written:
        fs, folder = files.opened(self.path)
        fs.create_dir(folder, recursive=True)
        done: list[tuple[str, int]] = []
        out = name = None
        for b in batches:
            for kind, i, uri, refers, payload in zip(*(b.column(c) for c in ("record_type", "record_id", "uri", "refers_to", "payload")), strict=True):
                if out and out.tell() >= self.most:
                    done.append((name, out.tell()))
                    out.close()
                    out = None
                if not out:
                    name = files.new_name(".warc.gz")
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(gzip_member(record(kind.as_py(), i.as_py(), uri.as_py(), refers.as_py(), payload.as_py() or b"")))
        if out:
            done.append((name, out.tell()))
            out.close()
        return files.Written(done)

    def commit(self, messages) -> None:
        files.commit(self.path, messages)

    def abort(self, messages) -> None:
        files.abort(self.path, messages)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")))


def deduplicated_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """record_id, record_type, uri, refers_to, payload of each page."""
    pages, row = row_key(pages)
    payload = F.encode(F.coalesce(pages[payload_col], F.lit("")), "utf-8")
    thin = staged(pages.select(row.alias("row"), pages[id_col].alias("page_id"), F.sha2(payload, 256).alias("key")))
    groups = thin.groupBy("key").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1 and last is not null").select("key", "last")
    again = staged(thin.join(staged(groups), "key").filter(~F.col("page_id").eqNullSafe(F.col("last"))).select("row", "last"))
    rows = pages.select(row.alias("row"), pages[id_col].alias("page_id"), pages[uri_col].alias("uri"), payload.alias("payload")).join(again, "row", "left")
    revisit = F.col("last").isNotNull()
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        record_id(F.col("page_id")).alias("record_id"),
        "uri",
        F.when(revisit, record_id(F.col("last"))).alias("refers_to"),
        "payload",
    )


@contextmanager
def pushed_filters(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark hands filters to the reader; afterwards the session is as it was."""
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    spark.dataSource.register(Warc)
    path = shared_folder(spark)
    kind = pages.schema["page_id"].dataType

    def page(urn: Column) -> Column:
        return F.nullif(F.url_decode(F.substring(urn, len("urn:page:") + 1, 1 << 20)), F.lit("")).cast(kind)

    deduplicated_records(pages).write.format("warc").mode("append").save(path)
    with pushed_filters(spark):
        records = spark.read.format("warc").option("payload", "check").load(path).filter("record_type in ('response', 'revisit')")
        return staged(records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")))
