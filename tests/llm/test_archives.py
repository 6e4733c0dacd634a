"""Media archives and WARC files: exact round trips, pushed filters, broken members."""

import base64
import gzip
import hashlib
import io
import struct
import wave
import zlib
from collections import defaultdict

import pytest

from corvane.llm import media, warc

TEXTS = ["", None, "a", "b" * 64, "b" * 65, "é😀" * 50, "same", "same", "long " * 50_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "clash", "x") for i, t in enumerate(TEXTS)] + [(3, "b" * 64, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, media string, size string")


def test_media_round_trip(docs):
    rows = media.media_features(media.stored_media(docs)).collect()
    want = sorted((str(r.doc_id), (r.text or "").encode()) for r in docs.collect())
    assert len(rows) == len(want)
    got = sorted((str(r.id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in rows)
    for (i, n, m, sha, crc, size), (j, raw) in zip(got, sorted(want, key=lambda x: (x[0], len(x[1]))), strict=True):
        padded = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        assert (i, n, m, sha, crc, size) == (j, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(padded) + 44)
    same = {r.feature for r in rows if r.id in ("6", "7")}
    assert len(same) == 1 and len({r.media_sha256 for r in rows}) == 7


def test_media_is_a_wav_file():
    with wave.open(io.BytesIO(media.wav(media.padded(b"abc")))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, b"abc" + bytes(61))


def test_ranges_split_archives_and_members_are_retried(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/a"
    media.stored_media(docs.coalesce(1), path=path).count()
    reader = media.ArchiveReader({"path": path, "split_bytes": "300"})
    parts = reader.partitions()
    assert len(parts) > 3
    found = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(found) == len(TEXTS) + 1
    tries = defaultdict(int)
    real = media.member

    def flaky(f, offset, *rest):
        tries[offset] += 1
        if tries[offset] == 1:
            raise OSError("lost")
        return real(f, offset, *rest)

    monkeypatch.setattr(media, "member", flaky)
    assert [r for p in parts for b in reader.read(p) for r in b.to_pylist()] == found
    assert set(tries.values()) == {2}
    monkeypatch.setattr(media, "member", lambda f, offset, *rest: 1 / 0 if offset < 0 else (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        list(reader.read(parts[0]))
    keeps = media.ArchiveReader({"path": path, "on_error": "keep"})
    assert all(r["media"] is None and "gone" in r["error"] for p in keeps.partitions() for b in keeps.read(p) for r in b.to_pylist())


PAGES = [(1, "http://a/ü b", "<p>x</p>"), (5, "http://b", "<p>x</p>"), (3, None, "<p>x</p>"), (2, "http://c", None), (9, "http://d", ""), (4, "http://e", "y\r\n\r\nz" * 20_000), (None, "http://f", "lone"), (5, "http://b", "<p>x</p>"), (11, "http://a/x%20b", "n"), (12, "<a>", "o"), (13, " \u2028 http://a\r\nX: y%41", "p"), (14, "", "q"), (15, "\u00a0a ", "r")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    spark.dataSource.register(warc.Warc)
    with warc.pushed_filters(spark):
        yield written(spark, tmp_path_factory)


def written(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/w"
    pages = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, payload string")
    warc.deduplicated_records(pages).write.format("warc").mode("append").save(path)
    return path


def test_warc_round_trip(spark, archive):
    rows = spark.read.format("warc").load(archive).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.record_id].append(r)
    assert len(rows) == len(PAGES)
    for page_id, url, html in PAGES:
        r = by_id[f"urn:page:{'' if page_id is None else page_id}"][0]
        raw = (html or "").encode()
        assert (r.payload_bytes, r.payload_digest, r.uri) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), url)
        refers = {1: "urn:page:5", 3: "urn:page:5", 2: "urn:page:9"}.get(page_id)
        assert (r.record_type, r.refers_to) == ("revisit" if refers else "response", refers)
        assert r.payload == (None if refers else raw)


def test_filters_are_pushed_and_payloads_skipped(spark, archive, monkeypatch):
    seen = spark.read.format("warc").load(archive).filter("record_type = 'revisit' and uri like 'http://c%'")
    assert [r.record_id for r in seen.collect()] == ["urn:page:2"]
    assert "Filter" not in seen._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    reader = warc.WarcReader({"path": archive})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    assert len(list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))) == 1
    monkeypatch.setattr(warc.Bytes, "upto", lambda self, n: 1 / 0)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_warc_of_other_writers(tmp_path):
    """Without lengths in the gzip header, and without gzip."""
    raw = [warc.record("response", f"urn:page:{i}", "http://x", None, b"p" * (i * 9000)) for i in range(5)]
    for name, whole in (("a.warc.gz", b"".join(map(gzip.compress, raw))), ("b.warc", b"".join(raw))):
        (tmp_path / name).write_bytes(whole)
        with (tmp_path / name).open("rb") as f:
            got = list(warc.records(f, len(whole), lambda c: c["record_id"] != "urn:page:2", True))
        assert [len(p) for _, _, p in got] == [0, 9000, 27_000, 36_000]


@pytest.mark.parametrize("pack", [bytes, gzip.compress, warc.gzip_member])
def test_a_file_that_ends_within_a_record_fails(tmp_path, pack):
    raw = [warc.record("response", f"urn:page:{i}", "http://x", None, bytes(range(256)) * 200) for i in range(4)]
    whole, last = b"".join(map(pack, raw)), len(pack(raw[3]))
    for payloads, wanted in ((True, lambda c: True), (False, lambda c: True), (True, lambda c: False)):
        for cut in (0, 5, 9, 300, last - 600, last - 200, last - 30, last - 1, last):
            name = tmp_path / f"{cut}"
            name.write_bytes(whole[: len(whole) - cut])
            with name.open("rb") as f:
                read = warc.records(f, len(whole) - cut, wanted, payloads)
                # Without its payload, a plain record lacks nothing but line ends.
                if cut in (0, last):
                    assert len(list(read)) == (4 - (cut == last)) * wanted(None)
                else:
                    with pytest.raises((ValueError, struct.error, zlib.error)):
                        list(read)


def test_op7_leaves_the_session_as_it_was(spark, tmp_path):
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, None)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for part in (pages, pages.limit(0)):
        part.write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op7(spark, str(tmp_path)).collect()), key=str)
        by = defaultdict(list)
        for i, _, html in PAGES if part is pages else []:
            by[(html or "").encode()].append(i)
        want = []
        for raw, ids in by.items():
            last = max((i for i in ids if i is not None), default=None)
            want += [(i or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), *(("response", None) if i == last else ("revisit", last))) for i in ids]
        assert got == sorted(want, key=str)
    assert spark.conf.get(name, None) == before


def test_ranges_are_put_together_where_tasks_would_be_too_many():
    from corvane.llm.files import together

    assert together([5, 5, 5], 5) == [[0], [1], [2]] and together([2, 2, 2, 9, 1], 4) == [[0, 1], [2, 3], [4]] and together([], 4) == []
    runs = together([16] * 100_000, 16, 200)
    assert len(runs) <= 201 and [i for run in runs for i in run] == list(range(100_000))


def test_empty_tables(spark, docs):
    assert media.media_features(media.stored_media(docs.limit(0))).count() == 0
