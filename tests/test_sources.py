"""Scans, sinks and streams on files of their own."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators import stages
from corvane.sources import files
from corvane.streaming import incremental


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a_20260101000000.txt").write_text("본문 " * 20, encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("견적 요청 드립니다 ".encode("cp949") * 5)
    (tmp_path / "short.txt").write_text("x")
    (tmp_path / "a.m4a").write_bytes(bytes(2048))
    (tmp_path / "tiny.m4a").write_bytes(bytes(10))
    (tmp_path / "batch_0001.json").write_text(json.dumps({"files": ["s1", "s2"], "results": [{"file": "s1", "status": "ok"}, {"file": "s2", "status": "error"}]}), encoding="utf-8-sig")
    (tmp_path / "batch_0002.json").write_text("{broken")
    (tmp_path / "black.state").write_text(json.dumps({"_meta": {}, "s3": {"failures": 3, "blacklisted_at": "t"}, "s4": {"failures": 1}}))
    (tmp_path / "run.log").write_text("x\nSpeaker diarization JSON parse failed for call one.m4a: bad\nSpeaker diarization JSON parse failed for call one.m4a: again\n")
    return tmp_path


def test_scans(spark, folder):
    t = {r.stem: r.text for r in files.transcripts(spark, str(folder)).collect()}
    assert set(t) == {"a_20260101000000", "b"} and t["b"].startswith("견적 요청") and t["a_20260101000000"].startswith("본문")
    a = files.audio(spark, str(folder))
    assert [(r.name, r.size_bytes) for r in a.collect()] == [("a.m4a", 2048)]
    day = F.lit("2025-12-31 20:00:00").cast("timestamp")
    assert [r.stem for r in files.of_day(files.transcripts(spark, str(folder)), day).collect()] == ["a_20260101000000"]
    assert files.recent(files.transcripts(spark, str(folder)), F.current_timestamp(), 1).count() == 2
    assert [r.stem for r in files.failed_stems(spark, str(folder / "run.log")).collect()] == ["call one"]


def test_state(spark, folder):
    good, bad = files.json_documents(spark, str(folder), "batch_*.json")
    assert {r.stem for r in files.batch_files(good).collect()} == {"s1", "s2"} and bad.count() == 1
    b, _ = files.json_documents(spark, str(folder), "black.state")
    assert {(r.stem, r.failures, r.blacklisted_at) for r in files.blacklist(b).collect()} == {("s3", 3, "t"), ("s4", 1, None)}
    (folder / "book.contacts").write_text(json.dumps({"010-1 2": "Kim", "011": 5, "012": ""}))
    c, _ = files.json_documents(spark, str(folder), "*.contacts")
    assert [tuple(r) for r in files.contacts(c).collect()] == [("0102", "Kim")] or [tuple(r) for r in files.contacts(c).collect()] == [("01012", "Kim")]


def test_json_lines(spark, folder):
    (folder / "good.jsonl").write_text('\ufeff{"a":1}\n\n{"a":2}\n', encoding="utf-8")
    assert {r.line for r in files.json_lines(spark, str(folder)).collect()} == {1, 3}
    (folder / "good.jsonl").write_text('{"a":1}\nnope\n')
    with pytest.raises(Exception, match="line 2"):
        files.json_lines(spark, str(folder)).collect()


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("r", i // 2, i) for i in range(6)], "run_id string, batch_index int, x int")
    files.write_batches(r, f"{tmp_path}/b")
    files.write_batches(r.filter("batch_index = 1").withColumn("x", F.lit(9)), f"{tmp_path}/b")
    assert sorted(x.x for x in spark.read.json(f"{tmp_path}/b").collect()) == [0, 1, 4, 5, 9, 9]
    files.append_json(r, f"{tmp_path}/j")
    files.append_json(r, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 12
    assert [x.x for x in files.rotated(r, 2, "x").collect()] == [5, 4]
    n = files.numbered(r, 4, "x").collect()
    assert sorted((x.batch_index, x.place) for x in n) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1)]


def test_streams(spark, tmp_path):
    rows = [(i, f"Acme order {i} when and where " + "word " * 60) for i in range(20)] + [(99, "ok")]
    spark.createDataFrame(rows, "id long, text string").write.parquet(f"{tmp_path}/in")
    q = incremental.into(incremental.signal_events(incremental.read(spark, f"{tmp_path}/in", "id long, text string")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    seen = []
    q = incremental.each_batch(incremental.read(spark, f"{tmp_path}/in", "id long, text string"), lambda df, _: seen.append(df.count()), f"{tmp_path}/ck2")
    q.awaitTermination()
    assert seen == [21]
    e = spark.range(100).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=(F.col("id") * 10).cast("int"))).alias("at"), (F.col("id") % 2).alias("k"))
    e.write.parquet(f"{tmp_path}/ev")
    w = incremental.counts_by_window(incremental.read(spark, f"{tmp_path}/ev", "at timestamp, k long"), "at", "k")
    incremental.into(w, f"{tmp_path}/wout", f"{tmp_path}/ck3").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/wout").agg(F.sum("n")).first()[0] >= 80


def test_tables_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, path)
    for i in range(4):
        files.replace_table(spark.range(i + 1), path)
        assert files.read_table(spark, path).count() == i + 1
    kept = files.read_table(spark, path)
    with pytest.raises(Exception, match="no way"):
        files.replace_table(spark.range(3).select(F.raise_error(F.lit("no way")).alias("x")), path)
    assert files.read_table(spark, path).count() == kept.count() == 4
    assert len(list((tmp_path / "t").glob("version=*/_SUCCESS"))) == 2


def test_files_are_written_by_name(spark, tmp_path):
    rows = [("a b.txt", "héllo"), ("c.md", ""), ("d", None)]
    files.write_files(spark.createDataFrame(rows, "name string, content string"), f"{tmp_path}/n")
    assert {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "n").iterdir() if p.suffix != ".crc"} == {"a b.txt": "héllo", "c.md": "", "d": ""}


def test_rules_are_read_again_when_they_change(spark, tmp_path):
    path, reads = tmp_path / "rules.json", []

    def read(spark, path):
        reads.append(path)
        return spark.read.json(path)

    path.write_text('{"a":1}')
    os.utime(path, (1000, 1000))
    rules = files.Reread(str(path), read)
    assert [r.a for r in rules.get(spark).collect()] == [1] and rules.get(spark).count() == 1 and len(reads) == 1
    path.write_text('{"a":2}')
    os.utime(path, (2000, 2000))
    assert [r.a for r in rules.get(spark).collect()] == [2] and len(reads) == 2


def test_locks(spark, tmp_path):
    path, now = f"{tmp_path}/lock", datetime(2024, 1, 1)
    assert files.take_lock(spark, path, now) and not files.take_lock(spark, path, now + timedelta(hours=8))
    assert files.take_lock(spark, path, now + timedelta(hours=8, seconds=1)) and not files.take_lock(spark, path, now + timedelta(hours=9))
    files.release_lock(spark, path)
    assert files.take_lock(spark, path, now)
    files.release_lock(spark, path)
    (tmp_path / "lock").write_text("broken")
    assert files.take_lock(spark, path, now) and not list(tmp_path.glob("*stale*"))


def test_connections_are_tried_again():
    said, waits = iter([OSError(), OSError(), "there"]), []

    def connect():
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    assert stages.connected(connect, sleep=waits.append) == "there" and waits == [5, 5]
    with pytest.raises(OSError, match="never"):
        stages.connected(lambda: (_ for _ in ()).throw(OSError("never")), sleep=waits.append)
    assert len(waits) == 4


def test_prompts(spark):
    rules = spark.createDataFrame([(1, "c", "d", "why"), (0, "a", "b", None)], "pos int, old string, new string, note string")
    block = stages.corrections_block(rules).first().block
    assert block.split("\n")[1:] == ['  - "a" → "b"', '  - "c" → "d" (why)'] and stages.corrections_block(rules.limit(0)).first().block == ""
    one = spark.createDataFrame([("the text",)], "t string")
    said = lambda **how: one.select(stages.prompt("{corrections}|{examples}|{content}", F.lit(block), F.col("t"), **how).alias("p")).first().p
    assert said(examples="EX").startswith(block + "|EX|") and "the text" in said()
    assert said(override="short") == said() and said(override="x" * 101 + "{content}").startswith("x" * 101) and "the text" in said(override="x" * 101 + "{content}")


def test_lines_of_a_large_file_are_numbered(spark, tmp_path):
    """Split into many tasks, a file's lines have the numbers that a plain reader gives them."""
    texts = [("" if i % 17 == 0 else f'{{"n":{i},"x":"{"é" * (i % 50)}"}}') + ("\r\n" if i % 5 == 0 else "\n") for i in range(60_000)]
    (tmp_path / "big.jsonl").write_bytes(("\ufeff" + "".join(texts)).encode())
    (tmp_path / "small.jsonl").write_bytes(b'{"n":1}\n\nbroken\n{"n":"\0"}')
    (tmp_path / "empty.jsonl").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        lines = files.numbered_lines(spark, f"file://{tmp_path}", "*.jsonl")
        assert lines.rdd.getNumPartitions() > 8
        got = {(r.path.rsplit("/", 1)[-1], r.line): r.text for r in lines.collect()}
        bad = {r.path.rsplit("/", 1)[-1]: (r.bad_line, r.nul) for r in files.bad_lines(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("big.jsonl", i + 1): t.rstrip("\r\n") for i, t in enumerate(texts)}
    assert got == want | {("small.jsonl", 1): '{"n":1}', ("small.jsonl", 2): "", ("small.jsonl", 3): "broken", ("small.jsonl", 4): '{"n":"\0"}'}
    assert bad == {"big.jsonl": (None, False), "small.jsonl": (3, True)}


def test_notes_are_listed_by_tasks_folder_by_folder(spark, tmp_path, monkeypatch):
    """More notes than a folder takes: each a file of its own, read back whole, and the driver lists folders alone."""
    monkeypatch.setattr(files, "IN_FOLDER", 5)
    path = f"file://{tmp_path}/notes"
    notes = [(f"n{i} 한.md", f"# {i}\r\n한글") for i in range(23)] + [("empty.md", None)]
    files.write_notes(spark.createDataFrame(notes, "note string, markdown string"), path)
    written = [p for p in (tmp_path / "notes").rglob("*.md")]
    assert len(written) == 24 and not any(p.parent == tmp_path / "notes" for p in written)
    back = files.read_notes(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted((n, t or "") for n, t in notes)
    assert "FileScan" not in back._jdf.queryExecution().toString()
    few = f"file://{tmp_path}/few"
    files.write_notes(spark.createDataFrame(notes[:3], "note string, markdown string"), few)
    assert sorted(p.name for p in (tmp_path / "few").glob("*.md")) == sorted(n for n, _ in notes[:3]) and files.read_notes(spark, few).count() == 3
    none = f"file://{tmp_path}/none"
    files.write_notes(spark.createDataFrame([], "note string, markdown string"), none)
    assert files.read_notes(spark, none).count() == 0
