"""Scans of call files and state, and the sinks beside them (S1 to S13, S20 to S24). All of them read by Spark alone, so that any
store that Spark knows will do."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.names import basename, stem
from corvane.operators.rank import global_rank
from corvane.session import staged

# Sizes that a file must exceed, the size at which a log is cut to its last lines, and the line by which a failed separation of speakers is known.
LEAST_TRANSCRIPT, LEAST_AUDIO, LEAST_RECENT = 50, 1024, 50
LOG_BYTES, KEPT_LINES = 5 << 20, 5000
STALE_LOCK = timedelta(hours=8)
#: Splits of files whose first line numbers are broadcast.
BLOCKS = 1_000_000
#: Notes in a folder, and tasks that write or read folders, at most.
IN_FOLDER, TASKS = 1000, 1000
DIARIZATION_FAILED = r"Speaker diarization JSON parse failed for (.+?)\.m4a:"


def _listed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """name, stem, size_bytes, mtime of files; contents aren't read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return f.select(basename(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), "path")


def transcripts(spark: SparkSession, path: str, least: int = LEAST_TRANSCRIPT) -> DataFrame:
    """name, stem, text, size_bytes, mtime of transcripts longer than `least` bytes."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).filter(F.col("length") > least)
    return f.select(basename(F.col("path")).alias("name"), stem(F.col("path")).alias("stem"), decoded(F.col("content")).alias("text"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))


def audio(spark: SparkSession, path: str, least: int = LEAST_AUDIO) -> DataFrame:
    return _listed(spark, path, "*.m4a").filter(F.col("size_bytes") > least)


def newest_first(files: DataFrame, ranked: bool = False) -> DataFrame:
    """files, the latest first; ranked: with each one's place, from 0, which doesn't need a sort to be shown."""
    if not ranked:
        return files.orderBy(F.desc("mtime"), "name")
    return global_rank(files.withColumn("_age", -F.unix_micros(F.col("mtime").cast("timestamp"))), "_age", "name").drop("_age")


def of_day(files: DataFrame, now: Column) -> DataFrame:
    """Files whose stem has the date of now at UTC+9."""
    return files.filter(F.contains("stem", F.date_format(F.from_utc_timestamp(now, "+09:00"), "yyyyMMdd")))


def recent(files: DataFrame, now: Column, days: int, least: int = LEAST_RECENT) -> DataFrame:
    return files.filter((F.col("mtime") >= now - F.make_interval(days=F.lit(days))) & (F.length(F.trim("text")) >= least))


def decoded(content: Column) -> Column:
    """UTF-8 if it is valid, else by the Korean code pages that the JVM knows, with what fails replaced."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(_legacy(content))


def _legacy(content: Column) -> Column:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for codec in ("utf-8", "cp949", "euc-kr"):
            try:
                return bytes(b).decode(codec)
            except UnicodeDecodeError:
                pass
        return bytes(b).decode("utf-8", "replace")

    @F.pandas_udf("string")
    def each(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return each(content)


def json_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Documents (path, v) and what is no JSON (path, error)."""
    f = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("raw"))
    v = f.withColumn("v", F.try_parse_json("raw"))
    return v.filter("v is not null").select("path", "v"), v.filter("v is null").select("path", F.lit("no JSON").alias("error"))


def numbered_lines(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, line (from 1), text of files of any size. Spark splits a file where it likes; a first scan counts the lines of each split, their
    sums say at which number a split begins, and a line's number is that and its place in its task. Texts aren't shuffled while
    there are BLOCKS splits at most; whatever ends a line (LF, CR, CRLF) does so in both scans."""
    scan = spark.read.text(path, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    splits = staged(scan.groupBy("path", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines")))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("start")) - F.col("lines")
    known = splits.select("path", "start", (before + 1 - F.col("first")).alias("shift"))
    found = scan.join(F.broadcast(known) if splits.count() <= BLOCKS else known, ["path", "start"])
    line = F.col("at") + F.col("shift")
    return found.select("path", line.alias("line"), F.when(line == 1, F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")).alias("text"))


def bad_lines(lines: DataFrame) -> DataFrame:
    """path, bad_line, nul of files of lines (path, line, text): the first line that is neither blank nor JSON, and whether a NUL byte is
    anywhere. Each task passes on a row for each file."""
    bad = F.when((F.trim("text") != "") & F.try_parse_json("text").isNull(), F.col("line"))
    return lines.groupBy("path").agg(F.min(bad).alias("bad_line"), F.bool_or(F.contains("text", F.lit("\0"))).alias("nul"))


def json_lines(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line, v: each line that isn't blank. A line that is no JSON fails the query, by its number."""
    rows = numbered_lines(spark, path, pattern).filter(F.trim("text") != "").select("path", "line", F.try_parse_json("text").alias("v"))
    bad = F.raise_error(F.concat("path", F.lit(": line "), F.col("line").cast("string"), F.lit(" is no JSON")))
    return rows.select("path", "line", F.when(F.col("v").isNull(), F.parse_json(bad.cast("string"))).otherwise(F.col("v")).alias("v"))


def batch_files(documents: DataFrame) -> DataFrame:
    """Distinct stems in `files` of batch documents (v)."""
    return documents.select(F.explode(F.try_variant_get("v", "$.files", "array<string>")).alias("stem")).distinct()


def batch_results(documents: DataFrame) -> DataFrame:
    """results: array of (file, status) of batch documents (v)."""
    return documents.select(F.try_variant_get("v", "$.results", "array<struct<file string, status string>>").alias("results"))


def failed_stems(spark: SparkSession, path: str, pattern: str = DIARIZATION_FAILED) -> DataFrame:
    """Distinct stems that a log names."""
    return spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("stem")).filter("stem <> ''").distinct()


def state_names(keys: DataFrame) -> DataFrame:
    """Base names of keys.path, whichever way its slashes lean."""
    return keys.select(basename(F.col("path")).alias("name")).distinct()


def blacklist(documents: DataFrame) -> DataFrame:
    """stem, failures, blacklisted_at of a blacklist document (v)."""
    entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    e = documents.select(F.explode(entries).alias("e")).filter("e.key <> '_meta'")
    return e.select(F.col("e.key").alias("stem"), F.try_variant_get("e.value", "$.failures", "int").alias("failures"), F.try_variant_get("e.value", "$.blacklisted_at", "string").alias("blacklisted_at"))


def contacts(documents: DataFrame) -> DataFrame:
    """phone, name of a contacts document (v): a map of phones, named by text only."""
    e = documents.select(F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("e"))
    n = e.filter(F.schema_of_variant("e.value") == "STRING").select(F.regexp_replace("e.key", "[- ]", "").alias("phone"), F.try_variant_get("e.value", "$", "string").alias("name"))
    return n.filter("name <> ''")


def day_events(events: DataFrame, day: str) -> DataFrame:
    """events (at) that begin on a day at UTC+9."""
    return events.filter(F.to_date(F.from_utc_timestamp("at", "+09:00")) == F.lit(day).cast("date"))


# ── sinks ──

def _versions(spark: SparkSession, path: str) -> list[str]:
    """The committed versions under path, oldest first: those in which Spark's commit has left its mark."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(str(f.getPath().getParent().toString()) for f in found or [])


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """A new version of the table at path. Readers see the old table until the whole new one is committed, and a job that fails leaves
    the old one; the last `keep` versions stay for readers that have begun. There is one writer at a time."""
    spark = df.sparkSession
    old = _versions(spark, path)
    number = int(old[-1].rsplit("=", 1)[-1]) + 1 if old else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number:012d}")
    for gone in old[: max(0, len(old) + 1 - keep)]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a table that replace_table writes."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} has no version that is whole")
    return spark.read.parquet(found[-1])


def write_files(contents: DataFrame, path: str) -> None:
    """A file of its own for each row (name, content as text or bytes, and a folder under path if there is such a column): written beside its
    place and then moved there, so that readers see whole files, and a task that is tried again writes the same ones. Names that repeat have
    the content of one of their rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(path)
        made = set()
        for pdf in batches:
            for under, name, content in zip(pdf["folder"], pdf["name"], pdf["content"], strict=True):
                folder = f"{base}/{under}" if under else base
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{folder}/.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(beside) as out:
                    out.write(content.encode("utf-8") if isinstance(content, str) else bytes(content or b""))
                fs.move(beside, f"{folder}/{name}")
        if not made:
            fs.create_dir(base, recursive=True)
        yield pd.DataFrame({"n": pd.Series([], dtype="int64")})

    folder = "folder" if "folder" in contents.columns else F.lit("").alias("folder")
    contents.select(folder, "name", "content").mapInPandas(each, "n long").write.format("noop").mode("overwrite").save()


def _filesystem(path: str) -> tuple:
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def append_json(df: DataFrame, path: str) -> None:
    """Lines with sorted keys, appended."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_batches(results: DataFrame, path: str) -> None:
    """results (run_id, batch_index, ...) by run and batch; writing a batch again replaces it alone."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "batch_index").json(path)


def numbered(files: DataFrame, each: int, *order: str) -> DataFrame:
    """files with batch_index and place, `each` to a batch, in order: by ranges, not in one task."""
    r = global_rank(files, *order)
    return r.withColumn("batch_index", F.floor(F.col("rank") / each)).withColumn("place", F.col("rank") % each).drop("rank")


def rotated(lines: DataFrame, keep: int = KEPT_LINES, order: str = "seq", most: int = 0, text: str = "line") -> DataFrame:
    """The last lines of a log if it has over `most` bytes, line ends included, else all of them."""
    if most and (lines.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0) <= most:
        return lines
    return lines.orderBy(F.desc(order)).limit(keep)


def write_notes(notes: DataFrame, path: str) -> None:
    """A file for each note (note, markdown), by its name. They are dealt into folders of some IN_FOLDER each, of which one task writes all;
    up to so many notes are written into path itself."""
    kept = staged(notes.select(F.col("note").alias("name"), F.col("markdown").alias("content")))
    folders = -(-kept.count() // IN_FOLDER)
    if folders > 1:
        kept = kept.withColumn("folder", F.format_string("%06d", F.crc32(F.col("name").cast("binary")) % folders)).repartition(min(folders, TASKS), "folder")
    write_files(kept, path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """note, markdown of the files that write_notes has written. The driver lists the folders alone; their files are listed and read by tasks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    inside = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(p)
    folders, flat = [], False
    while inside.hasNext():
        f = inside.next()
        if f.isDirectory():
            folders.append((f.getPath().getName(),))
        else:
            flat = True
    folders += [("",)] if flat else []

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs

        fs, base = _filesystem(path)
        for pdf in batches:
            for under in pdf["folder"]:
                found = fs.get_file_info(pafs.FileSelector(f"{base}/{under}" if under else base))
                names = [(f.base_name, f.path) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(".")]
                for start in range(0, len(names), IN_FOLDER):
                    some, texts = names[start : start + IN_FOLDER], []
                    for _, file in some:
                        with fs.open_input_stream(file) as opened:
                            texts.append(opened.read().decode("utf-8", "replace"))
                    yield pd.DataFrame({"note": [n for n, _ in some], "markdown": texts})

    return spark.createDataFrame(folders, "folder string").repartition(max(1, min(len(folders), TASKS))).mapInPandas(each, "note string, markdown string")


# ── beside the tables: what a driver does with files of its own ──

class Reread:
    """A file's rows as read(spark, path) gives them, read again only when the file has changed since: rules that people edit."""

    def __init__(self, path: str, read: Callable[[SparkSession, str], DataFrame]):
        self.path, self.read, self.at, self.rows = path, read, None, None

    def get(self, spark: SparkSession) -> DataFrame:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
        if self.rows is None or at > self.at:
            self.at, self.rows = at, self.read(spark, self.path)
        return self.rows


def take_lock(spark: SparkSession, path: str, now: datetime, stale: timedelta = STALE_LOCK) -> bool:
    """Whether this driver has the lock at path from now on. A lock that is older than `stale`, or can't be read, is taken away from its
    owner: moved aside first, so that of several who try one wins."""
    fs_package = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = fs_package.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def take() -> bool:
        try:
            out = fs.create(p, False)
        except Py4JJavaError:
            return False
        out.write(bytearray(now.isoformat().encode()))
        out.close()
        return True

    if take():
        return True
    try:
        opened = fs.open(p)
        since = datetime.fromisoformat(bytes(opened.readAllBytes()).decode())
        opened.close()
        old = now - since > stale
    except (Py4JJavaError, TypeError, ValueError):
        old = True
    if not old:
        return False
    aside = fs_package.Path(f"{path}.stale.{uuid.uuid4().hex}")
    try:
        moved = fs.rename(p, aside)
    except Py4JJavaError:
        return False
    if not moved:
        return False
    try:
        return take()
    finally:
        fs.delete(aside, False)


def release_lock(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)
