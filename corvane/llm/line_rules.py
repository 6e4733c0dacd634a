"""Quality rules with cross-document line frequency: lines that many documents of a host share are removed, and documents that are
depleted by it are rejected.

One pass over the texts counts words, symbols and repeats of each document and hashes its normalised lines (ASCII letters in lower
case, digits as 0, white space collapsed) to 128 bits, with the words that each distinct line stands for. A document's signature is
the hash of its lines in order; of documents of a host with one signature the first alone counts, so that copies of a clean
document, which are exact deduplication's business, don't make its lines frequent. A line is removed from all documents of a host
if more than LEAST distinct ones and more than SHARE of the host's have it. A document is rejected if its own figures fail
(`base_failed`) or if less than LEFT of its words stays.

Only the distinct lines of a document travel, as hashes, and counts are combined before they are shuffled, so a line that a third of
all documents have is one row of each task. Frequent lines are looked up by broadcast while they are SMALL rows at most; beyond that
both sides are shuffled, and adaptive execution splits what is hot.

Cases. A null or empty text, or one without words, has no lines and fails by its number of words. A null host is a host of its own,
with the empty one. Repeated rows are judged each. Very long texts are counted whole in their task. Extra columns are ignored by
`verdicts` and kept by `cleaned`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import row_key, slices, staged, table

LEAST, SHARE, LEFT = 20, 0.02, 0.5
MIN_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
SMALL = 100_000
SYMBOLS = b"#*$%&|<>"
NORMALISED = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words stand in windows of `size` words that occur twice or more, the first included."""
    if len(words) < size:
        return 0
    windows = list(zip(*[words[i:] for i in range(size)], strict=False))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + len(windows)] |= again
    return int(covered.sum())


def figures(text: str | None) -> tuple[int, ...]:
    """The figures of FEATURES."""
    raw = (text or "").encode("utf-8")
    words = raw.split()
    blank = len(raw) - sum(map(len, words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(text or "") - blank, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def line_key(line: bytes) -> tuple[bytes, int] | None:
    """Hash of a line, normalised, and its number of words; None of a line without words."""
    words = line.translate(NORMALISED).split()
    return (xxhash.xxh3_128_digest(b" ".join(words)), len(words)) if words else None


def lines_of(text: str | None) -> list[tuple[bytes, int]]:
    return [k for line in (text or "").encode("utf-8").split(b"\n") if (k := line_key(line))]


def features(docs: DataFrame) -> DataFrame:
    """Of documents (row, doc_id, host, text): the figures, signature, and lines (line, words), the words of all occurrences of
    each distinct line together. Staged."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line_type = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))
        for b in (part for whole in batches for part in slices(whole)):
            counts, signatures, lines = [], [], []
            for t in b.column("text"):
                text = t.as_py()
                counts.append(figures(text))
                found, words = lines_of(text), Counter()
                for line, n in found:
                    words[line] += n
                signatures.append(xxhash.xxh3_128_digest(b"".join(line for line, _ in found)))
                lines.append([{"line": k, "words": n} for k, n in words.items()])
            cols = np.array(counts, np.int64).reshape(-1, len(FEATURES)).T
            yield pa.RecordBatch.from_arrays(
                [*map(b.column, ("row", "doc_id", "host")), *map(pa.array, cols), pa.array(signatures, pa.binary()), pa.array(lines, line_type)], ["row", "doc_id", "host", *FEATURES, "signature", "lines"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    counted = ", ".join(f"{f} bigint" for f in FEATURES)
    return staged(docs.mapInArrow(each, f"row {kinds['row']}, doc_id {kinds['doc_id']}, host string, {counted}, signature binary, lines array<struct<line:binary,words:bigint>>"))


def frequent_lines(found: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """host, line, n: lines above both limits, and how many distinct documents of the host have them. Staged."""
    first = found.groupBy("host", "signature").agg(F.min("row").alias("row"))
    sizes = first.groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    counted = found.join(first.select("row"), "row", "left_semi").select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    # The filter comes first: what is left is few rows even of a host that has most of all lines.
    return staged(counted.filter(F.col("n") > least).join(sizes, "host").filter(F.col("n") > F.col("documents") * share).select("host", "line", "n"))


def removed_lines(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """row, line, words of the lines that go."""
    known = frequent.select("host", "line")
    if frequent.count() <= SMALL:
        known = F.broadcast(known)
    return found.select("row", "host", F.inline("lines")).join(known, ["host", "line"]).select("row", "line", "words")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def judged(docs: DataFrame, least: int, share: float, left: float) -> tuple[DataFrame, DataFrame]:
    """Of documents (row, doc_id, host, text): the verdicts with their `row`, and the lines removed."""
    found = features(docs)
    gone = removed_lines(found, frequent_lines(found, least, share))
    words = gone.groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    with_words = found.drop("signature", "lines", "host").join(words, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    failed = with_words.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return failed.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= left * F.col("n_words"))), gone


def host_of(df: DataFrame, host_col: str) -> Column:
    return F.coalesce(df[host_col].cast("string"), F.lit("")).alias("host")


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """doc_id, the figures, n_removed_words, base_failed, kept for each row of df."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("doc_id"), host_of(df, host_col), df[text_col].alias("text"))
    return judged(docs, least, share, left)[0].drop("row")


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least: int = LEAST, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """`doc`: each row of df that is kept, as a struct, and `text`, its text without the lines removed; nulls can't be kept."""
    df, row = row_key(df)
    docs = df.select(row.alias("row"), df[id_col].alias("doc_id"), host_of(df, host_col), df[text_col].alias("text"))
    marked, gone = judged(docs, least, share, left)
    lines = gone.groupBy("row").agg(F.collect_set("line").alias("gone"))
    whole = df.select(row.alias("row"), F.struct(*[df[c] for c in df.columns]).alias("doc"), df[text_col].alias("text"))
    both = whole.join(marked.filter("kept").select("row"), "row").join(lines, "row", "left").select("doc", "text", "gone")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            texts = []
            for t, g in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                drop = set(g or ())
                # \n is no part of another character's bytes, so lines can be taken from the text itself.
                texts.append("\n".join(x for x in t.split("\n") if not ((k := line_key(x.encode("utf-8"))) and k[0] in drop)) if drop else t)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(texts, pa.string())], ["doc", "text"])

    return both.mapInArrow(each, f"doc {both.schema['doc'].dataType.simpleString()}, text string")


def op11(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
    w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
    windows AS (SELECT r, unnest(list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: {'p': i, 'a': words[i], 'b': words[i + 1], 'c': words[i + 2]})) AS x FROM w),
    again AS (SELECT r, x.p AS p FROM windows QUALIFY count(*) OVER (PARTITION BY r, x.a, x.b, x.c) > 1),
    repeats AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS i FROM again) GROUP BY r),
    lines AS MATERIALIZED (SELECT r, host, i, line, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
        FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
    signed AS (SELECT d.r, d.host, coalesce(s, '') AS s FROM d LEFT JOIN (SELECT r, string_agg(norm, chr(10) ORDER BY i) AS s FROM lines GROUP BY r) USING (r)),
    firsts AS MATERIALIZED (SELECT host, min(r) AS r FROM signed GROUP BY host, s),
    sizes AS (SELECT host, count(*) AS documents FROM firsts GROUP BY host),
    frequent AS MATERIALIZED (SELECT host, norm FROM lines SEMI JOIN firsts USING (r) JOIN sizes USING (host) GROUP BY host, norm, documents HAVING count(DISTINCT r) > 20 AND count(DISTINCT r) > documents * 0.02::DOUBLE),
    gone AS (SELECT r, sum(len(regexp_extract_all(norm, '[^ ]+'))) AS n FROM lines JOIN frequent USING (host, norm) GROUP BY r),
    figures AS (
        SELECT doc_id, len(words)::BIGINT AS n_words, (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
               coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
        FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeats USING (r) LEFT JOIN gone USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.5::DOUBLE * n_words AS kept
    FROM figures"""
