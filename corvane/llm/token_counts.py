"""Token counts from pre-token frequencies: pieces are counted once for each distinct pre-token, ids never exist.

One pass cuts the texts. It writes each document's pre-tokens with their frequencies, and for each task those of all its texts
together, from which the distinct pre-tokens come; each is encoded once. The documents' frequencies are then joined to these
counts. Pre-tokens follow a steep distribution, so the join is done in two parts: the HOT most frequent ones, HOT rows of
HOT_LENGTH characters at most, are broadcast and looked up where the document's frequencies are; the rest, a few hundredths of
all, are shuffled and joined. Every pre-token is in exactly one part.

Cases. A null text counts as empty: no bytes, no tokens. Pre-tokens of any length are joined whole; a very long text is cut whole
in its task. Rows that repeat an id are counted each. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from corvane.llm.bpe import as_chars, cutter
from corvane.llm.common import shared_folder, slices, staged

HOT, HOT_LENGTH, FLUSH = 150_000, 32, 400_000
#: Pre-tokens in a row of those of a task.
TOGETHER = 5_000
DICTIONARY = 16 << 20
#: Marks a special token's own string among pre-tokens; no pre-token begins with a space here.
MARK = " "


def pre_tokens(text: str | None, path: str) -> list[str]:
    c = cutter(path)
    pre, special = c.cut(text or "")
    return [MARK + p if p in c.special else p for p in pre] if special else pre


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """Of documents (row, doc_id, text): row, doc_id, n_bytes, pre, n, the distinct pre-tokens and how often each occurs. Rows
    without n_bytes have those of many documents together. Staged, the two kinds apart."""
    kind = docs.schema["doc_id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together: Counter[str] = Counter()
        names = ["row", "doc_id", "n_bytes", "pre", "n"]
        lists = pa.list_(pa.string()), pa.list_(pa.int64())

        def of_all() -> Iterator[pa.RecordBatch]:
            pre, n = list(together.keys()), list(together.values())
            for at in range(0, len(pre), TOGETHER):
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.array([pre[at : at + TOGETHER]], lists[0]), pa.array([n[at : at + TOGETHER]], lists[1])], names
                )
            together.clear()

        id_type = to_arrow_type(kind)
        for b in (part for whole in batches for part in slices(whole)):
            size, pre, n = [], [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                size.append(len(text.encode("utf-8")))
                cut = pre_tokens(text, path)
                own = Counter(cut)
                together.update(cut)
                pre.append(list(own.keys()))
                n.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(pre, lists[0]), pa.array(n, lists[1])], names)
            if len(together) > FLUSH:
                yield from of_all()
        yield from of_all()

    counted = docs.mapInArrow(count, f"row bigint, doc_id {kind.simpleString()}, n_bytes bigint, pre array<string>, n array<bigint>")
    folder = shared_folder(docs.sparkSession)
    kinds = counted.withColumn("together", F.col("n_bytes").isNull().cast("int"))
    # A file's pre-tokens fit a dictionary of this size, so that a row holds their numbers.
    kinds.write.partitionBy("together").option("compression", "zstd").option("parquet.dictionary.page.size", DICTIONARY).parquet(folder)
    return docs.sparkSession.read.schema(StructType([*counted.schema, StructField("together", IntegerType())])).parquet(folder)


def distinct_pre_tokens(counted: DataFrame, path: str) -> DataFrame:
    """pre, freq, pieces of all texts; staged."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cutter(path)
        for b in batches:
            n = [1 if p.startswith(MARK) else len(c.model.tokenize(as_chars(p.encode("utf-8")))) for p in b.column("pre").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("pre"), b.column("freq"), pa.array(n, pa.int64())], ["pre", "freq", "pieces"])

    each = counted.filter("together = 1").select(F.explode(F.arrays_zip("pre", "n")).alias("p")).select("p.pre", "p.n")
    return staged(each.groupBy("pre").agg(F.sum("n").alias("freq")).mapInArrow(pieces, "pre string, freq bigint, pieces bigint"))


def most_frequent(known: DataFrame, hot: int) -> DataFrame:
    """The pre-tokens of the highest frequency steps, as many whole steps as have `hot` rows at most. No sort, no top-k on the
    driver: it sees the counts of steps, eight for each doubling."""
    steps = known.filter(F.length("pre") <= HOT_LENGTH).withColumn("step", F.floor(F.log2("freq") * 8).cast("int"))
    least, rows = None, 0
    for r in sorted(steps.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        rows += r["count"]
        if rows > hot:
            break
        least = r["step"]
    return steps.filter(F.lit(False) if least is None else F.col("step") >= least).drop("step")


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    spark = df.sparkSession
    docs = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("doc_id"), df[text_col].alias("text"))
    counted = frequencies(docs, path)
    known = distinct_pre_tokens(counted, path)
    top = most_frequent(known, hot).select("pre", "pieces").toPandas()
    table = spark.sparkContext.broadcast(dict(zip(top["pre"].tolist(), top["pieces"].tolist(), strict=True)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.get
        for b in batches:
            row, lists = b.column("row").to_numpy(), b.column("pre")
            # Each distinct pre-token of the batch is looked up once.
            found = lists.flatten().dictionary_encode()
            pieces = np.fromiter((get(p, -1) for p in found.dictionary.to_pylist()), np.int64, len(found.dictionary))[found.indices.to_numpy()]
            n, doc = b.column("n").flatten().to_numpy(), np.repeat(np.arange(len(row)), lists.value_lengths().to_numpy())
            hot = pieces >= 0
            here = np.zeros(len(row), np.int64)
            np.add.at(here, doc[hot], n[hot] * pieces[hot])
            rest = np.flatnonzero(~hot)
            # A document's own row has a key that no pre-token has, so that it meets nothing in the join.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row, row[doc[rest]]])),
                    pa.concat_arrays([b.column("doc_id"), pa.nulls(len(rest), b.column("doc_id").type)]),
                    pa.concat_arrays([b.column("n_bytes"), pa.nulls(len(rest), pa.int64())]),
                    pa.concat_arrays([pa.array([f"{MARK}{MARK}{r}" for r in row.tolist()], pa.string()), found.take(pa.array(rest)).cast(pa.string())]),
                    pa.array(np.concatenate([here, n[rest]])),
                ],
                ["row", "doc_id", "n_bytes", "pre", "n"],
            )

    own = counted.filter("together = 0").select("row", "doc_id", "n_bytes", "pre", "n")
    parts = own.mapInArrow(each, f"row bigint, doc_id {kind}, n_bytes bigint, pre string, n bigint")
    summed = (
        parts.join(known.select("pre", "pieces"), "pre", "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    )
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
