"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so: after at least CHUNK_MIN characters, behind the next punctuation
mark, and at CHUNK_MAX characters at the latest. Equal texts have equal cuts. Each distinct chunk gets an identifier
that is verified: every distinct (hash, chunk) pair is moved once, and where one hash stands for several chunks, those
are numbered. A document's recipe is the ordered list of its identifiers; two texts are equal exactly if their recipes
are, and from here on only recipes, of eight bytes and a number for each chunk, are shuffled and compared. The text of a
long document is never grouped or joined.

Cases. A null text counts as empty; all empty texts are one group. A null id sorts behind every other id, and a group in
which all ids are null has keep_id null. Exactly one row of a group is kept: of rows that repeat the smallest id, one.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WHITE_SPACE, drop_rows, keyed_text, row_key, staged

CHUNK_MIN, CHUNK_MAX = 512, 4096


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> str:
    # The quantifiers are lazy and possessive: the JVM's matcher loops over them and doesn't recurse.
    return rf"(?s).{{{least},{most}}}?\p{{Po}}|.{{1,{most}}}+"


def chunks_of(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(least, most)), F.lit(0))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def chunk_dictionary(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """h, chunk: every distinct chunk with its hash. Copies are combined in each map task before the shuffle."""
    return docs.select(F.explode(chunks_of(normalised(F.col("text")))).alias("chunk")).select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()


def recipes(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """row, doc_id, text_sha256, recipe of documents (row, doc_id, text); a recipe is an array of (h, n)."""
    text = normalised(F.col("text"))
    plain = docs.select(
        "row",
        "doc_id",
        F.sha2(text, 256).alias("text_sha256"),
        F.transform(chunks_of(text), lambda c: F.struct(chunk_hash(c).alias("h"), F.lit(0).alias("n"))).alias("recipe"),
    )
    words = chunk_dictionary(docs, chunk_hash)
    shared = staged(words.groupBy("h").count().filter("count > 1").select("h"))
    if shared.isEmpty():
        return plain
    # A few hashes stand for more than one chunk: number those chunks, and renumber the recipes that hold one.
    numbered = staged(
        words.join(shared, "h", "left_semi")
        .groupBy("h")
        .agg(F.sort_array(F.collect_set("chunk")).alias("all"))
        .select("h", F.posexplode("all").alias("n", "chunk"))
    )
    text_chunks = docs.select("row", F.posexplode(chunks_of(text)).alias("at", "chunk")).withColumn("h", chunk_hash(F.col("chunk")))
    touched = text_chunks.join(shared, "h", "left_semi").select("row").distinct()
    renumbered = (
        text_chunks.join(touched, "row", "left_semi")
        .join(numbered, ["h", "chunk"], "left")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("at", "h", F.coalesce("n", F.lit(0)).alias("n")))).alias("all"))
        .select("row", F.transform("all", lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"))).alias("again"))
    )
    return plain.join(renumbered, "row", "left").select("row", "doc_id", "text_sha256", F.coalesce("again", "recipe").alias("recipe"))


def exact_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """row, doc_id, keep_id, group_size, kept, text_sha256: one row for each row of df."""
    listed = staged(recipes(keyed_text(df, id_col, text_col), chunk_hash))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))
    groups = staged(listed.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    both = listed.join(groups, "recipe", "left")
    return both.select(
        "row",
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all its columns as they were."""
    df, _ = row_key(df)
    return drop_rows(df, exact_groups(df, id_col, text_col).filter("not kept"))
