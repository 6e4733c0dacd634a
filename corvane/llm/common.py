"""What the training-data operators share: staging in the shared folder, row keys, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE_SPACE = r"[\x20\x09-\x0D]+"
_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is missing, a temporary folder stands in for it in a local session, whose tasks share it; elsewhere it fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="corvane-"))
        base = _OWN_FOLDER[0]
    return f"{base.rstrip('/')}/corvane/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(df: DataFrame) -> tuple[DataFrame, Column]:
    """A DataFrame with df's rows and a column that identifies each row, the same in every evaluation.

    The key is the file and the row's place in it; a DataFrame that isn't a plain file scan is staged first.
    """
    try:
        meta = df.metadataColumn("_metadata")
        df.select(meta["row_index"])
    except AnalysisException:
        df = staged(df)
        meta = df.metadataColumn("_metadata")
    return df, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, text: all that an operator over groups of documents needs. Other columns, however named, stay out."""
    df, row = row_key(df)
    return df.select(row.alias("row"), df[id_col].alias("doc_id"), df[text_col].alias("text"))


def drop_rows(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """df without the rows whose key is in dropped.row. df must be the DataFrame whose row keys were taken."""
    df, row = row_key(df)
    with_key = df.select(F.struct(*[df[c] for c in df.columns]).alias("kept"), row.alias("row"))
    return with_key.join(dropped.select("row"), "row", "left_anti").select("kept.*")


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in parts, without a copy: what is made of one is passed on before the next is made."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that nothing is learned from: crc32 of the decimal id, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
