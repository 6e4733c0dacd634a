"""Sessions, tables and staging."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def session(name: str = "corvane", **settings: str) -> SparkSession:
    """A session with what the operators expect: UTC, adaptive execution, skewed joins split."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=conf | settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has too few splits for them, as one small file has. A large table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    """A small DataFrame of literals."""
    return spark.createDataFrame(list(values), schema)


def shared_folder(spark: SparkSession) -> str:
    """A fresh path under the folder in spark.checkpoint.dir, which all executors share. Only a local session may lack that setting:
    a temporary folder stands in for it there."""
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
    """Written once to the shared folder and read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(rows_: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """rows_ with the other columns of per_key, which has a row for each key. The join is on a text made of the key: an aggregate is
    dealt by its key already, and only if both sides are exchanged for the join does adaptive execution split a hot key."""
    made = F.concat(F.lit("="), F.col(key).cast("string"))
    return rows_.withColumn("_key", made).join(per_key.withColumn("_key", made).drop(key), "_key").drop("_key")
