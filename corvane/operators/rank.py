"""Positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import staged


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """df with rank from 0 in the order of columns. Rows are dealt by ranges and written; a range's rank is the rows of those before
    it, of which there are as many as shuffle partitions, plus the place in it."""
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
