"""Sharding along a Hilbert curve, in DataFrame functions only.

Each metadata dimension is quantised to 2**BITS equally filled steps, strings by the counts of their whole values, numbers,
dates and times by approximate quantiles; the steps of a row are a cell of a Hilbert curve, rows are ordered by the cell's place on the curve, and the order is cut into runs. The law is `rows`: counts of shards
differ by one at most. Rows of a shard are close in every dimension at once, so that `shard_manifest` and
`shards_matching` leave out most shards for a range in any dimension.

No global sort and no single-task window: a row's rank is the number of rows in cells before its own, plus those in
parts of its cell before its own, plus its place in its part. A cell is split into as many parts by hash as keeps each
at 1/PARTS of all rows; the tables of cells and of parts have 2**(BITS * dimensions) + PARTS rows at most, whatever the
input, and only they are broadcast.

Cases. A null or empty text has 8 bytes of size and crc32 0; nulls in other dimensions are the lowest value, with empty strings.
Binary values are ordered by their bytes, values of other types by their string. A value that is more frequent than a step is
wide fills it alone. Repeated rows have a slot each, and are split like others. Texts of any length count by their bytes.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import row_key, staged, table

SHARDS, BITS, PARTS = 24, 4, 4096
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")


def comparable(col: Column, kind: str) -> Column:
    """The column as a double or a string in the same order; null is the lowest value."""
    if kind.startswith(NUMBERS):
        return F.coalesce(col.cast("double"), F.lit(float("-inf")))
    if kind == "date":
        return F.coalesce(F.unix_date(col).cast("double"), F.lit(float("-inf")))
    if kind.startswith("timestamp"):
        return F.coalesce(F.unix_micros(col.cast("timestamp")).cast("double"), F.lit(float("-inf")))
    return F.coalesce(F.hex(col) if kind == "binary" else col.cast("string"), F.lit(""))


def number_edges(slim: DataFrame, names: list[str], steps: int) -> dict[str, list[float]]:
    """The values that end each step but the last, of columns of doubles: approximate quantiles in one pass."""
    shares = [i / steps for i in range(1, steps)]
    found = slim.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names]).first()
    return {c: sorted(set(found[c] or [])) for c in names}


def string_edges(slim: DataFrame, name: str, steps: int) -> list[str]:
    """The values that end each step but the last, of a column of strings, which are compared whole: counts of the distinct values,
    cumulated in the ranges that Spark sorts them into, and then over the ranges."""
    counted = slim.groupBy(F.col(name).alias("value")).count().repartitionByRange("value").withColumn("range", F.spark_partition_id())
    counted = staged(counted)
    ranges = counted.groupBy("range").agg(F.sum("count").alias("rows"))
    ahead = F.sum("rows").over(Window.orderBy("range"))
    ranges = ranges.select("range", (ahead - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    upto = F.sum("count").over(Window.partitionBy("range").orderBy("value"))
    place = counted.withColumn("upto", upto).join(F.broadcast(ranges), "range").select("value", (F.col("before") + F.col("upto")).alias("upto"), "count", "total")
    # A value ends a step if the rows up to it reach a further step; the last value of all ends none.
    ends = F.floor(F.col("upto") * steps / F.col("total"))
    ended = place.filter((ends > F.floor((F.col("upto") - F.col("count")) * steps / F.col("total"))) & (F.col("upto") < F.col("total")))
    return [r["value"] for r in ended.select("value").orderBy("value").collect()]


def curve_cells(dims: int, bits: int = BITS) -> list[int]:
    """curve_cells()[cell number] is the cell's place on the curve; for tests and for small tables of cells."""

    def place(point: tuple[int, ...]) -> int:
        x, m = list(point), 1 << (bits - 1)
        q = m
        while q > 1:
            p = q - 1
            for i in range(dims):
                if x[i] & q:
                    x[0] ^= p
                else:
                    t = (x[0] ^ x[i]) & p
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        t, q = 0, m
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        out = 0
        for b in range(bits - 1, -1, -1):
            for a in x:
                out = out * 2 + (((a ^ t) >> b) & 1)
        return out

    return [place(p) for p in itertools.product(range(1 << bits), repeat=dims)]


def ranked(df: DataFrame, cell: str, order: list[str], hashed: list[str], parts: int = PARTS) -> DataFrame:
    """df (staged) with cell_rank, from 0 within each `cell` (an integer column of few values), rank, from 0 over all rows in the
    order of `cell`, and the number of rows, `total`."""
    cells = df.groupBy(cell).count()
    ahead = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(cell, "count", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    total = cells.agg(F.sum("count")).first()[0] or 0
    share = max(1, -(-total // parts))
    cells = cells.withColumn("parts", F.ceil(F.col("count") / F.lit(share)).cast("int"))
    split = df.join(F.broadcast(cells.select(cell, "before", "parts")), cell).withColumn("part", F.pmod(F.xxhash64(*hashed), F.col("parts")).cast("int"))
    sizes = split.groupBy(cell, "part").agg(F.count(F.lit(1)).alias("part_rows"))
    sizes = sizes.select(cell, "part", F.coalesce(F.sum("part_rows").over(Window.partitionBy(cell).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_before"))
    place = F.row_number().over(Window.partitionBy(cell, "part").orderBy(*order)) - 1
    return (
        split.withColumn("place", place)
        .join(F.broadcast(sizes), [cell, "part"])
        .withColumn("cell_rank", F.col("part_before") + F.col("place"))
        .withColumn("rank", F.col("before") + F.col("cell_rank"))
        .withColumn("total", F.lit(total).cast("long"))
        .drop("before", "parts", "part", "part_before", "place")
    )


def hilbert_shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang"), shards: int = SHARDS, bits: int = BITS, with_row: bool = False
) -> DataFrame:
    """doc_id, size, text_crc32, one step_<i> for each dimension (the size in bytes is the last), cell, shard, slot; with_row: and the
    key of df's row."""
    kinds = dict(df.dtypes)
    keys = []
    if with_row:
        df, row = row_key(df)
        keys = [row.alias("row")]
    text = F.coalesce(df[text_col], F.lit(""))
    slim = staged(
        df.select(
            *keys,
            df[id_col].alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            # Written here, it tells rows apart that are alike in all else.
            F.monotonically_increasing_id().alias("nth"),
            *[comparable(df[c], kinds[c]).alias(f"dim_{i}") for i, c in enumerate(dims)],
            F.octet_length(text).cast("double").alias(f"dim_{len(dims)}"),
        )
    )
    n = len(dims) + 1
    kind = {c: k for c, k in slim.dtypes if c.startswith("dim_")}
    edges = number_edges(slim, [c for c, k in kind.items() if k == "double"], 1 << bits)
    edges |= {c: string_edges(slim, c, 1 << bits) for c, k in kind.items() if k == "string"}
    steps = slim
    for i in range(n):
        # The cast from a boolean: a step is the number of edges below the value.
        steps = steps.withColumn(f"step_{i}", sum(((F.col(f"dim_{i}") > F.lit(e)).cast("int") for e in edges[f"dim_{i}"]), F.lit(0)))
    number = F.lit(0)
    for i in range(n):
        number = number * (1 << bits) + F.col(f"step_{i}")
    steps = steps.withColumn("cell", F.element_at(F.array(*map(F.lit, curve_cells(n, bits))), number + 1)).drop(*[f"dim_{i}" for i in range(n)])
    out = ranked(steps, "cell", ["text_crc32", "doc_id", "size", "nth"], ["doc_id", "text_crc32", "nth"])
    out = out.withColumn("shard", F.expr(f"cast(rank * {shards}L div total as int)"))
    return out.withColumn("slot", F.expr(f"rank - (shard * total + {shards - 1}L) div {shards}L")).drop("rank", "cell_rank", "total", "nth")


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000, **how) -> DataFrame:
    """Writes df, all its columns as they are, to a folder for each shard in the order of slots, and gives the manifest. A row is
    shuffled once to its file; the manifest says which shards a range in any dimension can be in."""
    df, row = row_key(df)
    placed = staged(hilbert_shards(df, with_row=True, **how))
    whole = df.select(F.struct(*[df[c] for c in df.columns]).alias("doc"), row.alias("row")).join(placed.select("row", "shard", "slot"), "row")
    files = whole.withColumn("part", F.floor(F.col("slot") / rows_per_file)).repartition("shard", "part").sortWithinPartitions("shard", "slot")
    files.select("doc", "slot", "shard").write.partitionBy("shard").parquet(path)
    return shard_manifest(placed)


def shard_manifest(sharded: DataFrame) -> DataFrame:
    """For each shard its rows and the range of steps in each dimension."""
    steps = [c for c in sharded.columns if c.startswith("step_")]
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *[f(c).alias(f"{k}_{c}") for c in steps for k, f in (("min", F.min), ("max", F.max))]
    )


def shards_matching(manifest: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """The shards that may hold rows with step_i in ranges['step_i'], both ends included."""
    for c, (low, high) in ranges.items():
        manifest = manifest.filter((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return manifest.select("shard")


def op3(spark, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell"
    )
