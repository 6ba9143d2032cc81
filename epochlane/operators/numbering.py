"""Gapless row numbers inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 400
BUCKETS_PER_BLOCK = 512


def gapless_index(df: DataFrame, group: str, order: list[str], name: str, n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """df with column `name`: 0, 1, 2, ... in each value of `group`.

    Rows are dealt by a hash of `order` into buckets of about rows_per_bucket rows
    of the whole table; a row's number is its rank in its bucket plus the rows of
    the group's earlier buckets, which a two-level prefix sum gives. So a group
    that holds a third of all rows is numbered by many tasks. The numbering is
    fixed by the rows alone when `order` identifies them; equal rows are numbered
    in any order among themselves. n_rows sizes the buckets. Nulls form a group.
    """
    n = max(1, -(-n_rows // rows_per_bucket))
    b, k, g = f"_{name}_bucket", f"_{name}_block", f"_{name}_group"
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(n))).withColumn(g, F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    counts = rows.groupBy(g, b).agg(F.count("*").alias("_n")).withColumn(k, F.floor(F.col(b) / BUCKETS_PER_BLOCK))
    blocks = counts.groupBy(g, k).agg(F.sum("_n").alias("_m"))
    blocks = blocks.withColumn("_m", F.coalesce(F.sum("_m").over(Window.partitionBy(g).orderBy(k).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(g, k).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_n", inside).join(blocks, [g, k]).select(g, b, (F.col("_n") + F.col("_m")).alias("_start"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(g, b).orderBy(F.xxhash64(*order), *order)) - 1)
    return ranked.join(starts, [g, b]).withColumn(name, (F.col("_start") + F.col("_rank")).cast("long")).drop(g, b, "_rank", "_start")
