"""Joins to a small side by a key that may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.session import materialise

RUNS = 128
#: Rows of one task of dealt(), about.
ROWS_PER_TASK = 1_000_000


def dealt(df: DataFrame, *keys: str, rows: int = ROWS_PER_TASK) -> DataFrame:
    """df dealt by keys over as many tasks as its rows need, a shuffle's partitions at least.

    Spark sizes tasks by compressed bytes, and repetitive rows compress to next to nothing."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
    return df.repartition(parts, *keys)


def join_spread(rows: DataFrame, small: DataFrame, keys: list[str], by: str, runs: int = RUNS) -> DataFrame:
    """Inner join of rows with small, which has each value of keys once.

    Rows are dealt into runs by a hash of column `by`. Each run's distinct keys, at most one
    row a run and key, meet small first; then rows join by run and key, so a key that fills
    a third of rows is spread over all runs."""
    at = rows.withColumn("_run", F.pmod(F.xxhash64(by), F.lit(runs)))
    of_run = materialise(at.select("_run", *keys).distinct().join(small, keys))
    return at.join(of_run, ["_run", *keys]).drop("_run")
