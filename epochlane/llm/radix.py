"""Ranks of all rows by a distributed LSD radix sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.session import discard, materialise

DIGIT_BITS = 11
#: Rows of a block at least; on large tables there are about MOST_BLOCKS blocks.
BLOCK_ROWS, MOST_BLOCKS = 2048, 20_000
SIGN = -(1 << 63)


def _starts(at: DataFrame) -> DataFrame:
    """(_of, _d, _start): where the rows of a digit in a block go first: after all rows of lesser
    digits, and after those of the digit in earlier blocks. Totals of digits are 2 ** DIGIT_BITS rows at most."""
    counts = at.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    totals = at.groupBy("_digit").agg(F.count("*").alias("_n"))
    lesser = totals.select("_digit", (F.sum("_n").over(Window.orderBy("_digit")) - F.col("_n")).alias("_lesser"))
    before = F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n")
    return counts.withColumn("_before", before).join(lesser, "_digit").select(F.col("_block").alias("_of"), F.col("_digit").alias("_d"), (F.col("_before") + F.col("_lesser")).alias("_start"))


def _pass(now: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """now with each row's slot after one stable counting sort by digit, and its block there."""
    at = now.withColumn("_digit", digit.cast("int"))

    def place(rows: pa.Table, starts: pa.Table) -> pa.Table:
        slots, digits = (rows[c].to_numpy() for c in ("_slot", "_digit"))
        in_order = np.argsort(slots)
        d = digits[in_order].astype(np.uint16)
        start = np.zeros(1 << DIGIT_BITS, np.int64)
        start[starts["_d"].to_numpy()] = starts["_start"].to_numpy()
        count = np.bincount(d, minlength=1 << DIGIT_BITS)
        by_digit = np.argsort(d, kind="stable")  # a counting sort, as d has 16 bits
        to = np.empty(len(d), np.int64)
        to[by_digit] = np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        out = rows.take(pa.array(in_order)).drop_columns(["_digit", "_slot", "_block"])
        return out.append_column("_slot", pa.array(to)).append_column("_block", pa.array(to // block_rows))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema.fields if f.name not in ("_slot", "_block")]
    return at.groupBy("_block").cogroup(_starts(at).groupBy("_of")).applyInArrow(place, ", ".join([*fields, "_slot long", "_block long"]))


def with_rank(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with column `name`: 1, 2, 3, ... in ascending order of the long columns keys, the first one weighs most.

    The digits of the keys, from the last to the first, are sorted by one stable pass each:
    blocks of rows count their digits, prefix sums over digits and blocks give each block where
    its rows go, and a block's own counting sort the place after that. Bits that all rows share take no
    pass. Nulls come last. Rows with equal keys get neighbouring ranks in any order; no
    rows give no rows. Columns of rows must not be called _slot, _block or _digit."""
    rows = materialise(rows)
    least = [F.coalesce(k, F.lit((1 << 63) - 1)) for k in keys]
    seen = rows.agg(F.count("*"), *[f(c) for c in least for f in (F.min, F.max)]).first()
    n = seen[0]
    block_rows = max(BLOCK_ROWS, -(-n // MOST_BLOCKS))
    slot = F.monotonically_increasing_id()
    now = rows.withColumn("_slot", slot).withColumn("_block", F.pmod(F.xxhash64("_slot"), F.lit(max(1, -(-n // block_rows)))))
    for j in reversed(range(len(keys))):
        bits = ((seen[1 + 2 * j] ^ seen[2 + 2 * j]) & (1 << 64) - 1).bit_length() if n else 0
        unsigned = least[j].bitwiseXOR(F.lit(SIGN))
        for shift in range(0, bits, DIGIT_BITS):
            after = materialise(_pass(now, F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)), block_rows))
            discard(rows)
            now = rows = after
    if now is not rows:  # no pass: all rows have equal keys
        now = materialise(now.withColumn("_slot", F.row_number().over(Window.partitionBy("_block").orderBy("_slot")) - 1)) if n else now
        return _number_blocks(now, name)
    return now.withColumn(name, F.col("_slot") + 1).drop("_slot", "_block")


def _number_blocks(now: DataFrame, name: str) -> DataFrame:
    """Numbers through blocks whose rows are numbered from 0; there are about MOST_BLOCKS blocks at most."""
    sizes = now.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    return now.join(before, "_block").withColumn(name, F.col("_before") + F.col("_slot") + 1).drop("_slot", "_block", "_before")
