"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlane.operators.numbering import gapless_index
from epochlane.session import materialise

#: Whole-number target weights; all sources without an entry share the one of OTHER.
WEIGHTS = {f"src{i}": 4 if i == 0 else 1 + i % 3 for i in range(20)}
OTHER, OTHER_WEIGHT = "(other)", 1
BLOCK_ROWS = 64


def edf(quota: F.Column) -> F.Column:
    """The order of one round: an array of places in `quota`, an array of whole numbers above 0.

    Block i (from 0) of a source with quota c out of h may start at floor(i h / c) and must
    end by ceil((i + 1) h / c). Each slot goes to the released block of the earliest deadline,
    the first source on ties; every block then meets its deadline, so after every slot each
    source is less than one block from its share."""
    h = F.aggregate(quota, F.lit(0).cast("long"), lambda a, c: a + c)

    def step(state, slot):
        ready = F.transform(state["used"], lambda u, j: F.when((u < F.get(quota, j)) & (F.floor(u * h / F.get(quota, j)) <= slot), F.struct(F.ceil((u + 1) * h / F.get(quota, j)).alias("deadline"), j.alias("j"))))
        pick = F.array_min(F.filter(ready, lambda x: x.isNotNull()))["j"]
        moved = F.transform(F.array(pick), lambda p: F.struct(F.transform(state["used"], lambda u, j: F.when(j == p, u + 1).otherwise(u)).alias("used"), F.concat(state["out"], F.array(p)).alias("out")))
        return F.get(moved, F.lit(0))

    start = F.struct(F.transform(quota, lambda c: F.lit(0).cast("long")).alias("used"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), h - 1), start, step, lambda s: s["out"])


def round_table(sources: DataFrame) -> DataFrame:
    """The rounds of a mixture, as (mix_source, k, first_round, last_round, at, h, slot, release, deadline).

    sources: mix_source, weight, n (blocks). A round takes `weight` blocks of every source
    that still has them, and what is left in a source's last one. Rounds of equal quotas share
    one schedule: there are at most two kinds for each source and one more. `at` is the
    number of blocks before first_round, h the blocks of one round; block k of the source's
    blocks in the round takes `slot`. Size: sources squared times weights, whatever the data."""
    all_ = sources.where("n > 0").agg(F.sort_array(F.collect_list(F.struct("mix_source", "weight", "n"))).alias("s")).where("size(s) > 0")
    full = lambda x: F.floor(x["n"] / x["weight"]).cast("long")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("s", full), F.transform("s", lambda x: full(x) + 1))
    kinds = all_.withColumn("r", F.array_sort(F.array_distinct(starts))).select("s", "r", F.posexplode("r").alias("i", "first_round"))
    kinds = kinds.withColumn("last_round", F.coalesce(F.get("r", F.col("i") + 1) - 1, F.lit((1 << 62))))
    left = lambda x: F.greatest(F.lit(0).cast("long"), F.least(x["weight"].cast("long"), x["n"] - F.col("first_round") * x["weight"]))
    kinds = kinds.withColumn("q", F.filter(F.transform("s", lambda x: F.struct(x["mix_source"].alias("mix_source"), left(x).alias("c"))), lambda x: x["c"] > 0)).where("size(q) > 0")
    kinds = kinds.withColumn("at", F.aggregate(F.transform("s", lambda x: F.least(x["n"], F.col("first_round") * x["weight"])), F.lit(0).cast("long"), lambda a, b: a + b))
    kinds = kinds.withColumn("h", F.aggregate(F.transform("q", lambda x: x["c"]), F.lit(0).cast("long"), lambda a, b: a + b))
    slots = kinds.withColumn("order", edf(F.transform("q", lambda x: x["c"]))).select("first_round", "last_round", "at", "h", "q", F.posexplode("order").alias("slot", "j"))
    slots = slots.select("*", F.get("q", F.col("j"))["mix_source"].alias("mix_source"), F.get("q", F.col("j"))["c"].alias("c"))
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("first_round", "mix_source").orderBy("slot")) - 1)
    return slots.select("mix_source", F.col("k").cast("long").alias("k"), "first_round", "last_round", "at", "h", F.col("slot").cast("long").alias("slot"), F.floor(F.col("k") * F.col("h") / F.col("c")).alias("release"), F.ceil((F.col("k") + 1) * F.col("h") / F.col("c")).alias("deadline"))


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, mix_source, block, slot, release, deadline, position for every row of docs (doc_id, source).

    Rows of a source, in an order hashed from doc_id, form blocks of block_rows. Blocks are
    interleaved so that after every block each source has less than one block more or less
    than its target share of the blocks so far. When a source runs out, the others go on with
    the same weights among themselves, so every row has exactly one place: position runs
    gapless from 0 over rows, slot over blocks; release and deadline bound slot
    (release <= slot < deadline). A null or unlisted source belongs to OTHER. Weights are
    whole numbers above 0. Repeated rows each get a place; an empty table gives an empty one."""
    if any(w < 1 or w != int(w) for w in weights.values()):
        raise ValueError("weights must be whole numbers above 0")
    known = F.col("source").isin(list(weights))
    rows = docs.select("doc_id", F.when(known, F.col("source")).otherwise(OTHER).alias("mix_source"))
    n = rows.groupBy("mix_source").agg(F.count("*").alias("rows"))
    weight = F.coalesce(*[F.when(F.col("mix_source") == s, F.lit(int(w))) for s, w in weights.items()], F.lit(OTHER_WEIGHT))
    sources = materialise(n.select("mix_source", "rows", weight.alias("weight"), F.ceil(F.col("rows") / block_rows).alias("n")))
    total = sources.agg(F.sum("rows")).first()[0] or 0
    table = round_table(sources).join(sources.select("mix_source", "weight", "rows", "n"), "mix_source")
    # the last block of a source is short: rows that are missing from the blocks before a slot
    last = (F.col("n") - 1) % F.col("weight") == F.col("k")
    in_last = last & (F.floor((F.col("n") - 1) / F.col("weight")).between(F.col("first_round"), F.col("last_round")))
    end = F.when(in_last, F.struct((F.col("at") + (F.floor((F.col("n") - 1) / F.col("weight")) - F.col("first_round")) * F.col("h") + F.col("slot")).alias("slot"), (F.col("n") * block_rows - F.col("rows")).alias("gap")))
    table = table.withColumn("end", end)
    gaps = table.groupBy(F.lit(0).alias("one")).agg(F.collect_list("end").alias("gaps"))  # collect_list leaves nulls out
    table = materialise(table.withColumn("one", F.lit(0)).join(gaps, "one"))
    placed = gapless_index(rows, "mix_source", ["doc_id"], "rank", total)
    placed = placed.withColumn("block", F.floor(F.col("rank") / block_rows)).withColumn("weight", weight)
    placed = placed.withColumns({"round": F.floor(F.col("block") / F.col("weight")), "k": F.col("block") % F.col("weight")})
    # the table's size is bounded by the weights given, see round_table
    t = F.broadcast(table.select("mix_source", "k", "first_round", "last_round", "at", "h", "slot", "release", "deadline", "gaps"))
    out = placed.join(t, ["mix_source", "k"]).where(F.col("round").between(F.col("first_round"), F.col("last_round")))
    base = F.col("at") + (F.col("round") - F.col("first_round")) * F.col("h")
    out = out.withColumns({x: base + F.col(x) for x in ("slot", "release", "deadline")})
    missing = F.aggregate(F.filter("gaps", lambda g: g["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda a, g: a + g["gap"])
    return out.select("doc_id", "mix_source", "block", "slot", "release", "deadline", (F.col("slot") * block_rows + F.col("rank") % block_rows - missing).alias("position"))


def places(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """(_id, slot, position): the first place of each doc_id in the mixture."""
    first = F.min(F.struct("position", "slot")).alias("_first")
    return mix(docs, weights).groupBy(F.col("doc_id").alias("_id")).agg(first).select("_id", "_first.slot", "_first.position")


def with_places(docs: DataFrame, of: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """of (doc_id and other columns) with slot and position of each row's doc_id in the mixture of docs."""
    place = places(docs, weights)
    return of.join(place, of["doc_id"].eqNullSafe(place["_id"])).drop("_id")


def in_mixed_order(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS) -> DataFrame:
    """The rows of docs, all columns, dealt over partitions and sorted by their place in the mixture.

    Written files follow in that order. Rows of one doc_id share its first place."""
    place = places(docs, weights).select("_id", F.col("position").alias("_position"))
    rows = docs.select(F.col("doc_id").alias("_of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))  # names of docs can't clash in there
    return rows.join(place, F.col("_of").eqNullSafe(F.col("_id"))).repartitionByRange("_position").sortWithinPartitions("_position").select("_row.*")
