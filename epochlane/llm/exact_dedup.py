"""Exact dedup: sorted runs of digests, merged in rounds as a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlane.session import materialise

#: Runs at the start, and how many meet in one merge: three rounds.
RUNS, WAYS = 512, 8
#: A run is cut by range of digests into shards of about this many texts, LEAST_SHARDS at least.
TEXTS_PER_SHARD, LEAST_SHARDS = 500_000, 1024
KEY = ["digest", "check", "n_bytes"]


def normalised(text: Column) -> Column:
    """The text without blanks and control white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def digests(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """(doc_id, run, digest, check, n_bytes, points): what stands for each row's text.

    A text's identity is its SHA-256 together with a second, independent hash and its
    length, so a merge by this key is verified at every level."""
    text = normalised(F.col("text"))
    at = docs.select("doc_id", text.alias("_t"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    return at.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(runs)).alias("run"), F.unhex(F.sha2("_t", 256)).alias("digest"), F.xxhash64("_t").alias("check"), F.octet_length("_t").alias("n_bytes"), "points")


def shard_of(digest: Column, shards: int) -> Column:
    """The range of digests, out of `shards` equal ones, that a digest is in."""
    return F.floor(F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") * F.lit(shards) / F.lit(float(1 << 32))).cast("int")


def merge_runs(level: DataFrame, ways: int) -> DataFrame:
    """Every `ways` neighbouring runs become one; of equal keys the best row stays, counts add up.

    The same ranges of those runs are sent to one partition, where they are merged in the order
    of their digests: the grouping needs no exchange and no sort beyond these. Sizes are bounded
    by the shards."""
    met = level.withColumn("run", F.floor(F.col("run") / ways)).repartition("run", "shard").sortWithinPartitions("run", "shard", *KEY)
    return met.groupBy("run", "shard", *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def duplicates(docs: DataFrame, runs: int = RUNS, ways: int = WAYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, keep_points for every row of docs (doc_id, text).

    Texts are equal when they are after normalised(). Of equal texts the row with the most
    code points stays, then the smallest doc_id (null last). Null texts count as empty and
    all empty ones are equal. Rows that repeat the doc_id that stays are kept with it where they have as many code
    points; keep_points are those of the row that stays. Extra
    columns are ignored; an empty table gives an empty table.

    Each run first reduces its own copies, so a text that fills a third of the table is cut
    to one row a run before runs meet; on the way back its keeper goes to those rows first
    and then to the documents of each run, so no task gets all copies."""
    rows = materialise(digests(docs, runs))
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("last"), "doc_id")
    first = materialise(rows.groupBy("run", *KEY).agg(F.min(best).alias("best"), F.count("*").alias("n")))
    shards = max(LEAST_SHARDS, -(-first.count() // TEXTS_PER_SHARD))
    level, left = first.withColumn("shard", shard_of(F.col("digest"), shards)), runs
    while left > 1:
        level, left = merge_runs(level, ways), -(-left // ways)
    keeper = level.select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (-F.col("best.points")).alias("keep_points"))
    of_run = materialise(first.select("run", *KEY).join(keeper, KEY))
    out = rows.join(of_run, ["run", *KEY])
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "keep_points")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that duplicates() keeps, all columns: of each group of equal texts one row.

    Where rows repeat the doc_id that stays, it is one with the most code points, of these one
    with the least text. Rows meet their group's decision and each other in one exchange."""
    # null ids are a key like any other; one text, so that join and grouping use the same exchange
    id_key = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))
    kept = duplicates(docs).where("kept").select(id_key.alias("_id"), F.col("text_sha256").alias("_sha"), F.col("keep_points").alias("_points")).distinct()
    own = F.struct(*docs.columns).alias("_row")
    at = docs.select(id_key.alias("_id"), F.sha2(normalised(F.col("text")), 256).alias("_sha"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("_points"), own)
    found = at.join(kept, ["_id", "_sha", "_points"], "left_semi")
    return found.groupBy("_id", "_sha", "_points").agg(F.min_by("_row", F.coalesce("_row.text", F.lit(""))).alias("_row")).select("_row.*")
