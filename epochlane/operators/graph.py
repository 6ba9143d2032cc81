"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.session import discard, materialise

SALTS = 8


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the least v of its u, or u itself if that is less.

    The per-node minimum is combined before the shuffle; the join back is salted,
    so a node with very many neighbours is spread over SALTS keys.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "salt"]).select("u", "v", "m")


def _settled(pairs: DataFrame) -> bool:
    """Whether distinct pairs (u, v), v < u, are stars: every u has one v, and no v is a u."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node that has an edge.

    edges: columns src and dst of one orderable type. Rows with a null end are
    ignored; a self-loop makes its node a component of its own; repeated and
    reversed edges count once. An empty table gives an empty table. The number of
    rounds is logarithmic in the size of the largest component; each round is two
    group-bys over the remaining edges, written to the shared folder. Rounds end with
    the first whose edges are stars, so links that are stars already take none.
    """
    clean = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    nodes = clean.select(F.col("a").alias("node")).union(clean.select("b")).distinct()
    now = materialise(clean.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # u > v holds for every row of large, so its rows are each node's smaller neighbours
        stars = _least_neighbour(large)
        small = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).union(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialise(small)
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
