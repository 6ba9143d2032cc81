"""Splits of rows into folds, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.operators.ranking import quantile, rank_column, rank_within


def shuffled(id_col: str, seed: int) -> Column:
    """A text that orders rows at random, the same for the same seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def k_fold(df: DataFrame, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold 0..k-1, sizes at most one apart."""
    at = rank_column(df.withColumn("_o", shuffled(id_col, seed)), [F.col("_o"), F.col(id_col)], "_r")
    return at.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r", "_o")


def stratified(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """As k_fold within each label: each label's rows are ranked by range, its start taken off."""
    at = rank_column(df.withColumn("_o", shuffled(id_col, seed)), [F.col(label), F.col("_o"), F.col(id_col)], "_r")
    first = at.groupBy(F.col(label).alias("_l")).agg(F.min("_r").alias("_f"))
    at = at.join(F.broadcast(first), F.col(label).eqNullSafe(F.col("_l")))  # one row a class
    return at.withColumn("fold", ((F.col("_r") - F.col("_f")) % k).cast("int")).drop("_r", "_o", "_l", "_f")


def leave_one_out(df: DataFrame, id_col: str) -> DataFrame:
    return rank_column(df, [F.col(id_col)], "_r").withColumn("fold", F.col("_r") - 1).drop("_r")


def leave_two_groups_out(df: DataFrame, group: str) -> DataFrame:
    """(a, b): every pair of groups that is left out together; groups are few."""
    g = df.select(group).distinct()
    a, b = g.select(F.col(group).alias("a")), g.select(F.col(group).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def shuffle_split(df: DataFrame, id_col: str, splits: int, test_share: float, seed: int = 42) -> DataFrame:
    """(.., split, test): each split draws rows on its own, by a hash under a threshold."""
    at = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("split").cast("string"), F.lit(":"), F.col(id_col).cast("string"))), 1, 8), 16, 10).cast("long")
    return at.withColumn("test", h < int(test_share * (1 << 32)))


def stratified_shuffle_split(df: DataFrame, id_col: str, label: str, splits: int, test_share: float, seed: int = 42) -> DataFrame:
    """(.., split, test): each split draws floor(test_share * n) rows of each label on its own.

    Ranks inside a label come from a ranking of the whole table, so a label's rows meet in no one task."""
    at = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("split").cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    at = at.withColumn("_o", drawn).withColumn("_g", F.concat_ws(":", F.col("split").cast("string"), F.coalesce(F.col(label).cast("string"), F.lit("\0"))))
    ranked = rank_within(at, "_g", [F.asc("_o"), F.asc(id_col)], "_k")
    size = at.groupBy(F.col("_g").alias("_s")).agg(F.floor(F.count("*") * test_share).alias("_n"))
    return ranked.join(size, F.col("_g") == F.col("_s")).withColumn("test", F.col("_k") <= F.col("_n")).drop("_o", "_g", "_s", "_k", "_n")


def time_series(df: DataFrame, order: list[str], splits: int = 5) -> DataFrame:
    """(.., split, role): split i trains on the rows before its test block of n // (splits + 1) rows; later rows are left out."""
    n = df.count()
    size = n // (splits + 1)
    at = rank_column(df, [F.col(c) for c in order], "_r").withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    start = F.lit(n) - (F.lit(splits) - F.col("split")) * size
    role = F.when(F.col("_r") <= start, "train").when(F.col("_r") <= start + size, "test")
    return at.withColumn("role", role).where("role is not null").drop("_r")


def grouped(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups in order, dealt in turn to k folds; both groups and rows may be many."""
    g = rank_column(df.select(group).distinct(), [F.asc(group)], "_r").select(F.col(group).alias("_group"), ((F.col("_r") - 1) % k).cast("int").alias("fold"))
    return df.join(g, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def temporal(df: DataFrame, date: str, share: float = 0.8) -> DataFrame:
    """df with role train up to the distinct date at `share` of them, test after."""
    d = df.select(date).distinct()
    w = Window.partitionBy(F.lit(0))
    d = d.withColumns({"_k": F.row_number().over(w.orderBy(date)), "_n": F.count("*").over(w)})
    d = d.select(date, F.when(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("_n"))), "train").otherwise("test").alias("role"))
    return df.join(F.broadcast(d), date)


def design(df: DataFrame, features: list[str], train: Column) -> DataFrame:
    """Features filled with the train median, less the train mean, over the train sample deviation (1 where 0).

    Medians are exact, by ranks; mean and deviation, of the filled train rows, are one row."""
    on = df.where(train)
    mid = {c: quantile(on, c, 0.5) for c in features}
    fill = lambda at: at.withColumns({c: F.coalesce(c, F.lit(mid[c]).cast("double")) for c in features})
    stats = fill(on).agg(*[F.avg(c).alias(f"_a_{c}") for c in features], *[F.stddev_samp(c).alias(f"_s_{c}") for c in features]).withColumn("_", F.lit(0))
    out = fill(df).withColumn("_", F.lit(0)).join(F.broadcast(stats), "_")
    sd = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
    return out.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / sd(c) for c in features}).drop("_", *[f"_{k}_{c}" for k in "as" for c in features])
