"""Percentage profiles over a day, from prefix counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = ["subject_id", "day"]


def prefix_counts(epochs: DataFrame, stage: int, keys: list[str] = DAY, idx: str = "epoch_idx") -> DataFrame:
    """(keys, upto, hits): epochs of the stage among the first `upto`, for upto = 0 and each epoch.

    One window per key gives them; every interval count is then a difference of two."""
    w = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    inside = epochs.select(*keys, (F.col(idx) + 1).alias("upto"), F.sum((F.col("stage") == stage).cast("long")).over(w).alias("hits"))
    return inside.union(epochs.select(*keys, F.lit(0), F.lit(0).cast("long")).distinct())


def shares(intervals: DataFrame, counts: DataFrame, keys: list[str] = DAY, scale: float = 100.0) -> DataFrame:
    """intervals (keys, start, end, ...) with pct, the share of hits in [start, end) times scale; 0 if empty."""
    at = lambda col, hits: counts.select(*keys, F.col("upto").alias(col), F.col("hits").alias(hits))
    out = intervals.join(at("start", "_from"), [*keys, "start"]).join(at("end", "_to"), [*keys, "end"])
    share = F.when(F.col("end") > F.col("start"), F.lit(scale) * (F.col("_to") - F.col("_from")) / (F.col("end") - F.col("start"))).otherwise(0.0)
    return out.withColumn("pct", share).drop("_from", "_to")


def day_lengths(epochs: DataFrame, keys: list[str] = DAY) -> DataFrame:
    return epochs.groupBy(*keys).agg(F.count("*").alias("n"))


def fixed_intervals(lengths: DataFrame, n_points: Column, overlap: Column) -> DataFrame:
    """n_points intervals a day, centred in equal segments and as wide as the overlap makes them."""
    seg = F.col("n") / n_points
    points = lengths.withColumn("point_idx", F.explode(F.sequence(F.lit(0).cast("int"), n_points.cast("int") - 1)))
    centre, half = (F.col("point_idx") + 0.5) * seg, seg / (1 - overlap) / 2
    low, high = F.floor(F.greatest(F.lit(0.0), centre - half)), F.floor(F.least(F.col("n").cast("double"), centre + half))
    return points.withColumns({"start": low.cast("int"), "end": high.cast("int")})


def fixed_n(epochs: DataFrame, n_points: int, overlap: float, stage: int = 2, keys: list[str] = DAY) -> DataFrame:
    """(keys, point_idx, pct): n_points percentages of a stage a day, from overlapping intervals."""
    spots = fixed_intervals(day_lengths(epochs, keys), F.lit(n_points), F.lit(overlap))
    return shares(spots, prefix_counts(epochs, stage, keys), keys).select(*keys, "point_idx", "pct")


def grid(epochs: DataFrame, choices: list[tuple[int, float]], stage: int = 2) -> DataFrame:
    """fixed_n for every (n_points, overlap) at once: one pass over the epochs, the choices exploded per day."""
    options = F.array(*[F.struct(F.lit(n).alias("n_points"), F.lit(float(o)).alias("overlap")) for n, o in choices])
    days = day_lengths(epochs).withColumn("_c", F.explode(options)).select(*DAY, "n", "_c.n_points", "_c.overlap")
    spots = fixed_intervals(days, F.col("n_points"), F.col("overlap"))
    return shares(spots, prefix_counts(epochs, stage)).select(*DAY, "n_points", "overlap", "point_idx", "pct")


def sliding(epochs: DataFrame, width: int, step: int, stage: int = 2, inclusive: bool = False, scale: float = 100.0, keys: list[str] = DAY, whole_if_short: bool = False) -> DataFrame:
    """(keys, point_idx, pct): shares in windows of `width` epochs every `step`; epochs are numbered from 0 without gaps.

    A window that ends with the last epoch counts only if inclusive. A day that is shorter
    than one window has no point, or with whole_if_short one over all its epochs.
    Points are picked from the epochs that end them, in one pass: a table of points made from the
    days' lengths looks as small as those to the planner, which would send it through the driver."""
    day = Window.partitionBy(*keys).orderBy("epoch_idx")
    hits, upto = F.count(F.when(F.col("stage") == stage, 1)), F.col("epoch_idx") + 1
    ends = epochs.dropna(subset=keys).select(
        *keys, upto.alias("_upto"), F.lead("epoch_idx").over(day).isNull().alias("_last"),
        hits.over(day.rangeBetween(Window.unboundedPreceding, 0)).alias("_to"), hits.over(day.rangeBetween(Window.unboundedPreceding, -width)).alias("_from"))
    past = F.col("_upto") - width
    wanted = (past >= 0) & (past % step == 0) & (F.lit(inclusive) | ~F.col("_last"))
    if whole_if_short:
        wanted = wanted | (past < 0) & F.col("_last")
    pct = F.lit(scale) * (F.col("_to") - F.col("_from")) / F.least(F.col("_upto"), F.lit(width))
    return ends.where(wanted).select(*keys, F.floor(F.greatest(past, F.lit(0)) / step).cast("int").alias("point_idx"), pct.alias("pct"))


def concatenated(window_days: DataFrame, epochs: DataFrame) -> DataFrame:
    """Epochs of each window's days one after another: (window_id, epoch_idx, stage); missing days are skipped."""
    lengths = window_days.select("window_id", "day_idx", *DAY).join(day_lengths(epochs), DAY)
    before = Window.partitionBy("window_id").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return offsets.join(epochs, DAY).select("window_id", (F.col("_offset") + F.col("epoch_idx")).cast("int").alias("epoch_idx"), "stage")


def of_windows(window_days: DataFrame, profile: DataFrame, n_points: int) -> DataFrame:
    """(window_id, day_idx, point_idx, pct): the day profiles of a window; a missing day has n_points nulls."""
    slots = window_days.select("window_id", "day_idx", *DAY).withColumn("point_idx", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    return slots.join(profile, [*DAY, "point_idx"], "left").select("window_id", "day_idx", "point_idx", "pct")


def combine(window_profile: DataFrame, how: str) -> DataFrame:
    """One value a point over a window's days: average, max, min, std or sum; 0 where no day has one."""
    of = {"average": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop, "sum": F.sum}[how]
    return window_profile.groupBy("window_id", "point_idx").agg(F.coalesce(of("pct"), F.lit(0.0)).alias("value"))
