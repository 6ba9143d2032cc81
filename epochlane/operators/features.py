"""Features of window profiles: per day, per chunk, per period, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = {
    "max_min_diff": lambda c: F.max(c) - F.min(c), "range": lambda c: F.max(c) - F.min(c), "max": F.max, "min": F.min,
    "mean": F.avg, "std": F.stddev_pop, "sum": F.sum,
}


def daily_stats(rows: DataFrame, n_days: int, stats: list[str], empty: float | None = 0.0) -> DataFrame:
    """(window_id, day, stat...): statistics of n_days equal slices of each window; the last takes the remainder.

    rows: (window_id, pos, value), gaps as nulls. A slice without a value, and every slice of a window
    with fewer points than days, gets `empty`."""
    at = rows.withColumn("_n", F.count("*").over(Window.partitionBy("window_id")))
    size = F.floor(F.col("_n") / n_days)
    day = F.when(size > 0, F.least(F.floor(F.col("pos") / size), F.lit(n_days - 1)))
    got = at.withColumn("day", day.cast("int")).where("day is not null").groupBy("window_id", "day").agg(*[STATS[s]("value").alias(s) for s in stats])
    spots = rows.select("window_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))))
    return spots.join(got, ["window_id", "day"], "left").select("window_id", "day", *[F.coalesce(s, F.lit(empty).cast("double")).alias(s) for s in stats])


def wide_days(stats: DataFrame, n_days: int, names: list[str]) -> DataFrame:
    """One row a window, columns day_{d}_{stat}, day by day."""
    cols = [F.max(F.when(F.col("day") == d, F.col(s))).alias(f"day_{d}_{s}") for d in range(n_days) for s in names]
    return stats.groupBy("window_id").agg(*cols)


def profile_stats(rows: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("value", F.lit(p))
    return rows.groupBy("window_id").agg(F.max("value").alias("max"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q(0.5).alias("median"), (F.max("value") - F.min("value")).alias("range"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def summary(rows: DataFrame) -> DataFrame:
    """Basic statistics, trend (correlation with the index; 0 for two points or fewer), slope, variance and shape.

    The index counts the window's values without gaps."""
    at = rows.where("value is not null").withColumn("i", (F.row_number().over(Window.partitionBy("window_id").orderBy("pos")) - 1).cast("double"))
    many, flat = F.count("*") > 2, F.stddev_pop("value") == 0
    return at.groupBy("window_id").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"),
        F.when(many & ~flat, F.corr("i", "value")).otherwise(0.0).alias("trend"), F.when(many, F.regr_slope("value", "i")).otherwise(0.0).alias("slope"), F.var_pop("value").alias("variance"),
        F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis("value")).alias("kurtosis"))


def peaks(rows: DataFrame) -> DataFrame:
    """(window_id, n_peaks, mean, std) of local maxima at the mean or higher; a flat top is one peak; ends are none."""
    at = rows.where("value is not null")
    w = Window.partitionBy("window_id").orderBy("pos")
    at = at.withColumn("_new", F.coalesce((F.lag("value").over(w) != F.col("value")).cast("int"), F.lit(1)))
    at = at.withColumns({"_run": F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_mean": F.avg("value").over(Window.partitionBy("window_id"))})
    runs = at.groupBy("window_id", "_run").agg(F.first("value").alias("v"), F.first("_mean").alias("m"))
    r = Window.partitionBy("window_id").orderBy("_run")
    runs = runs.withColumn("peak", (F.lag("v").over(r) < F.col("v")) & (F.lead("v").over(r) < F.col("v")) & (F.col("v") >= F.col("m")))
    hit = F.when(F.col("peak"), F.col("v"))
    return runs.groupBy("window_id").agg(F.count(hit).alias("n_peaks"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(hit), F.lit(0.0)).alias("std"))


def chunks(rows: DataFrame, k: int) -> DataFrame:
    """rows (window_id, pos, value) with chunk_idx 0..k-1 over their values; windows with fewer than k have none.

    Lengths differ by one at most; the extra points go to chunks 0, 2, 4, ... first, then 1, 3, ..."""
    at = rows.where("value is not null")
    at = at.withColumns({"_i": F.row_number().over(Window.partitionBy("window_id").orderBy("pos")) - 1, "_n": F.count("*").over(Window.partitionBy("window_id"))}).where(F.col("_n") >= k)
    base, extra, n_even = F.floor(F.col("_n") / k), F.col("_n") % k, (k + 1) // 2
    ends = []
    end: Column = F.lit(0)
    for j in range(k):
        place = j // 2 if j % 2 == 0 else n_even + j // 2
        end = end + base + F.when(extra > place, 1).otherwise(0)
        ends.append(end)
    bounds = at.select("window_id", "_n").distinct().select("window_id", F.array(*ends).alias("_ends"))
    at = at.join(bounds, "window_id")
    return at.withColumn("chunk_idx", F.size(F.filter("_ends", lambda e: e <= F.col("_i")))).select("window_id", "pos", "chunk_idx", "value")


def chunk_stats(chunked: DataFrame, pairs: bool = False) -> DataFrame:
    """Range, mean, std, skew and excess kurtosis per chunk, or per pair of chunks 2k and 2k+1."""
    at = chunked.withColumn("chunk_idx", F.floor(F.col("chunk_idx") / 2).cast("int")) if pairs else chunked
    flat = F.stddev_pop("value") == 0
    return at.groupBy("window_id", "chunk_idx").agg(
        (F.max("value") - F.min("value")).alias("range"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.when(flat, 0.0).otherwise(F.skewness("value")).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis("value")).alias("kurtosis"))


def chunk_groups(stats: DataFrame, pair_stats: DataFrame) -> DataFrame:
    """stats with `grp`: all; even and odd by 0-based chunk index, numbered anew; concat from pairs."""
    even = F.col("chunk_idx") % 2 == 0
    parts = [stats.withColumn("grp", F.lit("all")), stats.where(even).withColumns({"grp": F.lit("even"), "chunk_idx": F.floor(F.col("chunk_idx") / 2).cast("int")}), stats.where(~even).withColumns({"grp": F.lit("odd"), "chunk_idx": F.floor(F.col("chunk_idx") / 2).cast("int")}), pair_stats.withColumn("grp", F.lit("concat"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chunk_fixed(scaled: DataFrame) -> DataFrame:
    """(window_id, day_idx, chunk, mean, range, std): adjacent point pairs of each day; sample deviation, null for one point."""
    at = scaled.withColumn("chunk", F.floor(F.col("point_idx") / 2).cast("int"))
    return at.groupBy("window_id", "day_idx", "chunk").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("range"), F.stddev_samp("value").alias("std"))


def shape_shift(points: DataFrame, keys: list[str] = ["window_id"]) -> DataFrame:  # noqa: B006
    """(keys, day_idx, shift): sum over points of the absolute change from the day before; none for the first day.

    A point without a value on either day adds nothing; null if no point has both."""
    was = F.lag("value").over(Window.partitionBy(*keys, "point_idx").orderBy("day_idx"))
    at = points.withColumns({"_d": F.abs(F.col("value") - was), "_first": F.min("day_idx").over(Window.partitionBy(*keys))})
    return at.where("day_idx > _first").groupBy(*keys, "day_idx").agg(F.sum("_d").alias("shift"))


def periods(points: DataFrame, half: int) -> DataFrame:
    """(window_id, day_idx, grp, mean, range) for daily, day (first half) and night (second half): one pass."""
    grp = F.array(F.lit("daily"), F.when(F.col("point_idx") < half, "day").otherwise("night"))
    return points.withColumn("grp", F.explode(grp)).groupBy("window_id", "day_idx", "grp").agg(F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("range"))


def long_features(wide: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """(keys, metric, value) from one column a metric."""
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("_")).select(*keys, "_.metric", "_.value")


def union(parts: list[tuple[str, DataFrame, float]], keys: list[str]) -> DataFrame:
    """Long features of several extractors under their names, each times its weight."""
    out = None
    for name, df, weight in parts:
        one = df.select(*keys, F.concat(F.lit(name + "."), "metric").alias("metric"), (F.col("value") * weight).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def distribution(values: DataFrame, keys: list[str]) -> DataFrame:
    """n, extremes, moments, quartiles, shares near 0 and 1, sign shares and outlier share per key.

    The outlier share needs the quartiles first, so the values meet the aggregates once more."""
    v = F.col("value")
    flat = F.stddev_pop("value") == 0
    share = lambda c: F.avg(c.cast("double"))
    stats = values.where(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("median"),
        F.percentile(v, F.lit(0.25)).alias("q25"), F.percentile(v, F.lit(0.75)).alias("q75"), F.when(flat, 0.0).otherwise(F.skewness(v)).alias("skew"), F.when(flat, 0.0).otherwise(F.kurtosis(v)).alias("kurtosis"),
        share(v <= 0.01).alias("near_0"), share(v >= 0.99).alias("near_1"), share(v > 0).alias("positive"), share(v < 0).alias("negative"))
    iqr = F.col("q75") - F.col("q25")
    out = values.where(v.isNotNull()).join(stats.select(*keys, "q25", "q75"), keys).groupBy(*keys).agg(share((v < F.col("q25") - 1.5 * iqr) | (v > F.col("q75") + 1.5 * iqr)).alias("outliers"))
    return stats.join(out, keys)


def recommend(dist: DataFrame) -> DataFrame:
    """The report with a likelihood: student_t where outliers exceed 5 %, |kurtosis| 3 or |skew| 1, else normal."""
    heavy = (F.col("outliers") > 0.05) | (F.abs("kurtosis") > 3) | (F.abs("skew") > 1)
    return dist.withColumn("likelihood", F.when(heavy, "student_t").otherwise("normal"))


def boundary_mass(values: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    v = F.col("value")
    share = lambda c: F.avg(c.cast("double"))
    return values.where(v.isNotNull()).groupBy(*keys).agg(share(v >= 0.9).alias("high"), share(v <= 0.1).alias("low"), share((v <= eps) | (v >= 1 - eps)).alias("clipped"))
