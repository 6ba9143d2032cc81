"""Masks, cleaning, interpolation and scaling of window profiles (window_id, pos, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.operators.ranking import quantile

ROW = ["window_id"]


def day_mask(window_days: DataFrame, points: DataFrame, missing: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """(window_id, day_idx, valid): false for missing days, artifact days if given, and days without a value.

    points: (window_id, day_idx, value)."""
    bad = missing.select("subject_id", "day")
    if artifacts is not None:
        bad = bad.union(artifacts.select("subject_id", "day"))
    bad = bad.distinct().withColumn("_bad", F.lit(True))
    full = points.groupBy("window_id", "day_idx").agg(F.max(F.col("value").isNotNull()).alias("_full"))
    at = window_days.join(bad, ["subject_id", "day"], "left").join(full, ["window_id", "day_idx"], "left")
    return at.select("window_id", "day_idx", (F.col("_bad").isNull() & F.coalesce("_full", F.lit(False))).alias("valid"))


def apply_mask(points: DataFrame, mask: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """points with null in `cols` on the days that mask (window_id, day_idx, valid) doesn't hold valid."""
    return points.join(mask, ["window_id", "day_idx"]).withColumns({c: F.when(F.col("valid"), F.col(c)) for c in cols or ["value"]}).drop("valid")


def min_valid_days(mask: DataFrame, least: int = 6) -> DataFrame:
    """(window_id, n_valid) of windows with at least that many valid days."""
    return mask.groupBy("window_id").agg(F.count_if("valid").alias("n_valid")).where(F.col("n_valid") >= least)


def _real(c: str = "value") -> Column:
    return F.when(F.col(c) != 0, F.col(c))


def fit(rows: DataFrame) -> DataFrame:
    """One row: median, mean and mode (smallest of the most frequent) of all values that are neither null nor 0."""
    real = rows.where(_real().isNotNull())
    stats = real.agg(F.lit(quantile(real, "value", 0.5)).cast("double").alias("median"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    mode = real.groupBy("value").count().agg(F.max_by("value", F.struct("count", -F.col("value"))).alias("mode"))
    return stats.withColumn("_", F.lit(0)).join(F.broadcast(mode.withColumn("_", F.lit(0))), "_").drop("_")  # one row each


def share_valid(rows: DataFrame) -> Column:
    w = Window.partitionBy(*ROW)
    return F.count(_real()).over(w) / F.count(F.lit(1)).over(w)


def apply_fill(rows: DataFrame, fill: float, min_share: float, policy: str = "skip", zeros: bool = True, nulls: bool = True) -> DataFrame:
    """Zeros and nulls of a window become fill; a window with too few real values is left, zeroed or nulled."""
    few = {"skip": F.col("value"), "zero": F.lit(0.0), "nan": F.lit(None).cast("double")}[policy]
    new = F.when(F.col("value").isNull() & F.lit(nulls), F.lit(fill)).when((F.col("value") == 0) & F.lit(zeros), F.lit(fill)).otherwise(F.col("value"))
    return rows.withColumn("_s", share_valid(rows)).withColumn("value", F.when(F.col("_s") < min_share, few).otherwise(new)).drop("_s")


def replace_local(rows: DataFrame, fallback: float) -> DataFrame:
    """Nulls and zeros become the window's median of real values, or fallback where it has none."""
    mid = rows.groupBy(*ROW).agg(F.percentile(_real(), F.lit(0.5)).alias("_mid"))
    return rows.join(mid, ROW).withColumn("value", F.coalesce(_real(), "_mid", F.lit(fallback))).drop("_mid")


def _replace_outliers(rows: DataFrame, odd: Column) -> DataFrame:
    at = rows.withColumn("_odd", odd)
    rest = at.groupBy(*ROW).agg(F.percentile(F.when(~F.col("_odd"), F.col("value")), F.lit(0.5)).alias("_rest"))
    return at.join(rest, ROW).withColumn("value", F.when(F.col("_odd"), F.coalesce("_rest", "value")).otherwise(F.col("value"))).drop("_odd", "_rest")


def adaptive(rows: DataFrame, fallback: float, z: float = 3.0) -> DataFrame:
    """replace_local, then values farther than z population deviations from the mean become the median of the rest.

    Only windows of more than three points have outliers."""
    at, w = replace_local(rows, fallback), Window.partitionBy(*ROW)
    far = F.abs(F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-8) > z
    return _replace_outliers(at, far & (F.count(F.lit(1)).over(w) > 3))


def robust(rows: DataFrame, fallback: float, factor: float = 1.5) -> DataFrame:
    """replace_local, then values beyond factor interquartile ranges of the quartiles become the median of the rest.

    Only windows of more than four points have outliers."""
    at = replace_local(rows, fallback)
    q = at.groupBy(*ROW).agg(F.percentile("value", F.lit(0.25)).alias("_a"), F.percentile("value", F.lit(0.75)).alias("_b"), F.count("*").alias("_n"))
    at = at.join(q, ROW)
    iqr = F.col("_b") - F.col("_a")
    odd = ((F.col("value") < F.col("_a") - factor * iqr) | (F.col("value") > F.col("_b") + factor * iqr)) & (F.col("_n") > 4)
    return _replace_outliers(at, odd).drop("_a", "_b", "_n")


def interpolate(rows: DataFrame, kind: str = "linear") -> DataFrame:
    """Nulls and zeros from the real points of the window: linear, with straight ends, or nearest (left on ties).

    With fewer than two real points: that value, or 0."""
    w = Window.partitionBy(*ROW).orderBy("pos")
    point = F.when(_real().isNotNull(), F.struct("pos", "value"))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = rows.withColumns({"_p": F.last(point, True).over(back), "_n": F.first(point, True).over(ahead), "_k": F.count(point).over(Window.partitionBy(*ROW))})
    one = F.coalesce(F.col("_p.value"), F.col("_n.value"), F.lit(0.0))
    if kind == "nearest":
        near = F.when(F.col("_n").isNull() | (F.col("pos") - F.col("_p.pos") <= F.col("_n.pos") - F.col("pos")), F.col("_p.value")).otherwise(F.col("_n.value"))
        return at.withColumn("value", F.when(F.col("_k") < 2, one).otherwise(near)).drop("_p", "_n", "_k")
    # the two real points that an end leans on: the second real one from the left, the second from the right
    spots = rows.where(_real().isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_j", F.row_number().over(Window.partitionBy(*ROW).orderBy(F.desc("pos"))))
    ends = spots.groupBy(*ROW).agg(*[F.max(F.when(F.col(c) == k, F.struct("pos", "value"))).alias(f"{c}{k}") for c in ("_i", "_j") for k in (1, 2)])
    at = at.join(ends, ROW, "left")
    line = lambda a, b: F.col(f"{a}.value") + (F.col(f"{b}.value") - F.col(f"{a}.value")) * (F.col("pos") - F.col(f"{a}.pos")) / (F.col(f"{b}.pos") - F.col(f"{a}.pos"))
    new = F.when(F.col("_p.pos") == F.col("_n.pos"), F.col("value")).when(F.col("_p").isNull(), line("_i1", "_i2")).when(F.col("_n").isNull(), line("_j2", "_j1")).otherwise(line("_p", "_n"))
    return at.withColumn("value", F.when(F.col("_k") < 2, one).otherwise(new)).drop("_p", "_n", "_k", "_i1", "_i2", "_j1", "_j2")


def interpolate_cubic(rows: DataFrame) -> DataFrame:
    """Nulls and zeros from a natural cubic spline through the window's real points, straight beyond the ends.

    One window's points are one task's bounded group. Fewer than two points as in interpolate()."""
    def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        h, n = np.diff(x), len(x)
        a, b = np.eye(n), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
        m = np.linalg.solve(a, b)
        i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        left, right = x[i + 1] - at, at - x[i]
        inside = (m[i] * left**3 + m[i + 1] * right**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * left + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * right
        lo, hi = (y[1] - y[0]) / h[0] - h[0] * m[1] / 6, (y[-1] - y[-2]) / h[-1] + h[-1] * m[-2] / 6
        return np.where(at < x[0], y[0] + lo * (at - x[0]), np.where(at > x[-1], y[-1] + hi * (at - x[-1]), inside))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        real = g["value"].notna() & (g["value"] != 0)
        x, y, at = (s.to_numpy(float) for s in (g.loc[real, "pos"], g.loc[real, "value"], g["pos"]))
        new = spline(x, y, at) if len(x) > 1 else np.full(len(g), y[0] if len(y) else 0.0)
        return pd.DataFrame({"window_id": g["window_id"], "pos": g["pos"], "value": np.where(real, g["value"], new)})

    return rows.select("window_id", "pos", "value").groupBy("window_id").applyInPandas(run, "window_id long, pos int, value double")


def policy(rows: DataFrame, strategy: DataFrame, few: str, min_share: float = 0.3) -> DataFrame:
    """strategy's values (window_id, pos, value) where a window has enough real ones, else few:
    interpolate, skip, zero or nan."""
    at = rows.select("window_id", "pos", "value", share_valid(rows).alias("_s")).join(strategy.select("window_id", "pos", F.col("value").alias("_new")), ["window_id", "pos"])
    if few == "interpolate":
        at = at.join(interpolate(rows.select("window_id", "pos", "value")).withColumnRenamed("value", "_few"), ["window_id", "pos"])
        other = F.col("_few")
    else:
        other = {"skip": F.col("value"), "zero": F.lit(0.0), "nan": F.lit(None).cast("double")}[few]
    return at.select("window_id", "pos", F.when(F.col("_s") < min_share, other).otherwise(F.col("_new")).alias("value"))


def min_max(rows: DataFrame, keys: list[str] = ROW, low: float = 0.0, high: float = 1.0, constant: float = 0.5) -> DataFrame:
    """Values scaled to [low, high] within keys; a constant group becomes `constant`, nulls stay."""
    w = Window.partitionBy(*keys)
    a, b, v = F.min("value").over(w), F.max("value").over(w), F.col("value")
    return rows.withColumn("value", F.when(v.isNull(), v).when(b > a, low + (high - low) * (v - a) / (b - a)).otherwise(F.lit(constant)))


def z_score(rows: DataFrame, keys: list[str] = ROW) -> DataFrame:
    """Less the mean, over the population deviation within keys; 0 where that is 0."""
    w = Window.partitionBy(*keys)
    std = F.stddev_pop("value").over(w)
    return rows.withColumn("value", F.when(F.col("value").isNull(), F.col("value")).when(std > 0, (F.col("value") - F.avg("value").over(w)) / std).otherwise(0.0))


def z_score_columns(rows: DataFrame) -> DataFrame:
    """Standardised per position over all windows: aggregates per position, joined back."""
    stats = rows.groupBy("pos").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return rows.join(F.broadcast(stats), "pos").withColumn("value", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(F.col("value") - F.col("_m"))).drop("_m", "_s")


def exclude(rows: DataFrame, listed: DataFrame, key: str = "window_id") -> DataFrame:
    """rows without the samples that are listed; both have column key.

    A listed sample that isn't there is an error, and so is a list that leaves nothing."""
    bad, there = listed.select(key).distinct(), rows.select(key).distinct()
    if not bad.join(there, key, "left_anti").isEmpty():
        raise ValueError("a listed sample is not among the samples")
    left = rows.join(bad, key, "left_anti")
    if left.isEmpty():
        raise ValueError("all samples are excluded")
    return left
