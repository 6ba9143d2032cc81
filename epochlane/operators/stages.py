"""From raw samples to stage codes: epochs, thresholds, stage rule and clean-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.session import materialise

DAY = ["subject_id", "day"]
CHANNEL = [*DAY, "channel"]
MAD_SCALE = 1.4826


def epochs(samples: DataFrame, length: int) -> DataFrame:
    """(subject_id, day, channel, epoch_idx, samples): whole epochs of `length` samples; a partial last one is dropped."""
    at = samples.withColumn("epoch_idx", F.floor(F.col("sample_idx") / length).cast("int"))
    out = at.groupBy(*CHANNEL, "epoch_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "sample"))).alias("s"))
    return out.where(F.size("s") == length).select(*CHANNEL, "epoch_idx", F.transform("s", lambda x: x["sample"]).alias("samples"))


def artifact_metric(eps: DataFrame, kind: str = "square") -> DataFrame:
    """The largest square (or absolute value) in each epoch."""
    f = (lambda x: x * x) if kind == "square" else F.abs
    return eps.select(*CHANNEL, "epoch_idx", F.array_max(F.transform("samples", f)).alias("metric"))


def threshold_mad(metric: DataFrame, factor: float = 7.0, keys: list[str] = CHANNEL) -> DataFrame:
    """median + factor * 1.4826 * median absolute deviation, exact, in two passes."""
    mid = metric.groupBy(*keys).agg(F.percentile("metric", F.lit(0.5)).alias("mid"))
    mad = metric.join(mid, keys).groupBy(*keys).agg(F.first("mid").alias("mid"), F.percentile(F.abs(F.col("metric") - F.col("mid")), F.lit(0.5)).alias("mad"))
    return mad.select(*keys, (F.col("mid") + factor * MAD_SCALE * F.col("mad")).alias("threshold"))


def threshold_quantile(metric: DataFrame, share: float = 0.995, approximate: bool = False, keys: list[str] = CHANNEL) -> DataFrame:
    q = F.percentile_approx("metric", share, 10000) if approximate else F.percentile("metric", F.lit(share))
    return metric.groupBy(*keys).agg(q.alias("threshold"))


def threshold_otsu(metric: DataFrame, bins: int = 256, keys: list[str] = CHANNEL) -> DataFrame:
    """The bin middle that best splits a histogram in two: largest n1 n2 (m1 - m2)^2, the first of equals.

    The value range is cut in `bins` equal bins; a range of one value gives that value."""
    span = metric.groupBy(*keys).agg(F.min("metric").alias("lo"), F.max("metric").alias("hi"))
    at = metric.join(span, keys).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("metric") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    h = at.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    h = h.withColumn("mid", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    h = h.select(*keys, "bin", "mid", F.sum("n").over(up).alias("n1"), F.sum(F.col("n") * F.col("mid")).over(up).alias("s1"), F.sum("n").over(down).alias("n2"), F.sum(F.col("n") * F.col("mid")).over(down).alias("s2"))
    gap = F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")
    between = F.coalesce(F.col("n1") * F.col("n2") * gap * gap, F.lit(-1.0))
    return h.groupBy(*keys).agg(F.max_by("mid", F.struct(F.round(between, 6), -F.col("bin"))).alias("threshold"))


def _histogram_mode(metric: DataFrame, keys: list[str], bins: int = 200, among: int = 150) -> DataFrame:
    """(keys, centre): the middle of the first fullest of the lower `among` of `bins` equal bins."""
    span = metric.groupBy(*keys).agg(F.min("metric").alias("lo"), F.max("metric").alias("hi"))
    at = metric.join(span, keys).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("metric") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    h = at.groupBy(*keys, "bin", "lo", "hi").agg(F.count("*").alias("n")).where(F.col("bin") < among)
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    return h.groupBy(*keys).agg(F.max_by(mid, F.struct("n", -F.col("bin"))).alias("centre"))


def threshold_envelope(metric: DataFrame, levels: int = 49, keys: list[str] = CHANNEL) -> DataFrame:
    """Drop the c percent farthest from the median, c = 1 .. levels, as long as the threshold lies above the
    values' mode, and take the c whose rest has the excess kurtosis nearest 0.

    A level's threshold is the middle between the largest value kept and the smallest dropped. A key
    with too few different values keeps them all: its threshold is the largest. Ranked once; running
    power sums give every level's moments, so levels cost no further pass."""
    mid = metric.groupBy(*keys).agg(F.percentile("metric", F.lit(0.5)).alias("mid"), F.count("*").alias("n"), F.max("metric").alias("most"))
    far = metric.join(mid, keys).withColumn("far", F.abs(F.col("metric") - F.col("mid"))).withColumn("x", F.col("metric") - F.col("mid"))
    order = Window.partitionBy(*keys).orderBy("far", "metric", "epoch_idx")
    w, rest = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    run = far.select(*keys, F.count("*").over(w).alias("k"), *[F.sum(F.col("x") ** i).over(w).alias(f"p{i}") for i in (1, 2, 3, 4)], ((F.max("metric").over(w) + F.min("metric").over(rest)) / 2).alias("cut"))
    level = mid.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("c")).withColumn("k", F.col("n") - F.ceil((F.col("n") - 1) * F.col("c") / 100))
    at = run.join(level, [*keys, "k"]).join(_histogram_mode(metric, keys), keys)
    m = F.col("p1") / F.col("k")
    m2 = F.col("p2") / F.col("k") - m * m
    m4 = F.col("p4") / F.col("k") - 4 * m * F.col("p3") / F.col("k") + 6 * m * m * F.col("p2") / F.col("k") - 3 * m * m * m * m
    lowest = F.min("cut").over(Window.partitionBy(*keys).orderBy("c").rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("kurt", F.when(m2 > 1e-9, F.round(F.abs(m4 / (m2 * m2) - 3), 6))).withColumn("_on", F.coalesce(lowest > F.col("centre"), F.lit(True)))
    best = at.where("_on and kurt is not null and cut is not null").groupBy(*keys).agg(F.min_by("cut", F.struct("kurt", "c")).alias("cut"))
    return mid.select(*keys, "most").join(best, keys, "left").select(*keys, F.coalesce("cut", "most").alias("threshold"))


def _mixture(x: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, variances and shares of two normal components fitted to x."""
    mean, var, share = np.quantile(x, [0.25, 0.75]), np.full(2, x.var()), np.full(2, 0.5)
    floor = 1e-6 * x.var() + 1e-12
    for _ in range(rounds):
        log = np.log(share) - 0.5 * np.log(var) - 0.5 * (x[:, None] - mean) ** 2 / var
        r = np.exp(log - log.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0) + 1e-12
        mean, share = (r * x[:, None]).sum(axis=0) / n, n / n.sum()
        var = (r * (x[:, None] - mean) ** 2).sum(axis=0) / n + floor
    return mean, var, share


def _mixture_split(x: np.ndarray) -> float:
    """Where two fitted normal components are equally likely, on a fine grid between their means."""
    x = np.sort(x[np.isfinite(x)])
    if len(x) < 4 or x[0] == x[-1]:
        return float(np.median(x)) if len(x) else float("nan")
    mean, var, share = _mixture(x)
    lo, hi = mean.argmin(), mean.argmax()
    at = np.linspace(mean[lo], mean[hi], 2048)
    log = lambda j: np.log(share[j]) - 0.5 * np.log(var[j]) - 0.5 * (at - mean[j]) ** 2 / var[j]
    return float(at[np.abs(log(lo) - log(hi)).argmin()])


def _mixture_middle(x: np.ndarray) -> float:
    """The middle between the largest value of the lower and the smallest of the higher of two fitted normal
    components; where one has no value, the halves at the median take their place."""
    x = np.sort(x[np.isfinite(x)])
    if len(x) < 2 or x[0] == x[-1]:
        return float(np.median(x)) if len(x) else float("nan")
    mean, var, share = _mixture(x)
    log = np.log(share) - 0.5 * np.log(var) - 0.5 * (x[:, None] - mean) ** 2 / var
    low = log.argmax(axis=1) == mean.argmin()
    if low.all() or not low.any():
        low = x <= np.median(x)
        if low.all():
            low = np.arange(len(x)) < len(x) // 2
    return float((x[low].max() + x[~low].min()) / 2)


def threshold_mixture(metric: DataFrame, keys: list[str] = CHANNEL, split: Callable[[np.ndarray], float] = _mixture_split) -> DataFrame:
    """Threshold from a two-component normal mixture, fitted per key; a key's epochs are one day of one channel."""
    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, split(g["metric"].to_numpy(float)))])

    schema = ", ".join(f"{k} {dict(metric.dtypes)[k]}" for k in keys) + ", threshold double"
    return metric.groupBy(*keys).applyInPandas(fit, schema)


def select_threshold(first: DataFrame, second: DataFrame, keys: list[str] = CHANNEL) -> DataFrame:
    """The first threshold where it is a number, else the second."""
    at = first.select(*keys, F.col("threshold").alias("_a")).join(second.select(*keys, F.col("threshold").alias("_b")), keys, "full")
    return at.select(*keys, F.coalesce(F.nullif(F.nanvl("_a", F.lit(None)), F.lit(float("nan"))), "_b").alias("threshold"))


def artifact_mask(metric: DataFrame, thresholds: DataFrame, combine: str = "any") -> DataFrame:
    """(subject_id, day, epoch_idx, artifact): over threshold in any channel, or in all of channels 0 and 1."""
    over = metric.join(thresholds, CHANNEL).withColumn("over", F.col("metric") > F.col("threshold"))
    if combine == "any":
        return over.groupBy(*DAY, "epoch_idx").agg(F.bool_or("over").alias("artifact"))
    return over.groupBy(*DAY, "epoch_idx").agg(F.coalesce(F.bool_and(F.when(F.col("channel") < 2, F.col("over"))), F.lit(False)).alias("artifact"))


def band_power(eps: DataFrame, low: float, high: float, rate: float) -> DataFrame:
    """Sum of spectral magnitudes at frequencies in [low, high), over 1e6, as `power`."""
    @F.pandas_udf("double")
    def power(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            def one(x) -> float:
                f = np.fft.rfftfreq(len(x), 1 / rate)
                return float(np.abs(np.fft.rfft(np.asarray(x, float)))[(f >= low) & (f < high)].sum() / 1e6)
            yield part.map(one)

    return eps.withColumn("power", power("samples"))


def with_feature(eps: DataFrame, name: str, feature: Callable[[np.ndarray], float]) -> DataFrame:
    """eps with a feature of the caller's, a function of one epoch's samples."""
    @F.pandas_udf("double")
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda x: float(feature(np.asarray(x, float))))

    return eps.withColumn(name, run("samples"))


def smooth5(df: DataFrame, col: str, keys: list[str] = CHANNEL, times: int = 1) -> DataFrame:
    """Five-point moving average with zeros beyond the ends."""
    w = Window.partitionBy(*keys).orderBy("epoch_idx").rowsBetween(-2, 2)
    for _ in range(times):
        df = df.withColumn(col, F.sum(col).over(w) / 5)
    return df


def baseline_remove(df: DataFrame, col: str, width: int = 20, keys: list[str] = CHANNEL) -> DataFrame:
    """col less the least value from `width` epochs before to width - 1 after; a day's last epoch isn't looked at."""
    w = Window.partitionBy(*keys).orderBy("epoch_idx")
    inner = F.when(F.lead("epoch_idx").over(w).isNotNull(), F.col(col))
    at = df.withColumn("_inner", inner)
    return at.withColumn(col, F.col(col) - F.coalesce(F.min("_inner").over(w.rowsBetween(-width, width - 1)), F.col(col))).drop("_inner")


def stage_rule(power: DataFrame, delta_thr: Column, ratio_thr: Column) -> DataFrame:
    """Stage by strict majority of channels: delta over its threshold 1, ratio over its threshold 2 (wins), else 0."""
    votes = power.groupBy(*DAY, "epoch_idx").agg(F.count("*").alias("n"), F.count_if(F.col("delta") > delta_thr).alias("d"), F.count_if(F.col("ratio") > ratio_thr).alias("r"))
    return votes.select(*DAY, "epoch_idx", F.when(2 * F.col("r") > F.col("n"), 2).when(2 * F.col("d") > F.col("n"), 1).otherwise(0).alias("stage"))


def stage_fill(stages: DataFrame, artifact: str = "artifact") -> DataFrame:
    """Artifact epochs take the last stage before them that isn't one; 0 where there is none."""
    w = Window.partitionBy(*DAY).orderBy("epoch_idx").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last(F.when(~F.col(artifact), F.col("stage")), ignorenulls=True).over(w)
    return stages.withColumn("stage", F.coalesce(kept, F.lit(0)))


def _by_day() -> Window:
    return Window.partitionBy(*DAY).orderBy("epoch_idx")


def no_single(stages: DataFrame, v: int) -> DataFrame:
    """A lone v between two equal other stages becomes that stage."""
    a, b = F.lag("stage").over(_by_day()), F.lead("stage").over(_by_day())
    at = stages.withColumns({"_a": a, "_b": b})
    return at.withColumn("stage", F.when((F.col("stage") == v) & (F.col("_a") == F.col("_b")) & (F.col("_a") != v), F.col("_a")).otherwise(F.col("stage"))).drop("_a", "_b")


def no_single_between(stages: DataFrame, a: int, b: int, c: int) -> DataFrame:
    """A lone a with b before and c after becomes b."""
    at = stages.withColumns({"_a": F.lag("stage").over(_by_day()), "_b": F.lead("stage").over(_by_day())})
    return at.withColumn("stage", F.when((F.col("stage") == a) & (F.col("_a") == b) & (F.col("_b") == c), F.lit(b)).otherwise(F.col("stage"))).drop("_a", "_b")


def no_rem_in_wake(stages: DataFrame, back: int = 2) -> DataFrame:
    """A run of stage 2 right after `back` epochs of stage 0 becomes 0 as a whole."""
    w = _by_day()
    starts = (F.col("stage") == 2) & F.coalesce(F.lag("stage").over(w) != 2, F.lit(True))
    wake = F.sum(F.when(F.col("stage") == 0, 1).otherwise(0)).over(w.rowsBetween(-back, -1)) == back
    at = stages.withColumns({"_start": starts, "_wake": starts & F.coalesce(wake, F.lit(False))})
    at = at.withColumn("_bad", F.last(F.when(F.col("_start"), F.col("_wake")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.withColumn("stage", F.when((F.col("stage") == 2) & F.col("_bad"), 0).otherwise(F.col("stage"))).drop("_start", "_wake", "_bad")


def clean(stages: DataFrame) -> DataFrame:
    """The fixed order of clean-up rules; all share one partitioning by subject and day."""
    at = no_rem_in_wake(no_single(no_single(stages, 0), 1), 2)
    return no_single_between(no_single_between(at, 0, 1, 2), 1, 2, 2)


def half(position: Column, n: Column, cycles: int = 2) -> Column:
    """Which of `cycles` equal stretches of n values the 0-based position is in; what is left over is in none."""
    size = F.greatest(F.floor(n / cycles), F.lit(1))
    return F.when(position < size * cycles, F.floor(position / size)).cast("int")


def delta_threshold(power: DataFrame, cycles: int = 2, keys: list[str] = CHANNEL) -> DataFrame:
    """(keys, cycle, threshold): mixture boundary of the delta values of each half of a day, up to their 99th percentile.

    power: (keys, epoch_idx, delta) of epochs without artifacts. The percentile is the day's."""
    top = power.groupBy(*keys).agg(F.percentile("delta", F.lit(0.99)).alias("_top"))
    kept = power.join(top, keys).where(F.col("delta") <= F.col("_top")).withColumn("metric", F.col("delta"))
    day = Window.partitionBy(*keys)
    at = kept.withColumn("cycle", half(F.row_number().over(day.orderBy("epoch_idx")) - 1, F.count("*").over(day), cycles)).where("cycle is not null")
    return threshold_mixture(at, [*keys, "cycle"], _mixture_middle)


def score(samples: DataFrame, length: int, rate: float, delta: tuple[float, float], theta: tuple[float, float], done: DataFrame | None = None, channels: DataFrame | None = None) -> DataFrame:
    """Stage codes of all subject-days of `samples` that aren't in `done`: the whole job in one plan.

    channels: (subject_id, day, channel) to use; all if not given. Delta is smoothed twice and has a
    threshold for each half of the day; the ratio is smoothed, loses its baseline, and has one from the
    envelope. Where a half has no threshold it takes the day's other one."""
    if done is not None:
        samples = samples.join(done.select(*DAY).distinct(), DAY, "left_anti")
    if channels is not None:
        samples = samples.join(channels.select(*CHANNEL).distinct(), CHANNEL, "left_semi")
    eps = epochs(samples, length)
    metric = artifact_metric(eps)
    bad = artifact_mask(metric, select_threshold(threshold_mixture(metric), threshold_otsu(metric)))
    power = band_power(eps, *delta, rate).withColumnRenamed("power", "delta")
    power = band_power(power, *theta, rate).withColumn("ratio", F.coalesce(F.col("power") / F.nullif("delta", F.lit(0.0)), F.lit(0.0))).drop("power", "samples")
    power = baseline_remove(smooth5(smooth5(power, "delta", times=2), "ratio"), "ratio")
    good = power.join(bad.where("not artifact"), [*DAY, "epoch_idx"], "left_semi")
    by_half = delta_threshold(good)
    d = by_half.groupBy(*CHANNEL).agg(F.max(F.when(F.col("cycle") == 0, F.col("threshold"))).alias("_d0"), F.max(F.when(F.col("cycle") == 1, F.col("threshold"))).alias("_d1"))
    r = threshold_envelope(good.withColumn("metric", F.col("ratio"))).withColumnRenamed("threshold", "_r")
    day = Window.partitionBy(*CHANNEL)
    at = power.withColumn("_half", 2 * F.row_number().over(day.orderBy("epoch_idx")) > F.count("*").over(day)).join(d, CHANNEL).join(r, CHANNEL)
    threshold = F.when(F.col("_half"), F.coalesce("_d1", "_d0")).otherwise(F.coalesce("_d0", "_d1"))
    staged = stage_rule(at, threshold, F.col("_r"))
    return clean(stage_fill(staged.join(bad, [*DAY, "epoch_idx"], "left").withColumn("artifact", F.coalesce("artifact", F.lit(False))))).select(*DAY, "epoch_idx", "stage")


def write_stages(samples: DataFrame, path: str, length: int, rate: float, delta: tuple[float, float], theta: tuple[float, float], channels: DataFrame | None = None) -> int:
    """The whole job over the subject-days of samples that aren't at path yet, written there; how many those are.

    Days are partitions of their own: a run that is repeated, or goes on after a stop, replaces only days that it computes,
    and computes none that is there. Days that give no stage are computed again each time."""
    spark = samples.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    done = None
    if there:
        done = materialise(spark.read.parquet(path).select("subject_id", F.col("day").cast("date").alias("day")).distinct())
    found = materialise(score(samples, length, rate, delta, theta, done, channels))
    n = found.select(*DAY).distinct().count()
    if n:
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*DAY).parquet(path)
    return n
