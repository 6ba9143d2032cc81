"""One shared changepoint day over all windows: likelihoods, posterior of tau, and its summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.session import materialise

MIN_SIGMA = 1e-3


def regime(chunk: Column, tau: Column) -> Column:
    """1, before, iff the 0-based chunk is under tau - 1; else 2."""
    return F.when(chunk < tau - 1, 1).otherwise(2)


def _softmax(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """df with p, exp(col) over its sum within keys, stable by the maximum."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    at = df.withColumn("_e", F.exp(F.col(col) - F.max(col).over(w)))
    return at.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def tau_weights(ll: DataFrame, keys: list[str], tau_low: int, tau_high: int) -> DataFrame:
    """(keys, window_id, tau, ll): each window's log-likelihood at every tau, from prefix sums.

    ll: (keys, window_id, chunk_idx, ll1, ll2), the log-likelihood of a chunk's value in either regime.
    At tau the chunks under tau - 1 count in regime 1, the others in regime 2, so the sum is
    cum1(tau - 1) + total2 - cum2(tau - 1): linear in chunks."""
    sums = ll.groupBy(*keys, "window_id", "chunk_idx").agg(F.sum("ll1").alias("a"), F.sum("ll2").alias("b"))
    w = Window.partitionBy(*keys, "window_id").orderBy("chunk_idx")
    at = sums.withColumns({"_a": F.sum("a").over(w) - F.col("a"), "_b": F.sum("b").over(w) - F.col("b"), "_t": F.sum("b").over(Window.partitionBy(*keys, "window_id"))})
    return at.where(F.col("chunk_idx").between(tau_low - 1, tau_high - 1)).select(*keys, "window_id", (F.col("chunk_idx") + 1).alias("tau"), (F.col("_a") + F.col("_t") - F.col("_b")).alias("ll"))


def tau_posterior(weights: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tau, ll, p): probabilities of tau over all windows under a uniform prior."""
    return _softmax(weights.groupBy(*keys, "tau").agg(F.sum("ll").alias("ll")), keys, "ll")


def tau_profile(values: DataFrame, keys: list[str], tau_low: int, tau_high: int) -> DataFrame:
    """(keys, tau, ll, p): normal profile log-likelihood of a split at each tau.

    values: (keys, window_id, chunk_idx, value), and times if a row counts more than once. n, sum and sum of squares per chunk, then prefix sums:
    each regime's mean and deviation are closed forms, and the data are read once for all taus."""
    v = F.col("value")
    times = F.col("times").cast("double") if "times" in values.columns else F.lit(1.0)
    per = values.where(v.isNotNull()).groupBy(*keys, "chunk_idx").agg(F.sum(times).alias("n"), F.sum(v * times).alias("s"), F.sum(v * v * times).alias("q"))
    w, whole = Window.partitionBy(*keys).orderBy("chunk_idx"), Window.partitionBy(*keys)
    at = per.select(*keys, "chunk_idx", *[(F.sum(c).over(w) - F.col(c)).alias(f"{c}1") for c in "nsq"], *[F.sum(c).over(whole).alias(f"{c}t") for c in "nsq"])
    at = at.where(F.col("chunk_idx").between(tau_low - 1, tau_high - 1))
    def part(n, s, q):
        var = F.greatest(q / n - (s / n) * (s / n), F.lit(MIN_SIGMA**2))
        return F.when(n > 0, -n / 2 * (F.log(2 * math.pi * var) + 1)).otherwise(0.0)

    n1, s1, q1 = (F.col(f"{c}1") for c in "nsq")
    n2, s2, q2 = (F.col(f"{c}t") - F.col(f"{c}1") for c in "nsq")
    return _softmax(at.select(*keys, (F.col("chunk_idx") + 1).alias("tau"), (part(n1, s1, q1) + part(n2, s2, q2)).alias("ll")), keys, "ll")


def tau_summary(post: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """E, sd, mode and its probability, entropy, concentration (1 - entropy / log of the number of taus), P(tau > threshold)."""
    p, t = F.col("p"), F.col("tau")
    h = -F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return post.groupBy(*keys).agg(
        F.sum(p * t).alias("e_tau"), F.sqrt(F.greatest(F.sum(p * t * t) - F.sum(p * t) * F.sum(p * t), F.lit(0.0))).alias("sd_tau"),
        F.max_by("tau", F.struct(F.round("p", 9), -t)).alias("map_tau"), F.max("p").alias("p_map"), h.alias("entropy"),
        F.when(F.count("*") > 1, 1 - h / F.log(F.count("*"))).otherwise(1.0).alias("concentration"), F.sum(F.when(t > threshold, p).otherwise(0.0)).alias("p_gt"))


def loo_exact(values: DataFrame, keys: list[str], tau: int) -> DataFrame:
    """(keys, window_id, elpd): normal log-density of each window's values under regimes fitted without it.

    The other windows' sums are the totals less the window's own, so nothing is fitted again."""
    v = F.col("value")
    at = values.where(v.isNotNull()).withColumn("regime", regime(F.col("chunk_idx"), F.lit(tau)))
    own = at.groupBy(*keys, "window_id", "regime").agg(F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    total = own.groupBy(*keys, "regime").agg(*[F.sum(c).alias(f"all_{c}") for c in "nsq"])
    both = own.join(total, [*keys, "regime"])
    rest = both.select(*keys, "window_id", "regime", *[F.col(c).alias(f"own_{c}") for c in "nsq"], *[(F.col(f"all_{c}") - F.col(c)).alias(f"r{c}") for c in "nsq"]).where("rn > 0")
    mu = F.col("rs") / F.col("rn")
    var = F.greatest(F.col("rq") / F.col("rn") - mu * mu, F.lit(MIN_SIGMA**2))
    ll = -F.col("own_n") / 2 * F.log(2 * math.pi * var) - (F.col("own_q") - 2 * mu * F.col("own_s") + F.col("own_n") * mu * mu) / (2 * var)
    return rest.withColumn("_ll", ll).groupBy(*keys, "window_id").agg(F.sum("_ll").alias("elpd"))


def drop_worst(values: DataFrame, keys: list[str], tau: int, rounds: int) -> DataFrame:
    """(keys, round, window_id, elpd): the window of the least leave-one-out density, dropped round by round.

    Densities equal to nine places are ties, of which the smaller id goes; elpd is the least density itself. Each round scores all keys at once; the number of rounds is the caller's."""
    history, left = None, materialise(values)
    for r in range(rounds):
        worst = loo_exact(left, keys, tau).groupBy(*keys).agg(F.min_by("window_id", F.struct(F.round("elpd", 9), F.col("window_id"))).alias("window_id"), F.min("elpd").alias("elpd"))
        worst = materialise(worst.select(*keys, F.lit(r).alias("round"), "window_id", "elpd"))
        history = worst if history is None else history.unionByName(worst)
        left = left.join(history.select(*keys, "window_id"), [*keys, "window_id"], "left_anti")
    return history


def g_prior_scale(n: Column, kind: str, g: float | None = None) -> Column:
    """Variance factor of the mean's prior: g fixed; unit information g = n; hyper-g/n at its prior mode g = n / 3."""
    return {"fixed": F.lit(g), "unit_information": n.cast("double"), "hyper_g_n": n / 3.0}[kind]
