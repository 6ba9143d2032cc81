"""Diagnostics of draws (config_id, chain, draw, value) and of pointwise log-likelihoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlane.functions.special import normal_quantile
from epochlane.session import materialise

CONFIG = ["config_id"]
#: Draws of one block of with_draws(), about, and the least number of blocks.
DRAWS_PER_BLOCK, LEAST_BLOCKS = 25_000, 32


def with_draws(values: DataFrame, draws: DataFrame) -> DataFrame:
    """Every row of values with every draw: the table of likelihoods to evaluate.

    Draws are cut into blocks by hash, LEAST_BLOCKS at least, each row of values repeated per block, so
    rows and draws meet by block and no side is sent whole. The blocks stay as many tasks however few bytes they are."""
    blocks = max(LEAST_BLOCKS, -(-draws.count() // DRAWS_PER_BLOCK))
    cut = draws.withColumn("_block", F.pmod(F.xxhash64(*draws.columns), F.lit(blocks))).repartition(blocks, "_block")
    return values.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(cut, "_block").drop("_block")


def quartiles_hdi(draws: DataFrame, mass: float = 0.6) -> DataFrame:
    """q25, q50, q75 and the shortest interval of floor(mass * n) steps between sorted draws."""
    w = Window.partitionBy(*CONFIG).orderBy("value", "chain", "draw")
    at = draws.withColumns({"_n": F.count("*").over(Window.partitionBy(*CONFIG)), "_i": F.row_number().over(w)})
    ends = at.select(*CONFIG, (F.col("_i") - F.floor(F.col("_n") * mass)).alias("_i"), F.col("value").alias("high"))
    spans = at.select(*CONFIG, "_i", F.col("value").alias("low")).join(ends, [*CONFIG, "_i"])
    hdi = spans.groupBy(*CONFIG).agg(F.min_by(F.struct("low", "high"), F.struct(F.round(F.col("high") - F.col("low"), 9), "low")).alias("h"))
    q = draws.groupBy(*CONFIG).agg(*[F.percentile("value", F.lit(p)).alias(f"q{round(100 * p)}") for p in (0.25, 0.5, 0.75)])
    return q.join(hdi, CONFIG).select(*CONFIG, "q25", "q50", "q75", F.col("h.low").alias("hdi_low"), F.col("h.high").alias("hdi_high"))


def split_rhat(draws: DataFrame) -> DataFrame:
    """R-hat over half chains (the middle draw of an odd chain is left out), without rank normalisation."""
    at = draws.withColumn("_n", F.count("*").over(Window.partitionBy(*CONFIG, "chain"))).withColumn("_h", F.floor(F.col("_n") / 2))
    at = at.withColumn("half", F.when(F.col("draw") < F.col("_h"), 0).when(F.col("draw") >= F.col("_n") - F.col("_h"), 1)).where("half is not null")
    per = at.groupBy(*CONFIG, "chain", "half").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").cast("double").alias("n"))
    n, within, between = F.avg("n"), F.avg("v"), F.var_samp("m")
    return per.groupBy(*CONFIG).agg(F.sqrt(((n - 1) / n * within + between) / F.nullif(within, F.lit(0.0))).alias("rhat"))


def bfmi(draws: DataFrame) -> DataFrame:
    """Mean squared step between successive draws over their variance, per chain."""
    step = F.col("value") - F.lag("value").over(Window.partitionBy(*CONFIG, "chain").orderBy("draw"))
    at = draws.withColumn("_s", step * step)
    return at.groupBy(*CONFIG, "chain").agg((F.avg("_s") / F.nullif(F.var_pop("value"), F.lit(0.0))).alias("bfmi"))


#: Lags that the first pass over the draws takes, and the most of a later one: each takes twice as many as the one before, as
#: most series end after a few lags.
FIRST_LAGS, LAGS = 4, 32


def _half_chains(draws: DataFrame) -> DataFrame:
    """(config_id, half, pos, value): both halves of every chain, all of the length that the shortest chain allows."""
    at = draws.withColumn("_n", F.count("*").over(Window.partitionBy(*CONFIG, "chain")))
    least = at.groupBy(*CONFIG).agg(F.floor(F.min("_n") / 2).alias("_h"))
    at = at.join(least, CONFIG).withColumn("half", F.when(F.col("draw") < F.col("_h"), 0).when(F.col("draw") >= F.col("_n") - F.col("_h"), 1)).where("half is not null")
    pos = F.when(F.col("half") == 0, F.col("draw")).otherwise(F.col("draw") - F.col("_n") + F.col("_h"))
    return at.select(*CONFIG, (2 * F.col("chain") + F.col("half")).alias("half"), pos.alias("pos"), "value", F.col("_h").alias("n"))


def _series(draws: DataFrame) -> DataFrame:
    """(config_id, kind, half, pos, n, x): the normal scores of the values' ranks (bulk), and whether a value is at most
    the 5 % and the 95 % quantile (low, high)."""
    at = _half_chains(draws)
    order, whole = Window.partitionBy(*CONFIG).orderBy("value"), Window.partitionBy(*CONFIG)
    rank = F.rank().over(order) + (F.count("*").over(Window.partitionBy(*CONFIG, "value")) - 1) / 2
    at = at.withColumns({"_r": rank, "_s": F.count("*").over(whole)})
    at = at.withColumn("_u", (F.col("_r") - 0.375) / (F.col("_s") + 0.25))
    cuts = at.groupBy(*CONFIG).agg(*[F.percentile("value", F.lit(p)).alias(c) for p, c in ((0.05, "_low"), (0.95, "_high"))])
    at = at.join(cuts, CONFIG)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("x")) for k, v in (("bulk", normal_quantile(F.col("_u"))), ("low", (F.col("value") <= F.col("_low")).cast("double")), ("high", (F.col("value") <= F.col("_high")).cast("double")))])
    return at.select(*CONFIG, "half", "pos", "n", F.explode(kinds).alias("_")).select(*CONFIG, "half", "pos", "n", "_.kind", "_.x")


def ess(draws: DataFrame) -> DataFrame:
    """(config_id, n, ess_bulk, ess_tail): effective sample sizes over the halves of all chains.

    Autocorrelations come from both the variance inside and between half chains, in pairs of lags up to the first
    negative pair, each at most the one before. Bulk: of normal scores; tail: the lesser of those of the two tails' marks.
    A pass over the draws takes FIRST_LAGS lags at first and up to LAGS later; only series whose pairs are all positive so far take part in the next.
    Configurations with fewer than four draws a half chain, or constant ones, have null."""
    keys = [*CONFIG, "kind"]
    chain = Window.partitionBy(*keys, "half")
    at = materialise(_series(draws).where("n >= 4").withColumn("m", F.avg("x").over(chain)).withColumn("x", F.col("x") - F.col("m")))
    means = at.groupBy(*keys, "half").agg(F.max("m").alias("m"), F.max("n").alias("n"))
    between = materialise(means.groupBy(*keys).agg(F.var_samp("m").alias("between"), F.count("*").alias("halves"), F.max("n").alias("n")))
    pairs, first, lags_now = None, 0, FIRST_LAGS
    while True:
        order = chain.orderBy("pos")
        steps = range(first, first + lags_now)
        led = at.select(*keys, "half", "n", "x", *[F.lead("x", t).over(order).alias(f"x{t}") if t else F.col("x").alias("x0") for t in steps])
        per = led.groupBy(*keys, "half").agg(F.max("n").alias("n"), *[(F.sum(F.col("x") * F.col(f"x{t}")) / F.max("n")).alias(f"c{t}") for t in steps])
        lags = F.array(*[F.struct(F.lit(t).alias("lag"), F.coalesce(f"c{t}", F.lit(0.0)).alias("c")) for t in steps])
        cov = per.select(*keys, "n", F.explode(lags).alias("_")).where("_.lag < n").groupBy(*keys, "n", F.col("_.lag").alias("lag")).agg(F.avg("_.c").alias("c"))
        found = cov.select(*keys, "lag", "c")
        both = materialise(found if pairs is None else pairs.unionByName(found))
        pairs = both
        zero = pairs.where("lag = 0").select(*keys, F.col("c").alias("c0")).join(between, keys)
        within = F.col("c0") * F.col("n") / (F.col("n") - 1)
        total = F.col("c0") + F.coalesce("between", F.lit(0.0))
        rho = pairs.join(zero, keys).where("c0 > 1e-12").withColumn("rho", F.when(F.col("lag") == 0, 1.0).otherwise(1 - (within - F.col("c")) / total))
        two = materialise(rho.groupBy(*keys, "halves", "n", F.floor(F.col("lag") / 2).alias("k")).agg(F.sum("rho").alias("p"), F.count("*").alias("_both")).where("_both = 2"))
        stop = two.groupBy(*keys).agg(F.min(F.when(F.round("p", 9) < 0, F.col("k"))).alias("stop"), F.max("k").alias("last"), F.max("n").alias("n"))
        more = stop.where(f"stop is null and 2 * last + 3 < n and last >= {(first + lags_now) // 2 - 1}").select(*keys)
        if more.isEmpty():
            break
        at, first, lags_now = materialise(at.join(more, keys, "left_semi")), first + lags_now, min(2 * lags_now, LAGS)
    kept = two.join(stop.select(*keys, "stop"), keys).where("stop is null or k < stop")
    least = F.min("p").over(Window.partitionBy(*keys).orderBy("k"))
    sums = kept.withColumn("p", least).groupBy(*keys, "halves", "n").agg((2 * F.sum("p") - 1).alias("tau"))
    size = F.col("halves") * F.col("n")
    each = sums.select(*keys, size.alias("n"), F.least(size / F.greatest("tau", F.lit(1e-9)), size * F.log10(size)).alias("ess"))
    of = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.col("ess")))
    out = each.groupBy(*CONFIG).agg(F.max("n").alias("n"), of("bulk").alias("ess_bulk"), of("low", "high").alias("ess_tail"))
    return draws.select(*CONFIG).distinct().join(out, CONFIG, "left")


#: Log-likelihoods in one stretch of this length are summed as they are: no exponential in it overflows.
STRETCH = 64.0


def waic(ll: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """elpd_waic = lppd - p_waic from (config_id, window_id, draw, ll).

    times: (window_id, times), how many events with the same likelihoods a window stands for; without it each is one.

    Draws are summed where they are, by stretches of log-likelihood, so that a few rows an event leave a task: the mean of
    exponentials and the variance follow from counts, means and variances of stretches."""
    n, m, e = F.col("n"), F.col("m"), F.col("_e")
    event = [*CONFIG, "window_id"]
    per = ll.withColumn("_e", F.floor(F.col("ll") / STRETCH)).groupBy(*event, "_e").agg(F.sum(F.exp(F.col("ll") - STRETCH * e)).alias("s"), F.count("*").alias("n"), F.avg("ll").alias("m"), F.var_pop("ll").alias("v"))
    w = Window.partitionBy(*event)
    per = per.withColumns({"_top": F.max("_e").over(w), "_mean": F.sum(n * m).over(w) / F.sum("n").over(w)})
    off = m - F.col("_mean")
    each = per.groupBy(*event).agg(
        (F.log(F.sum(F.col("s") * F.exp(STRETCH * (e - F.col("_top")))) / F.sum("n")) + STRETCH * F.max("_top")).alias("lppd"),
        (F.sum(n * (F.col("v") + off * off)) / F.nullif(F.sum("n") - 1, F.lit(0))).alias("p"))
    if times is not None:
        each = each.join(times, "window_id").withColumns({c: F.col(c) * F.col("times") for c in ("lppd", "p")})
    return each.groupBy(*CONFIG).agg(F.sum("lppd").alias("lppd"), F.sum("p").alias("p_waic"), (F.sum("lppd") - F.sum("p")).alias("elpd_waic"))


def psis_loo(ll: DataFrame, keys: list[str] = CONFIG) -> DataFrame:
    """(keys, window_id, elpd, pareto_k, influential): importance-sampling leave-one-out with a smoothed tail.

    ll: (keys, window_id, draw, ll). The tail, the largest min(0.2 S, 3 sqrt S) ratios of S draws, is fitted with a
    generalised Pareto by probability-weighted moments; with under five there, or where moments give none, nothing is smoothed and
    pareto_k is null. All steps are windows over the draws of one event, which share one sort; rows this short compress so
    well that Spark would put them into a few tasks, so they keep all partitions of a shuffle."""
    event = Window.partitionBy(*keys, "window_id")
    w = F.col("w")
    parts = int(ll.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ll.repartition(parts, *keys, "window_id").withColumn("w", -F.col("ll") - F.max(-F.col("ll")).over(event))
    at = at.withColumns({"r": F.row_number().over(event.orderBy("w", "draw")), "S": F.count("*").over(event)})
    at = at.withColumn("m", F.floor(F.least(0.2 * F.col("S"), 3 * F.sqrt("S")))).withColumn("j", F.col("r") - F.col("S") + F.col("m"))
    at = at.withColumn("cut", F.max(F.when(F.col("j") == 0, F.exp(w))).over(event)).withColumn("x", F.when(F.col("j") > 0, F.exp(w) - F.col("cut")))
    at = at.withColumns({"a0": F.sum("x").over(event) / F.nullif("m", F.lit(0)), "a1": F.sum(F.col("x") * (F.col("m") - F.col("j")) / F.nullif(F.col("m") - 1, F.lit(0))).over(event) / F.nullif("m", F.lit(0))})
    ok = (F.col("m") >= 5) & (F.col("a0") > 0) & (F.col("a0") - 2 * F.col("a1") > 0)
    d = F.col("a0") - 2 * F.col("a1")
    at = at.withColumns({"k": F.when(ok, 2 - F.col("a0") / d), "sigma": F.when(ok, 2 * F.col("a0") * F.col("a1") / d), "p": (F.col("j") - 0.5) / F.nullif("m", F.lit(0))})
    k, p = F.col("k"), F.col("p")
    fitted = F.when(F.abs(k) > 1e-9, F.col("sigma") / k * (F.pow(1 - p, -k) - 1)).otherwise(-F.col("sigma") * F.log1p(-p))
    at = at.withColumn("w", F.when(ok & (F.col("j") > 0), F.least(F.log(F.greatest(F.col("cut") + fitted, F.lit(1e-300))), F.lit(0.0))).otherwise(w))
    at = at.withColumn("top", F.max("ll").over(event))
    out = at.groupBy(*keys, "window_id").agg((F.log(F.sum(F.exp(F.col("w") + F.col("ll") - F.col("top"))) / F.sum(F.exp("w"))) + F.max("top")).alias("elpd"), F.max("k").alias("pareto_k"))
    return out.withColumn("influential", F.coalesce(F.col("pareto_k") > 0.7, F.lit(False)))
