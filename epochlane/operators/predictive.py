"""Replicated data of fitted changepoint models, and their densities on both sides of the likeliest changepoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.functions.special import hashed_uniform, lgamma, normal_quantile, t4_quantile
from epochlane.operators import density, search
from epochlane.operators.changepoint import MIN_SIGMA, _softmax, regime
from epochlane.operators.ranking import rank_within
from epochlane.session import materialise

#: Likelihoods whose replicates can be drawn, and those whose values are on the unit interval.
KINDS = ["normal", "student_t", "lognormal", "gamma", "beta", "interval_inflated_beta"]
UNIT = ["lognormal", "gamma", "beta", "beta_constrained", "interval_inflated_beta", "zero_inflated_beta"]
#: Cells over which a density without a closed quantile is summed, and the equal steps of probability of its table.
CELLS, STEPS = 512, 128
#: A gamma's table ends so many deviations over its mean.
DEVIATIONS = 10.0


def posteriors(scores: DataFrame, keys: list[str]) -> DataFrame:
    """scores (keys, likelihood, tau, ll) with p and `reached`, the probability of a tau up to this one."""
    post = _softmax(scores, [*keys, "likelihood"], "ll")
    return post.withColumn("reached", F.sum("p").over(Window.partitionBy(*keys, "likelihood").orderBy("tau")))


def parameters(sums: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """(keys, likelihood, tau, regime, a, b, share, alpha): each kind's parameters by moments.

    a, b: location and scale, shape and rate, or both shapes; share: of the values in an inflated part;
    alpha: the skew-normal's shape. Regimes without a value have none."""
    fit = search.fitted(sums.where("n > 0")).withColumns(search.moments())
    log_mean = F.col("aL") / F.col("an")
    log_sd = F.sqrt(F.greatest(F.col("aG") / F.col("an") - log_mean * log_mean, F.lit(MIN_SIGMA**2)))
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(MIN_SIGMA**2)))
    zero = F.lit(0.0)
    of = {
        "normal": (F.col("mean"), sd, zero, zero), "student_t": (F.col("mean"), F.col("t_scale"), zero, zero), "skew_normal": (F.col("xi"), F.col("omega"), zero, F.col("alpha")), "lognormal": (log_mean, log_sd, zero, zero), "gamma": (F.col("shape"), F.col("rate"), zero, zero),
        "interval_inflated_beta": (F.col("interval_inflated_beta_a"), F.col("interval_inflated_beta_b"), (F.col("an") - F.col("ln")) / F.col("an"), zero), "zero_inflated_beta": (F.col("zero_inflated_beta_a"), F.col("zero_inflated_beta_b"), (F.col("an") - F.col("pn")) / F.col("an"), zero),
        **{k: (F.col(f"{k}_a"), F.col(f"{k}_b"), zero, zero) for k in ("beta", "beta_constrained")},
    }
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("likelihood"), *[v.alias(n) for n, v in zip(("a", "b", "share", "alpha"), of[k], strict=True)]) for k in kinds]))
    return fit.select(*keys, "tau", "regime", stack.alias("_")).select(*keys, "tau", "regime", "_.*")


def quantile_tables(params: DataFrame, keys: list[str]) -> DataFrame:
    """params with `table`: for gamma and beta rows the quantiles of STEPS equal steps of probability, for others null.

    The density is summed over CELLS cells of its support; a quantile lies inside its cell by distance. A row of
    params is a fitted model, so there are as many as configurations, not as data."""
    at = [*keys, "likelihood", "tau", "regime"]
    gamma = F.col("likelihood") == "gamma"
    needs = params.where(F.col("likelihood").isin("gamma", "beta", "beta_constrained", "interval_inflated_beta", "zero_inflated_beta") & F.col("a").isNotNull())
    top = F.when(gamma, F.col("a") / F.col("b") + DEVIATIONS * F.sqrt("a") / F.col("b")).otherwise(1.0)
    cells = needs.withColumn("top", top).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))).withColumn("x", F.col("top") * (F.col("i") + 0.5) / CELLS)
    log = (F.col("a") - 1) * F.log("x") + F.when(gamma, -F.col("b") * F.col("x")).otherwise((F.col("b") - 1) * F.log(1 - F.col("x")))
    whole = Window.partitionBy(*at)
    cells = cells.withColumn("log", log).withColumn("w", F.exp(F.col("log") - F.max("log").over(whole)))
    cells = cells.withColumn("high", F.sum("w").over(whole.orderBy("i")) / F.sum("w").over(whole)).withColumn("low", F.col("high") - F.col("w") / F.sum("w").over(whole))
    first, last = F.floor(F.col("low") * STEPS) + 1, F.least(F.floor(F.col("high") * STEPS), F.lit(STEPS - 1))
    inside = cells.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    value = F.col("top") * (F.col("i") + F.least(F.greatest((F.col("k") / STEPS - F.col("low")) / (F.col("high") - F.col("low")), F.lit(0.0)), F.lit(1.0))) / CELLS
    tables = inside.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))).alias("t"), F.first("top").alias("top"))
    tables = tables.select(*at, F.concat(F.array(F.lit(0.0)), F.transform("t", lambda s: s["v"]), F.array("top")).alias("table"))
    return params.join(tables, at, "left")


def _sums_drawn(threshold: float = search.THRESHOLD) -> tuple[Column, Column]:
    """Sum and sum of squares of a cell's values of the likelihood in column likelihood with parameters _p, by the inverse of
    its distribution: each is a line over the cell, but the lognormal's, whose sums are there."""
    kind, p, n = F.col("likelihood"), F.col("_p"), F.col("n")

    def line(at: Column, step: Column, s: str) -> tuple[Column, Column]:
        return at * n + step * F.col(s), at * at * n + 2 * at * step * F.col(s) + step * step * F.col(f"{s}_sq")

    def table(place: str, s: str) -> tuple[Column, Column]:
        low = F.get(p["table"], F.col(place))
        return line(low, F.get(p["table"], F.col(place) + 1) - low, s)

    high = line(F.lit(threshold), F.lit(1 - threshold), "g")
    forms = (("normal", line(p["a"], p["b"], "z")), ("student_t", line(p["a"], p["b"], "t")), ("lognormal", (F.col("e"), F.col("e_sq"))))
    out = []
    for j in (0, 1):
        of = F.when((kind == "interval_inflated_beta") & (F.col("k") < 0), high[j]).when(kind == "interval_inflated_beta", table("k", "g")[j])
        for name, x in forms:
            of = of.when(kind == name, x[j])
        out.append(of.otherwise(table("i", "f")[j]))
    return out[0], out[1]


def models(values: DataFrame, keys: list[str], kinds: list[str], draws: int, low: int, high: int, seed: int) -> DataFrame:
    """(keys, likelihood, draw, tau, p1, p2), written: each draw's tau, by its probability, and the parameters before and from it on."""
    sums = materialise(search.regime_sums(values, keys, low, high))
    post = materialise(posteriors(search.tau_scores(values, keys, kinds, low, high), keys))
    params = materialise(quantile_tables(parameters(sums, keys, kinds), keys))
    every = post.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", hashed_uniform(F.lit(seed), F.lit("tau"), F.col("draw")))
    drawn = every.groupBy(*keys, "likelihood", "draw").agg(F.coalesce(F.min(F.when(F.col("reached") >= F.col("_u"), F.col("tau"))), F.max("tau")).alias("tau"))
    side = lambda r: params.where(F.col("regime") == r).select(*keys, "likelihood", "tau", F.struct("a", "b", "share", "table").alias(f"p{r}"))
    at = [*keys, "likelihood", "tau"]
    return materialise(drawn.join(side(1), at, "left").join(side(2), at, "left"))


def replicates(values: DataFrame, keys: list[str], kinds: list[str], draws: int, low: int, high: int, seed: int = 7) -> DataFrame:
    """(keys, likelihood, draw, tau, n, observed, mean, sd) of replicated data, draws times for each kind.

    values: (keys, window_id, chunk_idx, y, u). Every value that is there is drawn anew from the fitted
    likelihood of its side of the draw's tau; its random number is a hash of seed, draw, window and chunk, so
    results don't depend on how rows are partitioned. It is taken once for all keys and kinds. Values are summed by the cell, of
    STEPS of probability, in which their numbers lie, so models meet cells, whose number doesn't grow with the data."""
    fitted = models(values, keys, kinds, draws, low, high, seed)
    first = lambda kind, c: F.max(F.when(F.col("likelihood") == kind, F.col(c))).alias(c.replace(".", "_") + f"_{kind[0]}")
    own = materialise(fitted.groupBy(*keys, "draw").agg(*[first("lognormal", c) for c in ("tau", "p1.a", "p2.a", "p1.b", "p2.b")], *[first("interval_inflated_beta", c) for c in ("tau", "p1.share", "p2.share")]))
    there = values.where("y is not null").groupBy("window_id", "chunk_idx").agg(F.collect_list(F.struct(*keys, "y", "u")).alias("of"))
    there = there.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", hashed_uniform(F.lit(seed), F.col("draw"), F.col("window_id"), F.col("chunk_idx")))
    there = there.withColumns({"z": normal_quantile(F.col("_u")), "t": t4_quantile(F.col("_u"))})
    met = there.select("chunk_idx", "draw", "_u", "z", "t", F.explode("of").alias("_")).select("chunk_idx", "draw", "_u", "z", "t", "_.*").join(own, [*keys, "draw"])
    side = lambda tau, c: F.when(regime(F.col("chunk_idx"), F.col(f"tau_{tau}")) == 1, F.col(f"p1_{c}_{tau}")).otherwise(F.col(f"p2_{c}_{tau}"))
    met = met.withColumns({"_s": F.coalesce(side("i", "share"), F.lit(0.0)), "e": F.exp(side("l", "a") + side("l", "b") * F.col("z"))})
    cell = lambda x: F.least(F.floor(x * STEPS), F.lit(STEPS - 1)).cast("int")
    met = met.withColumn("_v", (F.col("_u") - F.col("_s")) / (1 - F.col("_s"))).withColumns({"i": cell(F.col("_u")), "k": F.when(F.col("_u") < F.col("_s"), -1).otherwise(cell(F.col("_v")))})
    met = met.withColumns({"f": F.col("_u") * STEPS - F.col("i"), "g": F.when(F.col("k") < 0, F.col("_u") / F.col("_s")).otherwise(F.col("_v") * STEPS - F.col("k"))})
    squares = [F.sum(F.col(c) * F.col(c)).alias(f"{c}_sq") for c in "ztefg"]
    cells = materialise(met.groupBy(*keys, "draw", "chunk_idx", "i", "k").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "yuztefg"], *squares))
    p = F.when(regime(F.col("chunk_idx"), F.col("tau")) == 1, F.col("p1")).otherwise(F.col("p2"))
    drawn, square = _sums_drawn()
    seen = F.when(F.col("likelihood").isin(*UNIT), F.col("u")).otherwise(F.col("y"))
    at = cells.join(fitted, [*keys, "draw"]).withColumn("_p", p).select(*keys, "likelihood", "draw", "tau", "n", seen.alias("seen"), drawn.alias("drawn"), square.alias("square"))
    at = at.groupBy(*keys, "likelihood", "draw", "tau").agg(F.sum("n").alias("n"), (F.sum("seen") / F.sum("n")).alias("observed"), F.sum("drawn").alias("drawn"), F.sum("square").alias("square"), F.sum(F.when(F.col("drawn").isNotNull(), F.col("n"))).alias("_n"))
    mean = F.col("drawn") / F.col("_n")
    return at.select(*keys, "likelihood", "draw", "tau", "n", "observed", mean.alias("mean"), F.sqrt(F.greatest(F.col("square") / F.col("_n") - mean * mean, F.lit(0.0))).alias("sd"))


def predictive_means(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, likelihood, n, observed, replicated, p_ge): over replicates(), and the share of draws whose mean is
    not under the observed one."""
    return found.groupBy(*keys, "likelihood").agg(F.max("n").alias("n"), F.max("observed").alias("observed"), F.avg("mean").alias("replicated"), F.avg((F.round("mean", 9) >= F.round("observed", 9)).cast("double")).alias("p_ge"))


def best_tau(post: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, likelihood, tau): the likeliest changepoint, the earlier one of equals."""
    return post.groupBy(*keys, "likelihood").agg(F.max_by("tau", F.struct(F.round("p", 9), -F.col("tau"))).alias("tau"))


def _seen(values: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """(keys, likelihood, chunk_idx, x): the values that a likelihood describes; positive ones for those on the positive axis."""
    x = F.when(F.col("likelihood").isin(*UNIT), F.col("u")).otherwise(F.col("y"))
    at = values.withColumn("likelihood", F.explode(F.array(*[F.lit(k) for k in kinds]))).select(*keys, "likelihood", "chunk_idx", x.alias("x"))
    return at.where("x is not null").where(~F.col("likelihood").isin("lognormal", "gamma") | (F.col("x") > 0))


def split_at_best(values: DataFrame, post: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """(keys, likelihood, tau, regime, n, mean, low, high): the observed values on both sides of the likeliest changepoint.

    A chunk's values are summed before they meet their tau, which is one row a likelihood."""
    per = _seen(values, keys, kinds).groupBy(*keys, "likelihood", "chunk_idx").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high"))
    at = per.join(best_tau(post, keys), [*keys, "likelihood"]).withColumn("regime", regime(F.col("chunk_idx"), F.col("tau")))
    return at.groupBy(*keys, "likelihood", "tau", "regime").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def spans(values: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """(keys, likelihood, first, last): the ends of each likelihood's grid.

    From 0.8 of the least to 1.2 of the greatest value on the positive axis; all of the unit interval for betas; else
    a quarter of the span of 98 % of the values beyond it on either side. Quantiles are exact, by ranks over ranges."""
    eps = 1e-6
    cut, real = materialise(_seen(values, keys, [k for k in kinds if k in ("lognormal", "gamma")] or ["gamma"])), [k for k in kinds if k not in UNIT]
    positive = cut.groupBy(*keys, "likelihood").agg(F.greatest(0.8 * F.min("x"), F.lit(eps)).alias("first"), (1.2 * F.max("x")).alias("last"))
    there = values.where("y is not null").withColumn("_of", F.concat_ws("\1", *keys)).select(*keys, "_of", F.col("y").alias("x"))
    ranked = materialise(rank_within(there, "_of", [F.asc("x")]))
    size = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sd"))
    at = lambda share: share * (F.col("n") - 1)

    def quantile(share: float) -> Column:
        low, step = F.floor(at(share)), at(share) - F.floor(at(share))
        a, b = F.max(F.when(F.col("place") == low + 1, F.col("x"))), F.max(F.when(F.col("place") == low + 2, F.col("x")))
        return a + (F.coalesce(b, a) - a) * F.max(step)

    near = F.floor(at(0.01)).alias("a"), F.floor(at(0.99)).alias("b")
    picked = ranked.join(size.select(*keys, "n", "sd", *near), keys).where((F.col("place") - 1).isin(F.col("a"), F.col("a") + 1, F.col("b"), F.col("b") + 1))
    wide = picked.groupBy(*keys).agg(quantile(0.01).alias("q1"), quantile(0.99).alias("q99"), F.max("sd").alias("sd"))
    spread = F.when(F.col("q99") > F.col("q1"), F.col("q99") - F.col("q1")).otherwise(F.greatest("sd", F.lit(1e-3)))
    each = lambda names: F.explode(F.array(*[F.lit(k) for k in names])).alias("likelihood")
    out = positive.where(F.col("likelihood").isin(*kinds))
    if real:
        out = out.union(wide.select(*keys, each(real), (F.col("q1") - 0.25 * spread).alias("first"), (F.col("q99") + 0.25 * spread).alias("last")))
    if units := [k for k in kinds if k in UNIT and k not in ("lognormal", "gamma")]:
        out = out.union(size.select(*keys, each(units), F.lit(eps).alias("first"), F.lit(1 - eps).alias("last")))
    return out


def _pdf(x: Column) -> Column:
    """The density of column likelihood at x with parameters a, b, share, alpha and norm, what doesn't depend on x of a gamma's
    or a beta's logarithm; the inflated part of an interval-inflated beta comes on top of its beta."""
    kind, a, b, share = (F.col(c) for c in ("likelihood", "a", "b", "share"))
    log = F.col("norm") + (a - 1) * F.log(x)
    return (
        F.when(kind == "normal", F.exp(density.normal(x, a, b))).when(kind == "student_t", F.exp(density.student_t(x, F.lit(search.NU), a, b))).when(kind == "skew_normal", F.exp(density.skew_normal(x, a, b, F.col("alpha"))))
        .when(kind == "lognormal", F.exp(density.lognormal(x, a, b))).when(kind == "gamma", F.exp(log - b * x))
        .otherwise((1 - share) * F.exp(log + (b - 1) * F.log(1 - x)) + F.when((kind == "interval_inflated_beta") & (x >= search.THRESHOLD), share / (1 - search.THRESHOLD)).otherwise(0.0)))


def density_profiles(values: DataFrame, keys: list[str], kinds: list[str], low: int, high: int, points: int = 50) -> DataFrame:
    """(keys, likelihood, tau, i, x, before, after): the fitted densities on both sides of the likeliest changepoint.

    Each likelihood has a grid of its own over its values, `points` equal steps of it."""
    sums = materialise(search.regime_sums(values, keys, low, high))
    post = posteriors(search.tau_scores(values, keys, kinds, low, high), keys)
    at = [*keys, "likelihood", "tau"]
    a, b = F.col("a"), F.col("b")
    norm = F.when(F.col("likelihood") == "gamma", a * F.log(b) - lgamma(a)).when(F.col("likelihood").isin("beta", "beta_constrained", "interval_inflated_beta", "zero_inflated_beta"), lgamma(a + b) - lgamma(a) - lgamma(b)).otherwise(0.0)
    params = materialise(best_tau(post, keys).join(parameters(sums, keys, kinds), at).withColumn("norm", norm))
    fitted = params.join(spans(values, keys, kinds), [*keys, "likelihood"])
    grid = fitted.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("first") + (F.col("last") - F.col("first")) * F.col("i") / (points - 1))
    grid = grid.withColumn("pdf", _pdf(F.col("x")))
    side = lambda r: F.max(F.when(F.col("regime") == r, F.col("pdf")))
    return grid.groupBy(*at, "i").agg(F.max("x").alias("x"), side(1).alias("before"), side(2).alias("after"))
