"""Changepoint models scored over whole grids of configurations: likelihoods from sums, shared between configurations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochlane.functions.special import lgamma
from epochlane.operators import density
from epochlane.operators.changepoint import MIN_SIGMA, _softmax, regime, tau_summary

EPS = 1e-6
#: Where the upper interval of the interval-inflated beta starts.
THRESHOLD = 0.9
#: Degrees of freedom of the student-t.
NU = 4.0
#: Prior of the normal's marginal likelihood: mean, its weight in observations, shape and rate of the precision.
PRIOR = (0.0, 1.0, 2.0, 0.1)
TAIL = 2 * math.pi


def _sums(times: Column, threshold: float = THRESHOLD) -> dict[str, Column]:
    """The sums of one chunk, each row counted `times`. n, s, q, c: count and powers of y; of the unit value x, clipped to
    (EPS, 1 - EPS), count, sum, squares, logs of x and of 1 - x over all (a), positive (p) and low (l) ones."""
    y, u = F.col("y"), F.col("u")
    x = F.least(F.greatest(u, F.lit(EPS)), F.lit(1 - EPS))
    out = {"n": F.sum(F.when(y.isNotNull(), times)), "s": F.sum(times * y), "q": F.sum(times * y * y), "c": F.sum(times * y * y * y), "aG": F.sum(F.when(u.isNotNull(), times * F.log(x) * F.log(x)))}
    for part, cond in (("a", u.isNotNull()), ("p", u > EPS), ("l", u < threshold)):
        of = lambda v, cond=cond: F.sum(F.when(cond, times * v))
        out |= {f"{part}n": of(F.lit(1.0)), f"{part}s": of(x), f"{part}q": of(x * x), f"{part}L": of(F.log(x)), f"{part}M": of(F.log(1 - x))}
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}


def _times(values: DataFrame) -> Column:
    """How many equal rows a row of values stands for: its column times, or one."""
    return F.col("times").cast("double") if "times" in values.columns else F.lit(1.0)


def regime_sums(values: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """(keys, tau, regime, sums): for every tau the sums before it (regime 1) and from it on (2).

    values: (keys, window_id, chunk_idx, y, u), and times if rows stand for several. One pass over the
    values; the rest are prefix sums over one row a chunk."""
    sums = _sums(_times(values))
    per = values.groupBy(*keys, "chunk_idx").agg(*[v.alias(k) for k, v in sums.items()])
    w, whole = Window.partitionBy(*keys).orderBy("chunk_idx"), Window.partitionBy(*keys)
    before = F.struct(F.lit(1).alias("regime"), *[(F.sum(k).over(w) - F.col(k)).alias(k) for k in sums])
    after = F.struct(F.lit(2).alias("regime"), *[(F.sum(k).over(whole) - F.sum(k).over(w) + F.col(k)).alias(k) for k in sums])
    at = per.select(*keys, "chunk_idx", before.alias("_1"), after.alias("_2")).where(F.col("chunk_idx").between(low - 1, high - 1))
    return at.select(*keys, (F.col("chunk_idx") + 1).alias("tau"), F.explode(F.array("_1", "_2")).alias("_")).select(*keys, "tau", "_.*")


def _variance(n: Column, s: Column, q: Column) -> Column:
    return F.greatest(q / n - (s / n) * (s / n), F.lit(MIN_SIGMA**2))


def _part(n: Column, share: Column) -> Column:
    """n log share, 0 for none."""
    return F.when(n > 0, n * F.log(share)).otherwise(0.0)


#: Beta likelihoods: the part of the values that the beta is fitted to, and the least shape.
BETAS = {"beta": ("a", 0.0), "beta_constrained": ("a", 1.0), "zero_inflated_beta": ("p", 0.0), "interval_inflated_beta": ("l", 0.0)}


def fitted(sums: DataFrame) -> DataFrame:
    """sums, as regime_sums() gives them, with the parameters that moments give, and their log gammas.

    Step by step, as columns of their own: log gammas of whole expressions grow too large to compile."""
    n, s, q = (F.col(k) for k in "nsq")
    m0, k0, a0, b0 = PRIOR
    size = {}
    for part in "apl":
        pn, ps, pq = (F.col(f"{part}{k}") for k in "nsq")
        size[f"{part}_mean"], size[f"{part}_var"] = ps / F.nullif(pn, F.lit(0.0)), _variance(F.nullif(pn, F.lit(0.0)), ps, pq)
    of = lambda part, what: F.col(f"{part}_{what}")
    out = sums.withColumns(size).withColumns({f"{p}_size": F.greatest(of(p, "mean") * (1 - of(p, "mean")) / of(p, "var") - 1, F.lit(0.1)) for p in "apl"})
    shapes = {}
    for kind, (p, least) in BETAS.items():
        shapes[f"{kind}_a"], shapes[f"{kind}_b"] = F.greatest(of(p, "mean") * of(p, "size"), F.lit(least)), F.greatest((1 - of(p, "mean")) * of(p, "size"), F.lit(least))
    mean = s / F.nullif(n, F.lit(0.0))
    shapes |= {"shape": of("a", "mean") * of("a", "mean") / of("a", "var"), "rate": of("a", "mean") / of("a", "var"), "post_n": k0 + n, "post_a": a0 + n / 2, "post_b": b0 + (q - s * mean) / 2 + k0 * n * (mean - m0) * (mean - m0) / (2 * (k0 + n))}
    out = out.withColumns(shapes).withColumns({f"{k}_sum": F.col(f"{k}_a") + F.col(f"{k}_b") for k in BETAS})
    return out.withColumns({f"lg_{c}": lgamma(F.col(c)) for c in ("shape", "post_a", *[f"{k}_{x}" for k in BETAS for x in ("a", "b", "sum")])})


def closed_forms() -> dict[str, Column]:
    """For each likelihood whose fitted log-likelihood follows from fitted() that expression."""
    n, s, q = (F.col(k) for k in "nsq")
    _, k0, a0, b0 = PRIOR
    normal = lambda n, s, q: -n / 2 * (F.log(TAIL * _variance(n, s, q)) + 1)

    def beta(kind: str) -> Column:
        p = BETAS[kind][0]
        pn, a, b = F.col(f"{p}n"), F.col(f"{kind}_a"), F.col(f"{kind}_b")
        return F.when(pn > 0, pn * (F.col(f"lg_{kind}_sum") - F.col(f"lg_{kind}_a") - F.col(f"lg_{kind}_b")) + (a - 1) * F.col(f"{p}L") + (b - 1) * F.col(f"{p}M")).otherwise(0.0)

    up, zero = F.col("an") - F.col("ln"), F.col("an") - F.col("pn")
    forms = {
        "normal": normal(n, s, q),
        "normal_marginal": F.col("lg_post_a") - math.lgamma(a0) + a0 * math.log(b0) - F.col("post_a") * F.log("post_b") + 0.5 * (math.log(k0) - F.log("post_n")) - n / 2 * math.log(TAIL),
        "lognormal": normal(n, F.col("aL"), F.col("aG")) - F.col("aL"),
        "gamma": n * (F.col("shape") * F.log("rate") - F.col("lg_shape")) + (F.col("shape") - 1) * F.col("aL") - F.col("rate") * F.col("as"),
        "beta": beta("beta"), "beta_constrained": beta("beta_constrained"),
        "zero_inflated_beta": _part(zero, zero / n) + _part(F.col("pn"), F.col("pn") / n) + beta("zero_inflated_beta"),
        "interval_inflated_beta": _part(up, up / n / (1 - THRESHOLD)) + _part(F.col("ln"), F.col("ln") / n) + beta("interval_inflated_beta"),
    }
    return {k: F.when(n > 0, v).otherwise(0.0) for k, v in forms.items()}


def moments() -> dict[str, Column]:
    """Location, scale and shape by moments of the student-t (fixed NU) and the skew-normal, from regime_sums()."""
    n, s, q, c = (F.col(k) for k in "nsqc")
    mean, var = s / n, _variance(n, s, q)
    skew = (c / n - 3 * mean * q / n + 2 * mean * mean * mean) / F.pow(var, F.lit(1.5))
    skew = F.least(F.greatest(F.round(skew, 6), F.lit(-0.9)), F.lit(0.9))  # rounded, so that noise of equal values has no sign
    power = F.pow(F.abs(skew), F.lit(2 / 3))
    delta = F.signum(skew) * F.sqrt(math.pi / 2 * power / (power + ((4 - math.pi) / 2) ** (2 / 3)))
    scale = F.sqrt(var / (1 - 2 * delta * delta / math.pi))
    return {"mean": mean, "t_scale": F.sqrt(var * (NU - 2) / NU), "xi": mean - scale * delta * math.sqrt(2 / math.pi), "omega": scale, "alpha": delta / F.sqrt(1 - delta * delta)}


def by_value() -> dict[str, Column]:
    """Log-densities that need each value, with the parameters of moments()."""
    y = F.col("y")
    return {"student_t": density.student_t(y, F.lit(NU), F.col("mean"), F.col("t_scale")), "skew_normal": density.skew_normal(y, F.col("xi"), F.col("omega"), F.col("alpha"))}


def tau_scores(values: DataFrame, keys: list[str], kinds: list[str], low: int, high: int) -> DataFrame:
    """(keys, likelihood, tau, ll): fitted log-likelihood of a split at tau, for each kind of likelihood.

    values: (keys, window_id, chunk_idx, y, u); y is the feature, u the same on the unit interval,
    both null where there is none; a column times says how many equal rows one stands for. Most kinds follow from sums that are read once for all; the
    student-t and the skew-normal meet each value once a tau."""
    sums = regime_sums(values, keys, low, high)
    closed = {k: v for k, v in closed_forms().items() if k in kinds}
    each = {k: v for k, v in by_value().items() if k in kinds}
    unknown = set(kinds) - set(closed) - set(each)
    if unknown:
        raise ValueError(f"unknown likelihoods: {sorted(unknown)}")
    stack = lambda of: F.explode(F.array(*[F.struct(F.lit(k).alias("likelihood"), v.alias("ll")) for k, v in of.items()]))
    parts = []
    if closed:
        parts.append(fitted(sums).select(*keys, "tau", stack(closed).alias("_")))
    if each:
        params = sums.where("n > 0").select(*keys, "tau", "regime", *[v.alias(k) for k, v in moments().items()])
        at = values.where("y is not null").withColumn("tau", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("regime", regime(F.col("chunk_idx"), F.col("tau")))
        parts.append(at.join(params, [*keys, "tau", "regime"]).select(*keys, "tau", stack({k: _times(values) * v for k, v in each.items()}).alias("_")))
    out = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return out.select(*keys, "tau", "_.likelihood", "_.ll").groupBy(*keys, "likelihood", "tau").agg(F.sum("ll").alias("ll"))


def score_configs(items: DataFrame, scores: DataFrame, keys: list[str], config_keys: list[str], threshold: float) -> DataFrame:
    """One row a configuration: n_features, n_scored, status, log_evidence and the summary of tau.

    items: (config_keys, keys, likelihood), a row a feature of a configuration; scores: (keys,
    likelihood, tau, ll), each computed once however many configurations use it. A configuration
    with a feature that has no score is an error row with nulls, kept beside the others. Features
    are independent given tau, so their log-likelihoods add up; tau has a uniform prior."""
    found = items.join(scores, [*keys, "likelihood"], "left")
    per = found.groupBy(*config_keys, "tau").agg(F.sum("ll").alias("ll"), F.count("ll").alias("_k"))
    size = items.groupBy(*config_keys).agg(F.count("*").alias("n_features"))
    top = Window.partitionBy(*config_keys)
    known = per.where("tau is not null").withColumn("_top", F.max("ll").over(top))
    have = known.groupBy(*config_keys).agg(F.max("_k").alias("n_scored"), (F.max("_top") + F.log(F.sum(F.exp(F.col("ll") - F.col("_top")))) - F.log(F.count("*"))).alias("log_evidence"))
    post = tau_summary(_softmax(known.select(*config_keys, "tau", "ll"), config_keys, "ll"), config_keys, threshold)
    cols = [c for c in post.columns if c not in config_keys]
    out = size.join(have, config_keys, "left").join(post, config_keys, "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    ok = F.col("n_scored") == F.col("n_features")
    return out.select(*config_keys, "n_features", "n_scored", F.when(ok, "ok").otherwise("error").alias("status"), *[F.when(ok, F.col(c)).alias(c) for c in ("log_evidence", *cols)])
