"""Gates, ranks, and reports over a table of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalised(results: DataFrame) -> DataFrame:
    """elpd per event, per feature and event, per feature and day; loo_ic = -2 elpd."""
    e = F.col("elpd_loo")
    return results.withColumns({"elpd_per_event": e / F.col("n_events"), "elpd_norm": e / (F.col("n_features") * F.col("n_events")), "elpd_per_day": e / (F.col("n_features") * F.col("n_days")), "loo_ic": -2 * e})


def reasons() -> Column:
    """Why a result isn't eligible, as texts; empty if it is."""
    checks = [
        (F.col("status") != "ok", "status"), (F.col("n_divergences") > 0, "divergences"), (F.col("pareto_k_max") > 0.7, "pareto_k"),
        (F.col("r_hat_max") > 1.05, "r_hat"), (F.col("ess_min_bulk") < 200, "ess"), (F.col("elpd_loo").isNull(), "elpd"), (F.col("family") == "beta", "diagnostic_only"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))


def eligible(results: DataFrame) -> DataFrame:
    return results.withColumn("reasons", reasons()).withColumn("eligible", F.size("reasons") == 0)


def record_checks(results: DataFrame) -> DataFrame:
    """(config_id, problem): each invariant that a record breaks."""
    rules = [((F.col("e_tau") < 2) | (F.col("e_tau") > 8), "e_tau out of range"), (F.col("r_hat_max") < 1, "r_hat under 1"), (F.col("n_events") <= 0, "no events"), ((F.col("status") == "ok") & F.col("elpd_loo").isNull(), "ok without elpd"), (F.col("pareto_k_max") > 0.85, "large pareto k")]
    return results.select("config_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))).alias("problem"))


def rank_column(results: DataFrame, order: list[Column], name: str = "rank", n_ranges: int | None = None) -> DataFrame:
    """results with 1, 2, ... in a total order, without sorting the table in one task.

    Rows are dealt by range of the order and sorted there; a row's rank is its place in its
    range plus the sizes of the ranges before, which are one row a range."""
    from epochlane.session import materialise

    parts = results.repartitionByRange(*([n_ranges] if n_ranges else []), *order).withColumn("_part", F.spark_partition_id())
    parts = materialise(parts)
    local = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    return local.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_k") + F.col("_start")).cast("long")).drop("_part", "_k", "_start")


def quantile(df: DataFrame, col: str, share: float) -> float | None:
    """The exact quantile of a column's values, between neighbours by their distance; None for no value.

    By ranks over ranges, so no task gathers all values; the driver gets two of them."""
    from epochlane.session import materialise

    ranked = materialise(rank_column(df.where(F.col(col).isNotNull()).select(col), [F.asc(col)], "_rank"))
    n = ranked.count()
    if not n:
        return None
    at = share * (n - 1)
    near = {r["_rank"]: r[col] for r in ranked.where(F.col("_rank").isin(int(at) + 1, int(at) + 2)).collect()}
    low = near[int(at) + 1]
    return low + (near.get(int(at) + 2, low) - low) * (at - int(at))


def rank_within(results: DataFrame, key: str, order: list[Column], name: str = "place") -> DataFrame:
    """results with 1, 2, ... in a total order inside each value of key, however few values there are.

    The whole table is ranked by key and order; a value's first rank, one row a value, is taken off."""
    from epochlane.session import materialise

    at = materialise(rank_column(results, [F.asc(key), *order], "_rank"))
    first = at.groupBy(F.col(key).alias("_key")).agg(F.min("_rank").alias("_first"))
    return at.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_rank", "_first", "_key")


def model_prior(kind: str, n_features: Column, n_observations: Column | None = None, weight: float = 0.69) -> Column:
    """Log prior of a model by its number of features: uniform; inverse; bic, half a log of the observations
    for each; lambda, a constant for each."""
    p = F.greatest(n_features, F.lit(1)).cast("double")
    if kind == "uniform":
        return F.lit(0.0)
    if kind == "inverse":
        return -F.log(p)
    if kind == "bic":
        return -0.5 * p * F.log(F.greatest(n_observations, F.lit(1)).cast("double"))
    if kind == "lambda":
        return -weight * p
    raise ValueError(f"unknown prior {kind}")


def fail_fast(results: DataFrame) -> DataFrame:
    """(config_id, early, passed): the reasons that the sampler's own marks give, before anything is scored.

    early: empty for those that pass; only they need go on to pointwise scores."""
    checks = [(F.col("status") != "ok", "status"), (F.col("n_divergences") > 0, "divergences"), (F.col("r_hat_max") > 1.05, "r_hat"), (F.col("ess_min_bulk") < 200, "ess")]
    early = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))
    return results.select("config_id", early.alias("early")).withColumn("passed", F.size("early") == 0)


def passed_only(pointwise: DataFrame, results: DataFrame) -> DataFrame:
    """The pointwise rows (config_id, ...) of configurations that fail_fast() lets pass."""
    return pointwise.join(fail_fast(results).where("passed").select("config_id"), "config_id", "left_semi")


def best_first(col: str = "elpd_norm") -> list[Column]:
    return [F.desc("eligible"), F.desc_nulls_last(col), F.asc("config_id")]


def top(results: DataFrame, n: int, col: str = "elpd_norm") -> DataFrame:
    """The n best eligible results, or the n best ok ones if none is eligible: a top-n report."""
    flag = results.agg(F.max("eligible").alias("any"), F.lit(1).alias("one"))
    at = results.withColumn("one", F.lit(1)).join(F.broadcast(flag), "one").where(F.col("eligible") | (~F.col("any") & (F.col("status") == "ok")))
    return at.orderBy(F.desc_nulls_last(col), "config_id").limit(n).drop("one", "any")


def unidentified(results: DataFrame, low: float = 3.3, high: float = 7.7, width: float = 3.5) -> DataFrame:
    """tau at an edge of its support with a wide or missing interval."""
    edge = (F.col("e_tau") <= low) | (F.col("e_tau") >= high)
    return results.withColumn("tau_unidentified", edge & (F.col("tau_hdi_width").isNull() | (F.col("tau_hdi_width") >= width)))


def screen(results: DataFrame, slices: list[tuple[str, Column]], keys: list[str]) -> DataFrame:
    """n, mean, median and share at most 2.05 of e_tau for each key in each of several, overlapping slices.

    Every row is tagged with its slices and aggregated once."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices]))
    at = results.where("status = 'ok'").withColumn("slice", F.explode(names))
    return at.groupBy("slice", *keys).agg(F.count("*").alias("n"), F.avg("e_tau").alias("mean"), F.percentile("e_tau", F.lit(0.5)).alias("median"), F.avg((F.col("e_tau") <= 2.05).cast("double")).alias("share"))


def ecdf(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """(keys, x, ecdf): share of values at most x, one row for each distinct x."""
    per = df.groupBy(*keys, F.col(col).alias("x")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    return per.select(*keys, "x", (F.sum("_n").over(w.orderBy("x")) / F.sum("_n").over(w)).alias("ecdf"))


def density_histogram(df: DataFrame, col: str, low: float, high: float, bins: int, keys: list[str]) -> DataFrame:
    """(keys, bin, n, density) on shared equal bins; the last one is closed."""
    width = (high - low) / bins
    at = df.where(F.col(col).between(low, high)).withColumn("bin", F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)))
    counts = at.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * width))


def permute(df: DataFrame, keys: list[str], id_col: str, value: str, seed: int) -> DataFrame:
    """df with `value` permuted among the rows of a key, or among all rows for no key; the same for the same seed.

    Rows in the order of their ids take the values in the order of the ids' hashes."""
    drawn = [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.col(id_col)]
    if keys:
        of = df.withColumn("_of", F.concat_ws("\1", *keys))
        at = rank_within(of, "_of", [F.asc(id_col)], "_i")
        src = rank_within(of, "_of", drawn, "_i").select("_of", "_i", F.col(value).alias("_v"))
        return at.join(src, ["_of", "_i"]).withColumn(value, F.col("_v")).select(*df.columns)
    else:
        at = rank_column(df, [F.col(id_col)], "_i")
        src = rank_column(df, drawn, "_i").select("_i", F.col(value).alias("_v"))
    return at.join(src, [*keys, "_i"]).withColumn(value, F.col("_v")).drop("_i", "_v")


def changes(was: DataFrame, now: DataFrame, id_col: str, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, n_changed): rows, and rows whose value isn't what it was."""
    both = was.select(*keys, id_col, F.col(value).alias("_was")).join(now.select(id_col, value), id_col)
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col(value).eqNullSafe(F.col("_was"))).alias("n_changed"))


def running_best(history: DataFrame, keys: list[str], order: list[str], window: int) -> DataFrame:
    """history (.., config_id, score) with best so far, rows since it rose, share of configs first seen in the
    last `window`, and the running 10, 50 and 90 % points over it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = w.rowsBetween(-window + 1, 0)
    first = F.row_number().over(Window.partitionBy(*keys, "config_id").orderBy(*order)) == 1
    at = history.withColumns({"_i": F.row_number().over(w), "best": F.max("score").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_new": first.cast("int")})
    at = at.withColumn("_rise", F.when(F.col("best") > F.coalesce(F.lag("best").over(w), F.lit(float("-inf"))), F.col("_i")))
    at = at.withColumn("patience", F.col("_i") - F.last("_rise", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.withColumns({"new_share": F.avg("_new").over(last), **{f"q{round(100 * p)}": F.percentile("score", F.lit(p)).over(last) for p in (0.1, 0.5, 0.9)}}).drop("_i", "_new", "_rise")


def compare(left: DataFrame, right: DataFrame, key: str, cols: list[str], tolerance: float) -> DataFrame:
    """(key, col, a, b): values that differ by more than tolerance, or that only one side has."""
    at = left.select(key, *[F.col(c).alias(f"a_{c}") for c in cols]).join(right.select(key, *[F.col(c).alias(f"b_{c}") for c in cols]), key, "full")
    stacked = at.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in cols])).alias("_")).select(key, "_.*")
    return stacked.where((F.abs(F.col("a") - F.col("b")) > tolerance) | (F.col("a").isNull() != F.col("b").isNull()))


def running_totals(df: DataFrame, order: list[Column], cols: list[str]) -> DataFrame:
    """df with before_{col}: the sum of col over all rows earlier in a total order, by ranges as in rank_column."""
    from epochlane.session import materialise

    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_b_{c}") for c in cols])
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(*[F.sum(c).alias(c) for c in cols]).select("_part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_s_{c}") for c in cols])
    out = local.join(F.broadcast(starts), "_part")
    return out.withColumns({f"before_{c}": F.col(f"_b_{c}") + F.col(f"_s_{c}") for c in cols}).drop("_part", *[f"_{k}_{c}" for k in "bs" for c in cols])


def slices(results: DataFrame, params: list[str], score: str) -> DataFrame:
    """(param_1, param_2, value_1, value_2, score, best, n): for every pair of params the best
    score of each pair of values, with all other params at the values of the best row (nulls equal nulls).

    Rows are grouped by all params once; a row then stands for every pair whose other params are the best
    row's, so all pairs come from one pass. The best row: of the highest score, then of the least params."""
    per = results.groupBy(*params).agg(F.max(score).alias("score"), F.count("*").alias("n"))
    best = per.orderBy(F.desc_nulls_last("score"), *params).limit(1)
    best = best.select(*[F.col(c).alias(f"_b_{c}") for c in params], F.col("score").alias("_top")).withColumn("_", F.lit(1))
    at = per.withColumn("_", F.lit(1)).join(F.broadcast(best), "_")  # one row
    same = {c: F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in params}
    pairs = []
    for i, a in enumerate(params):
        for b in params[i + 1 :]:
            others = F.lit(True)
            for c in params:
                others = others & same[c] if c not in (a, b) else others
            pairs.append(F.when(others, F.struct(F.lit(a).alias("param_1"), F.lit(b).alias("param_2"), F.col(a).cast("string").alias("value_1"), F.col(b).cast("string").alias("value_2"))))
    return at.select(F.explode(F.array_compact(F.array(*pairs))).alias("p"), "score", (F.col("score") == F.col("_top")).alias("best"), "n").select("p.*", "score", "best", "n")


def varying(results: DataFrame, params: list[str]) -> list[str]:
    """Those of params that every row has: a parameter that some grids don't share is skipped in slices()."""
    seen = results.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in params]).first()
    return [c for c in params if not seen[c]]


#: Weights and gates of the log-target: with an information criterion, and the older form without.
TARGET = {"elpd": 1.0, "p_tau": 0.2, "map": 0.05, "conc": 0.05, "complexity": 0.05, "r_hat_gate": 1.05, "r_hat": 40.0, "ess_least": 100.0, "ess": 0.15, "bfmi_least": 0.3, "bfmi": 25.0}
TARGET_LEGACY = {"p_tau": 8.0, "map": 2.0, "conc": 1.0, "ess": 0.002, "complexity": 0.08, "r_hat_gate": 1.01, "r_hat": 50.0, "ess_least": 100.0, "ess_penalty": 5.0}


def log_target(weights: dict[str, float] | None = None, legacy: dict[str, float] | None = None) -> Column:
    """A model's score on a log scale, higher is better; null for a rejected one: with divergences, or whose elpd is missing
    though it has an information criterion.

    From columns ic_computed, elpd, p_tau, map_prob, conc, r_hat_max, ess_bulk, ess_tail, bfmi, n_divergences, n_blocks. With a criterion
    elpd counts most and each gate takes off in proportion to how far it is missed; without, the older form of tau's
    probabilities and the sample size. Missing p_tau, map_prob and conc are 0, a missing r_hat_max 1."""
    w, v = TARGET | (weights or {}), TARGET_LEGACY | (legacy or {})
    log = lambda c: F.log(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-12)))
    p, m, conc, r = F.col("p_tau"), F.col("map_prob"), F.coalesce("conc", F.lit(0.0)), F.coalesce("r_hat_max", F.lit(1.0))
    blocks = F.greatest(F.coalesce("n_blocks", F.lit(1)) - 1, F.lit(0)).cast("double")
    over = F.when(r > w["r_hat_gate"], w["r_hat"] * (r - w["r_hat_gate"])).otherwise(0.0)
    short = w["ess"] * F.greatest(F.lit(0.0), w["ess_least"] - F.coalesce(F.least("ess_bulk", "ess_tail"), F.lit(0.0)))
    energy = F.when(F.col("bfmi") < w["bfmi_least"], w["bfmi"] * (w["bfmi_least"] - F.col("bfmi"))).otherwise(0.0)
    new = w["elpd"] * F.col("elpd") + w["p_tau"] * log(p) + w["map"] * log(m) + w["conc"] * conc - w["complexity"] * blocks - over - short - energy
    gate = F.when(r > v["r_hat_gate"], v["r_hat"] * (r - v["r_hat_gate"])).otherwise(0.0) + F.when(F.coalesce(F.col("ess_bulk") < v["ess_least"], F.lit(True)), v["ess_penalty"]).otherwise(0.0)
    old = v["p_tau"] * log(p) + v["map"] * log(m) + v["conc"] * conc + v["ess"] * F.coalesce(F.log(F.greatest("ess_bulk", F.lit(1.0))), F.lit(0.0)) - v["complexity"] * blocks - gate
    return F.when(F.coalesce("n_divergences", F.lit(0)) > 0, F.lit(None).cast("double")).when(F.coalesce("ic_computed", F.lit(False)), new).otherwise(old)


def with_priors(parts: DataFrame, kinds: tuple[str, ...] = ("uniform", "inverse", "bic", "lambda")) -> DataFrame:
    """parts once for each kind of model prior, with target, log_prior and their sum log_posterior."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("prior"), model_prior(k, F.col("n_blocks"), F.col("n_observations")).alias("log_prior")) for k in kinds]))
    at = parts.withColumn("target", log_target()).withColumn("_p", each)
    return at.select(*parts.columns, "target", "_p.prior", "_p.log_prior", (F.col("target") + F.col("_p.log_prior")).alias("log_posterior"))


def stop_reasons(history: DataFrame, key: str, order: list[str], window: int = 50, patience: int = 30, tolerance: float = 0.1, least_new: float = 0.1) -> DataFrame:
    """(key, order, old_mean, new_mean, reason): for each record of a search whether it would stop there, and why.

    history: key, order, config_id, score. The last `window` records, those there are, are cut in the middle; reasons in this order: no better
    score for `patience` records; both means at most tolerance apart (from four scores on); fewer than least_new of the records
    with a model not seen before. The first record never stops. Windows hold `window` records at most."""
    w = Window.partitionBy(key).orderBy(*order)
    last = w.rowsBetween(-(window - 1), 0)
    best = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = history.withColumns({"_i": F.row_number().over(w), "_new": (F.row_number().over(Window.partitionBy(key, "config_id").orderBy(*order)) == 1).cast("double"), "_rise": F.col("score") > F.coalesce(best, F.lit(float("-inf"))) + 1e-12})
    at = at.withColumns({"_since": F.col("_i") - F.coalesce(F.last(F.when(F.col("_rise"), F.col("_i")), ignorenulls=True).over(w), F.lit(0)), "_all": F.collect_list("score").over(last), "_share": F.avg("_new").over(last)})
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    half = F.floor(F.size("_all") / 2).cast("int")
    at = at.withColumns({"old_mean": mean(F.slice("_all", F.lit(1), half)), "new_mean": mean(F.slice("_all", half + 1, F.size("_all")))})
    reason = F.when(F.col("_since") >= patience, "no_improvement").when((F.size("_all") >= 4) & (F.round(F.abs(F.col("new_mean") - F.col("old_mean")), 9) <= tolerance), "stabilized").when(F.round("_share", 9) < least_new, "saturated")
    return at.select(key, *order, "old_mean", "new_mean", F.when(F.col("_i") > 1, reason).alias("reason"))


def best_params(results: DataFrame, params: list[str], score: str) -> DataFrame:
    """(param, value, score): the parameters of the best row, the least of equals; no row if none has a score."""
    best = results.where(F.col(score).isNotNull()).orderBy(F.desc(score), *params).limit(1)
    return best.select(F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("string").alias("value")) for c in params])).alias("_"), F.col(score).alias("score")).select("_.param", "_.value", "score")


def param_grid(results: DataFrame, params: list[str]) -> DataFrame:
    """(param, n_values, values): how many values each parameter has, and those in order, joined by commas."""
    at = results.select(F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("string").alias("value")) for c in params])).alias("_")).select("_.*").distinct()
    return at.groupBy("param").agg(F.count("value").alias("n_values"), F.array_join(F.sort_array(F.collect_list("value")), ",").alias("values"))
