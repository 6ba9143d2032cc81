"""Model configurations: grids, identity, labels, distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlane.operators.skew import dealt


def canonical(parts: dict[str, Column]) -> Column:
    """JSON text of the parts with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]))


def fingerprint(parts: dict[str, Column]) -> Column:
    return F.substring(F.sha2(canonical(parts), 256), 1, 16)


def subsets(spark: SparkSession, items: list[str], most: int) -> DataFrame:
    """(mask, features): every non-empty choice of up to `most` of the items, by bit mask."""
    n = len(items)
    masks = spark.range(1, 1 << n).where(F.bit_count("id") <= most)
    chosen = F.array_compact(F.array(*[F.when(F.col("id").bitwiseAND(F.lit(1 << i)) > 0, F.lit(x)) for i, x in enumerate(items)]))
    return masks.select(F.col("id").alias("mask"), chosen.alias("features"))


def with_subsets(df: DataFrame, items: list[str], most: int) -> DataFrame:
    """df with mask and features: each row once for every non-empty choice of up to `most` of the items."""
    masks = F.filter(F.sequence(F.lit(1).cast("long"), F.lit((1 << len(items)) - 1).cast("long")), lambda m: F.bit_count(m) <= most)
    at = df.withColumn("mask", F.explode(masks))
    chosen = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) > 0, F.lit(x)) for i, x in enumerate(items)]))
    return at.withColumn("features", chosen)


def grid(features: DataFrame, likelihoods: list[str], profiles: list[tuple[int, float]], zipped: bool = True) -> DataFrame:
    """features with every likelihood and every (n_points, overlap), or every pair of the two lists' entries."""
    pairs = profiles if zipped else [(n, o) for n in dict.fromkeys(p[0] for p in profiles) for o in dict.fromkeys(p[1] for p in profiles)]
    opts = F.array(*[F.struct(F.lit(n).alias("n_points"), F.lit(float(o)).alias("overlap")) for n, o in pairs])
    at = features.withColumn("likelihood", F.explode(F.array(*map(F.lit, likelihoods)))).withColumn("_p", F.explode(opts))
    return at.select(*features.columns, "likelihood", "_p.n_points", "_p.overlap")


def _without(items: Column, most: int) -> Column:
    """Array of (dropped, left): the sorted items with none, one or two of them dropped, up to `most`."""
    drop = lambda gone: F.filter(items, lambda x, k: ~F.array_contains(gone, k))
    entry = lambda n, left: F.struct(F.lit(n).alias("dropped"), left.alias("left"))
    at = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    out = [F.array(entry(0, items))]
    if most >= 1:
        out.append(F.transform(at, lambda i: entry(1, drop(F.array(i)))))
    if most >= 2:
        out.append(F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: entry(2, drop(F.array(i, j)))))))
    return F.concat(*out)


def distances(configs: DataFrame, most: int) -> DataFrame:
    """(a, b, distance) for pairs of configurations at most `most` apart: profile, and differing feature items.

    configs: config_id, n_points, overlap, items (array of different ones). Two sets that differ in
    d items are equal once each has dropped what only it holds, so pairs meet by what is left, those of
    one profile apart from the others: what meets is nearly what comes out. most may be 2 at most."""
    if most > 2:
        raise ValueError("sets are compared by dropping at most two items")
    c = configs.select("config_id", F.struct("n_points", "overlap").alias("p"), F.array_sort("items").alias("items"))

    def side(name: str, drops: int) -> DataFrame:
        at = c.withColumn("_w", F.explode(_without(F.col("items"), drops)))
        return at.select(F.col("_w.left").alias("left"), *[F.col(x).alias(f"{name}_{x}") for x in ("config_id", "p", "items")], F.col("_w.dropped").alias(f"{name}_dropped"))

    def meet(drops: int, same: bool) -> DataFrame:
        on = F.col("a_left") == F.col("b_left")
        on = on & (F.col("a_p") == F.col("b_p")) if same else on & (F.col("a_p") != F.col("b_p"))
        a, b = (side(x, drops).withColumnRenamed("left", f"{x}_left") for x in "ab")
        return a.join(b, on).where("a_config_id < b_config_id").where(F.col("a_dropped") + F.col("b_dropped") <= drops)

    # the same item set in another profile is one step, so there one item less may differ
    pairs = meet(most, True)
    if most >= 1:
        pairs = pairs.unionByName(meet(most - 1, False))
    apart = F.when(F.col("a_p") != F.col("b_p"), 1).otherwise(0) + F.size(F.array_except("a_items", "b_items")) + F.size(F.array_except("b_items", "a_items"))
    return pairs.select(F.col("a_config_id").alias("a"), F.col("b_config_id").alias("b"), apart.alias("distance")).where(F.col("distance") <= most).distinct()


#: Each metric's default likelihood, mean and deviation of its location's prior, deviation of its scale's prior,
#: and the likelihoods that it may have.
DEFAULTS = {
    "mean": ("student_t", 0.0, 1.5, 1.0, ["student_t", "lognormal", "normal", "skew_normal"]),
    "range": ("lognormal", -0.3, 1.0, 0.7, ["beta", "beta_constrained", "normal", "lognormal", "interval_inflated_beta", "zero_inflated_beta"]),
    "std": ("lognormal", -0.7, 1.0, 0.7, ["student_t", "lognormal", "gamma"]),
    "skewness": ("student_t", 0.0, 2.5, 1.5, ["student_t"]),
    "kurtosis": ("student_t", 0.0, 3.0, 2.0, ["student_t"]),
    "shape_shift": ("lognormal", -2.0, 1.0, 0.5, ["lognormal", "gamma"]),
}
SETTINGS = ("likelihood", "mu", "mu_sigma", "sigma", "g_prior")


def resolved(items: DataFrame, g_prior: str = "none") -> DataFrame:
    """items with a setting for each of SETTINGS and valid: what an item says itself, else its metric's default.

    items: metric and override (a map of texts, of any of SETTINGS, null or empty for none). g_prior is set for all metrics alike, unless an
    item says otherwise. valid: whether the metric is known and may have the likelihood; unknown metrics have only what they say."""
    spark = items.sparkSession
    rows = [(m, {"likelihood": k, "mu": str(mu), "mu_sigma": str(ms), "sigma": str(s), "g_prior": g_prior}, allowed) for m, (k, mu, ms, s, allowed) in DEFAULTS.items()]
    known = F.broadcast(spark.createDataFrame(rows, "metric string, _default map<string, string>, _allowed array<string>"))  # a row a metric
    none = F.create_map().cast("map<string, string>")
    at = items.join(known, "metric", "left")
    said = F.map_filter(F.coalesce("override", none), lambda k, v: v.isNotNull())
    at = at.withColumn("_all", F.map_concat(F.map_filter(F.coalesce("_default", none), lambda k, v: ~F.array_contains(F.map_keys(said), k)), said))
    at = at.withColumns({c: F.col("_all")[c] for c in SETTINGS})
    return at.withColumn("valid", F.coalesce(F.array_contains("_allowed", F.col("likelihood")), F.lit(False))).drop("_all", "_default", "_allowed")


def shared_chunks(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_chunks, valid): how many chunks a configuration's metrics have; valid if that's one number.

    features: (keys, metric, chunk_idx). The shape shift, which has one less, counts only where there is no other metric.
    Rows are dealt by keys first, so no task holds the distinct chunks of more than its share of configurations."""
    width = dealt(features.select(*keys, "metric", "chunk_idx"), *keys).groupBy(*keys, "metric").agg(F.countDistinct("chunk_idx").alias("w"))
    other = F.when(F.col("metric") != "shape_shift", F.col("w"))
    shift = F.when(F.col("metric") == "shape_shift", F.col("w"))
    at = width.groupBy(*keys).agg(F.max(other).alias("_o"), F.min(other).alias("_p"), F.max(shift).alias("_s"), F.min(shift).alias("_t"))
    return at.select(*keys, F.coalesce("_o", "_s").alias("n_chunks"), F.when(F.col("_o").isNotNull(), F.col("_o") == F.col("_p")).otherwise(F.col("_s") == F.col("_t")).alias("valid"))


def variants(features: DataFrame, profiles: list[tuple[int, float]]) -> DataFrame:
    """features with the grid variants: (variant, metric, likelihood, n_chunks, n_points, overlap).

    constrained: range with a constrained beta or a normal, a chunk a day; shift: the shape shift alone, lognormal or gamma; half_day: mean by
    a student-t and range by a constrained beta in two chunks a day. Profiles are zipped pairs."""
    rows = [("constrained", "range", k, 8) for k in ("beta_constrained", "normal")] + [("shift", "shape_shift", k, 7) for k in ("lognormal", "gamma")] + [("half_day", "mean", "student_t", 16), ("half_day", "range", "beta_constrained", 16)]
    opts = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(m).alias("metric"), F.lit(k).alias("likelihood"), F.lit(c).alias("n_chunks"), F.lit(n).alias("n_points"), F.lit(float(o)).alias("overlap")) for v, m, k, c in rows for n, o in profiles])
    return features.select(*features.columns, F.explode(opts).alias("_")).select(*features.columns, "_.*")
