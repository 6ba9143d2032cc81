"""Stacked logistic fits, effects of many subjects, hashed draws and slices, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochlane.functions.special import hashed_uniform, normal_quantile, t4_quantile
from epochlane.operators import density, mixed_effects, posterior, predictive, ranking, refit, stacked


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(3)
    x = rng.normal(size=(240, 3))
    y = (rng.uniform(size=240) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.0] + 0.3)))).astype(int)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(240)], "id long, x array<double>, y int")
    return stacked.ranked_folds(df, "id", 3)


def local(rows):
    got = sorted(rows.select("place", "fold", "x", "y").collect())
    return np.array([r["place"] for r in got]), np.array([r["fold"] for r in got]), np.array([r["x"] for r in got]), np.array([r["y"] for r in got])


def loss(w, x, y, m):
    z = x @ w[:-1] + w[-1]
    return np.mean(np.log1p(np.exp(z)) - y * z) + m.reg * (m.l1 * np.abs(w[:-1]).sum() + (1 - m.l1) / 2 * (w[:-1] ** 2).sum())


def test_stacked_fits_are_each_models_own_best(spark, rows):
    models = [stacked.Model(f"{r}:{a}", r, a, f, s) for r in (0.01, 0.1) for a in (0.0, 0.5) for f, s in ((0, 1.0), (2, 0.3))]
    fitted = stacked.fit(rows, models, 3)
    place, fold, x, y = local(rows)
    assert fitted.passes <= 12
    for m, w, size in zip(models, fitted.weights, fitted.sizes, strict=True):
        train = np.flatnonzero(fold != m.fold)[:size]  # the places are in order
        assert size == int(m.share * (fold != m.fold).sum() + 1e-9)
        best = loss(w, x[train], y[train], m)
        for step in np.vstack((np.eye(4), -np.eye(4), np.random.RandomState(1).normal(size=(20, 4)))):
            assert loss(w + 1e-3 * step, x[train], y[train], m) >= best - 1e-9


def test_scores_are_those_of_the_rows(rows):
    models = [stacked.Model("a", 0.01, 0.0, f, 0.5) for f in range(3)]
    fitted = stacked.fit(rows, models, 3)
    place, fold, x, y = local(rows)
    for r in stacked.scores(rows, fitted, 3).collect():
        m, w = models[r["model"]], fitted.weights[r["model"]]
        own = np.flatnonzero(fold == m.fold) if r["role"] == "test" else np.flatnonzero(fold != m.fold)[: fitted.sizes[r["model"]]]
        p = 1 / (1 + np.exp(-(x[own] @ w[:-1] + w[-1])))
        q = p >= 0.5
        assert r["n"] == len(own) and r["accuracy"] == pytest.approx((q == y[own]).mean()) and r["brier"] == pytest.approx(((p - y[own]) ** 2).mean())
        assert r["log_loss"] == pytest.approx(-np.log(np.where(y[own] == 1, p, 1 - p)).mean())
        assert r["macro_recall"] == pytest.approx((q[y[own] == 1].mean() + (~q[y[own] == 0]).mean()) / 2)


def test_jobs_do_not_grow_with_options(spark, rows):
    def jobs(n):
        group = f"options-{n}"
        spark.sparkContext.setJobGroup(group, group)
        stacked.fit(rows, [stacked.Model(str(i), 0.01 * (i + 1), 0.0, i % 3) for i in range(n)], 3, most_passes=2)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_learning_curve_parts_are_nested():
    place, models = np.arange(50), [stacked.Model("a", fold=f, share=s) for f in (0, 1, 3) for s in (0.2, 0.5, 1.0)]
    seen = stacked._seen(place, 50, 4, models)
    for j, m in enumerate(models):
        assert seen[:, j].sum() == stacked.training_size(50, 4, m) and not seen[place % 4 == m.fold, j].any()
        if j % 3:
            assert (seen[:, j] | ~seen[:, j - 1]).all()
    assert [m.params for m in stacked.sampled([stacked.Model(str(i)) for i in range(9)], 3, 1)] == [m.params for m in stacked.sampled([stacked.Model(str(i)) for i in reversed(range(9))], 3, 1)]


def test_effects_of_subjects_are_found(spark):
    rng = np.random.RandomState(0)
    effect, month = rng.normal(size=40) * 1.5, rng.normal(size=12) * 0.5
    s, m, x = rng.randint(0, 40, 6000), rng.randint(1, 13, 6000), rng.normal(size=(6000, 2))
    y = rng.uniform(size=6000) < 1 / (1 + np.exp(-(effect[s] + month[m - 1] + x @ [0.8, 0.0])))
    df = spark.createDataFrame([(f"s{a}", int(b), c.tolist(), int(d)) for a, b, c, d in zip(s, m, x, y, strict=True)], "subject_id string, month int, x array<double>, label int")
    fixed, own = mixed_effects.fit(df, [[True, True], [False, False]], [True, False])
    got = {r["subject_id"]: r["own"] for r in own.collect()}
    assert np.corrcoef([got[f"s{i}"][0] for i in range(40)], effect)[0, 1] > 0.97 and all(v[1] == 0 for v in got.values())
    assert fixed[0, 13] == pytest.approx(0.8, abs=0.12) and abs(fixed[0, 14]) < 0.12 and not fixed[1, 1:].any()
    new = spark.createDataFrame([("unseen", 1, [0.0, 0.0], 1), ("s0", 1, [0.0, 0.0], 0)], df.schema)
    p = {(r["variant"], r["y"]): r["p"] for r in mixed_effects.predict(new, fixed, own, ["full", "null"]).collect()}
    assert len(p) == 4 and p["null", 1] == pytest.approx(p["null", 0]) and p["full", 1] == pytest.approx(1 / (1 + np.exp(-(fixed[0, 0] + fixed[0, 1]))))


def test_a_hundred_thousand_subjects(spark):
    df = spark.range(200_000).select(F.concat(F.lit("s"), F.col("id") % 100_000).alias("subject_id"), (F.col("id") % 12 + 1).cast("int").alias("month"), F.array((F.col("id") % 7).cast("double")).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    _, own = mixed_effects.fit(df, [[True]], [True], rounds=1)
    assert own.count() == 100_000


def test_numbers_of_rows_do_not_depend_on_partitions(spark):
    values = spark.range(480).select(F.lit("a").alias("grp"), (F.col("id") / 8).cast("long").alias("window_id"), (F.col("id") % 8).cast("int").alias("chunk_idx"), (F.sin("id") * 0.4).alias("y"), ((F.sin("id") * 0.4 + 1) / 2).alias("u"))
    one, many = ({(r["likelihood"], r["draw"]): (r["tau"], r["n"], round(r["mean"], 9), round(r["sd"], 9)) for r in predictive.replicates(values.repartition(n), ["grp"], predictive.KINDS, 4, 2, 8).collect()} for n in (1, 200))
    assert one == many and len(one) == 4 * len(predictive.KINDS)
    seen = values.agg(F.avg("y"), F.avg("u")).first()
    for (kind, _), (_, n, mean, _) in one.items():
        assert n == 480 and abs(mean - seen[kind in predictive.UNIT]) < 0.1


def test_quantiles_invert_their_distributions(spark):
    us = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.999]
    got = spark.createDataFrame([(u,) for u in us], "u double").select("u", normal_quantile(F.col("u")).alias("z"), t4_quantile(F.col("u")).alias("t")).collect()
    import math

    for r in got:
        assert 0.5 * math.erfc(-r["z"] / math.sqrt(2)) == pytest.approx(r["u"], rel=1e-6)
        t = r["t"]
        cdf = 0.5 + 3 / 8 * (t / math.sqrt(1 + t * t / 4)) * (1 - t * t / 12 / (1 + t * t / 4))
        assert cdf == pytest.approx(r["u"], rel=1e-6, abs=1e-12)
    u = [r[0] for r in spark.range(20_000).select(hashed_uniform(F.lit(1), F.col("id"))).collect()]
    assert abs(np.mean(u) - 0.5) < 0.01 and np.histogram(u, 10, (0, 1))[0].min() > 1800


def test_refits_stop_where_nothing_is_over(spark):
    rng = np.random.RandomState(2)
    values = [(g, w, c, float(v)) for g in ("calm", "wild") for w in range(12) for c, v in enumerate(rng.normal(size=8) * 0.1)]
    values += [("wild", 99, c, 30.0) for c in range(8)]
    df = spark.createDataFrame(values, "grp string, window_id long, chunk_idx int, value double")
    got = {(r["grp"], r["attempt"]): r for r in refit.refit(df, ["grp"], 2, 8, draws=60, threshold=0.3).collect()}
    assert got["calm", 0]["n_events"] == 12 and got["wild", 0]["n_events"] == 13
    for (g, a), r in got.items():
        assert (r["removed"] is not None) == ((g, a + 1) in got)
        if r["removed"] is not None:
            assert r["removed"] == r["worst"] and got[g, a + 1]["n_events"] == r["n_events"] - 1


def test_importance_sampling_of_a_known_case(spark):
    """Without a tail to smooth the estimate is the harmonic mean; k needs draws enough."""
    ll = spark.createDataFrame([("c", 1, i, float(-i)) for i in range(4)], "config_id string, window_id long, draw int, ll double")
    r = posterior.psis_loo(ll).first()
    assert r["pareto_k"] is None and r["elpd"] == pytest.approx(-np.log(np.mean(np.exp(np.arange(4.0)))))


def test_sample_sizes_of_known_series(spark):
    rng = np.random.RandomState(0)
    slow = np.zeros(400)
    for i in range(1, 400):
        slow[i] = 0.9 * slow[i - 1] + rng.normal()
    rows = [(name, c, i, float(v)) for c in range(2) for name, s in (("free", rng.normal(size=400)), ("slow", slow + c * 0.01), ("flat", np.ones(400)), ("few", np.arange(5.0))) for i, v in enumerate(s)]
    got = {r["config_id"]: r for r in posterior.ess(spark.createDataFrame(rows, "config_id string, chain int, draw int, value double")).collect()}
    assert got["free"]["ess_bulk"] > 500 and 15 < got["slow"]["ess_bulk"] < 120 and got["few"]["ess_bulk"] is None
    assert got["free"]["ess_tail"] > 300 and set(got) == {"free", "slow", "flat", "few"}


def test_slices_match_nulls_and_all_pairs(spark):
    df = spark.createDataFrame([("a", None, 1, 3.0), ("b", None, 1, 2.0), ("a", "x", 1, 9.0), ("a", "x", 2, 1.0), ("b", "y", 2, 5.0)], "p string, q string, r int, score double")
    got = {(r["param_1"], r["param_2"], r["value_1"], r["value_2"]): (r["score"], r["best"]) for r in ranking.slices(df, ["p", "q", "r"], "score").collect()}
    assert got == {("p", "q", "a", None): (3.0, False), ("p", "q", "b", None): (2.0, False), ("p", "q", "a", "x"): (9.0, True), ("p", "r", "a", "1"): (9.0, True), ("p", "r", "a", "2"): (1.0, False), ("q", "r", None, "1"): (3.0, False), ("q", "r", "x", "1"): (9.0, True), ("q", "r", "x", "2"): (1.0, False)}
    assert ranking.varying(df, ["p", "q", "r"]) == ["p", "r"]


def test_priors_are_densities(spark):
    step = 0.002
    x = spark.range(40_000).select((-20 + (F.col("id") + 0.5) * step).alias("x"))
    priors = {"normal": {"mu": 0.5, "sigma": 2.0}, "halfnormal": {"sigma": 1.5}, "exponential": {"lam": 1.0}, "exponential_plus": {"lam": 0.5, "offset": 2.0}, "lognormal": {"mu": 0.0, "sigma": 0.5}, "beta": {"alpha": 2.0, "beta": 5.0}, "gamma": {"mu": 3.0, "sigma": 1.5}, "gamma_offset": {"alpha": 2.0, "beta": 3.0, "offset": 1.0}, "truncated_gamma": {"mu": 3.0, "sigma": 1.5, "lower": 1.0, "upper": 4.0}}
    got = x.agg(*[(F.sum(F.exp(density.prior(F.col("x"), k, **p))) * step).alias(k) for k, p in priors.items()]).first()
    for k in priors:
        assert got[k] == pytest.approx(1.0, abs=2e-3), k


def test_means_with_a_scale_of_random_size(spark):
    """Sums over nodes against integrals over fine grids."""
    rng = np.random.RandomState(4)
    z = np.abs(rng.normal(size=400_000))
    u = rng.beta(1.5, 1.5, size=400_000)
    n, mean, var = 30.0, 0.4, 0.5
    like = lambda g: np.mean(np.sqrt(var / n / (var / n + g)) * np.exp(-(mean**2) / (2 * (var / n + g))))
    at = spark.createDataFrame([(n, mean, var)], "n double, mean double, var double")
    r = at.select(*[refit.log_mean_evidence(k, F.col("n"), F.col("mean"), F.col("var")).alias(k) for k in refit.G_PRIORS]).first()
    assert r["none"] == pytest.approx(np.log(like(np.array([1.0])))) and r["unit_information"] == pytest.approx(np.log(like(np.array([n]))))
    assert r["zellner_siow"] == pytest.approx(np.log(like(n / z**2)), abs=0.02) and r["hyper_g_n"] == pytest.approx(np.log(like(n * u / (1 - u))), abs=0.02)
