"""Replicated data, density profiles and refits of changepoint models (section 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlane.functions import special
from epochlane.operators import density, features, posterior, predictive, refit, search
from epochlane.plans.base import alike, with_profiles
from epochlane.plans.profiling import PERIOD_SQL, PM1_SQL, _periods
from epochlane.plans.registry import query
from epochlane.plans.searching import _pointwise, _r, _with_unit, score_sql, skew_sql
from epochlane.sources.adapt import ctes, view

KEYS = ["grp", "metric"]
SEED, DRAWS, POINTS = 7, 16, 50
PROFILED = ["normal", "student_t", "skew_normal", "lognormal", "gamma", "beta", "beta_constrained", "interval_inflated_beta"]
LONG_SQL = "SELECT window_id, day_idx AS c, grp, metric, y, CASE WHEN metric = 'mean' THEN (y + 1) / 2 ELSE y / 2 END AS u FROM (SELECT window_id, day_idx, grp, unnest(['mean', 'range']) AS metric, unnest([mean, range]) AS y FROM p) x"


def _long(spark, d, firsts=False):
    return _with_unit(features.long_features(_periods(spark, d, firsts), ["mean", "range"], ["window_id", "day_idx", "grp"]))


def uniform_sql(*keys: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


def _horner_sql(x: str, coefficients: list[float]) -> str:
    out = f"({coefficients[0]}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c}::DOUBLE))"
    return out


def normal_quantile_sql(u: str) -> str:
    (a, b), (c, e) = special.QUANTILE_MIDDLE, special.QUANTILE_TAIL
    q, t = f"({u} - 0.5)", f"sqrt(-2 * ln(least({u}, 1 - {u})))"
    return f"CASE WHEN abs({q}) <= 0.5 - {special.TAIL} THEN {q} * {_horner_sql(f'({q} * {q})', a)} / {_horner_sql(f'({q} * {q})', b)} ELSE -sign({q}) * {_horner_sql(t, c)} / {_horner_sql(t, e)} END"


def t4_quantile_sql(u: str) -> str:
    a = f"sqrt(4 * {u} * (1 - {u}))"
    return f"(sign({u} - 0.5) * 2 * sqrt(greatest(cos(acos(least({a}, 1.0::DOUBLE)) / 3) / {a} - 1, 0)))"


def _shape_sql(p: str, n: str, s: str, least: float) -> tuple[str, str]:
    mean, var = f"({s} / nullif({n}, 0))", f"greatest({p}q / nullif({n}, 0) - ({s} / nullif({n}, 0)) ** 2, 1e-6)"
    size = f"greatest({mean} * (1 - {mean}) / {var} - 1, 0.1)"
    return f"greatest({mean} * {size}, {least}::DOUBLE)", f"greatest((1 - {mean}) * {size}, {least}::DOUBLE)"


_A_MEAN, _A_VAR = "(as_ / an)", "greatest(aq / an - (as_ / an) ** 2, 1e-6)"
PARAM_SQL = {
    "normal": ("mean", "sqrt(var)", "0.0", "0.0"), "student_t": ("mean", "t_scale", "0.0", "0.0"), "skew_normal": ("xi", "omega", "0.0", "alpha"),
    "lognormal": ("al / an", "sqrt(greatest(ag / an - (al / an) ** 2, 1e-6))", "0.0", "0.0"), "gamma": (f"{_A_MEAN} * {_A_MEAN} / {_A_VAR}", f"{_A_MEAN} / {_A_VAR}", "0.0", "0.0"),
    "beta": (*_shape_sql("a", "an", "as_", 0.0), "0.0", "0.0"), "beta_constrained": (*_shape_sql("a", "an", "as_", 1.0), "0.0", "0.0"), "interval_inflated_beta": (*_shape_sql("l", "ln_", "ls", 0.0), "(an - ln_) / an", "0.0"),
}


def model_sql(kinds: list[str]) -> dict[str, str]:
    """po: probabilities of tau; pa: parameters of both sides of every tau."""
    lists = [", ".join(f"({PARAM_SQL[k][j]})::DOUBLE" for k in kinds) for j in range(4)]
    return {
        "fl": LONG_SQL, **score_sql("fl", "grp, metric", kinds),
        "po": "SELECT *, sum(p) OVER (PARTITION BY grp, metric, likelihood ORDER BY tau) AS reached FROM (SELECT *, exp(ll - top) / sum(exp(ll - top)) OVER (PARTITION BY grp, metric, likelihood) AS p FROM (SELECT *, max(ll) OVER (PARTITION BY grp, metric, likelihood) AS top FROM sc))",
        "pa": f"SELECT grp, metric, tau, r AS regime, unnest([{', '.join(repr(k) for k in kinds)}]) AS likelihood, unnest([{lists[0]}]) AS a, unnest([{lists[1]}]) AS b, unnest([{lists[2]}]) AS share, unnest([{lists[3]}]) AS alpha FROM mo",
        "bt": "SELECT grp, metric, likelihood, arg_max(tau, (round(p, 9), -tau)) AS tau FROM po GROUP BY ALL",
    }


_AT = "grp, metric, likelihood, tau, regime"
_STEPS, _CELLS = predictive.STEPS, predictive.CELLS
_LOOK = "(tab[i + 1] + (place - i) * (tab[i + 2] - tab[i + 1]))"
REPLICATE_SQL = {
    "cell": f"""SELECT *, sum(w) OVER (PARTITION BY {_AT} ORDER BY i) / sum(w) OVER (PARTITION BY {_AT}) AS high, w / sum(w) OVER (PARTITION BY {_AT}) AS own FROM (
        SELECT *, exp(l - max(l) OVER (PARTITION BY {_AT})) AS w FROM (SELECT *, (a - 1) * ln(x) + CASE WHEN likelihood = 'gamma' THEN -b * x ELSE (b - 1) * ln(1 - x) END AS l FROM (
            SELECT *, top * (i + 0.5) / {_CELLS} AS x FROM (SELECT *, CASE WHEN likelihood = 'gamma' THEN a / b + {predictive.DEVIATIONS}::DOUBLE * sqrt(a) / b ELSE 1.0::DOUBLE END AS top FROM pa WHERE likelihood IN ('gamma', 'beta', 'interval_inflated_beta') AND a IS NOT NULL), (SELECT unnest(range({_CELLS})) AS i))))""",
    "tabs": f"""SELECT {_AT}, [0.0::DOUBLE] || list(v ORDER BY k) || [any_value(top)] AS tab FROM (
        SELECT *, top * (i + least(greatest((k / {_STEPS}.0::DOUBLE - (high - own)) / own, 0), 1)) / {_CELLS} AS v FROM (SELECT *, unnest(range(floor((high - own) * {_STEPS})::BIGINT + 1, least(floor(high * {_STEPS})::BIGINT, {_STEPS - 1}) + 1)) AS k FROM cell)) GROUP BY {_AT}""",
    "full": f"SELECT pa.*, tab FROM pa LEFT JOIN tabs USING ({_AT})",
    "dr": f"SELECT grp, metric, likelihood, draw, coalesce(min(tau) FILTER (WHERE reached >= z), max(tau)) AS tau FROM (SELECT po.*, draw, {uniform_sql(str(SEED), repr('tau'), 'draw')} AS z FROM po, (SELECT unnest(range({DRAWS})) AS draw)) GROUP BY ALL",
    "rv": f"SELECT fl.*, draw, {uniform_sql(str(SEED), 'draw', 'window_id', 'c')} AS z FROM fl, (SELECT unnest(range({DRAWS})) AS draw) WHERE y IS NOT NULL",
    "rm": f"""SELECT *, z2 * {_STEPS} AS place, least(floor(z2 * {_STEPS}), {_STEPS - 1})::BIGINT AS i FROM (SELECT rv.*, likelihood, tau, a, b, share, tab, CASE WHEN likelihood = 'interval_inflated_beta' THEN (z - share) / (1 - share) ELSE z END AS z2
        FROM rv JOIN dr USING (grp, metric, draw) LEFT JOIN full_ USING (grp, metric, likelihood, tau) WHERE regime IS NULL OR regime = CASE WHEN c < tau - 1 THEN 1 ELSE 2 END)""".replace("full_", '"full"'),
    "rd": f"""SELECT grp, metric, likelihood, draw, tau, CASE WHEN likelihood IN ('lognormal', 'gamma', 'beta', 'interval_inflated_beta') THEN u ELSE y END AS seen,
        CASE likelihood WHEN 'normal' THEN a + b * ({normal_quantile_sql('z')}) WHEN 'student_t' THEN a + b * {t4_quantile_sql('z')} WHEN 'lognormal' THEN exp(a + b * ({normal_quantile_sql('z')}))
            WHEN 'interval_inflated_beta' THEN CASE WHEN z < share THEN {search.THRESHOLD} + (1 - {search.THRESHOLD}) * z / share ELSE {_LOOK} END ELSE {_LOOK} END AS drawn FROM rm""",
    "rs": "SELECT grp, metric, likelihood, draw, tau, count(*) AS n, avg(seen) AS observed, avg(drawn) AS mean, stddev_pop(drawn) AS sd FROM rd GROUP BY ALL",
}


def replicate_sql() -> str:
    return with_profiles(s=PM1_SQL, p=PERIOD_SQL, **model_sql(predictive.KINDS), **{('"full"' if k == "full" else k): v for k, v in REPLICATE_SQL.items()})


def _replicates(spark, d):
    return predictive.replicates(_long(spark, d), KEYS, predictive.KINDS, DRAWS, 2, 8, SEED)


@query("ppc_replicates", replicate_sql() + "SELECT grp, metric, likelihood, draw, tau, n, round(mean, 5) AS mean, round(sd, 5) AS sd FROM rs")
def ppc_replicates(spark, d):
    """Each replicated data set's changepoint, mean and deviation."""
    return _r(_replicates(spark, d).drop("observed"), "mean", "sd", n=5).withColumn("draw", F.col("draw").cast("long"))


@query("ppc_mean", replicate_sql() + "SELECT grp, metric, likelihood, max(n) AS n, round(max(observed), 5) AS observed, round(avg(mean), 5) AS replicated, round(avg((round(mean, 9) >= round(observed, 9))::INT), 5) AS p_ge FROM rs GROUP BY ALL")
def ppc_mean(spark, d):
    """Observed and replicated means of every likelihood of both metrics, tau drawn from its probabilities."""
    return _r(predictive.predictive_means(_replicates(spark, d), KEYS), "observed", "replicated", "p_ge", n=5)


def _kinds_sql(kinds: list[str]) -> str:
    return "[" + ", ".join(repr(k) for k in kinds) + "]"


_UNITS = "('lognormal', 'gamma', 'beta', 'beta_constrained', 'interval_inflated_beta', 'zero_inflated_beta')"
SPLIT_SQL = {"sv": f"SELECT * FROM (SELECT grp, metric, likelihood, c, CASE WHEN likelihood IN {_UNITS} THEN u ELSE y END AS x FROM (SELECT *, unnest({_kinds_sql(PROFILED)}) AS likelihood FROM fl)) WHERE x IS NOT NULL AND (likelihood NOT IN ('lognormal', 'gamma') OR x > 0)"}


@query("observed_split", with_profiles(s=PM1_SQL, p=PERIOD_SQL, **model_sql(PROFILED), **SPLIT_SQL) + "SELECT grp, metric, likelihood, tau, CASE WHEN c < tau - 1 THEN 1 ELSE 2 END AS regime, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS low, round(max(x), 6) AS high FROM sv JOIN bt USING (grp, metric, likelihood) GROUP BY ALL")
def observed_split(spark, d):
    """The observed values before and from each likelihood's likeliest changepoint on."""
    long = _long(spark, d)
    post = predictive.posteriors(search.tau_scores(long, KEYS, PROFILED, 2, 8), KEYS)
    return _r(predictive.split_at_best(long, post, KEYS, PROFILED), "mean", "low", "high")


def _pdf_sql(x: str, p: str) -> str:
    a, b, s, al = (f"{p}.{c}" for c in ("a", "b", "share", "alpha"))
    normal = lambda v: f"exp(-0.5 * ln(2 * pi()) - ln({b}) - ({v} - {a}) ** 2 / (2 * {b} * {b}))"
    unit = f"least(greatest({x}, 1e-6), 1 - 1e-6)"
    beta = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + ({a} - 1) * ln({unit}) + ({b} - 1) * ln(1 - {unit}))"
    return f"""CASE g.likelihood WHEN 'normal' THEN {normal(x)} WHEN 'student_t' THEN exp(lgamma(2.5::DOUBLE) - lgamma(2.0::DOUBLE) - 0.5 * ln(4 * pi()) - ln({b}) - 2.5 * ln(1 + (({x} - {a}) / {b}) ** 2 / 4))
        WHEN 'skew_normal' THEN exp({skew_sql(x, a, b, al)}) WHEN 'lognormal' THEN {normal(f'ln(greatest({x}, 1e-6))')} / greatest({x}, 1e-6) WHEN 'gamma' THEN exp({a} * ln({b}) - lgamma({a}) + ({a} - 1) * ln(greatest({x}, 1e-6)) - {b} * greatest({x}, 1e-6))
        WHEN 'interval_inflated_beta' THEN (1 - {s}) * {beta} + CASE WHEN {x} >= {search.THRESHOLD} THEN {s} / (1 - {search.THRESHOLD}) ELSE 0 END ELSE {beta} END"""


PROFILE_SQL = SPLIT_SQL | {
    "ends": f"""SELECT grp, metric, likelihood, greatest(0.8 * min(x), 1e-6) AS first, 1.2 * max(x) AS last FROM sv WHERE likelihood IN ('lognormal', 'gamma') GROUP BY ALL
        UNION ALL SELECT grp, metric, unnest(['normal', 'student_t', 'skew_normal']), q1 - 0.25 * w, q99 + 0.25 * w FROM (SELECT *, CASE WHEN q99 > q1 THEN q99 - q1 ELSE greatest(sd, 1e-3) END AS w FROM (
            SELECT grp, metric, quantile_cont(y, 0.01) AS q1, quantile_cont(y, 0.99) AS q99, stddev_pop(y) AS sd FROM fl WHERE y IS NOT NULL GROUP BY ALL))
        UNION ALL SELECT grp, metric, unnest(['beta', 'beta_constrained', 'interval_inflated_beta']), 1e-6, 1 - 1e-6 FROM fl WHERE y IS NOT NULL GROUP BY grp, metric""",
    "gr": f"SELECT bt.*, i, first + (last - first) * i / {POINTS - 1} AS x FROM bt JOIN ends USING (grp, metric, likelihood), (SELECT unnest(range({POINTS}))::INT AS i)",
}
_SIDE = "LEFT JOIN pa {0} ON {0}.grp = g.grp AND {0}.metric = g.metric AND {0}.likelihood = g.likelihood AND {0}.tau = g.tau AND {0}.regime = {1}"


@query("density_profile", with_profiles(s=PM1_SQL, p=PERIOD_SQL, **model_sql(PROFILED), **PROFILE_SQL) + f"SELECT g.grp, g.metric, g.likelihood, g.tau, i, round(x, 6) AS x, round({_pdf_sql('x', 'p1')}, 4) AS before, round({_pdf_sql('x', 'p2')}, 4) AS after FROM gr g {_SIDE.format('p1', 1)} {_SIDE.format('p2', 2)}")
def density_profile(spark, d):
    """Eight likelihoods' densities before and after the likeliest changepoint, each on a grid over its own values."""
    return _r(_r(predictive.density_profiles(_long(spark, d), KEYS, PROFILED, 2, 8, POINTS), "x"), "before", "after", n=4)


# --- refits and importance sampling


def psis_sql(src: str, keys: str, p: str) -> dict[str, str]:
    """{p}loo: posterior.psis_loo() of src (keys, window_id, draw, ll)."""
    e = f"PARTITION BY {keys}, window_id"
    return {
        f"{p}a": f"SELECT *, least(0.2 * size, 3 * sqrt(size))::INT - CASE WHEN least(0.2 * size, 3 * sqrt(size))::INT > least(0.2 * size, 3 * sqrt(size)) THEN 1 ELSE 0 END AS m FROM (SELECT *, row_number() OVER ({e} ORDER BY w, draw) AS r, count(*) OVER ({e}) AS size FROM (SELECT *, -ll - max(-ll) OVER ({e}) AS w FROM {src}))",
        f"{p}b": f"SELECT *, CASE WHEN j > 0 THEN exp(w) - cut END AS x FROM (SELECT *, r - size + m AS j, max(CASE WHEN r - size + m = 0 THEN exp(w) END) OVER ({e}) AS cut FROM {p}a)",
        f"{p}c": f"SELECT *, sum(x) OVER ({e}) / nullif(m, 0) AS a0, sum(x * (m - j) / nullif(m - 1, 0)) OVER ({e}) / nullif(m, 0) AS a1 FROM {p}b",
        f"{p}d": f"SELECT *, CASE WHEN m >= 5 AND a0 > 0 AND a0 - 2 * a1 > 0 THEN 2 - a0 / (a0 - 2 * a1) END AS k, CASE WHEN m >= 5 AND a0 > 0 AND a0 - 2 * a1 > 0 THEN 2 * a0 * a1 / (a0 - 2 * a1) END AS sigma, (j - 0.5) / nullif(m, 0) AS pp, max(ll) OVER ({e}) AS top FROM {p}c",
        f"{p}loo": f"""SELECT {keys}, window_id, ln(sum(exp(w + ll - top)) / sum(exp(w))) + max(top) AS elpd, max(k) AS pareto_k FROM (SELECT * REPLACE (CASE WHEN k IS NOT NULL AND j > 0
            THEN least(ln(greatest(cut + CASE WHEN abs(k) > 1e-9 THEN sigma / k * (pow(1 - pp, -k) - 1) ELSE -sigma * ln(1 - pp) END, 1e-300)), 0) ELSE w END AS w) FROM {p}d) GROUP BY {keys}, window_id""",
    }


LL_DRAWS_SQL = {
    "lv": "SELECT grp, window_id, count(mean) AS n, sum(mean) AS sm, sum(mean * mean) AS q FROM p WHERE mean IS NOT NULL GROUP BY 1, 2",
    "lld": "SELECT config_id || ':' || grp AS config_id, window_id, draw, -n / 2.0 * ln(2 * pi() * 0.25) - (q - 2 * mu * sm + n * mu * mu) / 0.5 AS ll FROM lv, param_draws",
}


@query("psis_loo", with_profiles("param_draws", s=PM1_SQL, p=PERIOD_SQL, **LL_DRAWS_SQL, **psis_sql("lld", "config_id", "i")) + "SELECT config_id, window_id, round(elpd, 4) AS elpd, round(pareto_k, 4) AS pareto_k, coalesce(pareto_k > 0.7, false) AS influential FROM iloo")
def psis_loo(spark, d):
    """Windows with the same days have the same likelihoods, so one of each is fitted and its row is that of all."""
    found = _r(posterior.psis_loo(_pointwise(spark, d)), "elpd", "pareto_k", n=4).withColumnRenamed("window_id", "first_id")
    return found.join(alike(spark, d), "first_id").select("config_id", "window_id", "elpd", "pareto_k", "influential")


REFITS, REFIT_DRAWS, REFIT_OVER = 3, 100, 0.2


def refit_sql() -> dict[str, str]:
    """Every attempt's fit over what the ones before left, written out one after the other."""
    k = "grp, metric"
    out = {"fl": LONG_SQL, "l0": "SELECT grp, metric, window_id, c, y FROM fl WHERE y IS NOT NULL"}
    for r in range(REFITS + 1):
        n = f"n{r}_"
        out |= {
            f"{n}t": f"SELECT {k}, arg_max(tau, (round(p, 9), -tau)) AS tau FROM (SELECT *, exp(ll - top) / sum(exp(ll - top)) OVER (PARTITION BY {k}) AS p FROM (SELECT *, max(ll) OVER (PARTITION BY {k}) AS top FROM (SELECT {k}, tau, sum(CASE WHEN n > 0 THEN -n / 2.0 * (ln(2 * pi() * greatest(var, 1e-6)) + 1) ELSE 0 END) AS ll FROM (SELECT {k}, tau, c < tau - 1 AS b, count(y) AS n, avg(y * y) - avg(y) ** 2 AS var FROM l{r}, (SELECT unnest(range(2, 9))::INT AS tau) GROUP BY ALL) GROUP BY {k}, tau))) GROUP BY {k}",
            f"{n}o": f"SELECT {k}, window_id, CASE WHEN c < tau - 1 THEN 1 ELSE 2 END AS r, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM l{r} JOIN {n}t USING ({k}) GROUP BY ALL",
            f"{n}f": f"SELECT {k}, r, draw, var, mean + sqrt(var / size) * ({normal_quantile_sql('z')}) AS mu FROM (SELECT *, {uniform_sql(str(SEED), 'draw', 'r')} AS z FROM (SELECT {k}, r, sum(n) AS size, sum(s) / sum(n) AS mean, greatest(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2, 1e-6) AS var FROM {n}o GROUP BY {k}, r), (SELECT unnest(range({REFIT_DRAWS})) AS draw))",
            f"{n}l": f"SELECT {k}, window_id, draw, sum(-n / 2 * ln(2 * pi() * var) - (q - 2 * mu * s + n * mu * mu) / (2 * var)) AS ll FROM {n}o JOIN {n}f USING ({k}, r) GROUP BY ALL",
            **psis_sql(f"{n}l", k, n),
            f"{n}h": f"SELECT *, CASE WHEN n_over > 0 AND n_events > 1 AND {r} < {REFITS} THEN worst END AS removed FROM (SELECT {k}, {r} AS attempt, count(*) AS n_events, sum(elpd) AS elpd, max(round(pareto_k, 4)) AS k_max, count(*) FILTER (WHERE round(pareto_k, 4) > {REFIT_OVER}) AS n_over, arg_max(window_id, (coalesce(round(pareto_k, 4), -1e300), -window_id)) AS worst FROM {n}loo GROUP BY {k})",
            f"l{r + 1}": f"SELECT l{r}.* FROM l{r} JOIN {n}h USING ({k}) WHERE removed IS NOT NULL AND window_id <> removed",
        }
    return out


@query("refit_history", with_profiles(s=PM1_SQL, p=PERIOD_SQL, **refit_sql()) + "SELECT grp, metric, attempt, n_events, round(elpd, 3) AS elpd, k_max, n_over, worst, removed FROM (" + " UNION ALL ".join(f"SELECT * FROM n{r}_h" for r in range(REFITS + 1)) + ")")
def refit_history(spark, d):
    """Fits of both metrics of every part of the day, again without the most influential event while one is over the threshold."""
    v = _long(spark, d, firsts=True).select(*KEYS, "window_id", "chunk_idx", F.col("y").alias("value"))
    return _r(refit.refit(v, KEYS, 2, 8, REFIT_DRAWS, REFITS, REFIT_OVER, SEED, alike(spark, d)), "elpd", n=3)


# --- priors


def _evidence_sql(kind: str) -> str:
    at = "0.5 * (ln(var / n) - ln(var / n + {g})) - mean * mean / (2 * (var / n + {g}))"
    if kind == "none":
        return at.format(g="1.0")
    nodes = ", ".join(f"{{'g': {g!r}::DOUBLE, 'w': {w!r}::DOUBLE}}" for g, w in refit.NODES[kind])
    terms = f"list_transform([{nodes}], lambda x: {at.format(g='x.g * n')} + ln(x.w))"
    return f"list_transform([{terms}], lambda v: list_max(v) + ln(list_sum(list_transform(v, lambda t: exp(t - list_max(v))))))[1]"


_NORMAL_BASE = "-n / 2 * ln(2 * pi() * var) - (q - n * mean * mean) / (2 * var)"
G_SQL = {
    "gp": "SELECT grp, metric, tau, g_prior, sum(ll) AS ll FROM (SELECT grp, metric, tau, unnest([" + ", ".join(repr(k) for k in refit.G_PRIORS) + "]) AS g_prior, unnest([" + ", ".join(f"{_NORMAL_BASE} + {_evidence_sql(k)}" for k in refit.G_PRIORS) + "]) AS ll FROM mo) GROUP BY ALL",
    "gq": "SELECT *, exp(ll - top) / sum(exp(ll - top)) OVER (PARTITION BY grp, metric, g_prior) AS p FROM (SELECT *, max(ll) OVER (PARTITION BY grp, metric, g_prior) AS top FROM gp)",
}


@query("g_prior_posteriors", with_profiles(s=PM1_SQL, p=PERIOD_SQL, fl=LONG_SQL, **score_sql("fl", "grp, metric", ["normal"]), **G_SQL) + "SELECT grp, metric, g_prior, tau, round(ll, 4) AS ll, round(p, 6) AS p FROM gq")
def g_prior_posteriors(spark, d):
    """tau under normal regimes whose means have a prior of fixed, unit-information, Zellner-Siow and hyper-g/n scale."""
    sums = search.regime_sums(_long(spark, d), KEYS, 2, 8)
    return _r(_r(refit.g_prior_posteriors(sums, KEYS), "p"), "ll", n=4).select(*KEYS, "g_prior", "tau", "ll", "p")


PRIORS = {
    "normal": {"mu": 0.0, "sigma": 2.0}, "halfnormal": {"sigma": 1.0}, "halfstudentt": {"nu": 4.0, "sigma": 1.0}, "exponential": {"lam": 1.0}, "exponential_plus": {"lam": 0.05, "offset": 0.3},
    "lognormal": {"mu": 0.0, "sigma": 1.0}, "beta": {"alpha": 2.0, "beta": 5.0}, "gamma": {"alpha": 2.0, "beta": 3.0}, "gamma_offset": {"mu": 3.0, "sigma": 1.5, "offset": 0.2}, "truncated_gamma": {"mu": 3.0, "sigma": 1.5, "lower": 0.3},
}


def _prior_sql(dist: str, x: str) -> str:
    p = PRIORS[dist]
    normal = lambda v, m, s: f"-0.5 * ln(2 * pi()) - ln({s}::DOUBLE) - ({v} - {m}) ** 2 / (2 * {s} * {s})"

    def gamma(v: str) -> str:
        a, b = (p["alpha"], p["beta"]) if "alpha" in p else (p["mu"] ** 2 / p["sigma"] ** 2, p["mu"] / p["sigma"] ** 2)
        return f"{a!r} * ln({b!r}::DOUBLE) - lgamma({a!r}::DOUBLE) + ({a!r} - 1) * ln({v}) - {b!r} * {v}"

    if dist == "normal":
        return normal(x, p["mu"], p["sigma"])
    if dist == "halfnormal":
        return f"CASE WHEN {x} >= 0 THEN ln(2::DOUBLE) + {normal(x, 0.0, p['sigma'])} END"
    if dist == "halfstudentt":
        return f"CASE WHEN {x} >= 0 THEN ln(2::DOUBLE) + lgamma(2.5::DOUBLE) - lgamma(2.0::DOUBLE) - 0.5 * ln(4 * pi()) - 2.5 * ln(1 + {x} ** 2 / 4) END"
    if dist.startswith("exponential"):
        low = p.get("offset", 0.0)
        return f"CASE WHEN {x} >= {low} THEN ln({p['lam']}::DOUBLE) - {p['lam']} * ({x} - {low}) END"
    if dist == "lognormal":
        return f"CASE WHEN {x} > 0 THEN {normal(f'ln({x})', p['mu'], p['sigma'])} - ln({x}) END"
    if dist == "beta":
        return f"CASE WHEN {x} > 0 AND {x} < 1 THEN lgamma(7::DOUBLE) - lgamma(2::DOUBLE) - lgamma(5::DOUBLE) + ln({x}) + 4 * ln(1 - {x}) END"
    if dist == "gamma":
        return f"CASE WHEN {x} > 0 THEN {gamma(x)} END"
    if dist == "gamma_offset":
        return f"CASE WHEN {x} > {p['offset']} THEN {gamma('(' + x + ' - ' + str(p['offset']) + ')')} END"
    # shape 4 has a closed form of what lies over the lower end
    y = p["lower"] * p["mu"] / p["sigma"] ** 2
    return f"CASE WHEN {x} >= {p['lower']} THEN {gamma(x)} - ln(exp(-{y!r}) * (1 + {y!r} + {y!r} ** 2 / 2 + {y!r} ** 3 / 6)) END"


@query("prior_densities", with_profiles(s=PM1_SQL, p=PERIOD_SQL, fl=LONG_SQL, **score_sql("fl", "grp, metric", ["normal"])) + f"SELECT grp, metric, tau, regime, dist, round(ll, 5) AS ll FROM (SELECT grp, metric, tau, r AS regime, unnest({_kinds_sql(list(PRIORS))}) AS dist, unnest([" + ", ".join(_prior_sql(k, "sqrt(var)") for k in PRIORS) + "]) AS ll FROM mo)")
def prior_densities(spark, d):
    """Every family of priors at each regime's fitted deviation; null outside the support."""
    sums = search.regime_sums(_long(spark, d), KEYS, 2, 8).where("n > 0")
    mean = F.col("s") / F.col("n")
    at = sums.select(*KEYS, "tau", "regime", F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(1e-6))).alias("sd"))
    stack = F.explode(F.array(*[F.struct(F.lit(k).alias("dist"), F.round(density.prior(F.col("sd"), k, **p), 5).alias("ll")) for k, p in PRIORS.items()]))
    return at.select(*KEYS, "tau", "regime", stack.alias("_")).select(*KEYS, "tau", "regime", "_.*")


# --- effective sample sizes


ESS_SQL = """, hc AS (SELECT *, floor(min(nc) OVER (PARTITION BY config_id) / 2)::BIGINT AS n FROM (SELECT *, count(*) OVER (PARTITION BY config_id, chain) AS nc FROM draws)),
    hh AS (SELECT config_id, 2 * chain + CASE WHEN draw < n THEN 0 ELSE 1 END AS half, CASE WHEN draw < n THEN draw ELSE draw - nc + n END AS pos, n, value FROM hc WHERE draw < n OR draw >= nc - n),
    hr AS (SELECT *, (rank() OVER (PARTITION BY config_id ORDER BY value) + (count(*) OVER (PARTITION BY config_id, value) - 1) / 2.0 - 0.375) / (count(*) OVER (PARTITION BY config_id) + 0.25) AS z FROM hh),
    hq AS (SELECT config_id, quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95 FROM hh GROUP BY 1),
    sr AS (SELECT config_id, half, pos, n, unnest(['bulk', 'low', 'high']) AS kind, unnest([{z}, (value <= q5)::INT::DOUBLE, (value <= q95)::INT::DOUBLE]) AS x FROM hr JOIN hq USING (config_id) WHERE n >= 4),
    sm AS (SELECT *, x - avg(x) OVER (PARTITION BY config_id, kind, half) AS e FROM sr),
    bw AS (SELECT config_id, kind, coalesce(var_samp(m), 0) AS b, count(*) AS halves, max(n) AS n FROM (SELECT config_id, kind, half, avg(x) AS m, max(n) AS n FROM sr GROUP BY ALL) GROUP BY 1, 2),
    ls AS (SELECT config_id, kind, half, n, list(e ORDER BY pos) AS v FROM sm GROUP BY ALL),
    cv AS (SELECT config_id, kind, n, lag, avg(c) AS c FROM (SELECT config_id, kind, n, half, lag, list_sum(list_transform(range(1, n - lag + 1), lambda i: v[i] * v[i + lag])) / n AS c FROM (SELECT *, unnest(range(n)) AS lag FROM ls)) GROUP BY ALL),
    rh AS (SELECT c.config_id, c.kind, c.n, halves, c.lag, CASE WHEN c.lag = 0 THEN 1.0 ELSE 1 - (z.c * c.n / (c.n - 1) - c.c) / (z.c + b) END AS rho FROM cv c JOIN cv z ON z.config_id = c.config_id AND z.kind = c.kind AND z.lag = 0 JOIN bw ON bw.config_id = c.config_id AND bw.kind = c.kind WHERE z.c > 1e-12),
    pr AS (SELECT config_id, kind, n, halves, lag // 2 AS k, sum(rho) AS p FROM rh GROUP BY ALL HAVING count(*) = 2),
    st AS (SELECT config_id, kind, min(k) FILTER (WHERE round(p, 9) < 0) AS stop FROM pr GROUP BY ALL),
    ta AS (SELECT config_id, kind, n, halves, 2 * sum(p) - 1 AS tau FROM (SELECT pr.* EXCLUDE (p), min(p) OVER (PARTITION BY config_id, kind ORDER BY k) AS p FROM pr JOIN st USING (config_id, kind) WHERE stop IS NULL OR k < stop) GROUP BY ALL),
    es AS (SELECT config_id, kind, halves * n AS n, least(halves * n / greatest(tau, 1e-9), halves * n * log10(halves * n)) AS ess FROM ta)
    SELECT config_id, max(n) AS n, round(min(ess) FILTER (WHERE kind = 'bulk'), 4) AS ess_bulk, round(min(ess) FILTER (WHERE kind <> 'bulk'), 4) AS ess_tail FROM (SELECT DISTINCT config_id FROM draws) LEFT JOIN es USING (config_id) GROUP BY 1""".replace("{z}", normal_quantile_sql("z"))


@query("ess", ctes("draws") + ESS_SQL)
def ess(spark, d):
    return _r(posterior.ess(view(spark, d, "draws")), "ess_bulk", "ess_tail", n=4)
