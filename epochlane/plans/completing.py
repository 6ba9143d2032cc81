"""Targets, stop rules, resolved configurations, exclusions and report tables (sections 2.2 and 2.9 to 2.13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlane.functions.dates import event_key
from epochlane.operators import clean, configs, export, ranking
from epochlane.plans.base import rows, window_days, with_profiles
from epochlane.plans.profiling import _mask, masked
from epochlane.plans.registry import query
from epochlane.plans.searching import HIST, _r
from epochlane.session import materialise
from epochlane.sources.adapt import ctes, view
from epochlane.sources.tables import table

# --- the target of a search over models

PARTS_SQL = """SELECT config_id, status = 'ok' AND config_id NOT LIKE '%7' AS ic_computed, elpd_loo AS elpd, pareto_k_max AS p_tau, tau_hdi_width / 5 AS map_prob, overlap AS conc, r_hat_max, ess_min_bulk AS ess_bulk, ess_min_bulk * 0.6E0 AS ess_tail,
    tau_hdi_width / 4 AS bfmi, n_divergences, n_features AS n_blocks, n_events AS n_observations FROM {0}"""
_LOG = "ln(greatest(coalesce({0}, 0), 1e-12))"
_W, _V = ranking.TARGET, ranking.TARGET_LEGACY
TARGET_SQL = f"""SELECT *, CASE WHEN n_divergences > 0 THEN NULL WHEN ic_computed THEN elpd + {_W['p_tau']} * {_LOG.format('p_tau')} + {_W['map']} * {_LOG.format('map_prob')} + {_W['conc']} * conc - {_W['complexity']} * greatest(n_blocks - 1, 0)
        - CASE WHEN r_hat_max > {_W['r_hat_gate']} THEN {_W['r_hat']} * (r_hat_max - {_W['r_hat_gate']}) ELSE 0 END - {_W['ess']} * greatest(0, {_W['ess_least']} - least(ess_bulk, ess_tail)) - CASE WHEN bfmi < {_W['bfmi_least']} THEN {_W['bfmi']} * ({_W['bfmi_least']} - bfmi) ELSE 0 END
    ELSE {_V['p_tau']} * {_LOG.format('p_tau')} + {_V['map']} * {_LOG.format('map_prob')} + {_V['conc']} * conc + {_V['ess']} * ln(greatest(ess_bulk, 1)) - {_V['complexity']} * greatest(n_blocks - 1, 0)
        - CASE WHEN r_hat_max > {_V['r_hat_gate']} THEN {_V['r_hat']} * (r_hat_max - {_V['r_hat_gate']}) ELSE 0 END - CASE WHEN ess_bulk < {_V['ess_least']} THEN {_V['ess_penalty']} ELSE 0 END END AS target FROM parts"""
PRIOR_SQL = "unnest(['uniform', 'inverse', 'bic', 'lambda']) AS prior, unnest([0.0::DOUBLE, -ln(greatest(n_blocks, 1)), -0.5 * greatest(n_blocks, 1) * ln(greatest(n_observations, 1)), -0.69 * greatest(n_blocks, 1)]) AS log_prior"


@query("model_target", ctes("search_result", parts=PARTS_SQL.format("search_result"), t=TARGET_SQL) + f"SELECT config_id, prior, round(target, 5) AS target, round(log_prior, 5) AS log_prior, round(target + log_prior, 5) AS log_posterior FROM (SELECT *, {PRIOR_SQL} FROM t)")
def model_target(spark, d):
    """Each model's log-target, with gates or in its older form, and with each kind of model prior."""
    parts = spark.sql(PARTS_SQL.format("{s}"), s=view(spark, d, "search_result"))
    return _r(ranking.with_priors(parts).select("config_id", "prior", "target", "log_prior", "log_posterior"), "target", "log_prior", "log_posterior", n=5)


@query("stop_reasons", f"""WITH h AS ({HIST}), a AS (SELECT *, row_number() OVER w AS i, (row_number() OVER (PARTITION BY chain, config_id ORDER BY o_orderkey) = 1)::INT AS new, score > coalesce(max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) + 1e-12 AS rise,
        list(score) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS v FROM h WINDOW w AS (PARTITION BY chain ORDER BY o_orderkey)),
    b AS (SELECT *, i - coalesce(last_value(CASE WHEN rise THEN i END IGNORE NULLS) OVER (PARTITION BY chain ORDER BY o_orderkey), 0) AS since, avg(new) OVER (PARTITION BY chain ORDER BY o_orderkey ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS share,
        list_sum(v[1 : len(v) // 2]) / nullif(len(v) // 2, 0) AS old_mean, list_sum(v[len(v) // 2 + 1 :]) / (len(v) - len(v) // 2) AS new_mean FROM a)
    SELECT chain, o_orderkey, round(old_mean, 9) AS old_mean, round(new_mean, 9) AS new_mean, CASE WHEN i = 1 THEN NULL WHEN since >= 30 THEN 'no_improvement' WHEN len(v) >= 4 AND round(abs(new_mean - old_mean), 9) <= 0.1 THEN 'stabilized' WHEN round(share, 9) < 0.1 THEN 'saturated' END AS reason FROM b""")
def stop_reasons(spark, d):
    """Where every chain of a search would stop, and why."""
    o = table(spark, d, "orders")
    h = o.select((F.col("o_custkey") % 20).alias("chain"), "o_orderkey", F.concat(F.lit("C"), F.col("o_custkey") % 300).alias("config_id"), (F.col("o_totalprice") / 1000).alias("score"))
    return _r(ranking.stop_reasons(h, "chain", ["o_orderkey"]), "old_mean", "new_mean", n=9)


# --- configurations

RANGE_LIK = "CASE WHEN range_part <> '' THEN replace(range_part, 'range=', '') END"
RESOLVED_VALUES = ", ".join(f"('{m}', '{k}', '{mu}', '{ms}', '{s}', {allowed!r})" for m, (k, mu, ms, s, allowed) in configs.DEFAULTS.items())


@query("config_resolved", ctes("config", df=f"SELECT * FROM (VALUES {RESOLVED_VALUES}) v(metric, likelihood, mu, mu_sigma, sigma, allowed)", it=f"""SELECT config_id, 'mean' AS metric, replace(mean_part, 'mean=', '') AS lik, NULL AS sg FROM config UNION ALL SELECT config_id, 'range', {RANGE_LIK}, CASE WHEN overlap = 0 THEN '0.25' END FROM config
    UNION ALL SELECT config_id, 'shape_shift', CASE WHEN n_points = 12 THEN 'beta' END, NULL FROM config UNION ALL SELECT config_id, 'unheard_of', 'normal', NULL FROM config WHERE n_points = 48""") +
    "SELECT config_id, it.metric, coalesce(lik, likelihood) AS likelihood, mu, mu_sigma, coalesce(sg, sigma) AS sigma, CASE WHEN df.metric IS NOT NULL THEN 'zellner_siow' END AS g_prior, coalesce(list_contains(allowed, coalesce(lik, likelihood)), false) AS valid FROM it LEFT JOIN df ON df.metric = it.metric")
def config_resolved(spark, d):
    """What each configuration says of its metrics laid over the defaults, one g-prior for all, and whether the likelihood is allowed."""
    c = view(spark, d, "config")
    text = lambda v: v.cast("string")
    none = F.lit(None).cast("string")
    lik = lambda part, name: F.when(F.col(part) != "", F.replace(F.col(part), F.lit(f"{name}="), F.lit("")))
    said = [("mean", lik("mean_part", "mean"), none, F.lit(True)), ("range", lik("range_part", "range"), F.when(F.col("overlap") == 0, text(F.lit("0.25"))), F.lit(True)), ("shape_shift", F.when(F.col("n_points") == 12, text(F.lit("beta"))), none, F.lit(True)), ("unheard_of", text(F.lit("normal")), none, F.col("n_points") == 48)]
    each = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(m).alias("metric"), F.create_map(F.lit("likelihood"), k, F.lit("sigma"), s).alias("override"))) for m, k, s, on in said]))
    items = c.select("config_id", F.explode(each).alias("_")).select("config_id", "_.*")
    return configs.resolved(items, "zellner_siow").select("config_id", "metric", *configs.SETTINGS, "valid")


@query("shared_chunks", ctes("config", f="""SELECT config_id, metric, unnest(range(CASE WHEN metric = 'shape_shift' THEN 7 WHEN block LIKE 'night%' AND metric = 'range' AND overlap = 0.5 THEN 16 ELSE 8 END)) AS c FROM (
        SELECT *, unnest(CASE WHEN n_points = 12 THEN ['shape_shift'] WHEN range_part = '' THEN ['mean', 'shape_shift'] ELSE ['mean', 'range', 'shape_shift'] END) AS metric FROM config)""", w="SELECT config_id, metric, count(DISTINCT c) AS w FROM f GROUP BY ALL") +
    "SELECT config_id, coalesce(max(w) FILTER (WHERE metric <> 'shape_shift'), max(w)) AS n_chunks, coalesce(max(w) FILTER (WHERE metric <> 'shape_shift') = min(w) FILTER (WHERE metric <> 'shape_shift'), max(w) = min(w)) AS valid FROM w GROUP BY 1")
def shared_chunks(spark, d):
    """The number of chunks that all metrics of a configuration share; the shape shift alone decides only by itself."""
    metrics = F.when(F.col("n_points") == 12, F.array(F.lit("shape_shift"))).when(F.col("range_part") == "", F.array(F.lit("mean"), F.lit("shape_shift"))).otherwise(F.array(F.lit("mean"), F.lit("range"), F.lit("shape_shift")))
    c = view(spark, d, "config").withColumn("metric", F.explode(metrics))
    n = F.when(F.col("metric") == "shape_shift", 7).when(F.col("block").startswith("night") & (F.col("metric") == "range") & (F.col("overlap") == 0.5), 16).otherwise(8)
    return configs.shared_chunks(c.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1))), ["config_id"])


@query("grid_variants", ctes("config") + """SELECT config_id, v.*, p.* FROM config, (VALUES ('constrained', 'range', 'beta_constrained', 8), ('constrained', 'range', 'normal', 8), ('shift', 'shape_shift', 'lognormal', 7), ('shift', 'shape_shift', 'gamma', 7), ('half_day', 'mean', 'student_t', 16), ('half_day', 'range', 'beta_constrained', 16)) v(variant, metric, likelihood, n_chunks),
    (VALUES (12, 0.0::DOUBLE), (24, 0.5::DOUBLE)) p(n_points, overlap)""")
def grid_variants(spark, d):
    return configs.variants(view(spark, d, "config").select("config_id"), [(12, 0.0), (24, 0.5)])


# --- samples


@query("exported_metadata", with_profiles("hypno_local", m="SELECT window_id, count(*) FILTER (WHERE l.day IS NULL) AS n_missing, count(*) AS n_days FROM window_day w LEFT JOIN (SELECT DISTINCT subject_id, day FROM hypno_local) l ON w.subject_id = l.subject_id AND w.day = l.day GROUP BY 1") +
    "SELECT window_id, n_days, row_number() OVER (ORDER BY window_id) - 1 AS row_index FROM m WHERE n_missing = 0")
def exported_metadata(spark, d):
    """The exported windows' places in the matrix, whose number of rows is checked."""
    from epochlane.operators import catalog

    w, local = window_days(spark, d), view(spark, d, "hypno_local")
    meta = materialise(export.metadata(w, local))
    matrix = catalog.complete_windows(w, local).select("window_id").distinct()
    return export.exported_rows(meta, matrix).select("window_id", "n_days", "row_index")


@query("exclude_samples", masked(bad="SELECT window_id FROM mask GROUP BY 1 HAVING count(*) FILTER (WHERE NOT valid) >= 3") + "SELECT window_id, pos, round(value, 6) AS value FROM r WHERE window_id NOT IN (SELECT window_id FROM bad)")
def exclude_samples(spark, d):
    """Profiles without a list of samples: here those with three masked days or more."""
    bad = _mask(spark, d).groupBy("window_id").agg(F.count_if(~F.col("valid")).alias("n")).where("n >= 3")
    at = clean.exclude(rows(spark, d).select("window_id", "pos", "value"), materialise(bad.select("window_id")))
    return _r(at, "value")


@query("event_keys", ctes("trigger", "artifact_day", e="SELECT trigger_id, subject_id, substr(replace(trim('  ' || replace(event_date::VARCHAR, '-', CASE WHEN trigger_id % 2 = 0 THEN '_' ELSE '-' END) || ' 10:30 '), '_', '-'), 1, 10) AS key FROM trigger") +
    "SELECT trigger_id, e.subject_id, key, a.day IS NOT NULL AS masked FROM e LEFT JOIN artifact_day a ON a.subject_id = e.subject_id AND a.day::VARCHAR = key")
def event_keys(spark, d):
    """Events named by text of different forms, found in the table of masked days by their normalised key."""
    t = view(spark, d, "trigger")
    day = F.col("event_date").cast("string")
    text = F.concat(F.lit("  "), F.when(F.col("trigger_id") % 2 == 0, F.translate(day, "-", "_")).otherwise(day), F.lit(" 10:30 "))
    marks = view(spark, d, "artifact_day").select("subject_id", F.col("day").cast("string").alias("key"), F.lit(True).alias("masked"))
    at = t.select("trigger_id", "subject_id", event_key(text).alias("key")).join(marks, ["subject_id", "key"], "left")
    return at.select("trigger_id", "subject_id", "key", F.coalesce("masked", F.lit(False)).alias("masked"))


# --- report tables

REPORTED = ["family", "feature_kind", "n_points", "overlap"]


@query("best_params", ctes("search_result", b="SELECT * FROM search_result WHERE elpd_loo IS NOT NULL ORDER BY elpd_loo DESC, family, feature_kind, n_points, overlap LIMIT 1") + "SELECT unnest(['family', 'feature_kind', 'n_points', 'overlap']) AS param, unnest([family, feature_kind, n_points::VARCHAR, overlap::VARCHAR]) AS value, elpd_loo AS score FROM b")
def best_params(spark, d):
    return ranking.best_params(view(spark, d, "search_result"), REPORTED, "elpd_loo")


@query("param_grid", ctes("search_result") + " UNION ALL ".join(f"SELECT '{c}' AS param, count(DISTINCT {c}) AS n_values, string_agg(DISTINCT {c}::VARCHAR, ',' ORDER BY {c}::VARCHAR) AS values FROM search_result" for c in REPORTED).replace(" AS values", ' AS "values"'))
def param_grid(spark, d):
    return ranking.param_grid(view(spark, d, "search_result"), REPORTED)


@query("samples_head", with_profiles() + "SELECT window_id, pos, value FROM (SELECT window_id, pos, round(value, 6) AS value, dense_rank() OVER (ORDER BY window_id) AS k FROM r) WHERE k <= 5")
def samples_head(spark, d):
    """The first five samples: a report's look at the matrix."""
    first = export.sample_head(window_days(spark, d).select("window_id").distinct(), ["window_id"], 5)
    return _r(rows(spark, d).join(F.broadcast(first), "window_id").select("window_id", "pos", "value"), "value")
