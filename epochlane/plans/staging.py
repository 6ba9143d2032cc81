"""Signal to stages (section 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochlane.operators import stages
from epochlane.plans.registry import query
from epochlane.sources.adapt import ctes, view

LEN = 8
E_SQL = f"""SELECT subject_id, day, channel, floor(sample_idx / {LEN})::INT AS epoch_idx, list(sample ORDER BY sample_idx) AS samples, max(sample * sample) AS metric FROM signal_raw GROUP BY 1, 2, 3, 4 HAVING count(*) = {LEN}"""
K = "subject_id, day, channel"
MAD_SQL = f"""SELECT {K}, first(mid) + 7.0 * 1.4826 * quantile_cont(abs(metric - mid), 0.5) AS threshold FROM (SELECT *, quantile_cont(metric, 0.5) OVER (PARTITION BY {K}) AS mid FROM e) x GROUP BY {K}"""
OTSU_SQL = f"""SELECT {K}, arg_max(mid, (round(coalesce(n1 * n2 * (s1 / n1 - s2 / n2) * (s1 / n1 - s2 / n2), -1), 6), -bin)) AS threshold FROM (
    SELECT *, sum(n) OVER u AS n1, sum(n * mid) OVER u AS s1, sum(n) OVER d AS n2, sum(n * mid) OVER d AS s2 FROM (
        SELECT {K}, bin, count(*)::DOUBLE AS n, min(lo) + (bin + 0.5) * (max(hi) - min(lo)) / 256 AS mid FROM (
            SELECT {K}, lo, hi, CASE WHEN hi > lo THEN least(floor((metric - lo) / (hi - lo) * 256), 255) ELSE 0 END AS bin FROM (
                SELECT {K}, metric, min(metric) OVER (PARTITION BY {K}) AS lo, max(metric) OVER (PARTITION BY {K}) AS hi FROM e) a) b GROUP BY {K}, bin) c
    WINDOW u AS (PARTITION BY {K} ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY {K} ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) y GROUP BY {K}"""


def with_e(**more: str) -> str:
    return ctes("signal_raw", e=E_SQL, **more)


def _eps(spark, d):
    return stages.epochs(view(spark, d, "signal_raw"), LEN)


def _metric(spark, d):
    return stages.artifact_metric(_eps(spark, d))


@query("epochs", with_e() + f"SELECT {K}, epoch_idx, i AS k, samples[i + 1] AS sample FROM e, (SELECT unnest(range({LEN}))::INT AS i)")
def epochs(spark, d):
    return _eps(spark, d).select("subject_id", "day", "channel", "epoch_idx", F.posexplode("samples").alias("k", "sample"))


@query("artifact_metric", with_e() + f"SELECT {K}, epoch_idx, round(metric, 6) AS metric FROM e")
def artifact_metric(spark, d):
    return _metric(spark, d).withColumn("metric", F.round("metric", 6))


@query("thr_mad", with_e(t=MAD_SQL) + f"SELECT {K}, round(threshold, 6) AS threshold FROM t")
def thr_mad(spark, d):
    return stages.threshold_mad(_metric(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query("thr_quantile", with_e() + f"SELECT {K}, round(quantile_cont(metric, 0.995), 8) AS threshold FROM e GROUP BY {K}")
def thr_quantile(spark, d):
    return stages.threshold_quantile(_metric(spark, d)).withColumn("threshold", F.round("threshold", 8))


@query("thr_otsu", with_e(t=OTSU_SQL) + f"SELECT {K}, round(threshold, 4) AS threshold FROM t")
def thr_otsu(spark, d):
    return stages.threshold_otsu(_metric(spark, d)).withColumn("threshold", F.round("threshold", 4))


ENVELOPE_SQL = {
    "xm": f"SELECT *, metric - mid AS x, abs(metric - mid) AS far FROM (SELECT {K}, epoch_idx, metric, quantile_cont(metric, 0.5) OVER w AS mid, count(*) OVER w AS n, min(metric) OVER w AS lo, max(metric) OVER w AS hi FROM e WINDOW w AS (PARTITION BY {K})) a",
    "cm": f"""SELECT {K}, arg_max(lo + (bin + 0.5) * (hi - lo) / 200, (m, -bin)) AS centre FROM (
        SELECT {K}, lo, hi, CASE WHEN hi > lo THEN least(floor((metric - lo) / (hi - lo) * 200), 199) ELSE 0 END AS bin, count(*) AS m FROM xm GROUP BY ALL) a WHERE bin < 150 GROUP BY {K}""",
    "rm": f"""SELECT {K}, n, count(*) OVER w AS k, sum(x) OVER w AS p1, sum(x ** 2) OVER w AS p2, sum(x ** 3) OVER w AS p3, sum(x ** 4) OVER w AS p4,
        (max(metric) OVER w + min(metric) OVER (PARTITION BY {K} ORDER BY far, metric, epoch_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) / 2 AS cut FROM xm WINDOW w AS (PARTITION BY {K} ORDER BY far, metric, epoch_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "lm": f"""SELECT *, coalesce(min(cut) OVER (PARTITION BY {K} ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > centre, true) AS on_, CASE WHEN m2 > 1e-9 THEN round(abs(m4 / (m2 * m2) - 3), 6) END AS kurt FROM (
        SELECT {K}, c, cut, centre, p2 / k - (p1 / k) ** 2 AS m2, p4 / k - 4 * p1 / k * p3 / k + 6 * (p1 / k) ** 2 * p2 / k - 3 * (p1 / k) ** 4 AS m4 FROM rm JOIN cm USING ({K}), (SELECT unnest(range(1, 50)) AS c) WHERE k = n - ceil((n - 1) * c / 100.0)) a""",
}


@query("thr_envelope", with_e(**ENVELOPE_SQL) + f"SELECT {K}, round(coalesce(arg_min(cut, (kurt, c)) FILTER (WHERE on_ AND kurt IS NOT NULL AND cut IS NOT NULL), first(hi)), 6) AS threshold FROM (SELECT DISTINCT {K}, hi FROM xm) h LEFT JOIN lm USING ({K}) GROUP BY {K}")
def thr_envelope(spark, d):
    return stages.threshold_envelope(_metric(spark, d)).withColumn("threshold", F.round("threshold", 6))


@query("thr_gmm")
def thr_gmm(spark, d):
    return stages.threshold_mixture(_metric(spark, d))


@query("thr_select", with_e(o=OTSU_SQL, m=MAD_SQL, x=f"SELECT {K}, count(*) AS n FROM e GROUP BY {K}") + f"SELECT {K}, round(CASE WHEN x.n >= 8 THEN o.threshold ELSE m.threshold END, 4) AS threshold FROM o JOIN m USING ({K}) JOIN x USING ({K})")
def thr_select(spark, d):
    """Otsu's threshold on every channel with at least eight epochs, else the deviation's."""
    m = _metric(spark, d)
    enough = m.groupBy(*stages.CHANNEL).agg(F.count("*").alias("n"))
    first = stages.threshold_otsu(m).join(enough, stages.CHANNEL).withColumn("threshold", F.when(F.col("n") >= 8, F.col("threshold"))).drop("n")
    return stages.select_threshold(first, stages.threshold_mad(m)).withColumn("threshold", F.round("threshold", 4))


@query("artifact_mask", with_e(m=MAD_SQL, x="SELECT e.subject_id, e.day, epoch_idx, channel, metric > threshold AS o FROM e JOIN m USING (subject_id, day, channel)") +
    "SELECT subject_id, day, epoch_idx, bool_or(o) AS any_channel, coalesce(bool_and(o) FILTER (WHERE channel < 2), false) AS all_first2 FROM x GROUP BY 1, 2, 3")
def artifact_mask(spark, d):
    m = _metric(spark, d)
    t = stages.threshold_mad(m)
    a = stages.artifact_mask(m, t).withColumnRenamed("artifact", "any_channel")
    return a.join(stages.artifact_mask(m, t, "all_first2").withColumnRenamed("artifact", "all_first2"), ["subject_id", "day", "epoch_idx"])


@query("band_power", with_e() + f"""SELECT {K}, epoch_idx, round(sum(sqrt(re * re + im * im)) / 1e6, 6) AS power FROM (
    SELECT {K}, epoch_idx, f, sum(samples[i + 1] * cos(2 * pi() * f * i / {LEN})) AS re, sum(samples[i + 1] * sin(2 * pi() * f * i / {LEN})) AS im
    FROM e, (SELECT unnest(range({LEN}))::INT AS i), (SELECT unnest([1, 2]) AS f) GROUP BY ALL) x GROUP BY {K}, epoch_idx""")
def band_power(spark, d):
    return stages.band_power(_eps(spark, d), 1.0, 3.0, float(LEN)).select("subject_id", "day", "channel", "epoch_idx", F.round("power", 6).alias("power"))


_W = "PARTITION BY subject_id, day, channel ORDER BY epoch_idx"


@query("smooth5", with_e() + f"SELECT {K}, epoch_idx, round(sum(metric) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 4) AS metric FROM e")
def smooth5(spark, d):
    return stages.smooth5(_metric(spark, d), "metric").withColumn("metric", F.round("metric", 4))


@query("baseline_remove", with_e(x=f"SELECT *, CASE WHEN lead(epoch_idx) OVER ({_W}) IS NOT NULL THEN metric END AS i FROM e") + f"SELECT {K}, epoch_idx, round(metric - coalesce(min(i) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING), metric), 4) AS metric FROM x")
def baseline_remove(spark, d):
    return stages.baseline_remove(_metric(spark, d), "metric", 4).withColumn("metric", F.round("metric", 4))


@query("stage_rule", with_e() + "SELECT subject_id, day, epoch_idx, CASE WHEN 2 * count(*) FILTER (WHERE samples[1] > 60) > count(*) THEN 2 WHEN 2 * count(*) FILTER (WHERE metric > 6000) > count(*) THEN 1 ELSE 0 END AS stage FROM e GROUP BY 1, 2, 3")
def stage_rule(spark, d):
    eps = _eps(spark, d)
    power = eps.join(stages.artifact_metric(eps), ["subject_id", "day", "channel", "epoch_idx"]).selectExpr("subject_id", "day", "epoch_idx", "metric AS delta", "samples[0] AS ratio")
    return stages.stage_rule(power, F.lit(6000.0), F.lit(60.0))


_H = "PARTITION BY subject_id, day ORDER BY epoch_idx"


@query("stage_ffill", ctes("hypno") + f"""SELECT subject_id, day, epoch_idx, coalesce(last_value(CASE WHEN epoch_idx % 5 > 1 THEN stage END IGNORE NULLS) OVER ({_H} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS stage FROM hypno""")
def stage_ffill(spark, d):
    return stages.stage_fill(view(spark, d, "hypno").withColumn("artifact", F.col("epoch_idx") % 5 < 2)).drop("artifact")


def _single(src: str, v: int) -> str:
    return f"SELECT subject_id, day, epoch_idx, CASE WHEN stage = {v} AND a = b AND a <> {v} THEN a ELSE stage END AS stage FROM (SELECT *, lag(stage) OVER ({_H}) AS a, lead(stage) OVER ({_H}) AS b FROM {src}) x"


def _between(src: str, a: int, b: int, c: int) -> str:
    return f"SELECT subject_id, day, epoch_idx, CASE WHEN stage = {a} AND a = {b} AND b = {c} THEN {b} ELSE stage END AS stage FROM (SELECT *, lag(stage) OVER ({_H}) AS a, lead(stage) OVER ({_H}) AS b FROM {src}) x"


def _wake(src: str, back: int) -> str:
    return f"""SELECT subject_id, day, epoch_idx, CASE WHEN stage = 2 AND bool_or(s AND w) OVER (PARTITION BY subject_id, day, run) THEN 0 ELSE stage END AS stage FROM (
        SELECT *, sum(s::INT) OVER ({_H} ROWS UNBOUNDED PRECEDING) + CASE WHEN stage = 2 THEN 0 ELSE -1000000 - epoch_idx END AS run FROM (
            SELECT *, stage = 2 AND coalesce(lag(stage) OVER ({_H}) <> 2, true) AS s, coalesce(sum((stage = 0)::INT) OVER ({_H} ROWS BETWEEN {back} PRECEDING AND 1 PRECEDING) = {back}, false) AS w FROM {src}) x) y"""


@query("no_singles", ctes("hypno") + _single("hypno", 1))
def no_singles(spark, d):
    return stages.no_single(view(spark, d, "hypno"), 1)


@query("no_single_between", ctes("hypno") + _between("hypno", 0, 1, 2))
def no_single_between(spark, d):
    return stages.no_single_between(view(spark, d, "hypno"), 0, 1, 2)


@query("no_rem_in_wake", ctes("hypno") + _wake("hypno", 2))
def no_rem_in_wake(spark, d):
    return stages.no_rem_in_wake(view(spark, d, "hypno"), 2)


@query("stage_clean", ctes("hypno", s1=_single("hypno", 0), s2=_single("s1", 1), s3=_wake("s2", 2), s4=_between("s3", 0, 1, 2)) + _between("s4", 1, 2, 2))
def stage_clean(spark, d):
    return stages.clean(view(spark, d, "hypno"))


@query("thr_delta")
def thr_delta(spark, d):
    return stages.delta_threshold(_metric(spark, d).withColumnRenamed("metric", "delta"))


@query("score_stages")
def score_stages(spark, d):
    """The whole job over all days, on the channels that their quality admits."""
    from epochlane.functions.dates import channel_decision

    quality = view(spark, d, "channel_quality")
    good = channel_decision(quality.select(*stages.CHANNEL), quality, [0, 1], 0.3).where("good")
    return stages.score(view(spark, d, "signal_raw"), LEN, float(LEN), (1.0, 3.0), (3.0, 4.0), channels=good)
