"""Sources, windows, joins and profiles (sections 2.1, 2.3, 2.4 and 2.5 of the survey)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from epochlane.operators import catalog, export, profiles, windows
from epochlane.plans.base import N_DAYS, N_POINTS, alike, profile, rows, window_days, window_profile, with_profiles
from epochlane.plans.registry import query
from epochlane.session import shared_dir
from epochlane.sources import signals
from epochlane.sources.adapt import ctes, view

r6 = lambda c: F.round(c, 6)


@query("scan_hypno", ctes("hypno") + "SELECT * FROM hypno")
def scan_hypno(spark, d):
    return view(spark, d, "hypno")


@query("source_fallback", ctes("hypno", "hypno_local") + """SELECT h.*, CASE WHEN l.day IS NULL THEN 'remote' ELSE 'local' END AS origin
    FROM hypno h LEFT JOIN (SELECT DISTINCT subject_id, day FROM hypno_local) l ON h.subject_id = l.subject_id AND h.day = l.day""")
def source_fallback(spark, d):
    return catalog.first_available([("local", view(spark, d, "hypno_local")), ("remote", view(spark, d, "hypno"))])


@query("catalog_days", ctes("hypno_local") + "SELECT subject_id, day, count(*) OVER (PARTITION BY subject_id) AS n_days FROM (SELECT DISTINCT subject_id, day FROM hypno_local) x")
def catalog_days(spark, d):
    listed = catalog.days(view(spark, d, "hypno_local")).groupBy("subject_id").agg(F.sort_array(F.collect_set("day")).alias("days"))
    return listed.select("subject_id", F.explode("days").alias("day"), F.size("days").cast("long").alias("n_days"))


@query("required_days", ctes("trigger") + "SELECT DISTINCT subject_id, CAST(event_date - i AS DATE) AS day FROM trigger, (SELECT unnest(range(1, 17))::INT AS i) x")
def required_days(spark, d):
    return catalog.required(windows.basic(view(spark, d, "trigger"), N_DAYS))


@query("missing_days", with_profiles("hypno_local") + """SELECT n.subject_id, n.day, l.day IS NOT NULL AS available FROM (SELECT DISTINCT subject_id, day FROM window_day) n
    LEFT JOIN (SELECT DISTINCT subject_id, day FROM hypno_local) l ON n.subject_id = l.subject_id AND n.day = l.day""")
def missing_days(spark, d):
    return catalog.availability(catalog.required(window_days(spark, d)), view(spark, d, "hypno_local"))


@query("day_lengths", with_profiles() + "SELECT w.window_id, w.day_idx, count(h.epoch_idx) AS n FROM window_day w LEFT JOIN hypno h ON w.subject_id = h.subject_id AND w.day = h.day GROUP BY 1, 2")
def day_lengths(spark, d):
    n = profiles.day_lengths(view(spark, d, "hypno"))
    return window_days(spark, d).join(n, ["subject_id", "day"], "left").select("window_id", "day_idx", F.coalesce("n", F.lit(0)).alias("n"))


@query("resume_configs", ctes("search_result") + "SELECT config_id, family FROM search_result s WHERE NOT EXISTS (SELECT 1 FROM search_result t WHERE t.config_id = s.config_id AND t.status = 'ok')")
def resume_configs(spark, d):
    s = view(spark, d, "search_result")
    return catalog.resume(s.select("config_id", "family"), s.where("status = 'ok'").select(F.col("config_id")), "config_id")


@query("windows_basic", ctes("trigger") + """SELECT trigger_id, subject_id, event_date, CASE WHEN l = 1 THEN 'immediate_before' ELSE 'control_before' END AS window_type, l AS label, i AS day_idx,
    CAST(event_date + CAST(CASE WHEN l = 1 THEN i - 8 ELSE i - 16 END AS INT) AS DATE) AS day FROM trigger, (SELECT unnest(range(8))::INT AS i), (SELECT unnest([0, 1])::INT AS l)""")
def windows_basic(spark, d):
    return windows.basic(view(spark, d, "trigger"), N_DAYS)


@query("windows_positioned", ctes("trigger") + """SELECT trigger_id, subject_id, event_date, window_type, label, i AS day_idx, CAST(event_date + CAST(s + i AS INT) AS DATE) AS day FROM trigger,
    (SELECT unnest(range(6))::INT AS i), (VALUES ('immediate_before', 1, -7), ('control_before', 0, -9)) v(window_type, label, s)""")
def windows_positioned(spark, d):
    return windows.positioned(view(spark, d, "trigger"), 6, -2, 2).where("label = 1").unionByName(windows.positioned(view(spark, d, "trigger"), 6, 3, mode="control"))


@query("windows_invalid", ctes("trigger") + """SELECT trigger_id, window_type, day_idx, day FROM (SELECT trigger_id, event_date, window_type, i AS day_idx, CAST(event_date + CAST(s + i AS INT) AS DATE) AS day FROM trigger,
    (SELECT unnest(range(6))::INT AS i), (VALUES ('immediate_before', -3), ('control_before', -4)) v(window_type, s)) x
    WHERE (window_type = 'immediate_before' AND day > event_date) OR (window_type = 'control_before' AND day >= event_date)""")
def windows_invalid(spark, d):
    return windows.invalid(windows.positioned(view(spark, d, "trigger"), 6, -2, -2, fixed_start=4)).select("trigger_id", "window_type", "day_idx", "day")


@query("windows_directional", with_profiles() + "SELECT * FROM window_day")
def windows_directional(spark, d):
    return window_days(spark, d)


@query("windows_sweep", ctes("trigger") + """SELECT trigger_id, position, i AS day_idx, CAST(event_date + CAST(-position - 2 + i AS INT) AS DATE) AS day
    FROM trigger, (SELECT unnest(range(3))::INT AS i), (SELECT unnest(range(-4, 5))::INT AS position)""")
def windows_sweep(spark, d):
    return windows.sweep(view(spark, d, "trigger"), 3, range(4, -5, -1)).select("trigger_id", "position", "day_idx", "day")


@query("stratum", ctes("trigger") + """SELECT 'before_only' AS stratum, trigger_id FROM trigger WHERE direction = 'before' UNION ALL SELECT 'full', trigger_id FROM trigger
    UNION ALL SELECT 'drop_date', trigger_id FROM trigger WHERE event_date <> DATE '2024-01-12'""")
def stratum(spark, d):
    t = view(spark, d, "trigger")
    parts = [windows.stratum(t, n, "2024-01-12").select(F.lit(n).alias("stratum"), "trigger_id") for n in ("before_only", "full", "drop_date")]
    return parts[0].union(parts[1]).union(parts[2])


@query("stratum_flags", ctes("trigger") + """, s AS (SELECT 'before_only' AS stratum, event_date FROM trigger WHERE direction = 'before' UNION ALL SELECT 'full', event_date FROM trigger UNION ALL SELECT 'drop_date', event_date FROM trigger WHERE event_date <> DATE '2024-01-12')
    SELECT stratum, count(*) AS n, bool_or(event_date = DATE '2024-01-12') AS has_date FROM s GROUP BY 1""")
def stratum_flags(spark, d):
    """Whether each stratum holds events of the date that one of them drops."""
    t = view(spark, d, "trigger")
    parts = [windows.stratum(t, n, "2024-01-12").select(F.lit(n).alias("stratum"), "event_date") for n in ("before_only", "full", "drop_date")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("stratum").agg(F.count("*").alias("n"), F.bool_or(F.col("event_date") == F.lit("2024-01-12").cast("date")).alias("has_date"))


@query("read_profile_matrix", with_profiles() + "SELECT dense_rank() OVER (ORDER BY window_id) - 1 AS window_id, pos, round(value, 6) AS value FROM r")
def read_profile_matrix(spark, d):
    """The profile matrix written as text, a line a window, and read again."""
    path = f"{shared_dir(spark).rstrip('/')}/matrix-{uuid.uuid4().hex}"
    wide = export.matrix(rows(spark, d).withColumn("value", r6("value")), N_DAYS * N_POINTS)
    wide.orderBy("window_id").drop("window_id").write.csv(path)
    return signals.read_matrix(spark, path, N_DAYS * N_POINTS).withColumn("value", r6("value"))


@query("join_profiles", with_profiles() + "SELECT window_id, day_idx, point_idx, round(pct, 6) AS pct FROM wp")
def join_profiles(spark, d):
    return window_profile(spark, d).withColumn("pct", r6("pct"))


@query("complete_windows", with_profiles("hypno_local") + """SELECT window_id, day_idx, day FROM window_day WHERE window_id NOT IN (
    SELECT w.window_id FROM window_day w LEFT JOIN (SELECT DISTINCT subject_id, day FROM hypno_local) l ON w.subject_id = l.subject_id AND w.day = l.day WHERE l.day IS NULL)""")
def complete_windows(spark, d):
    return catalog.complete_windows(window_days(spark, d), view(spark, d, "hypno_local")).select("window_id", "day_idx", "day")


@query("align_hypno", ctes("hypno") + """SELECT a.subject_id || '-' || n.other AS pair, a.day, a.epoch_idx - 2 AS epoch_idx, a.stage AS y_true, b.stage AS y_pred FROM hypno a
    JOIN (SELECT subject_id, coalesce(lead(subject_id) OVER (ORDER BY subject_id), min(subject_id) OVER ()) AS other FROM (SELECT DISTINCT subject_id FROM hypno)) n ON a.subject_id = n.subject_id
    JOIN hypno b ON a.day = b.day AND b.subject_id = n.other AND a.epoch_idx - 2 = b.epoch_idx - 1 WHERE a.epoch_idx >= 2""")
def align_hypno(spark, d):
    from epochlane.operators.agreement import with_next

    return with_next(view(spark, d, "hypno"), 2, 1)


@query("min_event_distance", ctes("hypno", "trigger") + """SELECT d.subject_id, d.day, coalesce(min(abs(date_diff('day', t.event_date, d.day))), 1000000000)::INT AS distance
    FROM (SELECT DISTINCT subject_id, day FROM hypno) d LEFT JOIN trigger t ON d.subject_id = t.subject_id GROUP BY 1, 2""")
def min_event_distance(spark, d):
    from epochlane.operators.causal import event_distance

    return event_distance(catalog.days(view(spark, d, "hypno")), view(spark, d, "trigger"))


@query("label_next_day", ctes("hypno", "trigger") + """SELECT d.subject_id, d.day, (t.event_date IS NOT NULL)::INT AS label FROM (SELECT DISTINCT subject_id, day FROM hypno) d
    LEFT JOIN (SELECT DISTINCT subject_id, event_date FROM trigger) t ON d.subject_id = t.subject_id AND d.day + 1 = t.event_date""")
def label_next_day(spark, d):
    from epochlane.operators.causal import next_day_label

    return next_day_label(catalog.days(view(spark, d, "hypno")), view(spark, d, "trigger"))


@query("profile_fixed_n", with_profiles() + "SELECT subject_id, day, point_idx, round(pct, 6) AS pct FROM profile")
def profile_fixed_n(spark, d):
    return profile(spark, d).withColumn("pct", r6("pct"))


def _sliding_sql(width: int, step: int, last: str, scale: float) -> str:
    return ctes("hypno") + f"""SELECT h.subject_id, h.day, p.i AS point_idx, round({scale} * count(*) FILTER (WHERE stage = 2) / count(*), 6) AS pct FROM hypno h
        JOIN (SELECT subject_id, day, i, n FROM (SELECT subject_id, day, count(*) AS n FROM hypno GROUP BY 1, 2), (SELECT unnest(range(400))::INT AS i) WHERE i * {step} + {width} {last} n) p
        ON h.subject_id = p.subject_id AND h.day = p.day AND h.epoch_idx >= p.i * {step} AND h.epoch_idx < p.i * {step} + {width} GROUP BY 1, 2, 3"""


@query("profile_sliding", _sliding_sql(12, 4, "<", 100.0))
def profile_sliding(spark, d):
    return profiles.sliding(view(spark, d, "hypno"), 12, 4).withColumn("pct", r6("pct"))


@query("profile_sliding_incl", _sliding_sql(13, 5, "<=", 1.0))
def profile_sliding_incl(spark, d):
    return profiles.sliding(view(spark, d, "hypno"), 13, 5, inclusive=True, scale=1.0).withColumn("pct", r6("pct"))


@query("profile_concat", with_profiles(e="""SELECT w.window_id, row_number() OVER (PARTITION BY w.window_id ORDER BY w.day_idx, h.epoch_idx) - 1 AS e, h.stage, count(*) OVER (PARTITION BY w.window_id) AS n
    FROM window_day w JOIN hypno h ON w.subject_id = h.subject_id AND w.day = h.day""") + """SELECT e.window_id, i AS point_idx, round(100.0 * count(*) FILTER (WHERE stage = 2) / count(*), 6) AS pct
    FROM e, (SELECT unnest(range(60))::INT AS i) WHERE e >= i * 100 AND e < i * 100 + 100 AND i * 100 + 100 < n GROUP BY 1, 2""")
def profile_concat(spark, d):
    """Windows with the same days have the same points, so one of each is concatenated and its points are those of all."""
    e = profiles.concatenated(window_days(spark, d, firsts=True), view(spark, d, "hypno"))
    points = profiles.sliding(e, 100, 100, keys=["window_id"]).withColumnRenamed("window_id", "first_id")
    return points.join(alike(spark, d), "first_id").select("window_id", "point_idx", r6("pct").alias("pct"))


@query("profile_combine", with_profiles() + """SELECT window_id, point_idx, round(coalesce(avg(pct), 0), 6) AS average, round(coalesce(max(pct), 0), 6) AS max, round(coalesce(stddev_pop(pct), 0), 6) AS std,
    round(coalesce(sum(pct), 0), 6) AS sum FROM wp GROUP BY 1, 2""")
def profile_combine(spark, d):
    wp = window_profile(spark, d)
    out = None
    for how in ("average", "max", "std", "sum"):
        one = profiles.combine(wp, how).withColumn("value", r6("value")).withColumnRenamed("value", how)
        out = one if out is None else out.join(one, ["window_id", "point_idx"])
    return out


_GRID = [(8, 0.0), (12, 0.25), (12, 0.5), (24, 0.5)]


@query("profile_grid", ctes("hypno") + """SELECT p.subject_id, p.day, p.n_points, p.overlap, p.i AS point_idx, round(coalesce(100.0 * count(*) FILTER (WHERE stage = 2) / nullif(count(h.epoch_idx), 0), 0), 6) AS pct
    FROM (SELECT *, floor(greatest(0.0, (i + 0.5) * (n / n_points) - n / n_points / (1 - overlap) / 2)) AS a, floor(least(n, (i + 0.5) * (n / n_points) + n / n_points / (1 - overlap) / 2)) AS b
        FROM (SELECT subject_id, day, count(*)::DOUBLE AS n FROM hypno GROUP BY 1, 2), (VALUES (8, 0.0::DOUBLE), (12, 0.25), (12, 0.5), (24, 0.5)) g(n_points, overlap), (SELECT unnest(range(24))::INT AS i) WHERE i < n_points) p
    LEFT JOIN hypno h ON h.subject_id = p.subject_id AND h.day = p.day AND h.epoch_idx >= p.a AND h.epoch_idx < p.b GROUP BY 1, 2, 3, 4, 5""")
def profile_grid(spark, d):
    return profiles.grid(view(spark, d, "hypno"), _GRID).withColumn("pct", r6("pct"))


@query("export_matrix", with_profiles() + "SELECT window_id, " + ", ".join(f"round(coalesce(max(value) FILTER (WHERE pos = {i}), 0), 6) AS p{i}" for i in range(N_DAYS * N_POINTS)) + " FROM r GROUP BY window_id")
def export_matrix(spark, d):
    return export.matrix(rows(spark, d).withColumn("value", r6("value")), N_DAYS * N_POINTS, fill=0.0)


@query("pad", with_profiles() + "SELECT window_id, i AS pos, round(coalesce(value, 0), 6) AS value FROM (SELECT DISTINCT window_id FROM r) CROSS JOIN (SELECT unnest(range(100))::INT AS i) LEFT JOIN r USING (window_id) WHERE r.pos = i OR (i >= 96 AND r.pos = 0)".replace("coalesce(value, 0)", "CASE WHEN i >= 96 THEN 0 ELSE coalesce(value, 0) END"))
def pad(spark, d):
    return export.pad(rows(spark, d).select("window_id", "pos", "value"), 100, 0.0).withColumn("value", r6("value"))


@query("export_metadata", with_profiles("hypno_local") + """SELECT window_id, count(*) AS n_days, count(*) FILTER (WHERE l.n IS NULL) AS n_missing, coalesce(string_agg(CASE WHEN l.n IS NULL THEN w.day::VARCHAR END, ';' ORDER BY day_idx), '') AS missing_days,
    count(*) FILTER (WHERE l.n IS NULL) = 0 AS exported, coalesce(sum(l.n), 0)::BIGINT AS n_epochs FROM window_day w LEFT JOIN (SELECT subject_id, day, count(*) AS n FROM hypno_local GROUP BY 1, 2) l ON w.subject_id = l.subject_id AND w.day = l.day GROUP BY 1""")
def export_metadata(spark, d):
    return export.metadata(window_days(spark, d), view(spark, d, "hypno_local"))


@query("export_summary", with_profiles("hypno_local", m="""SELECT window_id, count(*) FILTER (WHERE l.day IS NULL) AS n_missing FROM window_day w LEFT JOIN (SELECT DISTINCT subject_id, day FROM hypno_local) l ON w.subject_id = l.subject_id AND w.day = l.day GROUP BY 1""") +
    "SELECT count(*) AS n_windows, count(*) FILTER (WHERE n_missing = 0) AS n_exported, sum(n_missing)::BIGINT AS n_missing_days, max(n_missing) AS most_missing FROM m")
def export_summary(spark, d):
    return export.summary(export.metadata(window_days(spark, d), view(spark, d, "hypno_local")))


@query("coverage_warnings", with_profiles("hypno_local") + """SELECT window_id, count(*) FILTER (WHERE l.day IS NULL) AS n_missing FROM window_day w LEFT JOIN (SELECT DISTINCT subject_id, day FROM hypno_local) l ON w.subject_id = l.subject_id AND w.day = l.day GROUP BY 1 HAVING count(*) FILTER (WHERE l.day IS NULL) > 2""")
def coverage_warnings(spark, d):
    return export.metadata(window_days(spark, d), view(spark, d, "hypno_local")).where("n_missing > 2").select("window_id", "n_missing")


@query("export_profiles", with_profiles("hypno_local", ok="SELECT window_id FROM window_day w LEFT JOIN (SELECT DISTINCT subject_id, day FROM hypno_local) l ON w.subject_id = l.subject_id AND w.day = l.day GROUP BY 1 HAVING count(*) FILTER (WHERE l.day IS NULL) = 0")
    + "SELECT window_id, " + ", ".join(f"round(coalesce(max(value) FILTER (WHERE pos = {i}), 0), 6) AS p{i}" for i in range(N_DAYS * N_POINTS)) + " FROM r WHERE window_id IN (SELECT window_id FROM ok) GROUP BY window_id")
def export_profiles(spark, d):
    """Windows, availability, complete ones only, profiles, zero-padded matrix."""
    w = catalog.complete_windows(window_days(spark, d), view(spark, d, "hypno_local"))
    p = profiles.of_windows(w, profile(spark, d), N_POINTS).selectExpr("window_id", f"day_idx * {N_POINTS} + point_idx AS pos", "round(pct, 6) AS value")
    return export.matrix(p, N_DAYS * N_POINTS, 0.0)
