"""Tables that many registered queries start from, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochlane.operators import profiles, windows
from epochlane.sources.adapt import ctes, view

N_DAYS, N_POINTS, OVERLAP = 8, 12, 0.5

SQL_WINDOW_DAY = f"""SELECT trigger_id AS window_id, subject_id, event_date, direction, i AS day_idx,
    CAST(event_date + CAST(CASE WHEN direction = 'before' THEN i - {N_DAYS} ELSE {N_DAYS} - i END AS INT) AS DATE) AS day
    FROM trigger, (SELECT unnest(range({N_DAYS}))::INT AS i) d"""
SQL_PROFILE = f"""SELECT p.subject_id, p.day, p.point_idx, coalesce(100.0 * count(*) FILTER (WHERE h.stage = 2) / nullif(count(h.epoch_idx), 0), 0) AS pct
    FROM (SELECT subject_id, day, i AS point_idx,
        floor(greatest(0.0, (i + 0.5) * (n / {N_POINTS}.0) - n / {N_POINTS}.0 / (1 - {OVERLAP}) / 2)) AS a,
        floor(least(n, (i + 0.5) * (n / {N_POINTS}.0) + n / {N_POINTS}.0 / (1 - {OVERLAP}) / 2)) AS b
        FROM (SELECT subject_id, day, count(*)::DOUBLE AS n FROM hypno GROUP BY 1, 2), (SELECT unnest(range({N_POINTS}))::INT AS i)) p
    LEFT JOIN hypno h ON h.subject_id = p.subject_id AND h.day = p.day AND h.epoch_idx >= p.a AND h.epoch_idx < p.b GROUP BY 1, 2, 3"""
SQL_WP = f"""SELECT w.window_id, w.day_idx, k.point_idx, p.pct FROM window_day w CROSS JOIN (SELECT unnest(range({N_POINTS}))::INT AS point_idx) k
    LEFT JOIN profile p ON p.subject_id = w.subject_id AND p.day = w.day AND p.point_idx = k.point_idx"""
SQL_ROW = f"SELECT window_id, day_idx * {N_POINTS} + point_idx AS pos, day_idx, point_idx, pct AS value FROM wp"


def with_profiles(*names: str, **more: str) -> str:
    """WITH hypno, trigger, window_day, profile, wp, r(window_id, pos, day_idx, point_idx, value), and more."""
    return ctes("hypno", "trigger", *names, window_day=SQL_WINDOW_DAY, profile=SQL_PROFILE, wp=SQL_WP, r=SQL_ROW, **more)


def window_days(spark: SparkSession, sf_dir: str, firsts: bool = False) -> DataFrame:
    """Every window's days; with firsts only those of one window of each set of windows with the same days."""
    triggers = view(spark, sf_dir, "trigger")
    return windows.directional(windows.firsts(triggers) if firsts else triggers, N_DAYS)


def alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, first_id): every window with the one that stands for it in tables of firsts."""
    return windows.alike(view(spark, sf_dir, "trigger"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.fixed_n(view(spark, sf_dir, "hypno"), N_POINTS, OVERLAP)


def window_profile(spark: SparkSession, sf_dir: str, firsts: bool = False) -> DataFrame:
    return profiles.of_windows(window_days(spark, sf_dir, firsts), profile(spark, sf_dir), N_POINTS)


def rows(spark: SparkSession, sf_dir: str, firsts: bool = False) -> DataFrame:
    """(window_id, pos, day_idx, point_idx, value), value null on missing days."""
    return window_profile(spark, sf_dir, firsts).selectExpr("window_id", f"day_idx * {N_POINTS} + point_idx AS pos", "day_idx", "point_idx", "pct AS value")
