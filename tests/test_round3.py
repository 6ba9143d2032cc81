"""Ties of the worst window, controls without a quiet day, and windows concatenated once."""

import datetime as dt

import pytest

from epochlane.operators import causal, changepoint, profiles
from epochlane.plans import windowing
from epochlane.plans.base import view

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("ids", [(2, 9), (9, 2)])
def test_worst_of_equal_windows_is_the_smaller_id(spark, ids):
    """Both windows hold the same values in another order, so their sums differ by their last bit."""
    values = {ids[0]: (0.1, 0.2, 0.3), ids[1]: (0.3, 0.2, 0.1), 20: (0.21, 0.19, 0.2), 21: (0.2, 0.2, 0.21), 22: (0.19, 0.2, 0.2)}
    rows = [("a", w, c, v) for w, of in values.items() for c, v in enumerate(of)]
    df = spark.createDataFrame(rows, "grp string, window_id long, chunk_idx int, value double").coalesce(1)
    got = {r["round"]: r["window_id"] for r in changepoint.drop_worst(df, ["grp"], 5, 2).collect()}
    assert got == {0: 2, 1: 9}


def test_controls_only_if_quiet(spark):
    rows = spark.createDataFrame([("S0", dt.date(2024, 1, 1), 1), ("S0", dt.date(2024, 1, 2), 0)], "subject_id string, day date, label int")
    events = spark.createDataFrame([("S0", dt.date(2024, 1, 2))], "subject_id string, event_date date")
    assert causal.quiet_controls(rows, events, 0, 1.0).count() == 1
    assert causal.quiet_controls(rows, events, 0, 1.0, else_any=False).count() == 0


def test_windows_with_the_same_days_are_concatenated_once(spark, monkeypatch, tmp_path):
    copies = view(spark, DATA, "trigger")
    more = copies.unionByName(copies.selectExpr("trigger_id + 1000000 AS trigger_id", "subject_id", "event_date", "direction"))
    seen, plain = [], profiles.concatenated
    real = view

    def copied(s, d, name):
        return more if name == "trigger" else real(s, d, name)

    monkeypatch.setattr("epochlane.plans.base.view", copied)
    monkeypatch.setattr(windowing, "view", copied)
    monkeypatch.setattr(profiles, "concatenated", lambda w, e: seen.append(w.select("window_id").distinct().count()) or plain(w, e))
    got = windowing.profile_concat(spark, DATA)
    assert seen[0] == copies.select("subject_id", "event_date", "direction").distinct().count()
    assert got.where("window_id >= 1000000").count() * 2 == got.count()


def test_rows_are_dealt_over_tasks_by_their_number(spark):
    from pyspark.sql import functions as F

    from epochlane.operators.skew import dealt

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(4000).select((F.col("id") % 500).alias("k"))
    assert dealt(df, "k").rdd.getNumPartitions() == parts
    assert dealt(df, "k", rows=100).rdd.getNumPartitions() == 40


def test_groups_are_worked_out_once(spark, monkeypatch):
    from epochlane.operators import features
    from epochlane.plans import profiling

    seen, plain = [], features.chunks
    monkeypatch.setattr(features, "chunks", lambda r, k: seen.append(r.select("window_id").distinct().count()) or plain(r, k))
    t = view(spark, DATA, "trigger")
    more = t.unionByName(t.selectExpr("trigger_id + 1000000 AS trigger_id", "subject_id", "event_date", "direction"))
    monkeypatch.setattr("epochlane.plans.base.view", lambda s, d, name: more if name == "trigger" else view(s, d, name))
    got = profiling._groups(spark, DATA)
    assert seen[0] == t.select("subject_id", "event_date", "direction").distinct().count()
    assert got.where("window_id >= 1000000").count() * 2 == got.count() > 0
