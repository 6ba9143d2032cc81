"""Targets, stop rules, resolved configurations, exclusions, and the whole stage job written with resume, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from epochlane.operators import clean, configs, export, ranking, selection, stages
from epochlane.sources.adapt import view

DATA = "/root/testdata/sf0.001"
PARTS = "ic_computed boolean, elpd double, p_tau double, map_prob double, conc double, r_hat_max double, ess_bulk double, ess_tail double, bfmi double, n_divergences int, n_blocks int"


def test_log_targets(spark):
    rows = [
        (True, -10.0, 0.5, 0.4, 0.3, 1.0, 500.0, 400.0, 0.9, 0, 3), (True, -10.0, 0.5, 0.4, 0.3, 1.15, 500.0, 40.0, 0.1, 0, 1), (True, None, 0.5, 0.4, 0.3, 1.0, 500.0, 400.0, 0.9, 0, 3),
        (False, -10.0, 0.5, 0.4, 0.3, 1.11, 80.0, 400.0, 0.9, 0, 3), (True, -10.0, 0.5, 0.4, 0.3, 1.0, 500.0, 400.0, 0.9, 2, 3), (True, -10.0, None, None, None, None, None, None, None, None, None)]
    got = [r["t"] for r in spark.createDataFrame(rows, PARTS).coalesce(1).select(ranking.log_target().alias("t")).collect()]
    tau = 0.2 * math.log(0.5) + 0.05 * math.log(0.4) + 0.05 * 0.3
    want = [-10 + tau - 0.1, -10 + tau - 40 * 0.1 - 0.15 * 60 - 25 * 0.2, None, 8 * math.log(0.5) + 2 * math.log(0.4) + 0.3 + 0.002 * math.log(80) - 0.16 - 50 * 0.1 - 5, None, -10 + 0.25 * math.log(1e-12) - 15]
    for a, b in zip(got, want, strict=True):
        assert a == (b if b is None else pytest.approx(b))


def test_stop_reasons(spark):
    flat = [("flat", i, "m", 1.0) for i in range(6)]
    rise = [("rise", i, f"m{i}", float(i)) for i in range(20)]
    fall = [("fall", i, f"m{i}", -float(i)) for i in range(8)]
    old = [("old", i, "m" if i else "n", float(i * i)) for i in range(30)]
    df = spark.createDataFrame(flat + rise + fall + old, "chain string, i int, config_id string, score double")
    got = {(r["chain"], r["i"]): r for r in ranking.stop_reasons(df, "chain", ["i"], window=10, patience=5).collect()}
    assert got["flat", 0]["reason"] is None and got["flat", 3]["reason"] == "stabilized" and got["flat", 5]["reason"] == "no_improvement"
    assert all(got["rise", i]["reason"] is None for i in range(20))
    assert [got["fall", i]["reason"] for i in range(8)] == [None] * 5 + ["no_improvement"] * 3
    assert got["old", 29]["reason"] == "saturated" and got["old", 9]["reason"] is None
    assert (got["rise", 19]["old_mean"], got["rise", 19]["new_mean"]) == (12.0, 17.0) and got["rise", 0]["old_mean"] is None


def test_configurations_over_defaults(spark):
    rows = [("a", "mean", None), ("a", "range", {"likelihood": "beta", "sigma": "2"}), ("b", "std", {"likelihood": "beta"}), ("b", "other", {"likelihood": "normal", "mu": None}), ("b", "kurtosis", {})]
    df = spark.createDataFrame(rows, "config_id string, metric string, override map<string, string>")
    got = {(r["config_id"], r["metric"]): (r["likelihood"], r["mu"], r["sigma"], r["g_prior"], r["valid"]) for r in configs.resolved(df, "hyper_g_n").collect()}
    assert got == {("a", "mean"): ("student_t", "0.0", "1.0", "hyper_g_n", True), ("a", "range"): ("beta", "-0.3", "2", "hyper_g_n", True), ("b", "std"): ("beta", "-0.7", "0.7", "hyper_g_n", False), ("b", "other"): ("normal", None, None, None, False), ("b", "kurtosis"): ("student_t", "0.0", "2.0", "hyper_g_n", True)}


def test_samples_that_are_listed(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "window_id long, pos int")
    of = lambda *ids: spark.createDataFrame([(i,) for i in ids], "window_id long")
    assert sorted(map(tuple, clean.exclude(rows, of(1, 3, 3)).collect())) == [(2, 0)] and clean.exclude(rows, of()).count() == 4
    for bad, said in ((of(9), "not among"), (of(1, 2, 3), "all samples")):
        with pytest.raises(ValueError, match=said):
            clean.exclude(rows, bad)


def test_metadata_must_fit_the_matrix(spark, tmp_path):
    meta = spark.createDataFrame([(5, True), (2, True), (3, False)], "window_id long, exported boolean")
    two = spark.range(2)
    assert [(r["window_id"], r["row_index"]) for r in export.exported_rows(meta, two).orderBy("row_index").collect()] == [(2, 0), (5, 1)]
    with pytest.raises(ValueError, match="2 rows of the metadata"):
        export.exported_rows(meta, spark.range(3))
    meta.withColumn("row_index", F.col("window_id")).write.option("header", "true").csv(f"{tmp_path}/m")
    assert export.read_metadata(spark, f"{tmp_path}/m", two).count() == 2
    with pytest.raises(ValueError, match="has no column"):
        meta.drop("exported").write.option("header", "true").csv(f"{tmp_path}/n")
        export.read_metadata(spark, f"{tmp_path}/n", two)


def test_shape_shift_is_of_chunks():
    assert selection.parse(["shape_shift even"]) == [("even", "shape_shift")]
    with pytest.raises(ValueError, match="no shape shift"):
        selection.parse({"daily": "shape_shift"})


def test_the_stage_job_computes_each_day_once(spark, tmp_path):
    samples = view(spark, DATA, "signal_raw")
    args = (4, 4.0, (1.0, 1.0), (2.0, 2.0))
    first = stages.write_stages(samples.where("day < date'2024-01-10'"), f"{tmp_path}/stages", *args)
    again = stages.write_stages(samples, f"{tmp_path}/stages", *args)
    third = stages.write_stages(samples, f"{tmp_path}/stages", *args)
    days = samples.select("subject_id", "day").distinct()
    assert first > 0 and first + again == spark.read.parquet(f"{tmp_path}/stages").select("subject_id", "day").distinct().count() and third == 0
    at = ["subject_id", "day", "epoch_idx", "stage"]
    whole = stages.score(samples, *args)
    key = lambda df: sorted(map(str, df.select("subject_id", F.col("day").cast("date").alias("day"), "epoch_idx", F.col("stage").cast("int").alias("stage")).collect()))
    got = spark.read.parquet(f"{tmp_path}/stages").select(*at)
    assert key(got) == key(whole) and got.select("day").distinct().count() <= days.select("day").distinct().count()
