import json

import pytest
from pyspark.sql import functions as F

from epochlane.operators import catalog, export, ranking, search, stages


def test_strict_mode_names_missing_days(spark):
    have = spark.createDataFrame([("S0", "2024-01-01"), ("S0", "2024-01-02")], "subject_id string, day string")
    assert catalog.require(have, have) is have
    with pytest.raises(ValueError, match="1 days are missing: S0 2024-01-02"):
        catalog.require(have, have.where("day < '2024-01-02'"))


def test_results_with_legend_and_summary(spark, tmp_path):
    df = spark.createDataFrame([("a", "ok", 2.0), ("b", "ok", 4.0), ("c", "error", None)], "config_id string, status string, elpd_loo double")
    assert export.write_results(df, str(tmp_path), {"elpd_loo": "score"}).first().asDict() == {"n": 3, "n_ok": 2, "best": 4.0, "mean": 3.0, "worst": 2.0}
    back = spark.read.option("header", "true").csv(str(tmp_path / "results"))
    assert back.columns == df.columns and back.count() == 3
    notes = [json.loads(x) for f in (tmp_path / "legend").glob("*.json") for x in f.read_text().splitlines()]
    assert [(n["column"], n["meaning"]) for n in notes] == [("config_id", ""), ("status", ""), ("elpd_loo", "score")]
    assert spark.read.parquet(export.write_step(df, str(tmp_path), 3, "scored")).count() == 3
    assert [r["config_id"] for r in export.sample_head(df, ["config_id"], 2).collect()] == ["a", "b"]


def test_rejected_before_they_are_scored(spark):
    results = spark.createDataFrame([("a", "ok", 0, 1.0, 300.0), ("b", "ok", 2, 1.2, 100.0), ("c", "error", 0, 1.0, 300.0)], "config_id string, status string, n_divergences int, r_hat_max double, ess_min_bulk double")
    got = {r["config_id"]: r["early"] for r in ranking.fail_fast(results).collect()}
    assert got == {"a": [], "b": ["divergences", "r_hat", "ess"], "c": ["status"]}
    points = spark.createDataFrame([(c, i) for c in "abc" for i in range(2)], "config_id string, window_id int")
    assert ranking.passed_only(points, results).groupBy("config_id").count().collect() == [("a", 2)]


def test_ranks_inside_few_groups(spark):
    df = spark.createDataFrame([(i, i % 2 if i else None, float(-i)) for i in range(9)], "id int, k int, v double")
    got = {r["id"]: r["place"] for r in ranking.rank_within(df, "k", [F.asc("v")]).collect()}
    assert got == {0: 1, 8: 1, 6: 2, 4: 3, 2: 4, 7: 1, 5: 2, 3: 3, 1: 4}


def test_components_that_hold_a_share():
    from epochlane.operators import models

    assert [models.components_for([0.5, 0.3, 0.1], x) for x in (0.2, 0.5, 0.6, 0.8, 0.95)] == [1, 1, 2, 2, 3]


def test_middle_between_two_components():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(0, 0.1, 300), rng.normal(5, 0.1, 200)))
    low, high = x[x < 2.5].max(), x[x >= 2.5].min()
    assert abs(stages._mixture_middle(x) - (low + high) / 2) < 1e-9
    assert stages._mixture_middle(np.array([3.0])) == 3.0 and np.isnan(stages._mixture_middle(np.array([])))


def brute_envelope(values):
    import numpy as np

    x = np.array(values)
    order = np.lexsort((np.arange(len(x)), x, np.abs(x - np.median(x))))
    lo, hi = x.min(), x.max()
    n, edges = np.histogram(x, 200, (lo, hi))
    centre = (edges[n[:150].argmax()] + edges[n[:150].argmax() + 1]) / 2
    best, cut = [], hi
    for c in range(1, 50):
        k = len(x) - int(np.ceil((len(x) - 1) * c / 100))
        if cut <= centre or not 0 < k < len(x):
            break
        kept = x[order[:k]]
        cut = (kept.max() + x[order[k:]].min()) / 2
        d = kept - kept.mean()
        if (d**2).mean() > 1e-9:
            best.append((round(abs((d**4).mean() / (d**2).mean() ** 2 - 3), 6), c, cut))
    return min(best)[2] if best else hi


def test_envelope_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    days = {"d": [*rng.normal(10, 1, 300), *rng.normal(60, 5, 12)], "e": [7.0], "f": [2.0] * 30, "g": [*rng.gamma(2, 3, 500)]}
    rows = [("S", d, 0, i, float(v)) for d, vs in days.items() for i, v in enumerate(vs)]
    got = {r["day"]: r["threshold"] for r in stages.threshold_envelope(spark.createDataFrame(rows, "subject_id string, day string, channel int, epoch_idx int, metric double")).collect()}
    assert got == pytest.approx({d: brute_envelope(v) for d, v in days.items()})


def test_a_configuration_without_a_score_is_kept_as_an_error(spark):
    values = spark.createDataFrame([(w, c, "daily", float(c >= 4) + 0.01 * w, (float(c >= 4) + 0.01 * w) / 2) for w in range(5) for c in range(8)], "window_id int, chunk_idx int, grp string, y double, u double")
    scores = search.tau_scores(values, ["grp"], ["normal", "student_t"], 2, 8)
    items = spark.createDataFrame([("good", "daily", "normal"), ("both", "daily", "normal"), ("both", "daily", "student_t"), ("bad", "weekly", "normal"), ("part", "daily", "normal"), ("part", "weekly", "normal")], "config_id string, grp string, likelihood string")
    got = {r["config_id"]: r for r in search.score_configs(items, scores, ["grp"], ["config_id"], 4).collect()}
    assert {k: (r["status"], r["n_scored"], r["map_tau"]) for k, r in got.items()} == {"good": ("ok", 1, 5), "both": ("ok", 2, 5), "bad": ("error", 0, None), "part": ("error", 1, None)}
    with pytest.raises(ValueError):
        search.tau_scores(values, ["grp"], ["poisson"], 2, 8)
