"""Operators on small literal tables."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from epochlane.functions.special import erf, lgamma
from epochlane.operators import agreement, causal, changepoint, clean, configs, export, features, folds, graph, metrics, models, numbering, posterior, profiles, ranking, stages, windows
from epochlane.session import materialise


def rows_of(spark, values, window=1):
    return spark.createDataFrame([(window, i, None if v is None else float(v)) for i, v in enumerate(values)], "window_id long, pos int, value double")


def values(df):
    return [r["value"] for r in df.orderBy("window_id", "pos").collect()]


def hypno(spark, stages_, subject="R1", day="2024-01-01"):
    return spark.createDataFrame([(subject, dt.date.fromisoformat(day), i, s) for i, s in enumerate(stages_)], "subject_id string, day date, epoch_idx int, stage int")


def codes(df):
    return [r["stage"] for r in df.orderBy("epoch_idx").collect()]


def test_alignment_counts_from_each_offset(spark):
    ref, auto = (hypno(spark, s).drop("subject_id", "day").withColumn("k", F.lit(1)) for s in ([0, 1, 2, 0, 1, 2, 2, 1], [1, 2, 0, 1, 2]))
    got = agreement.align(ref, auto, ["k"], 2, 0).orderBy("epoch_idx").collect()
    assert [r["y_true"] for r in got] == [2, 0, 1, 2, 2]
    assert len(got) == 5


def test_agreement_accuracy(spark):
    t, p = [0, 0, 1, 1, 2, 2, 2, 1, 0, 2], [0, 1, 1, 1, 2, 0, 2, 1, 0, 2]
    pairs = spark.createDataFrame(list(zip(t, p, strict=True)), "y_true int, y_pred int")
    got = agreement.kappa(agreement.confusion(pairs)).first()
    assert got["accuracy"] == pytest.approx(0.8)
    assert -1 <= got["kappa"] <= 1 and got["kappa_quadratic"] <= 1


@pytest.mark.parametrize("before, after", [
    ([0, 0, 1, 0, 0], [0, 0, 0, 0, 0]), ([1, 0, 1, 1], [1, 0, 1, 1]), ([0, 1, 2, 2], [0, 1, 2, 2]), ([1, 0, 0, 1], [1, 0, 0, 1]), ([0, 1], [0, 1])])
def test_no_single_one(spark, before, after):
    assert codes(stages.no_single(hypno(spark, before), 1)) == after


def test_rem_after_wake_is_wake_as_a_whole(spark):
    assert codes(stages.no_rem_in_wake(hypno(spark, [0, 0, 2, 2, 2, 1, 2, 0, 2, 2]))) == [0, 0, 0, 0, 0, 1, 2, 0, 2, 2]
    assert codes(stages.no_rem_in_wake(hypno(spark, [2, 2, 0]))) == [2, 2, 0]


def test_artifacts_take_the_last_clean_stage(spark):
    at = hypno(spark, [1, 2, 2, 1, 0]).withColumn("artifact", F.col("epoch_idx").isin(0, 2, 3))
    assert codes(stages.stage_fill(at)) == [0, 2, 2, 2, 0]


def test_fixed_profile_equals_direct_counts_and_stays_in_range(spark):
    random.seed(1)
    for n, points, overlap in [(37, 6, 0.0), (80, 12, 0.5), (5, 8, 0.25), (1, 3, 0.5)]:
        s = [random.randrange(3) for _ in range(n)]
        got = [r["pct"] for r in profiles.fixed_n(hypno(spark, s), points, overlap).orderBy("point_idx").collect()]
        want = []
        for i in range(points):
            seg = n / points
            width, centre = seg / (1 - overlap), (i + 0.5) * seg
            part = s[int(max(0, centre - width / 2)) : int(min(n, centre + width / 2))]
            want.append(100 * part.count(2) / len(part) if part else 0.0)
        assert got == pytest.approx(want)
        assert all(0 <= x <= 100 for x in got)


def test_sliding_profile_modes(spark):
    h = hypno(spark, [2, 2, 0, 0, 2, 0])
    at = lambda **k: [r["pct"] for r in profiles.sliding(h, 2, 2, **k).orderBy("point_idx").collect()]
    assert at() == [100.0, 0.0]
    assert at(inclusive=True, scale=1.0) == [1.0, 0.0, 0.5]
    assert profiles.sliding(h, 10, 2).count() == 0
    assert [r["pct"] for r in profiles.sliding(h, 10, 2, scale=1.0, whole_if_short=True).collect()] == [0.5]


def test_window_offsets():
    assert windows.immediate_offset(6, 1) == -6
    assert windows.immediate_offset(6, 0) == -5
    assert windows.immediate_offset(6, -4, 4) == -9
    assert windows.immediate_offset(6, -1, -1) == -4
    assert windows.control_offset(6, 3) == -9
    assert windows.control_offset(6, -2) == -9
    assert windows.control_offset(6, -2, 7) == -7


def test_reverse_window_after_the_event(spark):
    t = spark.createDataFrame([(1, "R1", dt.date(2024, 1, 10), "after_reversed"), (2, "R1", dt.date(2024, 1, 10), "before")], "trigger_id long, subject_id string, event_date date, direction string")
    got = windows.directional(t, 3).orderBy("window_id", "day_idx").collect()
    assert [r["day"].day for r in got] == [13, 12, 11, 7, 8, 9]


def shifts(spark, days):
    pts = spark.createDataFrame([(1, d, p, None if v is None else float(v)) for d, day in enumerate(days) for p, v in enumerate(day)], "window_id long, day_idx int, point_idx int, value double")
    return [r["shift"] for r in features.shape_shift(pts).orderBy("day_idx").collect()]


def test_shape_shift(spark):
    template = [math.sin(i) for i in range(19)]
    days = [list(template) for _ in range(8)]
    assert shifts(spark, days) == [0.0] * 7
    days[3] = [v + (i % 5 + 1) for i, v in enumerate(template)]
    got = shifts(spark, days)
    assert got[0] == 0 and got[1] == 0 and got[2] > 0 and got[3] > 0 and got[4] == 0


@pytest.mark.parametrize("n, k", [(10, 4), (152, 7), (7, 7), (23, 6)])
def test_chunks_cover_in_order(spark, n, k):
    got = features.chunks(rows_of(spark, [1 + i for i in range(n)] + [None, None]), k).orderBy("pos").collect()
    sizes = [sum(r["chunk_idx"] == j for r in got) for j in range(k)]
    flags, left = [0] * k, n % k
    for j in [*range(0, k, 2), *range(1, k, 2)]:
        flags[j], left = (1, left - 1) if left else (0, 0)
    assert sizes == [n // k + f for f in flags]
    assert [r["chunk_idx"] for r in got] == sorted(r["chunk_idx"] for r in got)
    assert features.chunks(rows_of(spark, [1, 2]), 3).count() == 0


def test_fewer_points_than_days_give_the_policy_value(spark):
    got = features.daily_stats(rows_of(spark, [1, 2]), 3, ["mean"], empty=None).collect()
    assert [r["mean"] for r in got] == [None] * 3


def test_constant_rows_scale_to_their_value(spark):
    r = rows_of(spark, [4, 4, None, 4])
    assert values(clean.min_max(r)) == [0.5, 0.5, None, 0.5]
    assert values(clean.min_max(r, low=-1.0, high=1.0, constant=0.0)) == [0.0, 0.0, None, 0.0]
    assert values(clean.z_score(r)) == [0.0, 0.0, None, 0.0]


def test_interpolation(spark):
    assert values(clean.interpolate(rows_of(spark, [None, 2, None, 4, None, None]))) == [1, 2, 3, 4, 5, 6]
    assert values(clean.interpolate(rows_of(spark, [None, 2, None, 4, None]), "nearest")) == [2, 2, 2, 4, 4]
    assert values(clean.interpolate(rows_of(spark, [None, 3, 0]))) == [3, 3, 3]
    assert values(clean.interpolate(rows_of(spark, [None, None]))) == [0, 0]
    assert values(clean.interpolate_cubic(rows_of(spark, [1, None, 3, None, 5, None]))) == pytest.approx([1, 2, 3, 4, 5, 6])


def test_outliers_become_the_median_of_the_rest(spark):
    assert values(clean.robust(rows_of(spark, [1, 2, 3, 2, 1, 100]), 0.0))[-1] == 2
    assert values(clean.adaptive(rows_of(spark, [1, 2, 100]), 0.0)) == [1, 2, 100]


def test_peaks_take_flat_tops_once_and_leave_ends(spark):
    got = features.peaks(rows_of(spark, [9, 1, 5, 5, 5, 1, 7, 1, 9])).first()
    assert got["n_peaks"] == 2 and got["mean"] == 6


def test_special_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 171.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(lgamma(F.col("x")).alias("g"), erf(F.col("x")).alias("e"), erf(-F.col("x")).alias("m")).collect()
    for x, r in zip(xs, got, strict=True):
        assert r["g"] == pytest.approx(math.lgamma(x), abs=1e-9, rel=1e-12)
        assert r["e"] == pytest.approx(math.erf(x), abs=1e-6) and r["m"] == pytest.approx(-math.erf(x), abs=1e-6)


def planted(spark, day, n=30):
    random.seed(day)
    data = [("c", w, c, max(-1.0, min(1.0, (0.35 if c >= day else -0.3) + random.gauss(0, 0.12)))) for w in range(n) for c in range(8)]
    return spark.createDataFrame(data, "k string, window_id long, chunk_idx int, value double")


@pytest.mark.parametrize("day", [2, 4, 6])
def test_planted_changepoint_is_found(spark, day):
    post = materialise(changepoint.tau_profile(planted(spark, day), ["k"], 2, 8))
    assert post.agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert changepoint.tau_summary(post, ["k"], 4).first()["map_tau"] == day + 1


def test_leave_one_out_equals_fitting_again(spark):
    v = planted(spark, 4, 10).collect()
    got = {r["window_id"]: r["elpd"] for r in changepoint.loo_exact(planted(spark, 4, 10), ["k"], 5).collect()}
    for w in range(10):
        want = 0.0
        for before in (True, False):
            rest = [r["value"] for r in v if r["window_id"] != w and (r["chunk_idx"] < 4) == before]
            mu = sum(rest) / len(rest)
            var = sum((x - mu) ** 2 for x in rest) / len(rest)
            want += sum(-0.5 * math.log(2 * math.pi * var) - (r["value"] - mu) ** 2 / (2 * var) for r in v if r["window_id"] == w and (r["chunk_idx"] < 4) == before)
        assert got[w] == pytest.approx(want, abs=1e-6)


def test_feature_grid_counts(spark):
    items = [f"{g}.{m}" for g in ("a", "b", "c") for m in ("mean", "range")]
    sets = configs.subsets(spark, items, 3)
    assert sets.count() == 41
    one = sets.limit(1)
    assert configs.grid(one, ["x", "y", "z"], [(24, 0.0), (24, 0.5)]).count() == 6


def test_fingerprint_ignores_key_order(spark):
    a = spark.range(1).select(configs.fingerprint({"b": F.lit(1), "a": F.lit("x")}).alias("f")).first()[0]
    b = spark.range(1).select(configs.fingerprint({"a": F.lit("x"), "b": F.lit(1)}).alias("f")).first()[0]
    assert a == b and len(a) == 16


def test_ranks_over_many_ranges(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = ranking.rank_column(df, [F.asc("x"), F.asc("id")], "r", 7).orderBy("x", "id").collect()
    assert [r["r"] for r in got] == list(range(1, 1001))
    totals = ranking.running_totals(df, [F.asc("x"), F.asc("id")], ["id"]).orderBy("x", "id").collect()
    run = 0
    for r in totals:
        assert r["before_id"] == run
        run += r["id"]


def test_null_score_ranks_last(spark):
    df = spark.createDataFrame([("a", True, None), ("b", True, 1.0), ("c", False, 9.0)], "config_id string, eligible boolean, elpd_norm double")
    assert [r["config_id"] for r in ranking.rank_column(df, ranking.best_first()).orderBy("rank").collect()] == ["b", "a", "c"]


def test_permutation_keeps_the_multiset(spark):
    df = spark.createDataFrame([(i, i % 3, i * i) for i in range(60)], "id long, g long, v long")
    for seed in (1, 2):
        got = ranking.permute(df, ["g"], "id", "v", seed)
        for g in range(3):
            assert sorted(r["v"] for r in got.where(F.col("g") == g).collect()) == sorted(i * i for i in range(60) if i % 3 == g)


def test_gapless_index_spreads_a_hot_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)))
    got = numbering.gapless_index(df, "g", ["id"], "k", 5000, 50).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part["k"]) == list(range(len(part)))


@pytest.mark.parametrize("edges, want", [
    ([(1, 2), (2, 3), (5, 4), (7, 7)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(0, i) for i in range(1, 60)], {i: 0 for i in range(60)}),
    ([(9, 9), (None, 3)], {9: 9}), ([], {})])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["node"]: r["component"] for r in graph.connected_components(materialise(df)).collect()} == want


def test_folds_are_even_and_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(103)], "id long, y int")
    sizes = [r["count"] for r in folds.k_fold(df, "id").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    per = folds.stratified(df, "id", "y").groupBy("fold").agg(F.sum("y").alias("s")).collect()
    assert max(r["s"] for r in per) - min(r["s"] for r in per) <= 1


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1)], "y int, p double")
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.875)


def test_knn_votes(spark):
    train = spark.createDataFrame([(i, [float(i), 0.0], int(i >= 5)) for i in range(10)], "id long, v array<double>, label int")
    test = spark.createDataFrame([(100, [0.2, 0.0]), (101, [8.9, 0.0])], "id long, v array<double>")
    for metric in models.METRICS:
        got = {r["id"]: r["pred"] for r in models.knn(train, test, 3, metric if metric != "cosine" else "euclidean", "distance", 4).collect()}
        assert got == {100: 0, 101: 1}


def test_rhat_of_equal_chains_is_near_one(spark):
    random.seed(3)
    df = spark.createDataFrame([("c", ch, i, random.gauss(0, 1)) for ch in range(2) for i in range(50)], "config_id string, chain int, draw int, value double")
    assert 0.9 < posterior.split_rhat(df).first()["rhat"] < 1.2
    assert 20 < posterior.ess(df).first()["ess_bulk"] <= 200


def test_trend_and_anomaly_need_days_before(spark):
    df = spark.createDataFrame([("s", d, float(m), 0.0, 0.0) for d, m in enumerate([1, 3, 4])], "subject_id string, day int, mean double, range double, std double")
    assert [r["trend_mean"] for r in causal.trend3(df, ["subject_id"], "day").orderBy("day").collect()] == [None, 2.0, 1.5]


def test_matrix_fills(spark):
    got = export.matrix(rows_of(spark, [1, None]), 3, 0.0).first()
    assert (got["p0"], got["p1"], got["p2"]) == (1.0, 0.0, 0.0)


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df: written.append(1) or materialise(df))
    star = spark.createDataFrame([(1, b) for b in range(2, 30)] + [(40, 41)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected_components(star).collect()}
    assert got == {b: 1 for b in range(1, 30)} | {40: 40, 41: 40} and len(written) == 1
