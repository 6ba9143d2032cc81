"""Windows with the same days are worked out once; every window still has its row."""

import datetime as dt

from pyspark.sql import functions as F

from epochlane.operators import posterior, windows


def _triggers(spark):
    day = dt.date(2024, 1, 9)
    rows = [(5, "S0", day, "before"), (3, "S0", day, "before"), (4, "S0", day, "after_reversed"), (6, None, day, "before"), (7, None, day, "before"), (8, "S1", None, None)]
    return spark.createDataFrame(rows, "trigger_id long, subject_id string, event_date date, direction string")


def test_every_window_has_its_first(spark):
    t = _triggers(spark)
    assert {tuple(r) for r in windows.alike(t).collect()} == {(5, 3), (3, 3), (4, 4), (6, 6), (7, 6), (8, 8)}
    assert sorted(r.trigger_id for r in windows.firsts(t).collect()) == [3, 4, 6, 8]


def _ll(spark, ids):
    v = F.sin(F.col("window_id").cast("double") + F.col("draw") * 1.7) * 3
    return spark.range(200).withColumnRenamed("id", "draw").withColumn("window_id", F.explode(F.array(*[F.lit(i) for i in ids]))).select(F.concat(F.lit("a"), F.col("window_id") % 1).alias("config_id"), "window_id", "draw", v.alias("ll"))


def test_waic_counts_events_a_window_stands_for(spark):
    one = _ll(spark, [1, 2])
    copies = one.unionByName(one.where("window_id = 2").withColumn("window_id", F.lit(3)))
    got = posterior.waic(one, spark.createDataFrame([(1, 1), (2, 2)], "window_id int, times int")).first()
    want = posterior.waic(copies).first()
    assert all(abs(got[c] - want[c]) < 1e-9 for c in ("lppd", "p_waic", "elpd_waic"))


def test_draws_of_events_keep_the_partitions_of_a_shuffle(spark):
    found = posterior.psis_loo(_ll(spark, range(40)))
    used = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1


def test_scores_count_rows_a_row_stands_for(spark):
    from epochlane.operators import search

    y = F.sin(F.col("id") * 1.3)
    one = spark.range(24).select(F.lit("a").alias("grp"), (F.col("id") % 3).alias("window_id"), F.floor(F.col("id") / 3).cast("int").alias("chunk_idx"), y.alias("y"), ((y + 1) / 2).alias("u"))
    twice = one.unionByName(one.where("window_id = 2").withColumn("window_id", F.lit(9).cast("long")))
    kinds = ["normal", "beta", "interval_inflated_beta", "student_t", "skew_normal"]
    of = lambda v: {(r.likelihood, r.tau): r.ll for r in search.tau_scores(v, ["grp"], kinds, 2, 8).collect()}
    got, want = of(one.withColumn("times", F.when(F.col("window_id") == 2, 2).otherwise(1))), of(twice)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
