"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlane.operators.ranking import running_totals

EPS = 1e-15


def _per_score(scored: DataFrame) -> DataFrame:
    return scored.where("y is not null and p is not null").groupBy("p").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve from (y, p) with average ranks for ties: one row per distinct score is ordered."""
    at = running_totals(_per_score(scored), [F.asc("p")], ["neg"])
    return at.agg((F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("roc_auc"))


def pr_auc(scored: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by trapezoids over falling scores, from recall 0 and precision 1."""
    at = running_totals(_per_score(scored), [F.desc("p")], ["pos", "neg"])
    tp0, n0 = F.col("before_pos"), F.col("before_pos") + F.col("before_neg")
    tp1, n1 = tp0 + F.col("pos"), n0 + F.col("pos") + F.col("neg")
    before = F.when(n0 > 0, tp0 / n0).otherwise(1.0)
    return at.agg((F.sum(F.col("pos") * (before + tp1 / n1) / 2) / F.nullif(F.sum("pos"), F.lit(0.0))).alias("pr_auc"))


def brier_log(scored: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    ll = F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))
    return scored.agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg(ll).alias("log_score"))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    at = scored.withColumn("_b", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))).groupBy("_b").agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"))
    return at.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def fold_metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy, precision of both classes and macro recall per key from (y, pred)."""
    n = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    y, q = F.col("y"), F.col("pred")
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return pred.groupBy(*keys).agg(
        (n(y == q) / F.count("*")).alias("accuracy"), ratio(n((y == 1) & (q == 1)), n(q == 1)).alias("precision_1"), ratio(n((y == 0) & (q == 0)), n(q == 0)).alias("precision_0"),
        ((ratio(n((y == 1) & (q == 1)), n(y == 1)) + ratio(n((y == 0) & (q == 0)), n(y == 0))) / 2).alias("macro_recall"))


def regression(df: DataFrame, y: Column, p: Column, w: Column, keys: list[str]) -> DataFrame:
    """Weighted MAPE (by |y|), bias, MSE, MAE and R2 per key."""
    at = df.select(*keys, y.cast("double").alias("y"), p.cast("double").alias("p"), w.cast("double").alias("w"))
    e, W = F.col("p") - F.col("y"), F.sum("w")
    mean = lambda c: F.sum(F.col("w") * c) / W
    ss = mean(F.col("y") * F.col("y")) - mean(F.col("y")) * mean(F.col("y"))
    return at.groupBy(*keys).agg((100 * mean(F.abs(e) / F.nullif(F.abs("y"), F.lit(0.0)))).alias("mape"), mean(e).alias("bias"), mean(e * e).alias("mse"), mean(F.abs(e)).alias("mae"), (1 - mean(e * e) / F.nullif(ss, F.lit(0.0))).alias("r2"))
