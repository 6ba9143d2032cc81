"""Models of the learning library against plain versions on the smallest tables."""

import numpy as np
from pyspark.sql import functions as F

from epochlane.operators import models
from epochlane.plans.all import QUERIES

DATA = "/root/testdata/sf0.001"


def test_principal_components_are_those_of_the_covariance(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x = x - x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes[:, ::-1][:, :3]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(3)])
    got = np.zeros((len(rows), 3))
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    for r in QUERIES["pca"](spark, DATA).collect():
        got[place[r["vec_id"]], r["component"]] = r["value"]
    assert np.abs(got - x @ axes).max() < 1e-4


def test_logistic_regression_finds_its_optimum(spark):
    """At the fit the gradient of the penalised loss, on features of unit deviation as the library scales them, vanishes."""
    rng = np.random.RandomState(5)
    x = rng.normal(size=(300, 3)) * [1.0, 2.0, 0.5]
    y = (rng.uniform(size=300) < 1 / (1 + np.exp(-(x @ [1.0, -0.4, 0.3])))).astype(int)
    df = models.vectors(spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, t int"), "x", "t")
    fit = models.logistic(0.05).fit(df)
    w, b = fit.coefficients.toArray(), fit.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    scale = x.std(axis=0, ddof=1)
    assert abs((p - y).mean()) < 1e-3 and np.abs(((p - y)[:, None] * x / scale).mean(axis=0) + 0.05 * w * scale).max() < 1e-3


def test_predictions_are_of_models_that_have_not_seen_the_fold(spark):
    df = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("x"), (F.col("id") % 2).cast("int").alias("t"), (F.col("id") % 3).cast("int").alias("fold"))
    out = models.out_of_fold(models.vectors(df, "x", "t").select("vec_id", "features", "y", "fold"), lambda: models.tree(5), 3)
    assert out.count() == 60 and out.select("vec_id").distinct().count() == 60
