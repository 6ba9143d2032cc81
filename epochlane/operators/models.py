"""Classifiers with folds: Spark ML estimators, and nearest neighbours by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochlane.operators.metrics import fold_metrics
from epochlane.session import materialise


def vectors(df: DataFrame, col: str, label: str) -> DataFrame:
    return df.withColumns({"features": array_to_vector(F.transform(col, lambda x: x.cast("double"))), "y": F.col(label).cast("double")})


def logistic(reg: float = 0.01, l1: float = 0.0) -> Estimator:
    return LogisticRegression(labelCol="y", regParam=reg, elasticNetParam=l1, maxIter=50)


def linear_svc(reg: float = 0.01) -> Estimator:
    return LinearSVC(labelCol="y", regParam=reg, maxIter=30)


def tree(depth: int = 4) -> Estimator:
    return DecisionTreeClassifier(labelCol="y", maxDepth=depth, seed=42)


def perceptron(layers: list[int]) -> Estimator:
    return MultilayerPerceptronClassifier(labelCol="y", layers=layers, seed=42, maxIter=60)


def out_of_fold(df: DataFrame, make: Callable[[], Estimator], k: int) -> DataFrame:
    """Predictions of every row by the model of the other folds; df: features, y, fold. One fit a fold."""
    df = materialise(df)
    parts = [make().fit(df.where(F.col("fold") != i)).transform(df.where(F.col("fold") == i)).withColumn("pred", F.col("prediction").cast("int")) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def cv_scores(df: DataFrame, make: Callable[[], Estimator], k: int) -> DataFrame:
    return fold_metrics(out_of_fold(df, make, k), ["fold"])


def principal_components(df: DataFrame, k: int) -> tuple[DataFrame, list[float]]:
    """df with `components`, the k first of the centred features, and their shares of variance.

    Spark's PCA centres by the covariance but not the projection, so the projected mean is taken off.
    Each axis points to where its largest loading is positive."""
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(df)
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)]).tolist()
    at = model.transform(df).withColumn("_pc", vector_to_array("_pc"))
    mean = at.agg(*[F.avg(F.get("_pc", F.lit(i))).alias(f"_m{i}") for i in range(k)]).withColumn("_", F.lit(0))
    out = at.withColumn("_", F.lit(0)).join(F.broadcast(mean), "_")
    out = out.withColumn("components", F.array(*[(F.get("_pc", F.lit(i)) - F.col(f"_m{i}")) * signs[i] for i in range(k)])).drop("_", "_pc", *[f"_m{i}" for i in range(k)])
    return out, model.explainedVariance.toArray().tolist()


def components_for(explained: list[float], share: float) -> int:
    """How many leading components hold at least `share` of the variance; all if none does."""
    held = np.cumsum(explained) >= share - 1e-12
    return int(held.argmax()) + 1 if held.any() else len(explained)


def principal_components_for(df: DataFrame, share: float, most: int) -> tuple[DataFrame, list[float]]:
    """principal_components() with as many of up to `most` components as hold `share` of the variance.

    The axes of fewer components are the leading ones of more, so one fit decides and the rest is cut."""
    out, explained = principal_components(df, most)
    k = components_for(explained, share)
    return out.withColumn("components", F.slice("components", 1, k)), explained[:k]


METRICS = {
    "euclidean": lambda a, b: np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)),
    "manhattan": lambda a, b: np.stack([np.abs(b - x).sum(1) for x in a]),
    "chebyshev": lambda a, b: np.stack([np.abs(b - x).max(1) for x in a]),
    "cosine": lambda a, b: 1 - (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)) @ (b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)).T,
}


#: The same distances of rows of a to rows of b, one by one.
ROW_METRICS = {
    "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(1)),
    "manhattan": lambda a, b: np.abs(a - b).sum(1),
    "chebyshev": lambda a, b: np.abs(a - b).max(1),
    "cosine": lambda a, b: 1 - (a * b).sum(1) / (np.maximum(np.linalg.norm(a, axis=1), 1e-12) * np.maximum(np.linalg.norm(b, axis=1), 1e-12)),
}
#: Blocks of a side of knn() while they have MOST_ROWS or fewer, and the rows of either side whose distances are in memory at a time.
SIDE, MOST_ROWS, TILE = 8, 100_000, (512, 4096)


def n_blocks(rows: int, rows_per_block: int) -> int:
    """The number of blocks of so many rows: SIDE at most, so that what is sent grows with the rows, unless blocks get too large."""
    return max(1, min(-(-rows // rows_per_block), SIDE), -(-rows // max(rows_per_block, MOST_ROWS)))


def _nearest(x: np.ndarray, y: np.ndarray, k: int, metric: str, parted: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of each row's k nearest rows of y; of equally near ones the first.

    Tiles of distances give candidates, a little more than k; their distances are taken again one by one, so equal rows tie."""
    found = []
    for i in range(0, len(x), TILE[0]):
        best = None
        for j in range(0, len(y), TILE[1]):
            dist = METRICS[metric](x[i : i + TILE[0]], y[j : j + TILE[1]])
            if parted:
                dist[parted[0][i : i + TILE[0], None] == parted[1][j : j + TILE[1]]] = np.inf
            kth = np.partition(dist, min(k, dist.shape[1]) - 1, axis=1)[:, min(k, dist.shape[1]) - 1]
            at = np.nonzero((dist <= (kth + 1e-6 * (1 + np.abs(kth)))[:, None]) & np.isfinite(dist))
            rows = at[0] + i, at[1] + j, ROW_METRICS[metric](x[at[0] + i], y[at[1] + j])
            row, other, d = rows if best is None else (np.concatenate(p) for p in zip(best, rows, strict=True))
            order = np.lexsort((other, d, row))
            row, other, d = row[order], other[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = row[place < k], other[place < k], d[place < k]
        found.append(best)
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def knn(train: DataFrame, test: DataFrame, k: int, metric: str = "euclidean", weights: str = "uniform", rows_per_block: int = 2000, apart: str | None = None) -> DataFrame:
    """(id, pred): the label with most (or, by 1 / distance, heaviest) votes of the k nearest train rows.

    train: id, v (array), label; test: id, v. Rows with the same value of column `apart` in both, a
    fold for instance, are no neighbours. Ties in distance go to the smaller id, in votes to the
    smaller label. Blocks of test rows meet blocks of train rows; each pair sends k candidates a row. The work is that of all
    pairs; what is sent, n_blocks() copies of a row, isn't."""
    n, m = (n_blocks(df.count(), rows_per_block) for df in (train, test))
    block = lambda df, col, size: df.withColumn(col, F.pmod(F.xxhash64("id"), F.lit(size)).cast("int"))
    extra = [apart] if apart else []
    a = block(test, "tb", m).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(*[F.col(c).alias(c) for c in ("tb", "rb", "id", "v", *extra)])
    b = block(train, "rb", n).withColumn("tb", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(*[F.col(c).alias(c) for c in ("tb", "rb", "id", "v", "label", *extra)])

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "other": [], "label": [], "dist": []}).astype({"id": "int64", "other": "int64", "label": "int32", "dist": "float64"})
        right = right.sort_values("id")
        x, y = (np.array(s.tolist(), float) for s in (left["v"], right["v"]))
        row, other, dist = _nearest(x, y, k, metric, (left[apart].to_numpy(), right[apart].to_numpy()) if apart else None)
        return pd.DataFrame({"id": left["id"].to_numpy()[row], "other": right["id"].to_numpy()[other], "label": right["label"].to_numpy()[other], "dist": dist})

    found = a.groupBy("tb", "rb").cogroup(b.groupBy("tb", "rb")).applyInPandas(near, "id long, other long, label int, dist double")
    top = found.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))).where(F.col("_k") <= k)
    vote = F.count("*").cast("double") if weights == "uniform" else F.sum(1 / F.greatest("dist", F.lit(1e-12)))
    votes = top.groupBy("id", "label").agg(vote.alias("w"))
    return votes.groupBy("id").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("pred"))
