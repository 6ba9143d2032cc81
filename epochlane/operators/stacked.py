"""Logistic models fitted together: all options, folds and shares of the data in one pass over the rows an iteration."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.functions.special import hashed_uniform
from epochlane.operators.ranking import rank_column

EPS = 1e-15
METRICS = ("accuracy", "macro_recall", "precision_1", "log_loss", "brier")


@dataclass(frozen=True)
class Model:
    """A penalised logistic model, the fold that it's tested on (-1: none), and the rows it may see of the others."""

    params: str
    reg: float = 0.01
    l1: float = 0.0
    fold: int = -1
    share: float = 1.0


@dataclass
class Fit:
    """Models with their weights, intercept last, and what fitting them took."""

    models: list[Model]
    weights: np.ndarray
    passes: int = 0
    seconds: float = 0.0
    sizes: list[int] = field(default_factory=list)


def ranked_folds(df: DataFrame, id_col: str, k: int, seed: int = 42) -> DataFrame:
    """df with place (0, 1, ... in an order by hash) and fold, which deals the places in turn.

    A fold's rows up to a place follow from the place, so every fold's training rows are ranked by it too."""
    at = rank_column(df.withColumn("_o", hashed_uniform(F.lit(seed), F.col(id_col))), [F.asc("_o"), F.asc(id_col)], "_r")
    return at.withColumn("place", F.col("_r") - 1).withColumn("fold", (F.col("place") % k).cast("int")).drop("_o", "_r")


def training_size(n: int, k: int, m: Model) -> int:
    """How many rows the model is fitted to: of n, without its fold, the share that comes first."""
    own = (n - m.fold + k - 1) // k if 0 <= m.fold < k else 0
    return int(m.share * (n - own) + 1e-9)


def _seen(place: np.ndarray, n: int, k: int, models: list[Model]) -> np.ndarray:
    """Whether each row (down) is a training row of each model (across)."""
    f = np.array([m.fold for m in models])[None, :]
    before = np.where(f >= 0, np.maximum(0, (place[:, None] - f + k - 1) // k), 0)
    own = (place[:, None] % k == f) & (f >= 0)
    return ~own & (place[:, None] - before < np.array([training_size(n, k, m) for m in models])[None, :])


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array(batch.column("x").to_pylist(), float)
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    return x, batch.column("y").to_numpy(zero_copy_only=False).astype(float), batch.column("place").to_numpy()


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _sums(rows: DataFrame, n: int, k: int, models: list[Model], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient and the Hessian of every model's mean loss. A task sends one row; the driver gets their sum, whose
    size is that of models times features squared."""
    size = weights.shape[1]
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros((len(models), size)), np.zeros((len(models), size, size))
        for batch in batches:
            x, y, place = _batch(batch)
            p, on = _sigmoid(x @ sent.value.T), _seen(place, n, k, models)
            g += (on * (p - y[:, None])).T @ x
            w = on * p * (1 - p)
            for j in range(len(models)):
                h[j] += (x * w[:, [j]]).T @ x
        flat = np.concatenate((g.reshape(-1), h.reshape(-1)))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat), dtype=np.int32)), "v": pa.array(flat)})

    found = rows.select("x", "y", "place").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(len(models) * size * (size + 1))
    flat[found["i"].to_numpy()] = found["v"].to_numpy()
    held = np.array([max(1, training_size(n, k, m)) for m in models], float)
    cut = len(models) * size
    return flat[:cut].reshape(len(models), size) / held[:, None], flat[cut:].reshape(len(models), size, size) / held[:, None, None]


def _step(m: Model, w: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The weights that minimise the penalised quadratic around w, by turns over the coordinates; no penalty on the intercept."""
    h = h + 1e-9 * np.eye(len(w))
    l1, l2 = np.full(len(w), m.reg * m.l1), np.full(len(w), m.reg * (1 - m.l1))
    l1[-1] = l2[-1] = 0.0
    if not l1.any():
        return w - np.linalg.solve(h + np.diag(l2), g + l2 * w)
    out, lin = w.copy(), g - h @ w
    for _ in range(200):
        last = out.copy()
        for j in range(len(w)):
            r = lin[j] + h[j] @ out - h[j, j] * out[j]
            out[j] = -np.sign(r) * max(abs(r) - l1[j], 0.0) / (h[j, j] + l2[j])
        if np.abs(out - last).max() < 1e-10:
            break
    return out


def fit(rows: DataFrame, models: list[Model], k: int, most_passes: int = 12, tolerance: float = 1e-7) -> Fit:
    """All models fitted to rows (x array, y 0 or 1, place, as ranked_folds() gives it), by Newton steps.

    Each iteration is one job, however many models there are; those that have settled are left out of the next."""
    began = time.perf_counter()
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    out = Fit(models, np.zeros((len(models), (head["d"] or 0) + 1)), sizes=[training_size(head["n"], k, m) for m in models])
    open_ = [j for j, size in enumerate(out.sizes) if size > 0]
    while open_ and out.passes < most_passes:
        g, h = _sums(rows, head["n"], k, [models[j] for j in open_], out.weights[open_])
        out.passes += 1
        after = np.stack([_step(models[j], out.weights[j], g[i], h[i]) for i, j in enumerate(open_)])
        moved = np.abs(after - out.weights[open_]).max(axis=1)
        out.weights[open_] = after
        open_ = [j for i, j in enumerate(open_) if moved[i] > tolerance]
    out.seconds = time.perf_counter() - began
    return out


def scores(rows: DataFrame, fitted: Fit, k: int) -> DataFrame:
    """(model, role, n, and METRICS): every model on its training rows and on the rows of its fold, in one pass.

    model: its place in fitted.models. A task sends one row a model and role."""
    n = rows.count()
    models, sent = fitted.models, rows.sparkSession.sparkContext.broadcast(fitted.weights)
    fields = ("n", "right", "p1", "t1", "y1", "t0", "loss", "square")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(fields), len(models)))
        for batch in batches:
            x, y, place = _batch(batch)
            p = _sigmoid(x @ sent.value.T)
            q, t = p >= 0.5, y[:, None] > 0.5
            own = place[:, None] % k == np.array([m.fold for m in models])[None, :]
            clipped = np.clip(np.where(t, p, 1 - p), EPS, 1)
            for r, on in enumerate((_seen(place, n, k, models), own)):
                for i, v in enumerate((np.ones_like(p), q == t, q, q & t, np.broadcast_to(t, p.shape), ~q & ~t, -np.log(clipped), (p - y[:, None]) ** 2)):
                    total[r, i] += (on * v).sum(axis=0)
        at = {"model": np.tile(np.arange(len(models), dtype=np.int32), 2), "role": np.repeat(["train", "test"], len(models))}
        yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in at.items()} | {c: pa.array(total[:, i].reshape(-1)) for i, c in enumerate(fields)})

    sums = rows.select("x", "y", "place").mapInArrow(run, "model int, role string, " + ", ".join(f"{c} double" for c in fields)).groupBy("model", "role").agg(*[F.sum(c).alias(c) for c in fields])
    c = {x: F.col(x) for x in fields}
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    size = F.nullif(c["n"], F.lit(0.0))
    return sums.select(
        "model", "role", c["n"].cast("long").alias("n"), (c["right"] / size).alias("accuracy"), ((share(c["t1"], c["y1"]) + share(c["t0"], c["n"] - c["y1"])) / 2).alias("macro_recall"),
        share(c["t1"], c["p1"]).alias("precision_1"), (c["loss"] / size).alias("log_loss"), (c["square"] / size).alias("brier"))


def named(found: DataFrame, fitted: Fit) -> DataFrame:
    """scores() with each model's params, fold, share and n_train."""
    names = found.sparkSession.createDataFrame([(j, m.params, m.fold, m.share, fitted.sizes[j]) for j, m in enumerate(fitted.models)], "model int, params string, fold int, share double, n_train long")
    return found.join(F.broadcast(names), "model")  # a row a model


def search(rows: DataFrame, options: list[Model], k: int) -> DataFrame:
    """(params, mean and deviation over folds of every test metric, mean of every training metric, rank): all options
    on the same folds, the best accuracy first; equal ones share a rank."""
    from pyspark.sql import Window

    fitted = fit(rows, [Model(m.params, m.reg, m.l1, f, m.share) for m in options for f in range(k)], k)
    at = named(scores(rows, fitted, k), fitted)
    on = lambda role, c: F.when(F.col("role") == role, F.col(c))
    out = at.groupBy("params").agg(
        *[F.avg(on("test", c)).alias(c) for c in METRICS], *[F.stddev_pop(on("test", c)).alias(f"{c}_std") for c in METRICS], *[F.avg(on("train", c)).alias(f"train_{c}") for c in METRICS])
    return out.withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.round("accuracy", 9)))))  # a row an option


def sampled(options: list[Model], n: int, seed: int) -> list[Model]:
    """n of the options, by a hash of seed and params: the same for the same seed, whatever their order."""
    import hashlib

    return sorted(options, key=lambda m: hashlib.md5(f"{seed}:{m.params}".encode()).hexdigest())[:n]


def curve(rows: DataFrame, option: Model, shares: list[float], k: int) -> DataFrame:
    """(share, fold, n_train, train and test accuracy and log loss): growing parts of every fold's training rows.

    A smaller share is the beginning of a larger one."""
    fitted = fit(rows, [Model(option.params, option.reg, option.l1, f, s) for s in shares for f in range(k)], k)
    return _both(named(scores(rows, fitted, k), fitted), ["share", "fold", "n_train"])


def validated(rows: DataFrame, options: list[Model], k: int) -> tuple[DataFrame, Fit]:
    """(params, fold, n_train, train and test scores) of every option and fold, and the fit."""
    fitted = fit(rows, [Model(m.params, m.reg, m.l1, f, m.share) for m in options for f in range(k)], k)
    return _both(named(scores(rows, fitted, k), fitted), ["params", "fold", "n_train"]), fitted


def _both(at: DataFrame, keys: list[str]) -> DataFrame:
    on = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    return at.groupBy(*keys).agg(on("test", "n").alias("n_test"), *[on(r, c).alias(f"{r}_{c}") for c in ("accuracy", "log_loss") for r in ("train", "test")])
