"""Logistic regression with an effect for each subject and month, for any number of subjects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.session import discard, materialise

#: Deviations of the normal priors on the intercept and on a feature's weight; the least and greatest of an effect's deviation.
INTERCEPT, WEIGHT = 1.5, 1.0
LEAST_SIGMA, MOST_SIGMA = 0.05, 3.0
MONTHS = 12


def _eta(fixed: np.ndarray, x: np.ndarray, month: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log odds, a column a variant: intercept, effects of the twelve months, weights, and the subject's own effect."""
    return fixed[:, 0][None, :] + fixed[:, 1 : 1 + MONTHS].T[month - 1] + x @ fixed[:, 1 + MONTHS :].T + own


def _p(eta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(eta, -35, 35)))


def _arrays(batch: pa.RecordBatch, variants: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
    own = np.array([v or [0.0] * variants for v in batch.column("own").to_pylist()], float).reshape(batch.num_rows, variants)
    return x, batch.column("month").to_numpy(zero_copy_only=False).astype(int), own


def _fixed_sums(at: DataFrame, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-likelihood in the fixed part of every variant: a row a task, summed by Spark."""
    v, size = fixed.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros((v, size)), np.zeros((v, size, size))
        for batch in batches:
            x, month, own = _arrays(batch, v)
            p, y = _p(_eta(fixed, x, month, own)), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            full = np.concatenate((np.ones((len(x), 1)), np.eye(MONTHS)[month - 1], x), axis=1)
            g += (y[:, None] - p).T @ full
            for j in range(v):
                h[j] += (full * (p[:, j] * (1 - p[:, j]))[:, None]).T @ full
        flat = np.concatenate((g.reshape(-1), h.reshape(-1)))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(flat), dtype=np.int32)), "v": pa.array(flat)})

    found = at.select("x", "month", "own", "label").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(v * size * (size + 1))
    flat[found["i"].to_numpy()] = found["v"].to_numpy()
    return flat[: v * size].reshape(v, size), flat[v * size :].reshape(v, size, size)


def _subject_sums(at: DataFrame, fixed: np.ndarray) -> DataFrame:
    """(subject_id, own, g, h): for each subject and variant what is left to explain, and its information."""
    v = len(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, month, own = _arrays(batch, v)
            p, y = _p(_eta(fixed, x, month, own)), batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            lists = lambda a: pa.array(list(a), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"subject_id": batch.column("subject_id"), "own": lists(own), "g": lists(y[:, None] - p), "h": lists(p * (1 - p))})

    kind = at.schema["subject_id"].dataType.simpleString()
    rows = at.select("subject_id", "x", "month", "own", "label").mapInArrow(run, f"subject_id {kind}, own array<double>, g array<double>, h array<double>")
    total = lambda c: F.array(*[F.sum(F.get(c, F.lit(j))) for j in range(v)]).alias(c)
    return rows.groupBy("subject_id").agg(F.array(*[F.max(F.get("own", F.lit(j))) for j in range(v)]).alias("own"), total("g"), total("h"))


def fit(train: DataFrame, allowed: list[list[bool]], calendar: list[bool], rounds: int = 12, tolerance: float = 1e-4) -> tuple[np.ndarray, DataFrame]:
    """The fixed parts (a row a variant: intercept, months, weights) and the subjects' effects (subject_id, own array).

    train: subject_id, month (1 to 12), x (array), label (0 or 1). allowed: the features of each variant; calendar: whether it
    has effects of subjects and months. All variants are fitted at once, by turns: a Newton step for the fixed part, whose
    sums are few numbers, then one for every subject by its own two sums, grouped by Spark; so the subjects are a table of
    any length, and the features no more columns for it. The deviations of both kinds of effects are set from the effects and their
    errors each round. It ends when nothing moves by more than tolerance."""
    v, d = len(allowed), len(allowed[0])
    size = 1 + MONTHS + d
    fixed = np.zeros((v, size))
    may = np.array([[True] + [cal] * MONTHS + list(a) for a, cal in zip(allowed, calendar, strict=True)])
    sigma = np.ones((2, v))  # of subjects, of months
    train = materialise(train.select("subject_id", "month", "x", "label"))
    own = materialise(train.select("subject_id").distinct().withColumn("own", F.array(*[F.lit(0.0)] * v)))
    for _ in range(rounds):
        at = materialise(train.join(own, "subject_id"))
        g, h = _fixed_sums(at, fixed)
        moved = 0.0
        for j in range(v):
            prior = np.concatenate(([INTERCEPT**-2], np.full(MONTHS, sigma[1, j] ** -2), np.full(d, WEIGHT**-2)))
            on = may[j]
            inverse = np.linalg.inv((h[j] + np.diag(prior))[np.ix_(on, on)])
            step = inverse @ (g[j] - prior * fixed[j])[on]
            fixed[j, on] += step
            moved = max(moved, float(np.abs(step).max()))
            if calendar[j]:
                months = slice(1, 1 + MONTHS)
                errors = np.diag(inverse)[1 : 1 + MONTHS]
                sigma[1, j] = np.clip(np.sqrt((fixed[j, months] ** 2 + errors).mean()), LEAST_SIGMA, MOST_SIGMA)
        sums = _subject_sums(at, fixed)
        one = lambda j: F.get("own", F.lit(j))
        info = lambda j: F.get("h", F.lit(j)) + float(sigma[0, j] ** -2)
        new = [(one(j) + (F.get("g", F.lit(j)) - one(j) * float(sigma[0, j] ** -2)) / info(j)) if calendar[j] else F.lit(0.0) for j in range(v)]
        after = materialise(sums.select("subject_id", F.array(*new).alias("own"), F.array(*[1 / info(j) for j in range(v)]).alias("error"), F.col("own").alias("was")))
        seen = after.agg(*[F.avg(one(j) * one(j) + F.get("error", F.lit(j))).alias(f"s{j}") for j in range(v)], *[F.max(F.abs(one(j) - F.get("was", F.lit(j)))).alias(f"m{j}") for j in range(v)]).first()
        for j in range(v):
            if calendar[j] and seen[f"s{j}"] is not None:
                sigma[0, j] = np.clip(np.sqrt(seen[f"s{j}"]), LEAST_SIGMA, MOST_SIGMA)
                moved = max(moved, seen[f"m{j}"])
        discard(at, own)
        own = after.select("subject_id", "own")
        own.written_to = after.written_to
        if moved <= tolerance:
            break
    return fixed, own


def predict(rows: DataFrame, fixed: np.ndarray, own: DataFrame, variants: list[str]) -> DataFrame:
    """rows' (label, p) once for each variant; a subject that wasn't there in training has no effect of its own."""
    v = len(variants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, month, effect = _arrays(batch, v)
            p = _p(_eta(fixed, x, month, effect))
            yield pa.RecordBatch.from_pydict({"variant": pa.array(np.repeat(variants, len(x))), "y": pa.concat_arrays([pa.array(batch.column("label"))] * v).cast(pa.int32()), "p": pa.array(p.T.reshape(-1))})

    return rows.select("subject_id", "month", "x", "label").join(own.select("subject_id", "own"), "subject_id", "left").mapInArrow(run, "variant string, y int, p double")
