"""Logistic regression on pair features that are never stored.

A pass reads compact pairs (text vector, place of the label, 0/1) and builds what it
needs of a batch in memory: the text t, its label l and their product, from which all
feature modes follow by one fixed matrix, as t - l is linear in both. Each pass adds up
the loss, the gradient and the curvature; Newton's method needs a handful of them. What
reaches the driver depends on the width of the vectors alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_fit import summed

ROWS = 4096


@dataclass
class PairWeights:
    """Coefficients of the pair features, in their order, and the intercept."""

    coefficients: DenseVector
    intercept: float


def spread(width: int, mode: str) -> np.ndarray:
    """The matrix that makes [features, 1] of [t, l, t * l, 1]."""
    one = np.eye(width)
    none = np.zeros((width, width))
    columns = []
    if "concat" in mode:
        columns += [np.vstack([one, none, none]), np.vstack([none, one, none])]
    if "diff" in mode:
        columns.append(np.vstack([one, -one, none]))
    if "prod" in mode:
        columns.append(np.vstack([none, none, one]))
    made = np.hstack(columns)
    out = np.zeros((3 * width + 1, made.shape[1] + 1))
    out[:-1, :-1], out[-1, -1] = made, 1
    return out


def compact(train: DataFrame) -> DataFrame:
    """(vector, label_idx, label) of training pairs; pairs without vector teach nothing."""
    return train.filter("vector is not null").select(
        F.col("vector").cast("array<double>").alias("vector"), F.col("label_idx").cast("int").alias("label_idx"), "label"
    )


def _read(labels: np.ndarray):
    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, labels.shape[1])
        return t, labels[b.column(1).to_numpy()], b.column(2).to_numpy()

    return read


def class_weights(pairs: DataFrame, balanced: bool = True) -> tuple[int, float, float]:
    """Number of pairs and the weight of a positive and of a negative one; 0 if there is none."""
    counts = {r["label"]: r["n"] for r in pairs.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    up, down = ((n / (2 * counts[k]) if balanced else 1.0) if counts.get(k) else 0.0 for k in (1.0, 0.0))
    return n, up, down


def _sides(t: np.ndarray, l: np.ndarray) -> np.ndarray:
    return np.column_stack([t, l, t * l, np.ones(len(t))])


def _loss_sums(pairs: DataFrame, labels: np.ndarray, w: np.ndarray, up: float, down: float) -> np.ndarray:
    """Loss, gradient and curvature at the weights ``w`` of [t, l, t * l, 1]."""
    size = len(w)

    def part(t, l, y):
        out = np.zeros(1 + size + size * size)
        for a in range(0, len(t), ROWS):
            x, ys = _sides(t[a : a + ROWS], l[a : a + ROWS]), y[a : a + ROWS]
            z = x @ w
            weight = np.where(ys > 0, up, down)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            out[0] += (weight * np.logaddexp(0, np.where(ys > 0, -z, z))).sum()
            out[1 : 1 + size] += x.T @ (weight * (p - ys))
            out[1 + size :] += ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()
        return out

    return summed(pairs, part, 1 + size + size * size, _read(labels))


def slope(pairs: DataFrame, labels: np.ndarray, mode: str, found: PairWeights, C: float, balanced: bool) -> np.ndarray:
    """Gradient of C times the weighted loss plus half the squared weights; zero at the optimum."""
    labels = np.asarray(labels, float)
    _, up, down = class_weights(pairs, balanced)
    made, at = spread(labels.shape[1], mode), np.append(found.coefficients.toArray(), found.intercept)
    sums = _loss_sums(pairs, labels, made @ at, up, down)
    return C * made.T @ sums[1 : 1 + len(made)] + np.append(at[:-1], 0.0)


def fit(
    pairs: DataFrame,
    labels: np.ndarray,
    mode: str,
    C: float = 1.0,
    balanced: bool = True,
    max_iter: int = 1000,
    tol: float = 1e-8,
) -> tuple[PairWeights, list[float]] | None:
    """Weights and the objective per pass; None without pairs of two classes.

    ``pairs`` comes from ``compact`` and is read once a pass. The objective is the mean
    weighted loss and half the squared weights over C n.
    """
    labels = np.asarray(labels, float)
    n, up, down = class_weights(pairs, balanced)
    if not up * down:
        return None
    made = spread(labels.shape[1], mode)
    size, features = made.shape
    keep = np.append(np.ones(features - 1), 0.0)  # the intercept is free
    at, step, base, best = np.zeros(features), np.zeros(features), np.zeros(features), np.inf
    curve = []
    for _ in range(max_iter):
        sums = _loss_sums(pairs, labels, made @ at, up, down)
        value = C * sums[0] + 0.5 * (keep * at * at).sum()
        curve.append(float(value / (C * n)))
        if value > best + 1e-9 * abs(best) and np.abs(step).max() > tol:
            step /= 2  # too far
            curve.pop()
        else:
            base, best = at, value
            slope = C * made.T @ sums[1 : 1 + size] + keep * at
            curved = C * made.T @ sums[1 + size :].reshape(size, size) @ made + np.diag(keep + 1e-10)
            step = -np.linalg.solve(curved, slope)
        if np.abs(step).max() < tol:
            break
        at = base + step
    return PairWeights(DenseVector(base[:-1]), float(base[-1])), curve


@dataclass
class PairAxes:
    """Mean, principal axes (as columns) and variances of the pair features."""

    labels: np.ndarray
    mode: str
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float

    def project(self, vector: str, label_idx: str):
        """Column expression: a pair's features, centred, on the axes; null without a vector."""

        @F.arrow_udf("array<double>")
        def projected(t: pa.Array, place: pa.Array) -> pa.Array:
            known = t.is_valid().to_numpy(zero_copy_only=False)
            values = t.drop_null()
            x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.labels.shape[1])
            l = self.labels[place.to_numpy(zero_copy_only=False)[known].astype(int)]
            made = spread(self.labels.shape[1], self.mode)[:, :-1]
            found = [(_sides(x[a : a + ROWS], l[a : a + ROWS]) @ made - self.mean) @ self.axes for a in range(0, len(x), ROWS)]
            width = self.axes.shape[1]
            offsets = np.concatenate([[0], np.cumsum(known * width)]).astype(np.int32)
            flat = np.concatenate([np.empty((0, width)), *found]).ravel()
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~known))

        return projected(F.col(vector), F.col(label_idx))


def axes(pairs: DataFrame, labels: np.ndarray, mode: str, k: int) -> PairAxes:
    """PCA of the features of ``compact`` pairs, from one pass over the vectors.

    The covariance of [t, l, t * l] gives that of all feature modes. ``k`` is kept between
    2 and the data's own size; the largest entry of an axis is positive.
    """
    labels = np.asarray(labels, float)
    size = 3 * labels.shape[1] + 1

    def part(t, l, y):
        out = np.zeros((size, size))
        for a in range(0, len(t), ROWS):
            x = _sides(t[a : a + ROWS], l[a : a + ROWS])
            out += x.T @ x
        return out.ravel()

    sums = summed(pairs, part, size * size, _read(labels)).reshape(size, size)
    n, made = sums[-1, -1], spread(labels.shape[1], mode)[:, :-1]
    if not n:
        raise ValueError("no pairs with vectors")
    mean = sums[-1] / n
    covariance = made.T @ (sums - n * np.outer(mean, mean)) @ made / max(1, n - 1)
    variances, found = np.linalg.eigh(covariance)
    k = max(2, min(k, len(variances), int(n)))
    found = found[:, ::-1][:, :k]
    found = found * np.sign(found[np.abs(found).argmax(0), np.arange(found.shape[1])])
    return PairAxes(labels, mode, mean @ made, found, variances[::-1][:k], float(np.trace(covariance)))
