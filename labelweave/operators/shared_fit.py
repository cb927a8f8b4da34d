"""Logistic regressions of many labels, penalties and folds, fitted in the same passes.

A pass over the rows adds up, for each label and each setting at once, the gradient,
the curvature and the loss at the weights of the step before; Newton's method then
moves all of them. Partial sums are one packed row per partition, added up in a few
groups before the driver sees them, so neither the number of passes nor what reaches
the driver grows with the rows. The sums take labels x settings x (width + 1)**2
numbers; labels are taken in groups so that they stay under ``SUMS_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS_BYTES = 32 << 20
#: Groups in which partial sums are added up on the way to the driver.
GROUPS = 8
NEVER = -1


@dataclass(frozen=True)
class Setting:
    """A penalty, and the fold that is left out (``NEVER`` for none)."""

    C: float
    held: int = NEVER


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors with a one behind, truth, folds."""
    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    y = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    return np.column_stack([x, np.ones(len(x))]), y.astype(float), b.column(2).to_numpy()


def summed(rows: DataFrame, part, size: int, read=_batch) -> np.ndarray:
    """Sum over all batches of the arrays that ``part`` gives for what ``read`` makes of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(*read(b))
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.record_batch([pa.array([group]), pa.array([total.tobytes()])], ["g", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in t.column("sums"))
        return pa.table([t.column("g")[:1], pa.array([total.tobytes()])], ["g", "sums"])

    schema = "g long, sums binary"
    found = rows.mapInArrow(run, schema).groupBy("g").applyInArrow(add, schema).collect()
    return sum((np.frombuffer(r["sums"]) for r in found), np.zeros(size))


def _probabilities(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w.T, -500, 500)))


def class_shares(rows: DataFrame, labels: int, settings: Sequence[Setting]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that each setting learns from, and positives among them per label."""
    per_fold = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("truth")[i]) for i in range(labels)]).alias("p")
    ).collect()
    n = np.array([sum(r["n"] for r in per_fold if r["fold"] != s.held) for s in settings], float)
    p = np.array([[sum(r["p"][i] for r in per_fold if r["fold"] != s.held) for i in range(labels)] for s in settings], float)
    return n, p.reshape(len(settings), labels)


def fit(
    rows: DataFrame,
    width: int,
    labels: int,
    settings: Sequence[Setting],
    balanced: bool = False,
    max_iter: int = 1000,
    tol: float = 1e-8,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (setting, label, width) and offsets (setting, label).

    ``rows`` has the columns vector (array<double>), truth (array<boolean>) and fold and
    is read once a pass. A label that is always or never true gets zero weights and
    an infinite offset.
    """
    n, positive = class_shares(rows, labels, settings)
    per_group = max(1, SUMS_BYTES // (8 * len(settings) * (width + 2) ** 2))
    weights = np.zeros((len(settings), labels, width + 1))
    for a in range(0, labels, per_group):
        some = slice(a, min(a + per_group, labels))
        weights[:, some] = _newton(rows, width, some, settings, n, positive[:, some], balanced, max_iter, tol)
    offsets = weights[:, :, -1]
    offsets[positive == 0] = -np.inf
    offsets[(positive == n[:, None]) & (positive > 0)] = np.inf
    return weights[:, :, :-1], offsets


def _newton(rows, width, some, settings, n, positive, balanced, max_iter, tol) -> np.ndarray:
    size, count = width + 1, some.stop - some.start
    held = np.array([s.held for s in settings])
    strength = np.array([s.C for s in settings])
    fixed = (positive == 0) | (positive == n[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(balanced & ~fixed, n[:, None] / (2 * positive), 1.0)
        down = np.where(balanced & ~fixed, n[:, None] / (2 * (n[:, None] - positive)), 1.0)
    keep = np.append(np.ones(width), 0.0)  # the offset is free
    at = np.zeros((len(settings), count, size))
    step, best = np.zeros_like(at), np.full((len(settings), count), np.inf)
    base, done = at.copy(), fixed.copy()
    each = 1 + size + size * size

    for _ in range(max_iter):
        if done.all():
            break
        w, open_ = at.copy(), ~done

        def part(x, y, fold, w=w, open_=open_):
            out = np.zeros((len(held), count, each))
            for s in np.flatnonzero(open_.any(1)):
                use = fold != held[s]
                xs, ys = x[use], y[use, some]
                p = _probabilities(xs, w[s])
                weight = np.where(ys > 0, up[s], down[s])
                with np.errstate(divide="ignore", invalid="ignore"):
                    loss = -np.log(np.maximum(np.where(ys > 0, p, 1 - p), 1e-300))
                out[s, :, 0] = (weight * loss).sum(0)
                out[s, :, 1 : 1 + size] = (weight * (p - ys)).T @ xs
                curve = weight * p * (1 - p)
                for k in np.flatnonzero(open_[s]):
                    out[s, k, 1 + size :] = ((xs * curve[:, k : k + 1]).T @ xs).ravel()
            return out.ravel()

        sums = summed(rows, part, len(held) * count * each).reshape(len(held), count, each)
        for s, k in zip(*np.nonzero(open_)):
            here = at[s, k]
            value = strength[s] * sums[s, k, 0] + 0.5 * (keep * here * here).sum()
            if value > best[s, k] + 1e-9 * abs(best[s, k]) and np.abs(step[s, k]).max() > tol:
                step[s, k] /= 2  # too far
            else:
                base[s, k], best[s, k] = here, value
                slope = strength[s] * sums[s, k, 1 : 1 + size] + keep * here
                curve = strength[s] * sums[s, k, 1 + size :].reshape(size, size) + np.diag(keep + 1e-10)
                step[s, k] = -np.linalg.solve(curve, slope)
            if np.abs(step[s, k]).max() < tol:
                done[s, k] = True
            at[s, k] = base[s, k] + step[s, k]
    return np.where(fixed[:, :, None], 0.0, at)


def held_out_counts(
    rows: DataFrame, weights: np.ndarray, offsets: np.ndarray, settings: Sequence[Setting], threshold: float
) -> np.ndarray:
    """Right, wrong and missed labels (setting, 3) of each setting on the fold it left out."""

    def part(x, y, fold):
        out = np.zeros((len(settings), 3))
        for s, setting in enumerate(settings):
            use = fold == setting.held
            logits = x[use, :-1] @ weights[s].T + offsets[s]
            said, true = 1 / (1 + np.exp(-np.clip(logits, -500, 500))) >= threshold, y[use] > 0
            out[s] = (said & true).sum(), (said & ~true).sum(), (~said & true).sum()
        return out.ravel()

    return summed(rows, part, len(settings) * 3).reshape(-1, 3)
