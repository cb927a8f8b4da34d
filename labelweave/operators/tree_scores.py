"""Boosted trees as flat arrays, walked for whole batches of texts against all labels.

Nothing is exploded: a batch of rows brings its vectors, and for one label after the
other their pair features exist for that batch only. All trees take a step together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose features a task holds at once.
ROWS = 4096
_IF = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"Predict: (\S+)")
_TREE = re.compile(r"Tree \d+ \(weight (\S+)\):")


def batch_features(text: np.ndarray, label: np.ndarray, mode: str) -> np.ndarray:
    """Pair features of rows with one label, or with a label per row, as ``pair_features`` has them."""
    label = np.broadcast_to(label, text.shape)
    parts = []
    if "concat" in mode:
        parts += [text, label]
    if "diff" in mode:
        parts.append(text - label)
    if "prod" in mode:
        parts.append(text * label)
    return np.concatenate(parts, axis=1)


@dataclass
class FlatTrees:
    """Nodes of all trees. A leaf is its own child, so a walk may go on past it."""

    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int
    mean: np.ndarray | None = None
    axes: np.ndarray | None = None

    @classmethod
    def of(cls, fitted: PipelineModel) -> FlatTrees:
        """The trees of a fitted pipeline, with the projection before them, if any."""
        feature, threshold, children, value, roots, weights = [], [], [], [], [], []
        open_: list[int] = []  # nodes that still lack a child
        depth = 0
        for line in fitted.stages[-1].toDebugString.splitlines():
            if tree := _TREE.search(line):
                roots.append(len(feature))
                weights.append(float(tree[1]))
                continue
            split, leaf = _IF.search(line), _LEAF.search(line)
            if not (split or leaf):
                continue
            node = len(feature)
            if open_:
                above = children[open_[-1]]
                above.append(node)
                if len(above) == 2:
                    open_.pop()
            feature.append(int(split[1]) if split else 0)
            threshold.append(float(split[2]) if split else np.inf)
            value.append(0.0 if split else float(leaf[1]))
            children.append([] if split else [node, node])
            if split:
                open_.append(node)
        found = cls(
            np.array(feature), np.array(threshold), np.array(children).reshape(-1, 2), np.array(value),
            np.array(roots), np.array(weights), 0,
        )
        at = found.roots
        while (found.children[at, 0] != at).any():
            at = np.unique(found.children[at])
            depth += 1
        found.depth = depth
        if len(fitted.stages) > 1:
            centred, pca = fitted.stages[0].stages
            found.mean, found.axes = centred.mean.toArray(), pca.pc.toArray()
        return found

    def leaves(self, features: np.ndarray) -> np.ndarray:
        """Weighted value of each row (first axis) in each tree."""
        if self.axes is not None:
            features = (features - self.mean) @ self.axes
        at = np.broadcast_to(self.roots, (len(features), len(self.roots)))
        row = np.arange(len(features))[:, None]
        for _ in range(self.depth):
            right = features[row, self.feature[at]] > self.threshold[at]
            at = self.children[at, right.astype(np.int8)]
        return self.value[at] * self.weights

    def probabilities(self, text: np.ndarray, labels: np.ndarray, mode: str) -> np.ndarray:
        """Match probability of each row with each label."""
        out = np.empty((len(text), len(labels)))
        for a in range(0, len(text), ROWS):
            some = text[a : a + ROWS]
            for i, label in enumerate(labels):
                margin = self.leaves(batch_features(some, label, mode)).sum(1)
                out[a : a + ROWS, i] = 1 / (1 + np.exp(-2 * margin))
        return out


def tree_scores(trees: FlatTrees, labels: np.ndarray, mode: str, vector: str | Column) -> Column:
    """Array of match probabilities with all labels; null where the vector is."""
    labels = np.asarray(labels, float)

    @F.arrow_udf("array<double>")
    def score(column: pa.Array) -> pa.Array:
        known = column.is_valid()
        vectors = column.drop_null()
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, labels.shape[1])
        found = trees.probabilities(values, labels, mode)
        lengths = np.where(known.to_numpy(zero_copy_only=False), len(labels), 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(found.ravel()), mask=pc.invert(known)
        )

    return score(F.col(vector) if isinstance(vector, str) else vector)


def loss_by_round(trees: FlatTrees, pairs: DataFrame) -> np.ndarray:
    """Mean loss after each tree over pairs (label, features as an array), in one pass."""
    n = len(trees.roots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(n), 0
        for b in batches:
            sign = 2 * b.column("label").to_numpy() - 1
            x = b.column("features").flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(b.num_rows, -1) if b.num_rows else x
            for a in range(0, b.num_rows, ROWS):
                margin = np.cumsum(trees.leaves(x[a : a + ROWS]), axis=1)
                total += 2 * np.logaddexp(0, -2 * sign[a : a + ROWS, None] * margin).sum(0)
            rows += b.num_rows
        yield pa.record_batch([pa.array([rows]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "loss"])

    parts = pairs.select("label", "features").mapInArrow(run, "n long, loss array<double>")
    sums = parts.agg(F.sum("n").alias("n"), *[F.sum(F.col("loss")[i]).alias(f"l{i}") for i in range(n)]).first()
    return np.array([sums[f"l{i}"] for i in range(n)]) / max(1, sums["n"] or 0)
