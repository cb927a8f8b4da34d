"""Models on tables: label-wise and pair-wise classifiers, PCA, grids, evaluation.

Fits of one model per label share their passes over the rows (``shared_fit``); pair
models are Spark ML jobs. Scoring with a linear model never builds the pair
table: for a fixed label the pair logit is linear in the text vector, so all
labels of a text are one small matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import pair_features, score_against, sigmoid
from ..session import ensure_checkpoint_dir
from . import metrics, pair_fit, pairs, shared_fit
from .frames import stacked
from .ranking import contiguous_folds
from .scoring import LabelSide, long_scores, similarity_rows, truth_array
from .tree_scores import FlatTrees, loss_by_round, tree_scores


#: Rows that a boosting task has at least, if there are enough, and feature values at most.
LEAST_ROWS, MOST_VALUES = 4096, 1 << 24


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """Spark ML vector next to an array column."""
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def linear_scores(weights: np.ndarray, offsets: Sequence[float], vector: str) -> Column:
    """Array of probabilities: sigmoid of the linear scores of a vector."""
    logits = score_against(np.asarray(weights))(F.col(vector))
    shift = F.lit(np.asarray(offsets, dtype=np.float64))
    return F.zip_with(logits, shift, lambda x, o: sigmoid(x + o))


# -- one model per label ---------------------------------------------------------


@dataclass
class LabelwiseModel:
    """One logistic regression per class on the text vector."""

    side: LabelSide
    weights: np.ndarray
    offsets: list[float]
    threshold: float = 0.5

    def score_rows(self, df: DataFrame, vector: str = "vector", out: str = "scores") -> DataFrame:
        return df.withColumn(out, linear_scores(self.weights, self.offsets, vector))


def fold_rows(df: DataFrame, side: LabelSide, vector: str, labels: str, fold: Column | None = None) -> DataFrame:
    """What ``shared_fit`` reads; rows without vector teach nothing."""
    return df.filter(F.col(vector).isNotNull()).select(
        F.col(vector).cast("array<double>").alias("vector"),
        truth_array(labels, side).alias("truth"),
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
    )


def _width(rows: DataFrame) -> int:
    first = rows.first()
    return 0 if first is None else len(first["vector"])


def fit_labelwise(
    df: DataFrame,
    side: LabelSide,
    vector: str = "vector",
    labels: str = "labels",
    C: float = 1.0,
    max_iter: int = 1000,
    balanced: bool = False,
) -> LabelwiseModel:
    """Independent L2 models of all labels, fitted in the same passes over the rows."""
    rows = fold_rows(df, side, vector, labels).persist()
    try:
        setting = [shared_fit.Setting(C)]
        weights, offsets = shared_fit.fit(rows, _width(rows), len(side), setting, balanced, max_iter)
    finally:
        rows.unpersist()
    return LabelwiseModel(side, weights[0], offsets[0].tolist())


def grid_search(
    df: DataFrame,
    side: LabelSide,
    row_id: str,
    grid: Sequence[float],
    cv: int = 3,
    vector: str = "vector",
    labels: str = "labels",
    max_iter: int = 1000,
    balanced: bool = False,
) -> tuple[LabelwiseModel, float, float, list[tuple[float, float]]]:
    """C with the best mean micro F1 over contiguous folds; the first wins a tie.

    Every C is fitted without each fold and on all rows, all in the same passes. Returns
    the model of all rows with the best C, that C, its score and all scores.
    """
    folded = contiguous_folds(df, row_id, cv)
    rows = fold_rows(folded, side, vector, labels, F.col("fold")).persist()
    settings = [shared_fit.Setting(C, k) for C in grid for k in (*range(cv), shared_fit.NEVER)]
    try:
        weights, offsets = shared_fit.fit(rows, _width(rows), len(side), settings, balanced, max_iter)
        threshold = LabelwiseModel(side, weights[0], []).threshold
        counts = shared_fit.held_out_counts(rows, weights, offsets, settings, threshold)
    finally:
        rows.unpersist()
    tp, fp, fn = counts.reshape(len(grid), cv + 1, 3)[:, :cv].transpose(2, 0, 1)
    f1 = np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros_like(tp), where=2 * tp + fp + fn > 0).mean(1)
    scores = [(float(C), float(s)) for C, s in zip(grid, f1)]
    best = int(f1.argmax())
    place = best * (cv + 1) + cv
    model = LabelwiseModel(side, weights[place], offsets[place].tolist())
    return model, scores[best][0], scores[best][1], scores


# -- one model for all pairs -----------------------------------------------------


@dataclass
class CosineModel:
    """Similarity to the label vectors; stands in until a model is fitted."""

    side: LabelSide
    threshold: float = 0.5

    def score_rows(self, df: DataFrame, vector: str = "vector", out: str = "scores") -> DataFrame:
        return similarity_rows(df, self.side, vector, out)


@dataclass
class LinearPairModel:
    """Logistic regression on pair features, folded into one row per label."""

    side: LabelSide
    mode: str
    fitted: pair_fit.PairWeights
    threshold: float = 0.5
    loss_curve: list[float] = field(default_factory=list)

    def folded(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and offset per label, so that logit = w_label . text + b_label.

        With features [t, l], t - l and t * l the parts of the coefficients act
        on t directly, on l as a constant, or on t scaled by l.
        """
        label = self.side.matrix
        d = label.shape[1]
        rest = self.fitted.coefficients.toArray()
        weights = np.zeros_like(label)
        offsets = np.full(len(label), self.fitted.intercept)
        if "concat" in self.mode:
            on_text, on_label, rest = rest[:d], rest[d : 2 * d], rest[2 * d :]
            weights += on_text
            offsets += label @ on_label
        if "diff" in self.mode:
            on_diff, rest = rest[:d], rest[d:]
            weights += on_diff
            offsets -= label @ on_diff
        if "prod" in self.mode:
            weights += label * rest[:d]
        return weights, offsets

    def score_rows(self, df: DataFrame, vector: str = "vector", out: str = "scores") -> DataFrame:
        weights, offsets = self.folded()
        return df.withColumn(out, linear_scores(weights, offsets, vector))

    def pair_scores(self, pairs: DataFrame) -> DataFrame:
        """Training pairs with the match probability as ``score``."""
        return self.score_rows(pairs, "vector", "_all").withColumn("score", F.col("_all")[F.col("label_idx")]).drop("_all")


@dataclass
class BoostedPairModel:
    """Boosted trees on (optionally projected) pair features."""

    side: LabelSide
    mode: str
    fitted: PipelineModel
    threshold: float = 0.5
    loss_curve: list[float] = field(default_factory=list)

    def pair_scores(self, pairs: DataFrame) -> DataFrame:
        """Training pairs with the match probability as ``score``."""
        scored = self.fitted.transform(pairs.filter("features is not null"))
        return scored.withColumn("score", vector_to_array("probability")[1])

    def score_rows(self, df: DataFrame, vector: str = "vector", out: str = "scores") -> DataFrame:
        """Arrays of scores, null without a vector; neither pairs nor a shuffle are made."""
        trees = FlatTrees.of(self.fitted)
        return df.withColumn(out, tree_scores(trees, self.side.matrix, self.mode, vector))


def training_pairs(
    df: DataFrame,
    side: LabelSide,
    row_id: str,
    vector: str = "vector",
    labels: str = "labels",
    n_neg: int = 3,
    seed: int = 42,
    mode: str = "concat+diff+prod",
) -> DataFrame:
    """Sampled pairs: ``label`` (double), ``features`` (vector), and what these are made of,
    ``vector`` and ``label_idx``. Who does not read the features does not have them made."""
    sampled = pairs.contrastive_pairs(df, side.keys, row_id, labels, n_neg, seed, keep=[vector])
    placed = sampled.withColumn("label_idx", F.array_position(F.lit(list(side.keys)), F.col("label_key")).cast("int") - 1)
    featured = pairs.featured_pairs(pairs.with_label_vectors(placed, side), mode, vector, "_f")
    return featured.select(
        row_id,
        "label_key",
        F.col(vector).alias("vector"),
        "label_idx",
        F.col("label").cast("double").alias("label"),
        F.when(F.col(vector).isNotNull(), array_to_vector("_f")).alias("features"),
    )


def enough_pairs(train: DataFrame) -> bool:
    """At least two pairs of two classes."""
    return train.agg(F.count_distinct("label")).first()[0] == 2


def fit_linear_pairs(
    train: DataFrame,
    side: LabelSide,
    mode: str = "concat+diff+prod",
    C: float = 1.0,
    max_iter: int = 1000,
    balanced: bool = True,
) -> LinearPairModel | None:
    """Balanced pair regression; None when there is nothing to learn from."""
    compact = pair_fit.compact(train).persist()
    try:
        found = pair_fit.fit(compact, side.matrix, mode, C, balanced, max_iter)
    finally:
        compact.unpersist()
    if found is None:
        return None
    weights, curve = found
    return LinearPairModel(side, mode, weights, loss_curve=curve)


def centred_pca(train: DataFrame, k: int, out: str = "projected", features: str = "features") -> PipelineModel:
    """PCA on centred features with ``k`` kept between 2 and the data's own size."""
    first = train.select(features).first()
    n = train.count()
    k = max(2, min(k, len(first[0]), n))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred")
    centred = scaler.fit(train)
    pca = PCA(k=k, inputCol="_centred", outputCol=out).fit(centred.transform(train))
    return PipelineModel([centred, pca])


def dealt_for_rounds(rows: DataFrame, width: int) -> DataFrame:
    """Rows dealt evenly to one partition a core, or to more where these would be large, and written.

    A pass of boosting is short, so what it takes is the start of its tasks. These are as
    many as the partitions, and each brings the lineage along, which the checkpoint cuts.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    few = max(1, min(cores, n // LEAST_ROWS))
    return rows.repartition(max(few, math.ceil(n * width / MOST_VALUES))).checkpoint()


def boosting_rounds(epochs: int, trees_per_epoch: int) -> int:
    """Boosting rounds of so many epochs, of which there is at least one."""
    return max(epochs, 1) * trees_per_epoch


def fit_boosted_pairs(
    train: DataFrame,
    side: LabelSide,
    mode: str = "concat+diff+prod",
    rounds: int = 200,
    max_depth: int = 6,
    learning_rate: float = 0.1,
    seed: int = 42,
    pca_components: int | None = None,
    validation: DataFrame | None = None,
    early_stopping: bool = False,
    extra: Mapping[str, object] | None = None,
) -> BoostedPairModel | None:
    """Gradient-boosted trees on pairs; None when there is nothing to learn from.

    ``rounds`` may come from ``boosting_rounds``; ``extra`` names further settings of
    Spark's classifier. With ``early_stopping`` the rounds are cut where the loss of the
    validation table stops falling; without it that table changes nothing.
    """
    if early_stopping and validation is None:
        raise ValueError("early stopping needs a validation table")
    train = train.filter("features is not null").persist()
    try:
        if not enough_pairs(train):
            return None
        stages = []
        features = "features"
        rows = train
        if pca_components is not None:
            projection = centred_pca(train, pca_components)
            rows = projection.transform(train)
            stages.append(projection)
            features = "projected"
        boosted = GBTClassifier(
            featuresCol=features,
            labelCol="label",
            maxIter=max(1, rounds),
            maxDepth=max_depth,
            stepSize=learning_rate,
            seed=seed,
            **dict(extra or {}),
        )
        if early_stopping:
            held = validation
            for stage in stages:
                held = stage.transform(held)
            rows = rows.select("label", features).withColumn("_held", F.lit(False)).unionByName(
                held.select("label", features).withColumn("_held", F.lit(True))
            )
            boosted = boosted.setValidationIndicatorCol("_held")
        used = ["label", features, *(["_held"] if early_stopping else [])]
        width = len(rows.select(features).first()[0])
        dealt = dealt_for_rounds(rows.select(*used), width)
    finally:
        train.unpersist()
    return BoostedPairModel(side, mode, PipelineModel([*stages, boosted.fit(dealt)]))


def fitted_or_zero_shot(model, side: LabelSide, threshold: float = 0.5):
    """The model, or similarity scores as long as there is none."""
    return CosineModel(side, threshold) if model is None else model


def pair_fit_summary(model, train: DataFrame, validation: DataFrame | None = None) -> dict[str, float]:
    """Pair counts and mean losses of a fit; the losses are NaN when nothing was fitted."""

    def mean_loss(rows: DataFrame | None) -> float:
        if model is None or rows is None:
            return math.nan
        scored = model.pair_scores(rows).select("score", (F.col("label") == 1.0).alias("truth"))
        value = metrics.pair_log_loss(scored).first()[0]
        return math.nan if value is None else value

    return {
        "fitted": float(model is not None),
        "n_pairs": float(train.count()),
        "n_eval_pairs": float(0 if validation is None else validation.count()),
        "mean_loss": mean_loss(train),
        "mean_val_loss": mean_loss(validation),
    }


def loss_curves(model: BoostedPairModel, tables: dict[str, DataFrame]) -> list[tuple[str, int, float]]:
    """Loss after every boosting round on each table: (split, round, loss), in a pass a table."""
    trees, out = FlatTrees.of(model.fitted), []
    for split, table in tables.items():
        pairs_of = table.filter("features is not null").select("label", vector_to_array("features").alias("features"))
        out += [(split, i + 1, float(x)) for i, x in enumerate(loss_by_round(trees, pairs_of))]
    return out


# -- evaluation ------------------------------------------------------------------


def score_snapshot(model, rows: DataFrame, keep: Sequence[str], labels: str = "labels", vector: str = "vector") -> DataFrame:
    """``keep, scores, truth`` arrays; write it once and evaluate any threshold from it."""
    scored = model.score_rows(rows.select(*keep, labels, vector), vector=vector)
    return scored.select(*keep, "scores", truth_array(labels, model.side).alias("truth"))


def split_snapshot(
    model, splits: Mapping[str, DataFrame], keep: Sequence[str], labels: str = "labels", vector: str = "vector"
) -> DataFrame:
    """``score_snapshot`` of several tables, told apart by the column ``split``."""
    parts = [
        score_snapshot(model, rows, keep, labels, vector).withColumn("split", F.lit(name))
        for name, rows in splits.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def split_scores(snapshot: DataFrame, side: LabelSide, thresholds: Sequence[float]) -> DataFrame:
    """``split, threshold, n_eval, macro_f1, micro_f1`` of a snapshot, in one pass over it.

    ``n_eval`` is the number of rows of the split. A row without scores predicts nothing.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    long = long_scores(snapshot, side, ["split"], truth="truth")
    long = long.select("split", "label_idx", "truth", "score", grid)
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    counts = long.groupBy("split", "threshold", "label_idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(hit & F.col("truth"), 1)).alias("tp"),
        F.count(F.when(hit, 1)).alias("predicted"),
        F.count(F.when(F.col("truth"), 1)).alias("true"),
    )

    def f1(tp: Column, predicted: Column, true: Column) -> Column:
        # 2 tp / (predicted + true), 0 where there is nothing
        return F.coalesce(2 * tp / F.nullif(predicted + true, F.lit(0)), F.lit(0.0))

    return counts.groupBy("split", "threshold").agg(
        F.max("n").alias("n_eval"),
        F.avg(f1(F.col("tp"), F.col("predicted"), F.col("true"))).alias("macro_f1"),
        f1(F.sum("tp"), F.sum("predicted"), F.sum("true")).alias("micro_f1"),
    )


def snapshot_metrics(snapshot: DataFrame, side: LabelSide, threshold: float) -> dict[str, float]:
    """All summary numbers of a snapshot at one threshold."""
    long = long_scores(snapshot, side, [], truth="truth")
    counts = metrics.confusion_counts(long, threshold)
    outcomes = metrics.row_outcomes(snapshot, threshold)
    summary = metrics.macro_micro(counts)
    found = (
        stacked(summary, ["metric", "value"], [(F.lit(c), F.col(c)) for c in summary.columns])
        .unionByName(metrics.row_accuracy(outcomes).toDF("value").withColumn("metric", F.lit("row_accuracy")))
        .unionByName(metrics.mean_log_loss(long).toDF("value").withColumn("metric", F.lit("mean_log_loss")))
        .collect()
    )
    return {r["metric"]: (math.nan if r["value"] is None else r["value"]) for r in found}


def evaluate(
    model, rows: DataFrame, threshold: float | None = None, labels: str = "labels", vector: str = "vector"
) -> dict[str, float]:
    """Score a labelled table against the model's own classes."""
    snapshot = score_snapshot(model, rows, [], labels, vector).persist()
    try:
        return snapshot_metrics(
            snapshot, model.side, model.threshold if threshold is None else threshold
        )
    finally:
        snapshot.unpersist()


def evaluate_splits(
    model, tables: Mapping[str, DataFrame], threshold: float | None = None, labels: str = "labels", vector: str = "vector"
) -> dict[str, dict[str, float]]:
    """``evaluate`` of each table, by its name, with the number of its rows as ``n_rows``."""
    threshold = model.threshold if threshold is None else threshold
    out = {}
    for split, rows in tables.items():
        snapshot = score_snapshot(model, rows, [], labels, vector).persist()
        try:
            out[split] = snapshot_metrics(snapshot, model.side, threshold) | {"n_rows": float(snapshot.count())}
        finally:
            snapshot.unpersist()
    return out
