"""Models of every kind in a folder: settings, labels and what was fitted.

``<folder>/settings`` is one JSON line that tells the kind; the rest depends on it.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import DenseVector
from pyspark.sql import SparkSession

from . import learning
from .pair_fit import PairWeights
from .scoring import LabelSide


@dataclass
class Settings:
    kind: str
    threshold: float = 0.5
    mode: str = ""
    loss_curve: list[float] = field(default_factory=list)


def _write_side(spark: SparkSession, side: LabelSide, path: str) -> None:
    """Labels in order; vectors only where the side has them."""
    vectors = side.vectors or [None] * len(side.keys)
    rows = [
        (i, k, c, None if v is None else [float(x) for x in v])
        for i, (k, c, v) in enumerate(zip(side.keys, side.categories, vectors))
    ]
    schema = "label_idx int, label_key string, category string, vector array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/labels")


def _read_side(spark: SparkSession, path: str) -> LabelSide:
    rows = spark.read.parquet(f"{path}/labels").orderBy("label_idx").collect()
    vectors = tuple(tuple(r["vector"]) for r in rows if r["vector"] is not None)
    return LabelSide(tuple(r["label_key"] for r in rows), tuple(r["category"] for r in rows), vectors)


def save_model(spark: SparkSession, model, path: str) -> None:
    """Write a cosine, labelwise, linear or boosted model, or any Spark ML model."""
    if isinstance(model, learning.CosineModel):
        settings = Settings("cosine", model.threshold)
    elif isinstance(model, learning.LabelwiseModel):
        settings = Settings("labelwise", model.threshold)
        rows = [
            (i, [float(x) for x in w], float(b))
            for i, (w, b) in enumerate(zip(model.weights, model.offsets))
        ]
        table = spark.createDataFrame(rows, "label_idx int, weights array<double>, offset double")
        table.coalesce(1).write.parquet(f"{path}/weights")
    elif isinstance(model, (learning.LinearPairModel, learning.BoostedPairModel)):
        kind = "linear" if isinstance(model, learning.LinearPairModel) else "boosted"
        settings = Settings(kind, model.threshold, model.mode, [float(x) for x in model.loss_curve])
        if kind == "linear":
            row = [([float(x) for x in model.fitted.coefficients], float(model.fitted.intercept))]
            spark.createDataFrame(row, "weights array<double>, offset double").coalesce(1).write.parquet(f"{path}/weights")
        else:
            model.fitted.write().save(f"{path}/fitted")
    else:
        settings = Settings("pipeline")
        model.write().save(f"{path}/fitted")
    if settings.kind != "pipeline":
        _write_side(spark, model.side, path)
    # last, so that a folder with settings is whole
    line = spark.createDataFrame([(json.dumps(asdict(settings)),)], "value string")
    line.coalesce(1).write.text(f"{path}/settings")


def load_model(spark: SparkSession, path: str):
    settings = Settings(**json.loads(spark.read.text(f"{path}/settings").first()[0]))
    if settings.kind == "pipeline":
        return PipelineModel.load(f"{path}/fitted")
    side = _read_side(spark, path)
    if settings.kind == "cosine":
        return learning.CosineModel(side, settings.threshold)
    if settings.kind == "labelwise":
        rows = spark.read.parquet(f"{path}/weights").orderBy("label_idx").collect()
        weights = np.array([r["weights"] for r in rows])
        return learning.LabelwiseModel(side, weights, [r["offset"] for r in rows], settings.threshold)
    if settings.kind == "linear":
        row = spark.read.parquet(f"{path}/weights").first()
        fitted = PairWeights(DenseVector(row["weights"]), row["offset"])
        return learning.LinearPairModel(side, settings.mode, fitted, settings.threshold, settings.loss_curve)
    fitted = PipelineModel.load(f"{path}/fitted")
    return learning.BoostedPairModel(side, settings.mode, fitted, settings.threshold, settings.loss_curve)
