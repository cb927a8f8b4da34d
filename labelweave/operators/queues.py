"""Active-learning queues and navigation over labelled and unlabelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import unlabelled_rows
from .ranking import global_rank, hash_order

STRATEGIES = ("margin", "least_confidence", "random")


def urgency(
    strategy: str, row_id: str, threshold: float = 0.5, seed: int = 42, scores: str = "scores"
) -> Column:
    """Sort key of a row; the smallest comes first."""
    if strategy == "margin":
        return F.array_min(F.transform(scores, lambda s: F.abs(s - F.lit(float(threshold)))))
    if strategy == "least_confidence":
        return F.array_max(scores)
    if strategy == "random":
        return hash_order(seed, row_id)
    raise ValueError(f"unknown strategy: {strategy!r}; use one of {STRATEGIES}")


def label_queue(
    scored: DataFrame,
    row_id: str,
    strategy: str = "margin",
    threshold: float = 0.5,
    seed: int = 42,
    labels: str = "labels",
) -> DataFrame:
    """All unlabelled rows with their place in the queue: ``row_id, urgency, position``."""
    keyed = unlabelled_rows(scored, labels).select(
        row_id, urgency(strategy, row_id, threshold, seed).alias("urgency")
    )
    return global_rank(keyed, ["urgency", row_id])


def queue_head(
    scored: DataFrame,
    row_id: str,
    k: int,
    strategy: str = "margin",
    threshold: float = 0.5,
    seed: int = 42,
    labels: str = "labels",
) -> DataFrame:
    """The first k rows of the queue; each task keeps only its own best k."""
    keyed = unlabelled_rows(scored, labels).select(
        row_id, urgency(strategy, row_id, threshold, seed).alias("urgency")
    )
    return keyed.orderBy("urgency", row_id).limit(k)


def next_item(queue: DataFrame, labelled: DataFrame, row_id: str) -> DataFrame:
    """First queue row that has not been labelled since the queue was made."""
    left = queue.join(labelled.select(row_id), row_id, "left_anti")
    return left.agg(F.min_by(row_id, "position").alias(row_id), F.min("position").alias("position"))


def next_unlabelled(rows: DataFrame, row_id: str, cursor: int, labels: str = "labels") -> DataFrame:
    """Next unlabelled row after the cursor, wrapping around, the cursor left out."""
    after = F.col(row_id) > F.lit(cursor)
    before = F.col(row_id) < F.lit(cursor)
    return unlabelled_rows(rows, labels).agg(
        F.coalesce(
            F.min(F.when(after, F.col(row_id))), F.min(F.when(before, F.col(row_id)))
        ).alias(row_id)
    )


def first_unlabelled(rows: DataFrame, row_id: str, labels: str = "labels") -> DataFrame:
    """Smallest unlabelled row id, 0 when every row is labelled."""
    return unlabelled_rows(rows, labels).agg(F.coalesce(F.min(row_id), F.lit(0)).alias(row_id))
