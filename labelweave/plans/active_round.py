"""One round of active learning: labels so far -> fit -> scores -> metrics -> queue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames, learning, queues
from ..operators.scoring import LabelSide
from ..sources.store import Store


@dataclass
class Round:
    number: int
    model: object
    queue_version: int
    metrics: dict[str, float]


def run_round(
    store: Store,
    pool: DataFrame,
    evaluation: DataFrame,
    side: LabelSide,
    row_id: str = "row_id",
    strategy: str = "margin",
    threshold: float = 0.5,
    n_neg: int = 3,
    mode: str = "concat+diff+prod",
    C: float = 1.0,
    max_iter: int = 1000,
    seed: int = 42,
    fit: Callable[[DataFrame], object] | None = None,
) -> Round:
    """Fit on the labelled rows of the pool and requeue the others.

    ``fit`` makes any model with ``score_rows`` and ``pair_scores`` of the training pairs,
    or None; without it the pair regression is fitted. Below two labelled pairs nothing is fitted: the scores are similarities and no
    round is counted. The queue is written as the next version of the dataset
    ``queue``, and the round, once its scores are known, as a row of the round table.
    """
    labelled = frames.labelled_rows(pool)
    known = F.size(F.array_intersect("labels", F.lit(list(side.keys))))
    n_pairs = labelled.agg(F.coalesce(F.sum(known), F.lit(0))).first()[0]
    fitted = None
    if n_pairs >= 2:
        train = learning.training_pairs(
            labelled, side, row_id, n_neg=n_neg, seed=seed, mode=mode
        )
        fitted = fit(train) if fit else learning.fit_linear_pairs(train, side, mode, C, max_iter)
    model = learning.fitted_or_zero_shot(fitted, side, threshold)
    model.threshold = threshold
    scores = learning.evaluate(model, evaluation)
    queue = queues.label_queue(
        model.score_rows(pool.select(row_id, "labels", "vector")), row_id, strategy, threshold, seed
    )
    version = store.submit_dataset(queue, "queue")
    number = 0
    if fitted is not None:
        number = store.next_round()
        store.append_round(
            number,
            int(n_pairs),
            1,
            labelled.count(),
            learning.pair_fit_summary(fitted, train)["mean_loss"],
            scores["macro_f1"],
            scores["micro_f1"],
        )
    return Round(number, model, version, scores)
