"""Multi-label evaluation.

Row metrics read the ``scores``/``truth`` arrays of one row and need no shuffle.
Label metrics explode those arrays inside the scan stage and pre-aggregate there,
so a task sends one small row per label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import harmonic, ratio
from ..functions.vectors import sigmoid
from .frames import is_labelled, stacked
from .scoring import LabelSide, predicted_array

LOG_LOSS_EPS = 2.220446049250313e-16
LABEL_COLS = ["label_idx", "label_key", "category"]
# float sums may differ in the last bits between layouts; ties are taken on this grid
TIE_DIGITS = 12


def threshold_grid() -> list[float]:
    """0.01 .. 0.99 in steps of 0.01."""
    return [0.01 + 0.01 * i for i in range(99)]


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def confusion_counts(
    long: DataFrame, threshold: float, keys: Sequence[str] = tuple(LABEL_COLS)
) -> DataFrame:
    """tp, fp, tn, fn per label from the long scores; the counts sum to the row count.

    A row without score predicts nothing.
    """
    pred = F.coalesce(F.col("score") >= F.lit(float(threshold)), F.lit(False))
    truth = F.col("truth")
    return long.groupBy(*keys).agg(
        _count(pred & truth).alias("tp"),
        _count(pred & ~truth).alias("fp"),
        _count(~pred & ~truth).alias("tn"),
        _count(~pred & truth).alias("fn"),
    )


def binary_matrix(counts: DataFrame) -> DataFrame:
    """``[[TN, FP], [FN, TP]]`` next to the counts."""
    return counts.withColumn("matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))


def category_confusion(
    scored: DataFrame, side: LabelSide, threshold: float, scores: str = "scores", truth: str = "truth"
) -> DataFrame:
    """Counts per category; a row is positive for a category if any of its labels is."""
    per_cat = []
    for cat in side.category_names:
        idx = side.members(cat)
        per_cat.append(
            F.struct(
                F.lit(cat).alias("category"),
                F.array_max(F.array(*[F.col(scores)[i] for i in idx])).alias("score"),
                F.array_max(F.array(*[F.col(truth)[i] for i in idx])).alias("truth"),
            )
        )
    return confusion_counts(
        scored.select(F.inline(F.array(*per_cat))), threshold, ["category"]
    )


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 next to the counts; an empty denominator gives 0."""
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return (
        counts.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn("f1", harmonic(F.col("precision"), F.col("recall")))
    )


def macro_micro(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro (plain mean over all labels) and micro (summed counts) P / R / F1."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    agg = prf(counts).groupBy(*by).agg(
        F.avg("precision").alias("macro_p"),
        F.avg("recall").alias("macro_r"),
        F.avg("f1").alias("macro_f1"),
        ratio(tp, tp + fp).alias("micro_p"),
        ratio(tp, tp + fn).alias("micro_r"),
    )
    return agg.withColumn("micro_f1", harmonic(F.col("micro_p"), F.col("micro_r")))


def row_outcomes(
    scored: DataFrame, threshold: float, scores: str = "scores", truth: str = "truth"
) -> DataFrame:
    """Per-row counts ``n_tp, n_fp, n_true, n_neg`` and ``all_right``."""
    empty = F.transform(F.col(truth), lambda t: F.lit(False))
    pred = F.coalesce(predicted_array(scores, threshold), empty)
    both = F.zip_with(
        pred,
        F.col(truth),
        lambda p, t: F.when(p & t, "tp").when(p, "fp").when(t, "fn").otherwise("tn"),
    )
    kind = scored.withColumn("_k", both)

    def n(*names: str) -> Column:
        return F.size(F.filter("_k", lambda x: x.isin(*names)))

    return (
        kind.withColumn("n_tp", n("tp"))
        .withColumn("n_fp", n("fp"))
        .withColumn("n_true", n("tp", "fn"))
        .withColumn("n_neg", n("fp", "tn"))
        .withColumn("all_right", ~F.exists("_k", lambda x: x.isin("fp", "fn")))
        .drop("_k")
    )


def row_accuracy(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.coalesce(F.avg(F.col("all_right").cast("int")), F.lit(0.0)).alias("row_accuracy")
    )


def label_hit_rates(outcomes: DataFrame) -> DataFrame:
    """Mean share of true labels caught and of other labels wrongly predicted."""
    return outcomes.agg(
        F.coalesce(F.avg(F.try_divide(F.col("n_tp"), F.col("n_true"))), F.lit(0.0)).alias(
            "avg_pct_correct"
        ),
        F.coalesce(F.avg(F.try_divide(F.col("n_fp"), F.col("n_neg"))), F.lit(0.0)).alias(
            "avg_pct_incorrect"
        ),
    )


def multilabel_metrics(counts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``f1_micro, f1_macro, subset_accuracy`` as ``metric, value`` rows."""
    scores = stacked(
        macro_micro(counts),
        ["metric", "value"],
        [(F.lit("f1_micro"), F.col("micro_f1")), (F.lit("f1_macro"), F.col("macro_f1"))],
    )
    exact = row_accuracy(outcomes).select(
        F.lit("subset_accuracy").alias("metric"), F.col("row_accuracy").alias("value")
    )
    return scores.unionByName(exact)


def classification_report(counts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per label and the micro, macro, weighted and samples averages."""
    per_label = prf(counts).withColumn("support", F.col("tp") + F.col("fn"))
    cols = ["name", "precision", "recall", "f1", "support"]
    rows = per_label.withColumn("name", F.col("label_key")).select(*cols)
    tp, fp, support = F.sum("tp"), F.sum("fp"), F.sum("support")
    micro_p, micro_r = ratio(tp, tp + fp), ratio(tp, support)

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), support)

    totals = per_label.agg(
        support.alias("support"),
        micro_p.alias("mp"),
        micro_r.alias("mr"),
        *[F.avg(c).alias(f"a_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    averages = stacked(
        totals,
        cols,
        [
            (F.lit("micro avg"), F.col("mp"), F.col("mr"), harmonic(F.col("mp"), F.col("mr")), F.col("support")),
            (F.lit("macro avg"), F.col("a_precision"), F.col("a_recall"), F.col("a_f1"), F.col("support")),
            (F.lit("weighted avg"), F.col("w_precision"), F.col("w_recall"), F.col("w_f1"), F.col("support")),
        ],
    )
    n_pred = F.col("n_tp") + F.col("n_fp")
    samples = outcomes.agg(
        F.avg(ratio(F.col("n_tp"), n_pred)).alias("precision"),
        F.avg(ratio(F.col("n_tp"), F.col("n_true"))).alias("recall"),
        F.avg(ratio(2 * F.col("n_tp"), n_pred + F.col("n_true"))).alias("f1"),
        F.sum("n_true").alias("support"),
    ).withColumn("name", F.lit("samples avg"))
    return rows.unionByName(averages).unionByName(samples.select(*cols))


def row_scores(
    scored: DataFrame,
    side: LabelSide,
    threshold: float,
    keep: Sequence[str],
    scores: str = "scores",
    truth: str = "truth",
) -> DataFrame:
    """Per row: ``<category>_correct``, their number ``score`` and ``fully_correct``."""
    pred = scored.withColumn("_p", predicted_array(scores, threshold))
    names = []
    for cat in side.category_names:
        right = F.lit(True)
        for i in side.members(cat):
            right = right & (F.col("_p")[i] == F.col(truth)[i])
        names.append(f"{cat}_correct")
        pred = pred.withColumn(names[-1], right)
    total = sum((F.col(f"`{n}`").cast("int") for n in names), F.lit(0))
    return pred.select(
        *keep,
        total.alias("score"),
        (total == len(names)).alias("fully_correct"),
        *[F.col(f"`{n}`") for n in names],
    )


def row_score_summary(rows: DataFrame, n_categories: int) -> DataFrame:
    return rows.agg(
        _count(F.col("fully_correct")).alias("fully_correct_count"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(n_categories).alias("n_categories"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_cat_correct"),
    )


def cross_entropy(probability: Column, truth: Column) -> Column:
    """Binary log loss of one prediction with clipped probability."""
    p = F.least(F.greatest(probability, F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    return -F.when(truth, F.ln(p)).otherwise(F.ln(F.lit(1.0) - p))


def mean_log_loss(long: DataFrame, probability: str = "score", truth: str = "truth") -> DataFrame:
    """Log loss per label, then the plain mean over labels."""
    per_label = long.groupBy("label_idx").agg(
        F.avg(cross_entropy(F.col(probability), F.col(truth))).alias("loss")
    )
    return per_label.agg(F.avg("loss").alias("mean_log_loss"))


def pair_log_loss(pairs: DataFrame, probability: str = "score", truth: str = "truth") -> DataFrame:
    """One log loss over all pairs."""
    return pairs.agg(F.avg(cross_entropy(F.col(probability), F.col(truth))).alias("log_loss"))


def logit_loss(logit: Column, truth: Column) -> Column:
    """Binary cross entropy straight from a logit, without overflow."""
    return (
        F.greatest(logit, F.lit(0.0))
        - logit * truth.cast("double")
        + F.log1p(F.exp(-F.abs(logit)))
    )


def binary_evaluation(
    pairs: DataFrame, logit: str, truth: str, threshold: float = 0.5, batch: str | None = None
) -> DataFrame:
    """Loss, accuracy, precision, recall and F1 of one class from logits.

    ``batch`` names a column with batch numbers: the loss is then the mean of the
    batch means instead of the mean over rows.
    """
    pred = sigmoid(logit) >= F.lit(float(threshold))
    t = F.col(truth)
    partial = pairs.groupBy(*([batch] if batch else [])).agg(
        F.avg(logit_loss(F.col(logit), t)).alias("loss"),
        _count(pred & t).alias("tp"),
        _count(pred & ~t).alias("fp"),
        _count(~pred & t).alias("fn"),
        F.count(F.lit(1)).alias("n"),
    )
    total = partial.agg(
        F.avg("loss").alias("loss"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n")]
    )
    return prf(total).select(
        F.coalesce("loss", F.lit(0.0)).alias("loss"),
        ratio(F.col("n") - F.col("fp") - F.col("fn"), F.col("n")).alias("accuracy"),
        "precision",
        "recall",
        "f1",
    )


def with_grid_bucket(long: DataFrame, grid: Sequence[float], out: str = "bucket") -> DataFrame:
    """Number of grid thresholds that a score reaches."""
    splits = [float("-inf"), *grid, float("inf")]
    marked = Bucketizer(splits=splits, inputCol="score", outputCol="_bucket").transform(long)
    return marked.withColumn(out, F.col("_bucket").cast("int")).drop("_bucket")


def threshold_counts(
    long: DataFrame, side: LabelSide, grid: Sequence[float] | None = None
) -> DataFrame:
    """tp, fp, fn per (label, threshold) of a grid from one pass over the scores.

    Scores are counted per grid bucket first; the counts at a threshold are the
    suffix sums over the buckets of a label.
    """
    grid = sorted(grid if grid is not None else threshold_grid())
    found = (
        with_grid_bucket(long, grid)
        .groupBy("label_idx", "bucket")
        .agg(
            _count(F.col("truth")).alias("pos"),
            _count(~F.col("truth")).alias("neg"),
        )
    )
    spark = long.sparkSession
    steps = spark.range(len(side) * (len(grid) + 1)).select(
        F.expr(f"cast(id div {len(grid) + 1} as int)").alias("label_idx"),
        F.expr(f"cast(id % {len(grid) + 1} as int)").alias("bucket"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(0).cast("bigint").alias("neg"),
    )
    full = (
        found.unionByName(steps)
        .groupBy("label_idx", "bucket")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    above = (
        Window.partitionBy("label_idx")
        .orderBy(F.desc("bucket"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    everything = Window.partitionBy("label_idx")
    thresholds = F.array(*[F.lit(float(t)) for t in grid])
    return (
        full.withColumn("tp", F.sum("pos").over(above))
        .withColumn("fp", F.sum("neg").over(above))
        .withColumn("fn", F.sum("pos").over(everything) - F.col("tp"))
        .filter(F.col("bucket") > 0)
        .select(
            "label_idx",
            F.element_at(thresholds, F.col("bucket")).alias("threshold"),
            "tp",
            "fp",
            "fn",
        )
    )


def threshold_sweep(
    long: DataFrame, side: LabelSide, grid: Sequence[float] | None = None
) -> DataFrame:
    """``macro_f1`` and ``micro_f1`` for every threshold of the grid."""
    return macro_micro(threshold_counts(long, side, grid), ["threshold"]).select(
        "threshold", "macro_f1", "micro_f1"
    )


def best_threshold(sweep: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Best threshold and its score; the lowest threshold wins a tie."""
    if metric not in ("macro_f1", "micro_f1"):
        raise ValueError(f"unknown metric: {metric!r}")
    best = F.max(F.struct(F.round(metric, TIE_DIGITS).alias("s"), (-F.col("threshold")).alias("t")))
    return sweep.agg(best.alias("_b")).select(
        F.lit(metric).alias("metric"),
        F.coalesce(-F.col("_b.t"), F.lit(0.5)).alias("threshold"),
        F.coalesce(F.col("_b.s"), F.lit(-1.0)).alias("score"),
    )


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight ``n / (classes * n_class)`` per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # one row per class
    every = Window.partitionBy(F.lit(0))
    n, classes = F.sum("n_class").over(every), F.count(F.lit(1)).over(every)
    return counts.withColumn("weight", n.cast("double") / (classes * F.col("n_class")))


def label_progress(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """Labelled and remaining row counts."""
    return rows.agg(
        _count(is_labelled(labels)).alias("n_labeled"),
        _count(~is_labelled(labels)).alias("n_remaining"),
    )


def last_losses(history: DataFrame, step: str = "step", metrics: str = "metrics") -> DataFrame:
    """Newest train and eval loss of a history of sparse metric maps."""

    def newest(first: str, second: str) -> Column:
        value = F.coalesce(F.col(metrics)[first], F.col(metrics)[second])
        return F.max_by(value, F.when(value.isNotNull(), F.col(step)))

    return history.agg(
        newest("embedding_loss", "loss").alias("train_loss"),
        newest("eval_embedding_loss", "eval_loss").alias("eval_loss"),
    )
