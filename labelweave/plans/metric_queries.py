"""Evaluation per label, category, row and threshold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sigmoid
from ..operators import metrics, scoring
from ..operators.ranking import global_rank
from . import views
from .catalog import query

DIGITS = 9


def rounded(df, digits=DIGITS):
    """Round every double so that sum order does not show."""
    return df.select(
        *[
            (F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c)
            if t == "double"
            else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


def parts(spark, d):
    """Label side, score rows and long scores of the vectors."""
    side = views.label_side(spark, d)
    rows = views.scored(spark, d, side)
    return side, rows, scoring.long_scores(rows, side, ["vec_id"], truth="truth")


@query(
    "confusion_by_label",
    views.with_views("counts") + "SELECT label_idx, label_key, category, tp, fp, tn, fn FROM counts",
)
def confusion_by_label(spark, d):
    _, _, long = parts(spark, d)
    return metrics.confusion_counts(long, views.THRESHOLD)


@query(
    "confusion_matrix",
    views.with_views("counts")
    + "SELECT label_key, tn AS m00, fp AS m01, fn AS m10, tp AS m11, tn + fp + fn + tp AS n_rows FROM counts",
)
def confusion_matrix(spark, d):
    _, _, long = parts(spark, d)
    m = metrics.binary_matrix(metrics.confusion_counts(long, views.THRESHOLD))
    cell = F.col("matrix")
    return m.select(
        "label_key",
        cell[0][0].alias("m00"),
        cell[0][1].alias("m01"),
        cell[1][0].alias("m10"),
        cell[1][1].alias("m11"),
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_rows"),
    )


@query(
    "confusion_by_category",
    views.with_views("scores")
    + """, cat AS (SELECT vec_id, category, bool_or(score >= 0.1) AS p, bool_or(truth) AS t FROM scores GROUP BY ALL)
SELECT category, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp,
  count(*) FILTER (NOT p AND NOT t) AS tn, count(*) FILTER (NOT p AND t) AS fn FROM cat GROUP BY category""",
)
def confusion_by_category(spark, d):
    side, rows, _ = parts(spark, d)
    return metrics.category_confusion(rows, side, views.THRESHOLD)


@query(
    "prf_by_label",
    views.with_views("prf")
    + """SELECT label_key, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM prf""",
)
def prf_by_label(spark, d):
    _, _, long = parts(spark, d)
    out = metrics.prf(metrics.confusion_counts(long, views.THRESHOLD))
    return rounded(out.select("label_key", "precision", "recall", "f1"))


_MACRO = """, agg AS (SELECT avg(precision) AS macro_p, avg(recall) AS macro_r, avg(f1) AS macro_f1,
  coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0) AS micro_p,
  coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0) AS micro_r FROM prf),
mm AS (SELECT *, coalesce(2 * micro_p * micro_r / nullif(micro_p + micro_r, 0), 0) AS micro_f1 FROM agg)
"""


@query(
    "macro_micro",
    views.with_views("prf")
    + _MACRO
    + "SELECT "
    + ", ".join(
        f"round({c}, 9) AS {c}"
        for c in ("macro_p", "macro_r", "macro_f1", "micro_p", "micro_r", "micro_f1")
    )
    + " FROM mm",
)
def macro_micro(spark, d):
    _, _, long = parts(spark, d)
    return rounded(metrics.macro_micro(metrics.confusion_counts(long, views.THRESHOLD)))


@query(
    "multilabel_metrics",
    views.with_views("prf", "outcomes")
    + _MACRO
    + """SELECT 'f1_micro' AS metric, round(micro_f1, 9) AS value FROM mm
UNION ALL SELECT 'f1_macro', round(macro_f1, 9) FROM mm
UNION ALL SELECT 'subset_accuracy', round(avg(all_right::INT), 9) FROM outcomes""",
)
def multilabel_metrics(spark, d):
    _, rows, long = parts(spark, d)
    return rounded(
        metrics.multilabel_metrics(
            metrics.confusion_counts(long, views.THRESHOLD),
            metrics.row_outcomes(rows, views.THRESHOLD),
        )
    )


@query(
    "classification_report",
    views.with_views("prf", "outcomes")
    + _MACRO
    + """, rep AS (
SELECT label_key AS name, precision, recall, f1, tp + fn AS support FROM prf
UNION ALL SELECT 'micro avg', micro_p, micro_r, micro_f1, (SELECT sum(tp + fn) FROM prf) FROM mm
UNION ALL SELECT 'macro avg', macro_p, macro_r, macro_f1, (SELECT sum(tp + fn) FROM prf) FROM mm
UNION ALL SELECT 'weighted avg', sum(precision * (tp + fn)) / sum(tp + fn), sum(recall * (tp + fn)) / sum(tp + fn),
  sum(f1 * (tp + fn)) / sum(tp + fn), sum(tp + fn) FROM prf
UNION ALL SELECT 'samples avg', avg(coalesce(n_tp / nullif(n_tp + n_fp, 0), 0)), avg(coalesce(n_tp / nullif(n_true, 0), 0)),
  avg(coalesce(2 * n_tp / nullif(n_tp + n_fp + n_true, 0), 0)), sum(n_true) FROM outcomes)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM rep""",
)
def classification_report(spark, d):
    _, rows, long = parts(spark, d)
    return rounded(
        metrics.classification_report(
            metrics.confusion_counts(long, views.THRESHOLD),
            metrics.row_outcomes(rows, views.THRESHOLD),
        )
    )


_ROW_CATS = """, cat AS (SELECT vec_id, category, bool_and((score >= 0.1) = truth) AS ok FROM scores GROUP BY ALL),
rs AS (SELECT vec_id, count(*) FILTER (ok) AS score, bool_and(ok) AS fully_correct,
  bool_or(ok) FILTER (category = 'c0') AS c0_correct, bool_or(ok) FILTER (category = 'c1') AS c1_correct,
  bool_or(ok) FILTER (category = 'c2') AS c2_correct FROM cat GROUP BY vec_id)
"""


@query(
    "row_scores",
    views.with_views("scores")
    + _ROW_CATS
    + "SELECT vec_id, score::INT AS score, fully_correct, c0_correct, c1_correct, c2_correct FROM rs",
)
def row_scores(spark, d):
    side, rows, _ = parts(spark, d)
    return metrics.row_scores(rows, side, views.THRESHOLD, ["vec_id"])


@query(
    "row_score_summary",
    views.with_views("scores")
    + _ROW_CATS
    + """SELECT count(*) FILTER (fully_correct) AS fully_correct_count, count(*) AS n_rows, 3 AS n_categories,
  round(avg(score), 9) AS mean_cat_correct FROM rs""",
)
def row_score_summary(spark, d):
    side, rows, _ = parts(spark, d)
    out = metrics.row_scores(rows, side, views.THRESHOLD, ["vec_id"])
    return rounded(metrics.row_score_summary(out, len(side.category_names)))


@query(
    "row_accuracy",
    views.with_views("outcomes")
    + "SELECT round(avg(all_right::INT), 9) AS row_accuracy FROM outcomes",
)
def row_accuracy(spark, d):
    _, rows, _ = parts(spark, d)
    return rounded(metrics.row_accuracy(metrics.row_outcomes(rows, views.THRESHOLD)))


@query(
    "label_hit_rates",
    views.with_views("outcomes")
    + """SELECT round(coalesce(avg(n_tp / n_true) FILTER (n_true > 0), 0), 9) AS avg_pct_correct,
  round(coalesce(avg(n_fp / n_neg) FILTER (n_neg > 0), 0), 9) AS avg_pct_incorrect FROM outcomes""",
)
def label_hit_rates(spark, d):
    _, rows, _ = parts(spark, d)
    return rounded(metrics.label_hit_rates(metrics.row_outcomes(rows, views.THRESHOLD)))


_PROB = """, prob AS (SELECT vec_id, label_idx, truth, 8 * score - 1 AS logit, 1 / (1 + exp(-(8 * score - 1))) AS p FROM scores),
losses AS (SELECT *, -ln(CASE WHEN truth THEN least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)
  ELSE 1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) END) AS loss FROM prob)
"""


def probabilities(long):
    """Scores as logits and probabilities."""
    logit = F.lit(8.0) * F.col("score") - F.lit(1.0)
    return long.withColumn("logit", logit).withColumn("score", sigmoid("logit"))


@query(
    "log_loss",
    views.with_views("scores")
    + _PROB
    + """SELECT round(avg(l), 9) AS mean_log_loss FROM (SELECT label_idx, avg(loss) AS l FROM losses GROUP BY 1)""",
)
def log_loss(spark, d):
    _, _, long = parts(spark, d)
    return rounded(metrics.mean_log_loss(probabilities(long)))


@query(
    "pair_log_loss",
    views.with_views("scores") + _PROB + "SELECT round(avg(loss), 9) AS log_loss FROM losses",
)
def pair_log_loss(spark, d):
    _, _, long = parts(spark, d)
    return rounded(metrics.pair_log_loss(probabilities(long)))


_BINARY = """, b AS (SELECT *, p >= 0.5 AS pred,
  greatest(logit, 0) - logit * truth::INT + ln(1 + exp(-abs(logit))) AS bce FROM prob)
"""
_BINARY_OUT = """round((count(*) FILTER (pred = truth)) / count(*), 9) AS accuracy,
  round(coalesce((count(*) FILTER (pred AND truth)) / nullif(count(*) FILTER (pred), 0), 0), 9) AS precision,
  round(coalesce((count(*) FILTER (pred AND truth)) / nullif(count(*) FILTER (truth), 0), 0), 9) AS recall,
  round(coalesce(2 * (count(*) FILTER (pred AND truth)) / nullif((count(*) FILTER (pred)) + (count(*) FILTER (truth)), 0), 0), 9) AS f1
FROM b"""


@query(
    "binary_eval",
    views.with_views("scores")
    + _PROB
    + _BINARY
    + "SELECT round(avg(bce), 9) AS loss, "
    + _BINARY_OUT,
)
def binary_eval(spark, d):
    _, _, long = parts(spark, d)
    return rounded(metrics.binary_evaluation(probabilities(long), "logit", "truth"))


@query(
    "binary_eval_batched",
    views.with_views("scores")
    + _PROB
    + _BINARY
    + """, batches AS (SELECT avg(bce) AS l FROM (
  SELECT bce, (row_number() OVER (ORDER BY vec_id, label_idx) - 1) // 32 AS batch FROM b) GROUP BY batch)
SELECT (SELECT round(avg(l), 9) FROM batches) AS loss, """
    + _BINARY_OUT,
)
def binary_eval_batched(spark, d):
    """Loss as the mean of the means of consecutive batches of 32 pairs."""
    _, _, long = parts(spark, d)
    numbered = global_rank(
        probabilities(long).select("vec_id", "label_idx", "logit", "truth"),
        ["vec_id", "label_idx"],
    )
    batched = numbered.withColumn("batch", F.expr("(position - 1) div 32"))
    return rounded(metrics.binary_evaluation(batched, "logit", "truth", batch="batch"))


_SWEEP = """, grid AS (SELECT 0.01::DOUBLE + 0.01::DOUBLE * i AS threshold FROM range(99) t(i)),
c AS (SELECT threshold, label_idx, count(*) FILTER (score >= threshold AND truth) AS tp,
  count(*) FILTER (score >= threshold AND NOT truth) AS fp, count(*) FILTER (score < threshold AND truth) AS fn
  FROM scores, grid GROUP BY ALL),
f AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c),
sweep AS (SELECT threshold, avg(coalesce(2 * p * r / nullif(p + r, 0), 0)) AS macro_f1,
  coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0) AS mp, coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0) AS mr
  FROM f GROUP BY threshold),
s2 AS (SELECT threshold, macro_f1, coalesce(2 * mp * mr / nullif(mp + mr, 0), 0) AS micro_f1 FROM sweep)
"""


@query(
    "threshold_sweep",
    views.with_views("scores")
    + _SWEEP
    + "SELECT round(threshold, 9) AS threshold, round(macro_f1, 9) AS macro_f1, round(micro_f1, 9) AS micro_f1 FROM s2",
)
def threshold_sweep(spark, d):
    side, _, long = parts(spark, d)
    return rounded(metrics.threshold_sweep(long, side))


@query(
    "best_threshold",
    views.with_views("scores")
    + _SWEEP
    + """, ranked AS (
SELECT 'macro_f1' AS metric, threshold, round(macro_f1, 12) AS score FROM s2
UNION ALL SELECT 'micro_f1', threshold, round(micro_f1, 12) FROM s2)
SELECT metric, round(threshold, 9) AS threshold, round(score, 9) AS score FROM ranked
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY score DESC, threshold) = 1""",
)
def best_threshold(spark, d):
    side, _, long = parts(spark, d)
    sweep = metrics.threshold_sweep(long, side)
    return rounded(
        metrics.best_threshold(sweep, "macro_f1").unionByName(
            metrics.best_threshold(sweep, "micro_f1")
        )
    )
