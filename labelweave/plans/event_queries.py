"""Label edits read from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..streaming import events as ev
from . import views
from .catalog import query

_EVENTS = """WITH ev AS (
  SELECT event_id AS seq, user_id AS row_id, 't::' || ((props->>'$.k')::BIGINT % 5) AS label_key,
    CASE event_type WHEN 'purchase' THEN 'off' WHEN 'error' THEN 'clear' ELSE 'on' END AS action
  FROM events)
"""


def label_events(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return views.table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("row_id"),
        F.concat(F.lit("t::"), k % 5).alias("label_key"),
        F.when(F.col("event_type") == "purchase", "off")
        .when(F.col("event_type") == "error", "clear")
        .otherwise("on")
        .alias("action"),
    )


@query(
    "label_fold",
    _EVENTS
    + """, clears AS (SELECT row_id, max(seq) FILTER (action = 'clear') AS c FROM ev GROUP BY row_id),
lasts AS (SELECT row_id, label_key, arg_max(action, seq) AS action, max(seq) AS seq
  FROM ev WHERE action <> 'clear' GROUP BY ALL),
kept AS (SELECT c.row_id, label_key FROM clears c JOIN lasts l ON l.row_id = c.row_id
  WHERE action = 'on' AND seq > coalesce(c, -1))
SELECT c.row_id, coalesce(string_agg(label_key, '|' ORDER BY label_key), '') AS labels, count(label_key)::INT AS n_labels
FROM clears c LEFT JOIN kept k ON k.row_id = c.row_id GROUP BY c.row_id""",
)
def label_fold(spark, d):
    return ev.labels_now(label_events(spark, d)).select(
        "row_id", F.array_join("labels", "|").alias("labels"), F.size("labels").alias("n_labels")
    )


@query(
    "retrain_rounds",
    _EVENTS
    + """, ep AS (SELECT *, sum((action = 'clear')::INT) OVER (PARTITION BY row_id ORDER BY seq) AS epoch FROM ev),
st AS (SELECT *, CASE WHEN action = 'clear' THEN 0 ELSE (action = 'on')::INT - coalesce(lag((action = 'on')::INT)
  OVER (PARTITION BY row_id, epoch, label_key, action = 'clear' ORDER BY seq), 0) END AS delta FROM ep),
cn AS (SELECT *, sum(delta) OVER (PARTITION BY row_id, epoch ORDER BY seq) AS n FROM st),
fl AS (SELECT *, (n > 0)::INT - coalesce(lag((n > 0)::INT) OVER (PARTITION BY row_id ORDER BY seq), 0) AS change FROM cn),
tot AS (SELECT seq, row_id, sum(change) OVER (ORDER BY seq)::BIGINT AS labelled_total FROM fl),
pk AS (SELECT *, max(labelled_total) OVER (ORDER BY seq) // 10 AS round FROM tot)
SELECT seq, row_id, labelled_total, round, greatest(0, 10 - (labelled_total - round * 10)) AS remaining FROM pk""",
)
def retrain_rounds(spark, d):
    return ev.retrain_rounds(label_events(spark, d), every=10)


@query(
    "last_losses",
    """SELECT arg_max(value, event_id) FILTER (event_type = 'click') AS train_loss,
  arg_max(value, event_id) FILTER (event_type = 'view') AS eval_loss FROM events""",
)
def last_losses(spark, d):
    kind = (
        F.when(F.col("event_type") == "click", "embedding_loss")
        .when(F.col("event_type") == "view", "eval_embedding_loss")
        .otherwise("other")
    )
    history = views.table(spark, d, "events").select(
        F.col("event_id").alias("step"), F.create_map(kind, "value").alias("metrics")
    )
    return metrics.last_losses(history)
