"""Queues, navigation, shuffles, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import queues, ranking
from . import views
from .catalog import query

_OPEN = views.with_views("scores") + """, per_row AS (
  SELECT vec_id, min(abs(score - 0.1::DOUBLE)) AS margin, max(score) AS best,
    md5(concat_ws('|', '42', vec_id)) AS h FROM scores WHERE len(labels) = 0 GROUP BY vec_id)
"""


def _queue(spark, d, strategy):
    side = views.label_side(spark, d)
    return queues.label_queue(
        views.scored(spark, d, side), "vec_id", strategy, views.THRESHOLD, views.SEED
    )


@query(
    "queue_margin",
    _OPEN
    + """SELECT vec_id, round(margin, 9) AS urgency, row_number() OVER (ORDER BY margin, vec_id) AS position
FROM per_row""",
)
def queue_margin(spark, d):
    return _queue(spark, d, "margin").select(
        "vec_id", F.round("urgency", 9).alias("urgency"), "position"
    )


@query(
    "queue_least_confidence",
    _OPEN
    + """SELECT vec_id, round(best, 9) AS urgency, row_number() OVER (ORDER BY best, vec_id) AS position
FROM per_row""",
)
def queue_least_confidence(spark, d):
    return _queue(spark, d, "least_confidence").select(
        "vec_id", F.round("urgency", 9).alias("urgency"), "position"
    )


@query(
    "queue_random",
    _OPEN + "SELECT vec_id, h AS urgency, row_number() OVER (ORDER BY h, vec_id) AS position FROM per_row",
)
def queue_random(spark, d):
    return _queue(spark, d, "random")


@query(
    "queue_head",
    _OPEN + "SELECT vec_id, round(margin, 9) AS urgency FROM per_row ORDER BY margin, vec_id LIMIT 25",
)
def queue_head(spark, d):
    """The 25 rows to label next."""
    side = views.label_side(spark, d)
    head = queues.queue_head(
        views.scored(spark, d, side), "vec_id", 25, "margin", views.THRESHOLD
    )
    return head.select("vec_id", F.round("urgency", 9).alias("urgency"))


@query(
    "next_item",
    _OPEN
    + """, q AS (SELECT vec_id, row_number() OVER (ORDER BY margin, vec_id) AS position FROM per_row)
SELECT arg_min(vec_id, position) AS vec_id, min(position) AS position FROM q
WHERE vec_id NOT IN (SELECT item_id FROM benchmark)""",
)
def next_item(spark, d):
    """Head of the queue after the rows named in ``benchmark`` were labelled."""
    since = views.table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return queues.next_item(_queue(spark, d, "margin"), since, "vec_id")


@query(
    "next_unlabelled",
    views.with_views("vec_labels")
    + """SELECT coalesce(min(vec_id) FILTER (vec_id > 100), min(vec_id) FILTER (vec_id < 100)) AS vec_id
FROM vec_labels WHERE len(labels) = 0""",
)
def next_unlabelled(spark, d):
    return queues.next_unlabelled(views.vec_labels(spark, d), "vec_id", cursor=100)


@query(
    "first_unlabelled",
    views.with_views("vec_labels")
    + "SELECT coalesce(min(vec_id), 0) AS vec_id FROM vec_labels WHERE len(labels) = 0",
)
def first_unlabelled(spark, d):
    return queues.first_unlabelled(views.vec_labels(spark, d), "vec_id")


_ORDERED = """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS rn,
  count(*) OVER () AS n FROM documents)
"""


def _ids(spark, d):
    return views.table(spark, d, "documents").select("doc_id")


@query("split_70_30", _ORDERED + "SELECT doc_id, rn <= ceil(0.3 * n) AS is_test FROM o")
def split_70_30(spark, d):
    return ranking.mark_hash_split(
        _ids(spark, d), "doc_id", ranking.test_size(0.3), views.SEED, "is_test"
    )


@query(
    "holdout_split",
    _ORDERED + "SELECT doc_id, rn <= greatest(1, floor(0.1 * n)) AS is_eval FROM o",
)
def holdout_split(spark, d):
    return ranking.mark_hash_split(
        _ids(spark, d), "doc_id", ranking.holdout_size(0.1), views.SEED, "is_eval"
    )


@query("first_k_split", _ORDERED + "SELECT doc_id, rn <= 30 AS is_train FROM o")
def first_k_split(spark, d):
    """The first 30 rows after a shuffle train, the rest tests."""
    return ranking.mark_hash_split(
        _ids(spark, d), "doc_id", lambda n: min(30, n), views.SEED, "is_train"
    )


@query(
    "split_by_text",
    """WITH t AS (SELECT DISTINCT md5(text) AS t FROM documents),
o AS (SELECT t, row_number() OVER (ORDER BY md5(concat_ws('|', '42', t)), t) AS rn, count(*) OVER () AS n FROM t)
SELECT doc_id, rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) AS is_validation
FROM documents JOIN o ON md5(text) = t""",
)
def split_by_text(spark, d):
    docs = views.table(spark, d, "documents").select("doc_id", "text")
    return ranking.split_by_text(docs, "text", 0.2, views.SEED).select("doc_id", "is_validation")


@query(
    "prefix_split",
    """SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= floor(0.7 * count(*) OVER ()) AS is_train
FROM documents""",
)
def prefix_split(spark, d):
    return ranking.mark_prefix(_ids(spark, d), "doc_id", 0.7)


@query(
    "kfold",
    "SELECT doc_id, (ntile(3) OVER (ORDER BY doc_id) - 1)::INT AS fold FROM documents",
)
def kfold(spark, d):
    return ranking.contiguous_folds(_ids(spark, d), "doc_id", 3)


@query("shuffle", _ORDERED + "SELECT doc_id, rn AS position FROM o")
def shuffle(spark, d):
    keyed = _ids(spark, d).withColumn("_h", ranking.hash_order(views.SEED, "doc_id"))
    return ranking.global_rank(keyed, ["_h", "doc_id"]).select("doc_id", "position")


@query(
    "rank_within_label",
    """SELECT vec_id, label, row_number() OVER (PARTITION BY label
  ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id) AS rn FROM embeddings""",
)
def rank_within_label(spark, d):
    emb = views.table(spark, d, "embeddings").select(
        "vec_id", "label", ranking.hash_order(views.SEED, "vec_id").alias("_h")
    )
    return ranking.rank_within(emb, ["label"], "_h", "vec_id").select("vec_id", "label", "rn")
