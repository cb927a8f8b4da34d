"""Similarity scores, label ranking, wide frames and tag prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import label_text
from ..functions.vectors import hash_vectors
from ..operators import scoring
from . import views
from .catalog import query

_SCORES = views.with_views("scores")


@query(
    "zero_shot_scores",
    _SCORES + "SELECT vec_id, label_idx, label_key, category, score FROM scores",
)
def zero_shot_scores(spark, d):
    side = views.label_side(spark, d)
    return scoring.long_scores(views.similarities(spark, d, side), side, ["vec_id"])


@query(
    "blocked_scores",
    _SCORES + "SELECT vec_id, label_idx, label_key, category, score FROM scores",
)
def blocked_scores(spark, d):
    """The join form for label tables of any size, here on a small one."""
    long = scoring.similarity_join(
        views.table(spark, d, "embeddings"),
        views.label_vectors(spark, d),
        "vec_id",
        vector="embedding",
        block_labels=4,
    )
    return long.withColumn("score", F.round("score", views.SCORE_DIGITS) + F.lit(0.0))


@query(
    "top_labels_per_category",
    _SCORES
    + """SELECT vec_id, category, label_idx, label_key, score, rank::INT AS rank, rank <= 2 AS is_top FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id, category ORDER BY score DESC, label_idx) AS rank FROM scores)""",
)
def top_labels_per_category(spark, d):
    side = views.label_side(spark, d)
    return scoring.rank_in_category(views.similarities(spark, d, side), side, "vec_id", top_k=2)


def _keys():
    return [f"c{i % 3}::l{i}" for i in range(10)]


@query(
    "wide_scores",
    _SCORES
    + "SELECT vec_id, "
    + ", ".join(
        f"max(score) FILTER (label_key = '{k}') AS \"sim::{k}\", "
        f"bool_or(score >= {views.THRESHOLD}) FILTER (label_key = '{k}') AS \"{k}\""
        for k in _keys()
    )
    + " FROM scores GROUP BY vec_id",
)
def wide_scores(spark, d):
    side = views.label_side(spark, d)
    return views.similarities(spark, d, side).select(
        "vec_id", *scoring.wide_columns(side, views.THRESHOLD)
    )


@query(
    "category_rollup",
    _SCORES
    + "SELECT vec_id, "
    + ", ".join(
        f"max(score) FILTER (category = 'c{c}') AS \"cat_sim::c{c}\", "
        f"bool_or(score >= {views.THRESHOLD}) FILTER (category = 'c{c}') AS \"cat::c{c}\""
        for c in range(3)
    )
    + " FROM scores GROUP BY vec_id",
)
def category_rollup(spark, d):
    side = views.label_side(spark, d)
    return views.similarities(spark, d, side).select(
        "vec_id", *scoring.category_columns(side, views.THRESHOLD)
    )


@query(
    "score_tags",
    _SCORES
    + """SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label_idx)::INT AS position,
  label_key, score FROM scores""",
)
def score_tags(spark, d):
    side = views.label_side(spark, d)
    return scoring.scored_tags(views.similarities(spark, d, side), side, "vec_id")


@query(
    "predict_tags",
    _SCORES
    + """SELECT * FROM (
  SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label_idx)::INT AS position,
    label_key, score FROM scores WHERE score >= 0.1) WHERE position <= 3""",
)
def predict_tags(spark, d):
    side = views.label_side(spark, d)
    return scoring.scored_tags(
        views.similarities(spark, d, side), side, "vec_id", threshold=views.THRESHOLD, top_k=3
    )


@query(
    "pair_truth",
    _SCORES + "SELECT vec_id, label_key, truth, score >= 0.1 AS predicted FROM scores",
)
def pair_truth(spark, d):
    side = views.label_side(spark, d)
    long = scoring.long_scores(views.scored(spark, d, side), side, ["vec_id"], truth="truth")
    return long.select(
        "vec_id", "label_key", "truth", (F.col("score") >= views.THRESHOLD).alias("predicted")
    )


@query(
    "labelled_subset",
    views.with_views("vec_labels", "label_vectors")
    + """SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first_value, len(embedding)::INT AS dims,
  (SELECT string_agg(CASE WHEN list_contains(v.labels, k.label_key) THEN '1' ELSE '0' END, '' ORDER BY k.label_idx)
   FROM label_vectors k) AS truth
FROM vec_labels v WHERE len(labels) > 0""",
)
def labelled_subset(spark, d):
    from ..operators.frames import labelled_rows

    side = views.label_side(spark, d)
    truth = F.transform(
        scoring.truth_array("labels", side), lambda t: t.cast("int").cast("string")
    )
    return labelled_rows(views.vec_labels(spark, d)).select(
        "vec_id",
        (F.round(F.col("embedding")[0].cast("double"), 6) + F.lit(0.0)).alias("first_value"),
        F.size("embedding").alias("dims"),
        F.array_join(truth, "").alias("truth"),
    )


_LABEL_WORDS = ", ".join(
    f"('{c}::{l}', '{l}. {t}')" for c, ls in views.DOC_TAXONOMY.items() for l, t in ls.items()
)


@query(
    "text_scores",
    f"""WITH words(k, t) AS (VALUES {_LABEL_WORDS}),
tokens AS (SELECT doc_id::VARCHAR AS id, 'doc' AS kind,
    unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents
  UNION ALL SELECT k, 'label', unnest(regexp_extract_all(t, '[^ \\t\\n\\x0B\\f\\r]+')) FROM words),
counts AS (SELECT id, kind, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64) AS dim, count(*) AS n FROM tokens GROUP BY ALL),
unit AS (SELECT id, kind, dim, n / (sqrt(sum(n * n) OVER (PARTITION BY id, kind)) + 1e-12) AS v FROM counts),
ids AS (SELECT DISTINCT doc_id::VARCHAR AS id FROM documents),
dots AS (SELECT a.id, b.id AS k, sum(a.v * b.v) AS score FROM unit a JOIN unit b USING (dim)
  WHERE a.kind = 'doc' AND b.kind = 'label' GROUP BY ALL)
SELECT ids.id::BIGINT AS doc_id, words.k AS label_key, round(coalesce(score, 0), 6) AS score,
  round(coalesce(score, 0), 6) >= 0.1 AS predicted FROM ids CROSS JOIN words LEFT JOIN dots ON dots.id = ids.id AND dots.k = words.k""",
)
def text_scores(spark, d):
    """Texts and label descriptions embedded alike, every text scored with every label."""
    flat = scoring.taxonomy_frame(spark, views.DOC_TAXONOMY)
    words = flat.withColumn("words", label_text("label", "description"))
    embedded = hash_vectors(words, "label_key", "words").withColumnRenamed("vector", "vector_label")
    side = scoring.LabelSide.from_frame(embedded.join(flat, "label_key"))
    docs = hash_vectors(views.table(spark, d, "documents"), "doc_id", "text")
    scored = scoring.similarity_rows(docs, side, digits=views.SCORE_DIGITS)
    return scoring.long_scores(scored, side, ["doc_id"]).select(
        "doc_id", "label_key", "score", (F.col("score") >= views.THRESHOLD).alias("predicted")
    )
