"""Derived views over the given tables, in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lab
from ..operators.scoring import LabelSide, similarity_rows, truth_array

SEED = 42
THRESHOLD = 0.1
SCORE_DIGITS = 6

# labels carried by the documents
DOC_TAXONOMY = {
    "lang": {
        "de": "written in German",
        "en": "written in English",
        "es": "written in Spanish",
        "fr": "written in French",
    },
    "quality": {"bad": "judged to be of low quality", "good": "judged to be of good quality"},
    "safety": {"clean": "free of toxic language", "toxic": "contains toxic language"},
}
DOC_SIDE = LabelSide.from_taxonomy(DOC_TAXONOMY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_docs(spark: SparkSession, sf_dir: str, *values: Column) -> DataFrame:
    """``doc_id, lang, labels`` and the given values of a document.

    Documents without judgement have no labels. Values are taken before the join,
    so that a text is never shuffled for something that is read off it.
    """
    judged = table(spark, sf_dir, "labels").withColumn("_j", F.lit(True))
    keys = F.array_sort(
        F.array(
            lab.label_key(F.lit("lang"), "lang"),
            lab.label_key(
                F.lit("quality"), F.when(F.col("quality") == 1, "good").otherwise("bad")
            ),
            lab.label_key(F.lit("safety"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean")),
        )
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", *values)
    return (
        docs.join(judged, "doc_id", "left")
        .select(
            *docs.columns,
            F.when(F.col("_j"), keys).otherwise(lab.empty_labels()).alias("labels"),
        )
    )


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a document written in three ways; toxic ones as broken JSON."""
    labels = F.col("labels")
    toxic = F.array_contains(labels, "safety::toxic")
    as_json = F.to_json(labels)
    return labelled_docs(spark, sf_dir).select(
        "doc_id",
        "labels",
        F.concat(F.lit(" "), F.array_join(labels, " ; "), F.lit(",, ")).alias("delimited"),
        F.when(F.size(labels) == 0, F.lit("  "))
        .when(toxic, F.concat(F.lit("["), F.array_join(labels, ",")))
        .otherwise(F.concat(as_json, F.lit(" ")))
        .alias("json"),
        F.concat(
            F.lit("["),
            F.array_join(F.transform(labels, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "),
            F.lit("]"),
        ).alias("literal"),
    )


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exemplar vector per label: that of the smallest vec_id.

    The ids are found first, so that the vectors are neither sorted nor shuffled.
    """
    emb = table(spark, sf_dir, "embeddings")
    first = emb.groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")
    exemplars = emb.join(first, "vec_id", "left_semi")
    return exemplars.select(
        F.col("label").alias("label_idx"),
        F.concat(F.lit("c"), F.col("label") % 3, F.lit("::l"), F.col("label")).alias("label_key"),
        F.col("embedding").alias("vector_label"),
    )


def label_side(spark: SparkSession, sf_dir: str) -> LabelSide:
    return LabelSide.from_frame(label_vectors(spark, sf_dir))


def with_vec_labels(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Replace ``label`` by ``labels``: own key, a second one for good quality, none if unjudged."""
    judged = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("vec_id"), "quality", F.lit(True).alias("_j")
    )

    def key(value):
        return F.concat(F.lit("c"), value % 3, F.lit("::l"), value)

    own = key(F.col("label"))
    other = key((F.col("label") + 3) % 10)
    labels = (
        F.when(F.col("_j").isNull(), lab.empty_labels())
        .when(F.col("quality") == 1, F.array(own, other))
        .otherwise(F.array(own))
    )
    joined = rows.join(judged, "vec_id", "left")
    return joined.select(*[c for c in rows.columns if c != "label"], labels.alias("labels"))


def vec_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, embedding, labels``"""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return with_vec_labels(spark, sf_dir, emb)


def similarities(spark: SparkSession, sf_dir: str, side: LabelSide) -> DataFrame:
    """``vec_id, label, scores`` with scores rounded to six digits; row-wise."""
    rows = similarity_rows(
        table(spark, sf_dir, "embeddings"), side, vector="embedding", digits=SCORE_DIGITS
    )
    return rows.select("vec_id", "label", "scores")


def scored(spark: SparkSession, sf_dir: str, side: LabelSide) -> DataFrame:
    """``vec_id, scores, labels, truth``; scored before the join, so no vector is shuffled."""
    rows = with_vec_labels(spark, sf_dir, similarities(spark, sf_dir, side))
    return rows.withColumn("truth", truth_array("labels", side))


CTES = {
    "labelled_docs": """labelled_docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source,
    CASE WHEN l.doc_id IS NULL THEN []::VARCHAR[] ELSE list_sort([
      'lang::' || d.lang,
      'quality::' || CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END,
      'safety::' || CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END]) END AS labels
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
    "doc_classes": """doc_classes AS (
  SELECT list(k ORDER BY k) AS classes FROM (SELECT DISTINCT unnest(labels) AS k FROM labelled_docs))""",
    "label_vectors": """label_vectors AS (
  SELECT label AS label_idx, 'c' || (label % 3) AS category,
    'c' || (label % 3) || '::l' || label AS label_key,
    arg_min(embedding, vec_id) AS vector_label
  FROM embeddings GROUP BY label)""",
    "vec_labels": """vec_labels AS (
  SELECT e.vec_id, e.embedding,
    CASE WHEN l.doc_id IS NULL THEN []::VARCHAR[]
      WHEN l.quality = 1 THEN ['c' || (label % 3) || '::l' || label,
        'c' || ((label + 3) % 10 % 3) || '::l' || ((label + 3) % 10)]
      ELSE ['c' || (label % 3) || '::l' || label] END AS labels
  FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id)""",
    "scores": """scores AS (
  SELECT v.vec_id, v.labels, k.label_idx, k.label_key, k.category,
    round(list_dot_product(v.embedding::DOUBLE[], k.vector_label::DOUBLE[]), 6) + 0.0 AS score,
    list_contains(v.labels, k.label_key) AS truth
  FROM vec_labels v CROSS JOIN label_vectors k)""",
    "counts": """counts AS (
  SELECT label_idx, label_key, category,
    count(*) FILTER (score >= 0.1 AND truth) AS tp,
    count(*) FILTER (score >= 0.1 AND NOT truth) AS fp,
    count(*) FILTER (score < 0.1 AND NOT truth) AS tn,
    count(*) FILTER (score < 0.1 AND truth) AS fn
  FROM scores GROUP BY ALL)""",
    "prf": """prf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
          CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM counts))""",
    "outcomes": """outcomes AS (
  SELECT vec_id, count(*) FILTER (score >= 0.1 AND truth) AS n_tp,
    count(*) FILTER (score >= 0.1 AND NOT truth) AS n_fp,
    count(*) FILTER (truth) AS n_true, count(*) FILTER (NOT truth) AS n_neg,
    bool_and((score >= 0.1) = truth) AS all_right
  FROM scores GROUP BY vec_id)""",
}
NEEDS = {
    "doc_classes": ["labelled_docs"],
    "scores": ["vec_labels", "label_vectors"],
    "counts": ["scores"],
    "prf": ["counts"],
    "outcomes": ["scores"],
}


def with_views(*names: str) -> str:
    """``WITH`` clause holding the named CTEs and all they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTES[n] for n in order) + "\n"
