"""Label parsing, encoding, filters, taxonomies and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lab
from ..functions import vectors
from ..functions.text import described_tag, with_allowed_labels
from ..operators import frames, scoring, vocabularies
from . import views
from .catalog import query


def _joined(col):
    return F.array_join(col, "|")


_RAW = views.with_views("labelled_docs") + """, raw AS (
  SELECT doc_id, labels, ' ' || array_to_string(labels, ' ; ') || ',, ' AS delimited,
    CASE WHEN len(labels) = 0 THEN '  '
      WHEN list_contains(labels, 'safety::toxic') THEN '[' || array_to_string(labels, ',')
      ELSE to_json(labels)::VARCHAR || ' ' END AS json,
    '[' || array_to_string(list_transform(labels, lambda x: '''' || x || ''''), ', ') || ']' AS literal
  FROM labelled_docs)
"""


@query(
    "parse_labels_delimited",
    _RAW
    + """SELECT doc_id, array_to_string(parts, '|') AS parsed, len(parts)::INT AS n_labels FROM (
  SELECT doc_id, list_filter(list_transform(string_split(replace(delimited, ';', ','), ','),
    lambda x: trim(x)), lambda x: x <> '') AS parts FROM raw)""",
)
def parse_labels_delimited(spark, d):
    parsed = lab.parse_delimited("delimited")
    return views.raw_labels(spark, d).select(
        "doc_id", _joined(parsed).alias("parsed"), F.size(parsed).alias("n_labels")
    )


@query(
    "parse_labels_json",
    _RAW
    + """SELECT doc_id, array_to_string(parts, '|') AS parsed, len(parts)::INT AS n_labels FROM (
  SELECT doc_id, CASE WHEN trim(json) = '' THEN []::VARCHAR[]
    WHEN trim(json)[1] = '[' AND json_valid(json) THEN from_json(json, '["VARCHAR"]')
    ELSE [trim(json)] END AS parts FROM raw)""",
)
def parse_labels_json(spark, d):
    parsed = lab.parse_json_list("json")
    return views.raw_labels(spark, d).select(
        "doc_id", _joined(parsed).alias("parsed"), F.size(parsed).alias("n_labels")
    )


@query(
    "parse_labels_literal",
    _RAW
    + """SELECT doc_id, array_to_string(parts, '|') AS parsed, len(parts)::INT AS n_labels FROM (
  SELECT doc_id, from_json(replace(literal, '''', '"'), '["VARCHAR"]') AS parts FROM raw)""",
)
def parse_labels_literal(spark, d):
    parsed = lab.parse_literal_list("literal")
    return views.raw_labels(spark, d).select(
        "doc_id", _joined(parsed).alias("parsed"), F.size(parsed).alias("n_labels")
    )


@query(
    "label_names",
    views.with_views("labelled_docs")
    + """SELECT doc_id, array_to_string(list_transform(labels, lambda x: split_part(x, '::', 2)), '|') AS names
FROM labelled_docs""",
)
def label_names(spark, d):
    return views.labelled_docs(spark, d).select(
        "doc_id", _joined(lab.label_names("labels")).alias("names")
    )


@query(
    "normalize_tags",
    """SELECT p_partkey, array_to_string(list_reduce(list_prepend([]::VARCHAR[],
    list_transform([b, t, b], lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, x[1])
    THEN acc ELSE list_concat(acc, x) END), '|') AS tags
FROM (SELECT p_partkey, trim(p_brand) AS b, trim(p_type) AS t FROM part)""",
)
def normalize_tags(spark, d):
    raw = F.array(
        F.concat(F.lit(" "), "p_brand"),
        F.concat(F.lit("\t"), "p_type", F.lit("\n")),
        F.lit("  "),
        F.concat("p_brand", F.lit("  ")),
    )
    return views.table(spark, d, "part").select(
        "p_partkey", _joined(lab.normalize_tags(raw)).alias("tags")
    )


@query(
    "label_vocabulary",
    views.with_views("labelled_docs")
    + "SELECT DISTINCT unnest(labels) AS label_key FROM labelled_docs",
)
def label_vocabulary(spark, d):
    return frames.vocabulary(views.labelled_docs(spark, d))


@query(
    "multi_hot",
    views.with_views("labelled_docs", "doc_classes")
    + """SELECT doc_id, array_to_string(list_transform(classes,
  lambda c: CASE WHEN list_contains(labels, c) THEN '1' ELSE '0' END), '') AS bits
FROM labelled_docs, doc_classes""",
)
def multi_hot(spark, d):
    docs = views.labelled_docs(spark, d)
    vocab = vocabularies.numbered_vocabulary(docs)
    numbered = vocabularies.label_numbers(docs, vocab, "doc_id")
    hot = vocabularies.dense_hot("label_ids", vocab.count())
    return numbered.select("doc_id", F.array_join(F.transform(hot, lambda b: b.cast("string")), "").alias("bits"))


@query(
    "label_numbers",
    views.with_views("labelled_docs")
    + """, v AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i FROM (SELECT DISTINCT unnest(labels) AS k FROM labelled_docs)),
o AS (SELECT doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, unnest(labels) AS k FROM labelled_docs) JOIN v USING (k) GROUP BY 1)
SELECT doc_id, coalesce(ids, '') AS label_ids FROM labelled_docs LEFT JOIN o USING (doc_id)""",
)
def label_numbers(spark, d):
    """Sparse form of the multi-hot vector."""
    docs = views.labelled_docs(spark, d)
    numbered = vocabularies.label_numbers(docs, vocabularies.numbered_vocabulary(docs), "doc_id")
    return numbered.select("doc_id", F.array_join(F.col("label_ids").cast("array<string>"), ",").alias("label_ids"))


@query(
    "onehot_export",
    views.with_views("labelled_docs")
    + "SELECT doc_id, "
    + ", ".join(f"list_contains(labels, '{k}') AS \"{k}\"" for k in views.DOC_SIDE.keys)
    + " FROM labelled_docs",
)
def onehot_export(spark, d):
    docs = views.labelled_docs(spark, d)
    return docs.select("doc_id", *frames.one_hot_columns(views.DOC_SIDE.keys))


_PREDICTED_SQL = """, predicted AS (
  SELECT doc_id, labels, list_sort(['lang::en', CASE WHEN length(text) >= 500
    THEN 'quality::good' ELSE 'quality::bad' END]) AS guess FROM labelled_docs)
"""


def _guessed(spark, d):
    """Documents with a rule-based prediction, for review frames."""
    guess = F.array_sort(
        F.array(
            F.lit("lang::en"),
            F.when(F.col("long"), "quality::good").otherwise("quality::bad"),
        )
    )
    docs = views.labelled_docs(spark, d, (F.length("text") >= 500).alias("long"))
    return docs.select("doc_id", "labels", guess.alias("guess"))


@query(
    "predictions_frame",
    views.with_views("labelled_docs")
    + _PREDICTED_SQL
    + """SELECT doc_id, array_to_string(labels, ';') AS "true", array_to_string(guess, ';') AS predicted
FROM predicted""",
)
def predictions_frame(spark, d):
    classes = sorted(views.DOC_SIDE.keys)
    hot = _guessed(spark, d).select(
        "doc_id",
        lab.multi_hot("labels", classes).alias("t"),
        lab.multi_hot("guess", classes).alias("p"),
    )
    return frames.predictions_frame(hot, classes, "t", "p", keep=["doc_id"])


@query(
    "review_frame",
    views.with_views("labelled_docs")
    + _PREDICTED_SQL
    + """SELECT doc_id, array_to_string(labels, '|') AS labels, array_to_string(guess, '|') AS predicted,
  labels = guess AS is_correct FROM predicted""",
)
def review_frame(spark, d):
    out = frames.review_frame(_guessed(spark, d), "labels", "guess", keep=["doc_id"])
    return out.select(
        "doc_id",
        _joined(F.col("labels")).alias("labels"),
        _joined(F.col("predicted")).alias("predicted"),
        "is_correct",
    )


@query(
    "labeled_rows",
    views.with_views("labelled_docs")
    + "SELECT doc_id, len(labels)::INT AS n_labels FROM labelled_docs WHERE len(labels) > 0",
)
def labeled_rows(spark, d):
    return frames.labelled_rows(views.labelled_docs(spark, d)).select(
        "doc_id", F.size("labels").alias("n_labels")
    )


@query(
    "label_progress",
    views.with_views("labelled_docs")
    + """SELECT count(*) FILTER (len(labels) > 0) AS n_labeled,
  count(*) FILTER (len(labels) = 0) AS n_remaining FROM labelled_docs""",
)
def label_progress(spark, d):
    from ..operators.metrics import label_progress as progress

    return progress(views.labelled_docs(spark, d))


@query(
    "validation_report",
    views.with_views("labelled_docs")
    + """SELECT 'at_least_two_rows' AS rule, CASE WHEN count(*) < 2 THEN 1 ELSE 0 END::BIGINT AS violations,
  NULL::BIGINT AS first_row FROM labelled_docs
UNION ALL SELECT 'non_blank_text', count(*) FILTER (trim(text) = ''),
  min(doc_id) FILTER (trim(text) = '') FROM labelled_docs
UNION ALL SELECT 'at_least_one_tag', count(*) FILTER (len(labels) = 0),
  min(doc_id) FILTER (len(labels) = 0) FROM labelled_docs""",
)
def validation_report(spark, d):
    docs = views.labelled_docs(spark, d, frames.is_blank().alias("blank"))
    return frames.validation_report(docs, "doc_id", blank=F.col("blank"))


@query(
    "label_search",
    """SELECT doc_id, source, lang FROM documents
WHERE contains(lower(source || ' ' || lang), 'src1') AND contains(lower(source || ' ' || lang), 'en')""",
)
def label_search(spark, d):
    hay = F.concat_ws(" ", "source", "lang")
    return (
        views.table(spark, d, "documents")
        .filter(lab.matches_query(hay, "SRC1 en"))
        .select("doc_id", "source", "lang")
    )


@query(
    "label_texts",
    views.with_views("labelled_docs")
    + """, tax(label_idx, category, label, description) AS (VALUES """
    + ", ".join(
        f"({i}, '{c}', '{l}', '{t}')"
        for i, (c, l, t) in enumerate(
            (c, l, t) for c, ls in views.DOC_TAXONOMY.items() for l, t in ls.items()
        )
    )
    + """), used AS (SELECT k, count(*) AS n_docs FROM (SELECT unnest(labels) AS k FROM labelled_docs) GROUP BY k)
SELECT label_idx, category || '::' || label AS label_key, label || '. ' || description AS label_text,
  category || '::' || label || ': ' || description AS tag_text, coalesce(n_docs, 0) AS n_docs
FROM tax LEFT JOIN used ON k = category || '::' || label""",
)
def label_texts(spark, d):
    tax = scoring.taxonomy_frame(spark, views.DOC_TAXONOMY)
    used = (
        views.labelled_docs(spark, d)
        .select(F.explode("labels").alias("label_key"))
        .groupBy("label_key")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    return tax.join(used, "label_key", "left").select(
        "label_idx",
        "label_key",
        lab.label_text("label", "description").alias("label_text"),
        described_tag("label_key", "description").alias("tag_text"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
    )


@query(
    "allowed_instruction",
    views.with_views("labelled_docs")
    + """, per AS (SELECT split_part(k, '::', 1) AS field, list(split_part(k, '::', 2) ORDER BY k) AS vals
  FROM (SELECT DISTINCT unnest(labels) AS k FROM labelled_docs) GROUP BY 1)
SELECT 'Assign every applicable label.' || chr(10) || chr(10) || 'Allowed labels per field:' || chr(10) || '{'
  || string_agg('"' || field || '": ["' || array_to_string(vals, '", "') || '"]', ', ' ORDER BY field) || '}' AS instruction
FROM per""",
)
def allowed_instruction(spark, d):
    allowed: dict[str, list[str]] = {}
    for key in frames.fit_classes(views.labelled_docs(spark, d)):
        field, value = key.split("::", 1)
        allowed.setdefault(field, []).append(value)
    text = with_allowed_labels("Assign every applicable label.", allowed)
    return spark.createDataFrame([(text,)], "instruction string")


@query(
    "wide_vectors",
    "SELECT vec_id, "
    + ", ".join(f"embedding[{i + 1}] AS emb_{i}" for i in range(64))
    + " FROM embeddings",
)
def wide_vectors(spark, d):
    emb = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.widen(emb, "embedding", 64)


@query(
    "vector_lengths",
    """WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len FROM embeddings),
u AS (SELECT vec_id, len, list_transform(embedding, lambda x: x::DOUBLE / (len + 1e-12)) AS unit FROM n)
SELECT vec_id, round(len, 6) AS norm_before, round(sqrt(list_sum(list_transform(unit, lambda x: x * x))), 6) AS norm_after FROM u""",
)
def vector_lengths(spark, d):
    unit = vectors.l2_normalize("embedding")
    return views.table(spark, d, "embeddings").select(
        "vec_id",
        F.round(F.sqrt(vectors.dot("embedding", "embedding")), 6).alias("norm_before"),
        F.round(F.sqrt(vectors.dot(unit, unit)), 6).alias("norm_after"),
    )


@query(
    "known_label_filter",
    views.with_views("labelled_docs")
    + "SELECT doc_id FROM labelled_docs WHERE list_has_any(labels, ['quality::good', 'lang::fr', 'none::such'])",
)
def known_label_filter(spark, d):
    from ..operators.pairs import known_label_filter as known

    keep = known("labels", ["quality::good", "lang::fr", "none::such"])
    return views.labelled_docs(spark, d).filter(keep).select("doc_id")


@query(
    "nested_examples",
    "SELECT doc_id, md5(text) AS text_md5, lang AS ex_lang, source AS ex_source FROM documents",
)
def nested_examples(spark, d):
    docs = views.table(spark, d, "documents")
    ex = frames.nested_examples(docs, "text", ["lang", "source"], keep=["doc_id"])
    return ex.select(
        "doc_id",
        F.md5("text").alias("text_md5"),
        F.col("extracted.lang").alias("ex_lang"),
        F.col("extracted.source").alias("ex_source"),
    )


@query(
    "set_ops_per_row",
    views.with_views("labelled_docs")
    + _PREDICTED_SQL
    + """SELECT doc_id, array_to_string(list_sort(list_intersect(labels, guess)), '|') AS both,
  array_to_string(list_sort(list_filter(labels, lambda x: NOT list_contains(guess, x))), '|') AS missed,
  len(list_distinct(list_concat(labels, guess)))::INT AS n_union FROM predicted""",
)
def set_ops_per_row(spark, d):
    return _guessed(spark, d).select(
        "doc_id",
        _joined(F.array_sort(F.array_intersect("labels", "guess"))).alias("both"),
        _joined(F.array_sort(F.array_except("labels", "guess"))).alias("missed"),
        F.size(F.array_union("labels", "guess")).alias("n_union"),
    )


@query(
    "anti_seen_texts",
    "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)",
)
def anti_seen_texts(spark, d):
    docs = views.table(spark, d, "documents")
    return frames.without_seen(docs, views.table(spark, d, "benchmark")).select("doc_id")


@query(
    "distinct_texts",
    "SELECT sha256(text) AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY text",
)
def distinct_texts(spark, d):
    docs = views.table(spark, d, "documents")
    return frames.distinct_texts(docs, "doc_id")


@query(
    "slug_names",
    """SELECT o_orderpriority AS name, lower(o_orderpriority) AS lowered,
  regexp_full_match(o_orderpriority, '[a-z0-9][a-z0-9_-]*') AND NOT contains(o_orderpriority, '__') AS is_slug,
  regexp_full_match(lower(replace(o_orderpriority, ' ', '_')), '[a-z0-9][a-z0-9_-]*') AS fixed_is_slug,
  count(*) AS n FROM orders GROUP BY ALL""",
)
def slug_names(spark, d):
    name = F.col("o_orderpriority")
    return (
        views.table(spark, d, "orders")
        .groupBy(name.alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "name",
            F.lower("name").alias("lowered"),
            lab.is_slug("name").alias("is_slug"),
            lab.is_slug(F.lower(F.replace("name", F.lit(" "), F.lit("_")))).alias("fixed_is_slug"),
            "n",
        )
    )


@query(
    "hash_embed",
    """WITH tokens AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents),
counts AS (
  SELECT doc_id, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INT AS dim, count(*) AS n
  FROM tokens GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM counts GROUP BY doc_id)
SELECT doc_id, dim, round(n / (len + 1e-12), 6) AS value FROM counts JOIN norms USING (doc_id)""",
)
def hash_embed(spark, d):
    vecs = vectors.hash_vectors(views.table(spark, d, "documents"), "doc_id", "text")
    return (
        vecs.select("doc_id", F.posexplode("vector").alias("dim", "value"))
        .filter(F.col("value") > 0)
        .select("doc_id", "dim", F.round("value", 6).alias("value"))
    )
