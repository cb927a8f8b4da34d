"""Contrastive, ratio and full pairs, pair features and pair summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import FEATURE_MODES, plain_zero
from ..operators import frames, metrics, pairs, vocabularies
from . import views
from .catalog import query

_PAIRS_SQL = (
    views.with_views("vec_labels", "label_vectors")
    + """, grid AS (
  SELECT vec_id, label_key, list_contains(labels, label_key)::INT AS label
  FROM vec_labels, label_vectors WHERE len(labels) > 0),
sampled AS (
  SELECT vec_id, label_key, label, row_number() OVER (PARTITION BY vec_id, label
    ORDER BY md5(concat_ws('|', '42', vec_id, label_key)), label_key) AS rn FROM grid),
pairs AS (SELECT vec_id, label_key, label FROM sampled WHERE label = 1 OR rn <= 3)
"""
)


def contrastive(spark, d, side, keep=()):
    return pairs.contrastive_pairs(
        views.vec_labels(spark, d), side.keys, "vec_id", n_neg=3, seed=views.SEED, keep=keep
    )


@query("contrastive_pairs", _PAIRS_SQL + "SELECT vec_id, label_key, label FROM pairs")
def contrastive_pairs(spark, d):
    return contrastive(spark, d, views.label_side(spark, d))


@query("blocked_pairs", _PAIRS_SQL + "SELECT vec_id, label_key, label FROM pairs")
def blocked_pairs(spark, d):
    """The join form for label tables of any size, here on a small one."""
    return pairs.contrastive_pairs_from_table(
        views.vec_labels(spark, d),
        views.label_vectors(spark, d),
        "vec_id",
        n_neg=3,
        seed=views.SEED,
        block_labels=4,
    )


_TAGS_SQL = """WITH tagged AS (
  SELECT p_partkey, list_distinct([p_brand, p_type]) AS tags FROM part),
vocab AS (SELECT DISTINCT unnest(tags) AS tag FROM tagged),
grid AS (SELECT p_partkey, tag, list_contains(tags, tag)::INT AS label, len(tags) AS n_pos FROM tagged, vocab),
sampled AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, label
  ORDER BY md5(concat_ws('|', '42', p_partkey, tag)), tag) AS rn FROM grid)
"""


def product_tags(spark, d):
    return views.table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("text"), F.array("p_brand", "p_type").alias("tags")
    )


@query(
    "ratio_pairs",
    _TAGS_SQL
    + "SELECT p_partkey, tag AS label_key, label FROM sampled WHERE label = 1 OR rn <= 2 * n_pos",
)
def ratio_pairs(spark, d):
    tagged = product_tags(spark, d)
    vocab = frames.fit_classes(tagged, "tags")
    return pairs.ratio_pairs(
        tagged, vocab, "p_partkey", negatives_per_positive=2, seed=views.SEED
    )


_DEALT_SQL = """WITH tagged AS (SELECT p_partkey, list_distinct([p_brand, p_type]) AS tags FROM part),
vocab AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS idx
  FROM (SELECT DISTINCT unnest(tags) AS tag FROM tagged) WHERE tag IS NOT NULL),
size AS (SELECT count(*) AS n FROM vocab),
prime AS (SELECT n, min(p) AS p FROM (SELECT n, unnest(range(greatest(n, 2), 2 * n + 4)) AS p FROM size)
  WHERE len(list_filter(range(2, p), lambda q: p % q = 0)) = 0 GROUP BY n),
own AS (SELECT p_partkey, list(idx ORDER BY idx) AS ids
  FROM (SELECT p_partkey, unnest(tags) AS tag FROM tagged) JOIN vocab USING (tag) GROUP BY 1),
dealt AS (SELECT p_partkey, ids, n, p,
    ('0x' || substr(md5(concat_ws('|', '42', p_partkey, 'start')), 1, 15))::BIGINT % p AS a,
    ('0x' || substr(md5(concat_ws('|', '42', p_partkey, 'step')), 1, 15))::BIGINT % (p - 1) + 1 AS b
  FROM own, prime),
walked AS (SELECT p_partkey, ids, list_filter(list_transform(range(0, p), lambda j: (a + j * b) % p),
    lambda x: x < n AND NOT list_contains(ids, x))[1:2 * len(ids)] AS others FROM dealt)
SELECT p_partkey, tag AS label_key, label FROM (
  SELECT p_partkey, unnest(ids) AS idx, 1 AS label FROM walked
  UNION ALL SELECT p_partkey, unnest(others), 0 FROM walked) JOIN vocab USING (idx)"""


@query("dealt_pairs", _DEALT_SQL)
def dealt_pairs(spark, d):
    """Ratio pairs from a vocabulary table, with dealt negatives."""
    tagged = product_tags(spark, d)
    vocab = vocabularies.numbered_vocabulary(tagged, "tags")
    return vocabularies.ratio_pairs_from_table(
        tagged, vocab, "p_partkey", negatives_per_positive=2, seed=views.SEED
    )


@query("all_pairs", _TAGS_SQL + "SELECT p_partkey, tag AS label_key, label FROM grid")
def all_pairs(spark, d):
    tagged = product_tags(spark, d)
    return pairs.all_pairs(tagged, frames.fit_classes(tagged, "tags"), "p_partkey", "tags")


_FEATURE_SQL = {
    "concat": ["embedding[i]::DOUBLE", "vector_label[i]::DOUBLE"],
    "diff": ["embedding[i]::DOUBLE - vector_label[i]::DOUBLE"],
    "prod": ["embedding[i]::DOUBLE * vector_label[i]::DOUBLE"],
}


def _features_sql(mode: str) -> str:
    parts = [
        f"[{expr.replace('[i]', '[i]')} FOR i IN range(1, 65)]"
        for part in ("concat", "diff", "prod")
        if part in mode
        for expr in _FEATURE_SQL[part]
    ]
    features = parts[0]
    for p in parts[1:]:
        features = f"list_concat({features}, {p})"
    return (
        _PAIRS_SQL
        + f""", featured AS (
  SELECT vec_id, label_key, label, {features} AS f
  FROM pairs JOIN vec_labels USING (vec_id) JOIN label_vectors USING (label_key))
SELECT vec_id, label_key, label, len(f)::INT AS width, round(f[1], 6) + 0.0 AS first_value,
  round(f[len(f)], 6) + 0.0 AS last_value, round(list_sum(f), 6) + 0.0 AS total,
  round(list_sum([f[i] * i FOR i IN range(1, len(f) + 1)]), 5) + 0.0 AS weighted FROM featured"""
    )


def _register_features(mode: str) -> None:
    @query("pair_features_" + mode.replace("+", "_"), _features_sql(mode))
    def features(spark, d):
        side = views.label_side(spark, d)
        base = contrastive(spark, d, side, keep=["embedding"])
        out = pairs.featured_pairs(
            pairs.with_label_vectors(base, side), mode, vector="embedding"
        )
        f = F.col("features")
        weighted = F.aggregate(
            F.transform(f, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
        )
        return out.select(
            "vec_id",
            "label_key",
            "label",
            F.size(f).alias("width"),
            plain_zero(F.round(f[0], 6)).alias("first_value"),
            plain_zero(F.round(F.element_at(f, -1), 6)).alias("last_value"),
            plain_zero(
                F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x), 6)
            ).alias("total"),
            plain_zero(F.round(weighted, 5)).alias("weighted"),
        )


for _mode in FEATURE_MODES:
    _register_features(_mode)


@query(
    "class_weights",
    _PAIRS_SQL
    + """SELECT label, count(*) AS n_class, round((SELECT count(*) FROM pairs) / (2.0 * count(*)), 9) AS weight
FROM pairs GROUP BY label""",
)
def class_weights(spark, d):
    out = metrics.class_weights(contrastive(spark, d, views.label_side(spark, d)))
    return out.select("label", "n_class", F.round("weight", 9).alias("weight"))


@query(
    "dataset_summary",
    _PAIRS_SQL
    + """SELECT 'rows' AS item, count(*) AS n FROM vec_labels
UNION ALL SELECT 'vocabulary', count(DISTINCT k) FROM (SELECT unnest(labels) AS k FROM vec_labels)
UNION ALL SELECT CASE WHEN label = 1 THEN 'positive_pairs' ELSE 'negative_pairs' END, count(*) FROM pairs GROUP BY label""",
)
def dataset_summary(spark, d):
    return frames.dataset_summary(
        views.vec_labels(spark, d), contrastive(spark, d, views.label_side(spark, d))
    )


_DRAW = "('0x' || substr(md5(concat_ws('|', '42', {parts})), 1, 15))::BIGINT"


def _draw_sql(*parts: str) -> str:
    return _DRAW.format(parts=", ".join(parts))


_TEXT_PAIRS_SQL = (
    views.with_views("vec_labels")
    + f""", owned AS (SELECT vec_id, list_sort(list_distinct(labels)) AS s, md5(concat_ws('|', '42', vec_id)) AS h
  FROM vec_labels WHERE len(labels) > 0),
its AS (SELECT unnest(range(20)) AS iteration),
numbered AS (SELECT vec_id, l, row_number() OVER (PARTITION BY l ORDER BY h, vec_id) AS rn, count(*) OVER (PARTITION BY l) AS n
  FROM (SELECT vec_id, h, unnest(s) AS l FROM owned)),
own AS (SELECT vec_id, list({{'l': l, 'rn': rn, 'n': n}} ORDER BY l) AS o FROM numbered WHERE n > 1 GROUP BY vec_id),
chosen AS (SELECT vec_id, iteration, o[({_draw_sql("vec_id", "iteration", "'label'")} % len(o))::INT + 1] AS x FROM own, its),
same AS (SELECT c.vec_id, p.vec_id AS partner_id, 1 AS label, iteration FROM chosen c JOIN numbered p ON p.l = x.l
  AND p.rn = (x.rn - 1 + 1 + {_draw_sql("c.vec_id", "iteration", "'same'")} % (x.n - 1)) % x.n + 1),
line AS (SELECT *, row_number() OVER (ORDER BY h, vec_id) AS pos, count(*) OVER () AS total FROM owned),
tries AS (SELECT a.vec_id, a.s, a.total, iteration, t, (a.pos - 1 + 1 + {_draw_sql("a.vec_id", "iteration", "t")} % (a.total - 1)) % a.total + 1 AS dest
  FROM line a, its, (SELECT unnest([0, 1, 2, 3]) AS t)),
hits AS (SELECT tries.vec_id, iteration, arg_min(b.vec_id, t) AS partner_id FROM tries JOIN line b ON b.pos = dest
  WHERE NOT list_has_any(tries.s, b.s) GROUP BY ALL),
rest AS (SELECT vec_id, s, iteration FROM line, its WHERE (vec_id, iteration) NOT IN (SELECT (vec_id, iteration) FROM hits)),
far AS (SELECT r.vec_id, iteration, b.vec_id AS partner_id,
    row_number() OVER (PARTITION BY r.vec_id, iteration ORDER BY md5(array_to_string(b.s, chr(1))), b.h, b.vec_id) - 1 AS place,
    count(*) OVER (PARTITION BY r.vec_id, iteration) AS free FROM rest r JOIN line b ON NOT list_has_any(r.s, b.s)),
other AS (SELECT vec_id, partner_id, 0 AS label, iteration FROM hits
  UNION ALL SELECT vec_id, partner_id, 0, iteration FROM far
  WHERE place = {_draw_sql("vec_id", "iteration", "'far'")} % free)
SELECT vec_id, partner_id, label, iteration FROM same UNION ALL SELECT vec_id, partner_id, label, iteration FROM other"""
)


@query("text_pairs", _TEXT_PAIRS_SQL)
def text_pairs(spark, d):
    """Same-label and other-label partners for contrastive tuning."""
    return pairs.text_pairs(
        views.vec_labels(spark, d).select("vec_id", "labels"),
        "vec_id",
        num_iterations=20,
        seed=views.SEED,
    )
