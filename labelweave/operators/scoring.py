"""Label side, similarity scores and everything read off one row of scores.

A row keeps its scores as one array in label order. Ranking labels, thresholds,
category roll-ups, wide output and row metrics are then row-wise expressions and
need no shuffle. The long form is an explode away.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lab
from ..functions.vectors import dot, plain_zero, score_against

BLOCK_LABELS = 64


@dataclass(frozen=True)
class LabelSide:
    """Ordered labels, known on the driver and in every task, as a model's weights are.

    Label tables that should not be held there go through ``similarity_join``.
    """

    keys: tuple[str, ...]
    categories: tuple[str, ...]
    vectors: tuple[tuple[float, ...], ...] = ()

    @classmethod
    def from_taxonomy(cls, taxonomy: Mapping[str, Mapping[str, str]]) -> LabelSide:
        pairs = [(c, l) for c, labs in taxonomy.items() for l in labs]
        return cls(
            tuple(f"{c}{lab.KEY_SEPARATOR}{l}" for c, l in pairs), tuple(c for c, _ in pairs)
        )

    @classmethod
    def from_keys(cls, keys: Sequence[str]) -> LabelSide:
        return cls(tuple(keys), tuple(k.split(lab.KEY_SEPARATOR)[0] for k in keys))

    @classmethod
    def from_frame(cls, label_vectors: DataFrame) -> LabelSide:
        """Read ``label_idx, label_key, vector_label``."""
        rows = label_vectors.select("label_idx", "label_key", "vector_label").collect()
        rows.sort(key=lambda r: r["label_idx"])
        side = cls.from_keys([r["label_key"] for r in rows])
        return cls(side.keys, side.categories, tuple(tuple(r["vector_label"]) for r in rows))

    def __len__(self) -> int:
        return len(self.keys)

    @property
    def matrix(self) -> np.ndarray:
        return np.asarray(self.vectors, dtype=np.float64)

    @property
    def category_names(self) -> list[str]:
        return list(dict.fromkeys(self.categories))

    def members(self, category: str) -> list[int]:
        return [i for i, c in enumerate(self.categories) if c == category]

    def frame(self, spark: SparkSession) -> DataFrame:
        """``label_idx, label_key, vector_label`` as a small table."""
        rows = [
            (i, k, list(map(float, v))) for i, (k, v) in enumerate(zip(self.keys, self.vectors))
        ]
        return spark.createDataFrame(
            rows, "label_idx int, label_key string, vector_label array<float>"
        )

    def key_at(self, index: Column) -> Column:
        return F.element_at(lab.class_array(self.keys), index + 1)

    def category_at(self, index: Column) -> Column:
        return F.element_at(lab.class_array(self.categories), index + 1)


def taxonomy_frame(spark: SparkSession, taxonomy: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Flat taxonomy in its own order: index, category, label, description, key."""
    rows = [
        (i, c, l, d, f"{c}{lab.KEY_SEPARATOR}{l}")
        for i, (c, l, d) in enumerate(
            (c, l, d) for c, labs in taxonomy.items() for l, d in labs.items()
        )
    ]
    return spark.createDataFrame(
        rows,
        "label_idx int, category string, label string, description string, label_key string",
    )


def similarity_rows(
    texts: DataFrame, side: LabelSide, vector: str = "vector", out: str = "scores", digits: int | None = None
) -> DataFrame:
    """Add the array of dot products of a vector with every label vector."""
    scored = texts.withColumn(out, score_against(side.matrix)(F.col(vector)))
    if digits is not None:
        scored = scored.withColumn(
            out, F.transform(F.col(out), lambda s: plain_zero(F.round(s, digits)))
        )
    return scored


def long_scores(
    scored: DataFrame, side: LabelSide, keep: Sequence[str], scores: str = "scores", truth: str | None = None
) -> DataFrame:
    """One row per (row, label): ``label_idx, label_key, category, score[, truth]``."""
    # a row without vector has no scores, but keeps its place under every label
    none = F.array_repeat(F.lit(None).cast("double"), len(side))
    scored = scored.withColumn(scores, F.coalesce(scores, none))
    zipped = F.arrays_zip(scores, truth) if truth else F.arrays_zip(scores)
    exploded = scored.select(*keep, F.posexplode(zipped).alias("label_idx", "_s"))
    cols = [
        *keep,
        "label_idx",
        side.key_at(F.col("label_idx")).alias("label_key"),
        side.category_at(F.col("label_idx")).alias("category"),
        F.col("_s")[scores].alias("score"),
    ]
    if truth:
        cols.append(F.col("_s")[truth].alias("truth"))
    return exploded.select(*cols)


def similarity_join(
    texts: DataFrame,
    label_vectors: DataFrame,
    row_id: str,
    vector: str = "vector",
    salts: int | None = None,
    block_labels: int = BLOCK_LABELS,
) -> DataFrame:
    """Scores of every text with every label, for a label table of any size.

    The labels are cut into blocks, the texts are repeated once per block, and both
    meet in an equi join on (block, salt); the salt spreads a block over tasks. Where
    the blocks are small, Spark's own size check sends them along instead. A text
    without vector has NULL scores.
    """
    spark = texts.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct("label_idx", "label_key", "vector_label")
    blocks = (
        label_vectors.groupBy(F.expr(f"label_idx div {block_labels}").alias("_block"))
        .agg(F.collect_list(item).alias("_labels"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    top = label_vectors.agg(F.max("label_idx")).first()[0]
    repeated = texts.select(
        row_id,
        F.col(vector).alias("_v"),
        F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int").alias("_salt"),
        F.explode(F.expr(f"sequence(0L, {top // block_labels}L)")).alias("_block"),
    )
    scored = F.transform(
        F.col("_labels"),
        lambda x: F.struct(
            x["label_idx"].alias("label_idx"),
            x["label_key"].alias("label_key"),
            dot(x["vector_label"], F.col("_v")).alias("score"),
        ),
    )
    return repeated.join(blocks, ["_block", "_salt"]).select(row_id, F.inline(scored)).select(
        row_id,
        "label_idx",
        "label_key",
        F.element_at(F.split("label_key", lab.KEY_SEPARATOR), 1).alias("category"),
        "score",
    )


def truth_array(labels: Column | str, side: LabelSide) -> Column:
    """Boolean per label in label order; labels outside the side are ignored."""
    return lab.label_flags(labels, side.keys)


def predicted_array(scores: Column | str, threshold: float) -> Column:
    """Boolean per label; the threshold itself counts as predicted."""
    s = F.col(scores) if isinstance(scores, str) else scores
    return F.transform(s, lambda x: F.coalesce(x >= F.lit(float(threshold)), F.lit(False)))


def wide_columns(side: LabelSide, threshold: float, scores: str = "scores") -> list[Column]:
    """``sim::<key>`` and ``<key>`` for every label."""
    value = F.col(scores)
    sims = [value[i].alias(f"sim::{k}") for i, k in enumerate(side.keys)]
    return sims + [
        (value[i] >= F.lit(float(threshold))).alias(k) for i, k in enumerate(side.keys)
    ]


def category_columns(side: LabelSide, threshold: float, scores: str = "scores") -> list[Column]:
    """``cat_sim::<category>`` (highest score) and ``cat::<category>`` (any predicted)."""
    out = []
    for cat in side.category_names:
        parts = [F.col(scores)[i] for i in side.members(cat)]
        best = F.greatest(*parts) if len(parts) > 1 else parts[0]
        out += [
            best.alias(f"cat_sim::{cat}"),
            (best >= F.lit(float(threshold))).alias(f"cat::{cat}"),
        ]
    return out


def ranked_items(side: LabelSide, members: Sequence[int], scores: str = "scores") -> Column:
    """Structs (order, label_idx, score) of some labels, best first, ties by index."""
    items = [
        F.struct(
            (-F.col(scores)[i]).alias("order"),
            F.lit(i).alias("label_idx"),
            F.col(scores)[i].alias("score"),
        )
        for i in members
    ]
    return F.array_sort(F.array(*items))


def rank_in_category(
    scored: DataFrame, side: LabelSide, row_id: str, top_k: int, scores: str = "scores"
) -> DataFrame:
    """Rank of every label inside its category and the top-k flag.

    Apply label searches afterwards: the rank is that of the full category.
    """
    per_cat = F.array(
        *[
            F.transform(
                ranked_items(side, side.members(c), scores),
                lambda x, i: F.struct(
                    x["label_idx"].alias("label_idx"),
                    x["score"].alias("score"),
                    (i + 1).alias("rank"),
                ),
            )
            for c in side.category_names
        ]
    )
    return (
        scored.select(row_id, F.inline(F.flatten(per_cat)))
        .withColumn("label_key", side.key_at(F.col("label_idx")))
        .withColumn("category", side.category_at(F.col("label_idx")))
        .withColumn("is_top", F.col("rank") <= F.lit(top_k))
    )


def scored_tags(
    scored: DataFrame,
    side: LabelSide,
    row_id: str,
    threshold: float | None = None,
    top_k: int | None = None,
    scores: str = "scores",
) -> DataFrame:
    """Labels of every row, best first, with an optional threshold and top-k."""
    best = ranked_items(side, range(len(side)), scores)
    if threshold is not None:
        best = F.filter(best, lambda x: x["score"] >= F.lit(float(threshold)))
    if top_k is not None:
        best = F.slice(best, 1, top_k)
    return scored.select(row_id, F.posexplode(best).alias("_p", "_x")).select(
        row_id,
        (F.col("_p") + 1).alias("position"),
        side.key_at(F.col("_x")["label_idx"]).alias("label_key"),
        F.col("_x")["score"].alias("score"),
    )
