"""Text-label pairs and text-text pairs.

Pairs of a text with labels come from array expressions over the text's own row:
the candidates are the label array minus the text's labels, their order is a
seeded hash, and the sample is a slice. No join and no shuffle are involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lab
from ..functions.vectors import pair_features
from ..session import ensure_checkpoint_dir
from .ranking import hash_number, hash_order, rank_within
from .scoring import BLOCK_LABELS, LabelSide


def known_label_filter(labels: str, keys: Sequence[str]) -> Column:
    """Rows with at least one label of the vocabulary."""
    return F.arrays_overlap(F.col(labels), lab.class_array(keys))


def sampled_negatives(
    labels: Column, keys: Sequence[str], row_id: str, count: Column, seed: int
) -> Column:
    """The first ``count`` labels a text does not have, in seeded hash order."""
    candidates = F.array_except(lab.class_array(keys), labels)
    ordered = F.array_sort(
        F.transform(
            candidates,
            lambda k: F.struct(hash_order(seed, F.col(row_id), k).alias("h"), k.alias("k")),
        )
    )
    return F.transform(F.slice(ordered, F.lit(1), count), lambda x: x["k"])


def _exploded(df: DataFrame, keep: Sequence[str], positives: Column, negatives: Column) -> DataFrame:
    flagged = F.concat(
        F.transform(positives, lambda k: F.struct(k.alias("label_key"), F.lit(1).alias("label"))),
        F.transform(negatives, lambda k: F.struct(k.alias("label_key"), F.lit(0).alias("label"))),
    )
    return df.select(*keep, F.inline(flagged))


def contrastive_pairs(
    texts: DataFrame,
    keys: Sequence[str],
    row_id: str,
    labels: str = "labels",
    n_neg: int = 3,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """All positives of a text and ``n_neg`` sampled negatives.

    Texts without any known label are left out. Vectors need not ride along: add
    them afterwards with ``with_label_vectors``.
    """
    known = F.array_intersect(F.col(labels), lab.class_array(keys))
    negatives = sampled_negatives(F.col(labels), keys, row_id, F.lit(n_neg), seed)
    return _exploded(
        texts.filter(known_label_filter(labels, keys)), [row_id, *keep], known, negatives
    )


def contrastive_pairs_from_table(
    texts: DataFrame,
    label_table: DataFrame,
    row_id: str,
    labels: str = "labels",
    n_neg: int = 3,
    seed: int = 42,
    block_labels: int = BLOCK_LABELS,
) -> DataFrame:
    """``contrastive_pairs`` for a label table (``label_idx, label_key``) of any size.

    The labels are cut into blocks. Every block gives at most ``n_neg`` candidates per
    text, and the best ``n_neg`` of those are the same as the best of all labels.
    """
    salts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = texts.select(row_id, F.explode(F.array_distinct(labels)).alias("label_key"))
    positives = owned.join(label_table.select("label_key"), "label_key").select(
        row_id, "label_key", F.lit(1).alias("label")
    )
    blocks = (
        label_table.groupBy(F.expr(f"label_idx div {block_labels}").alias("_block"))
        .agg(F.collect_list("label_key").alias("_keys"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    top = label_table.agg(F.max("label_idx")).first()[0]
    known = texts.join(positives.select(row_id).distinct(), row_id, "left_semi")
    repeated = known.select(
        row_id,
        labels,
        F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int").alias("_salt"),
        F.explode(F.expr(f"sequence(0L, {top // block_labels}L)")).alias("_block"),
    )
    candidates = F.slice(
        F.array_sort(
            F.transform(
                F.array_except(F.col("_keys"), F.col(labels)),
                lambda k: F.struct(hash_order(seed, F.col(row_id), k).alias("h"), k.alias("k")),
            )
        ),
        1,
        n_neg,
    )
    best = Window.partitionBy(row_id).orderBy("h", "k")
    negatives = (
        repeated.join(blocks, ["_block", "_salt"])
        .select(row_id, F.inline(candidates))
        .withColumn("_rn", F.row_number().over(best))
        .filter(F.col("_rn") <= n_neg)
        .select(row_id, F.col("k").alias("label_key"), F.lit(0).alias("label"))
    )
    return positives.unionByName(negatives)


def ratio_pairs(
    texts: DataFrame,
    all_tags: Sequence[str],
    row_id: str,
    tags: str = "tags",
    negatives_per_positive: int = 3,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Distinct tags as positives and ``negatives_per_positive`` times as many negatives."""
    positives = F.array_sort(F.array_distinct(F.col(tags)))
    count = F.size(positives) * F.lit(negatives_per_positive)
    negatives = sampled_negatives(positives, all_tags, row_id, count, seed)
    return _exploded(texts, [row_id, *keep], positives, negatives)


def all_pairs(
    texts: DataFrame,
    keys: Sequence[str],
    row_id: str,
    labels: str = "labels",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every label of the vocabulary with its truth flag, one row per (text, label)."""
    flagged = F.zip_with(
        lab.class_array(keys),
        lab.multi_hot(labels, keys),
        lambda k, y: F.struct(k.alias("label_key"), y.alias("label")),
    )
    return texts.select(row_id, *keep, F.inline(flagged))


def with_label_vectors(pairs: DataFrame, side: LabelSide) -> DataFrame:
    """Attach ``vector_label`` by key. The labels are broadcast: Spark cannot tell their size, and
    else moves the pairs to them, all of a label to one task."""
    vectors = side.frame(pairs.sparkSession).select("label_key", "vector_label")
    return pairs.join(F.broadcast(vectors), "label_key")


def featured_pairs(
    pairs: DataFrame, mode: str = "concat+diff+prod", vector: str = "vector", out: str = "features"
) -> DataFrame:
    return pairs.withColumn(out, pair_features(vector, "vector_label", mode))


def _draw(seed: int, *cols: Column | str) -> Column:
    return hash_number(hash_order(seed, *cols))


def same_label_pairs(
    texts: DataFrame, row_id: str, labels: str = "labels", num_iterations: int = 1, seed: int = 42
) -> DataFrame:
    """``num_iterations`` partners per text that share a label with it.

    The texts of a label are numbered, a text draws one of its labels and another
    number, and the partner is fetched by an equi join on (label, number).
    """
    member = texts.select(
        F.col(row_id),
        F.explode(F.array_distinct(labels)).alias("_l"),
        hash_order(seed, row_id).alias("_h"),
    )
    ensure_checkpoint_dir(texts.sparkSession)
    numbered = (
        rank_within(member, ["_l"], "_h", row_id, out="_rn", size="_n")
        .select(row_id, "_l", "_rn", "_n")
        .checkpoint()
    )
    own = (
        numbered.filter("_n > 1")
        .groupBy(row_id)
        .agg(F.array_sort(F.collect_list(F.struct("_l", "_rn", "_n"))).alias("_own"))
    )
    drawn = own.withColumn("iteration", _each_of(num_iterations)).withColumn(
        "_x",
        F.get("_own", F.pmod(_draw(seed, row_id, "iteration", F.lit("label")), F.size("_own")).cast("int")),
    )
    step = F.pmod(_draw(seed, row_id, "iteration", F.lit("same")), F.col("_x._n") - 1) + 1
    wanted = drawn.select(
        row_id,
        "iteration",
        F.col("_x._l").alias("_l"),
        (F.pmod(F.col("_x._rn") - 1 + step, F.col("_x._n")) + 1).alias("_rn"),
    )
    partner = numbered.select("_l", "_rn", F.col(row_id).alias("partner_id"))
    return wanted.join(partner, ["_l", "_rn"]).select(
        row_id, "partner_id", F.lit(1).alias("label"), "iteration"
    )


def _each_of(n: int) -> Column:
    """Explodes to 0 .. n - 1; to nothing for 0, where a sequence would count down."""
    return F.explode(F.slice(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), 1, max(n, 0)))


def other_label_pairs(
    texts: DataFrame,
    row_id: str,
    labels: str = "labels",
    num_iterations: int = 1,
    seed: int = 42,
    tries: int = 4,
) -> DataFrame:
    """``num_iterations`` partners per text that share no label with it.

    All texts are numbered; a text draws ``tries`` other numbers and takes the
    first partner without a common label. Texts that drew none, which happens
    when they overlap with nearly all others, go through ``_far_partners``.
    """
    owned = texts.filter(F.size(labels) > 0).select(
        F.col(row_id), F.array_sort(F.array_distinct(labels)).alias("_set")
    )
    ensure_checkpoint_dir(texts.sparkSession)
    total = owned.count()
    if total < 2:
        return owned.select(
            row_id,
            F.col(row_id).alias("partner_id"),
            F.lit(0).alias("label"),
            F.lit(0).alias("iteration"),
        ).limit(0)
    line = rank_within(
        owned.withColumn("_h", hash_order(seed, row_id)), [], "_h", row_id, out="_pos"
    ).drop("_h").checkpoint()
    asked = line.withColumn("iteration", _each_of(num_iterations))
    step = F.pmod(_draw(seed, row_id, "iteration", "_try"), F.lit(total - 1)) + 1
    drawn = asked.withColumn("_try", _each_of(tries)).withColumn(
        "_to", F.pmod(F.col("_pos") - 1 + step, F.lit(total)) + 1
    )
    partner = line.select(
        F.col("_pos").alias("_to"), F.col(row_id).alias("partner_id"), F.col("_set").alias("_set2")
    )
    hit = (
        drawn.join(partner, "_to")
        .filter(~F.arrays_overlap("_set", "_set2"))
        .groupBy(row_id, "iteration")
        .agg(F.min_by("partner_id", "_try").alias("partner_id"))
        .checkpoint()
    )
    rest = asked.join(hit, [row_id, "iteration"], "left_anti").select(row_id, "iteration", "_set")
    found = hit.select(row_id, "partner_id", F.lit(0).alias("label"), "iteration")
    if rest.isEmpty():
        return found
    return found.unionByName(_far_partners(owned, rest, row_id, total, seed))


def _far_partners(
    owned: DataFrame, rest: DataFrame, row_id: str, total: int, seed: int
) -> DataFrame:
    """Exact partners for the few texts whose draws all shared a label.

    Texts are put in a line ordered by their label set, so the texts overlapping
    with a given set fill a few intervals of it. The draw is a position outside
    those intervals; texts that overlap with everything get no partner.
    """
    keyed = owned.withColumn("_sig", F.md5(F.concat_ws("\u0001", "_set")))
    sizes = keyed.groupBy("_sig", "_set").agg(F.count(F.lit(1)).alias("_n"))
    cut = sizes.withColumn("_b", F.substring("_sig", 1, 3))
    # at most 4096 hash ranges of label sets
    before_cut = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cut_start = (
        cut.groupBy("_b")
        .agg(F.sum("_n").alias("_c"))
        .select("_b", F.coalesce(F.sum("_c").over(before_cut), F.lit(0)).alias("_cs"))
    )
    inside = Window.partitionBy("_b").orderBy("_sig").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        cut.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(cut_start), "_b")
        .select("_sig", "_set", "_n", (F.col("_cs") + F.col("_in")).alias("_s"))
    )
    asked = rest.withColumn("_sig", F.md5(F.concat_ws("\u0001", "_set")))
    spans = (
        asked.select(F.col("_sig").alias("_asked"), F.explode("_set").alias("_l"))
        .distinct()
        .join(placed.select("_s", "_n", F.explode("_set").alias("_l")), "_l")
        .select("_asked", "_s", "_n")
        .distinct()
        .groupBy("_asked")
        .agg(
            F.array_sort(F.collect_list(F.struct("_s", "_n"))).alias("_spans"),
            F.sum("_n").alias("_near"),
        )
        .withColumnRenamed("_asked", "_sig")
    )
    free = F.lit(total) - F.col("_near")
    pick = F.pmod(_draw(seed, row_id, "iteration", F.lit("far")), free)
    at = F.aggregate(
        "_spans", pick, lambda acc, x: F.when(acc >= x["_s"], acc + x["_n"]).otherwise(acc)
    )
    wanted = (
        asked.join(spans, "_sig").filter(free > 0).select(row_id, "iteration", at.alias("_at"))
    )
    line = (
        rank_within(
            keyed.withColumn("_h", hash_order(seed, row_id)), ["_sig"], "_h", row_id, out="_rn"
        )
        .join(placed.select("_sig", "_s"), "_sig")
        .select(F.col(row_id).alias("partner_id"), (F.col("_s") + F.col("_rn") - 1).alias("_at"))
    )
    return wanted.join(line, "_at").select(
        row_id, "partner_id", F.lit(0).alias("label"), "iteration"
    )


def text_pairs(
    texts: DataFrame, row_id: str, labels: str = "labels", num_iterations: int = 1, seed: int = 42
) -> DataFrame:
    """Same-label (1) and different-label (0) partners for contrastive tuning."""
    same = same_label_pairs(texts, row_id, labels, num_iterations, seed)
    return same.unionByName(other_label_pairs(texts, row_id, labels, num_iterations, seed))
