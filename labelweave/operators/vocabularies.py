"""Numbered vocabulary tables: rows hold numbers of labels, names come by joins.

Nothing here brings the vocabulary to the driver or into a plan; only its size does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import vocabulary
from .ranking import global_rank, hash_number, hash_order


def numbered_vocabulary(df: DataFrame, labels: str = "labels") -> DataFrame:
    """``label_idx, label_key``: the distinct labels of all rows, numbered from 0 in order."""
    names = vocabulary(df, labels).filter("label_key is not null")
    ranked = global_rank(names, ["label_key"], "_at")
    return ranked.select((F.col("_at") - 1).alias("label_idx"), "label_key")


def label_numbers(
    df: DataFrame, vocab: DataFrame, row_id: str, labels: str = "labels", out: str = "label_ids"
) -> DataFrame:
    """``row_id, label_ids``: the sorted numbers of a row's labels, ``[]`` for rows without.

    Labels outside the vocabulary are ignored; row ids are unique.
    """
    owned = df.select(row_id, F.explode_outer(F.array_distinct(labels)).alias("label_key"))
    return (
        owned.join(vocab.select("label_key", "label_idx"), "label_key", "left")
        .groupBy(row_id)
        .agg(F.array_sort(F.collect_list("label_idx")).alias(out))
    )


def dense_hot(ids: Column | str, n_labels: int) -> Column:
    """0/1 per label from the numbers that are set."""
    if n_labels == 0:
        return F.array().cast("array<int>")
    ids = F.col(ids) if isinstance(ids, str) else ids
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(n_labels - 1).cast("bigint"))
    return F.transform(every, lambda i: F.array_contains(ids, i).cast("int"))


def prime_from(n: int) -> int:
    """The smallest prime that is not below n."""
    p = max(n, 2)
    while any(p % q == 0 for q in range(2, int(p**0.5) + 1)):
        p += 1
    return p


def dealt_negatives(ids: Column, count: Column, n_labels: int, row_id: str, seed: int) -> Column:
    """``count`` different numbers below ``n_labels`` that are not among ``ids``; all, if fewer.

    Steps of a hashed width from a hashed start, modulo a prime, meet every number once. So
    the walk needs ``count`` steps, one for each own label and one for each number between
    the vocabulary's size and the prime, however large the vocabulary is.
    """
    prime = prime_from(n_labels)
    start = F.pmod(hash_number(hash_order(seed, row_id, F.lit("start"))), F.lit(prime))
    step = F.pmod(hash_number(hash_order(seed, row_id, F.lit("step"))), F.lit(prime - 1)) + 1
    steps = F.least(count + F.size(ids) + F.lit(prime - n_labels), F.lit(prime)).cast("bigint")
    walk = F.transform(
        F.sequence(F.lit(0).cast("bigint"), steps - 1), lambda j: F.pmod(start + j * step, F.lit(prime))
    )
    free = F.array_except(F.filter(walk, lambda x: x < n_labels), ids)
    return F.when(count > 0, F.slice(free, F.lit(1), F.greatest(count, F.lit(1)))).otherwise(
        F.array().cast("array<bigint>")
    )


def ratio_pairs_from_table(
    texts: DataFrame,
    vocab: DataFrame,
    row_id: str,
    tags: str = "tags",
    negatives_per_positive: int = 3,
    seed: int = 42,
) -> DataFrame:
    """Distinct tags as positives and ``negatives_per_positive`` times as many dealt negatives.

    ``row_id, label_key, label``. Work per text follows its own pairs and not the size of
    the vocabulary, as no label is hashed that the text does not get. Rows without tags
    give no pairs.
    """
    n_labels = vocab.count()
    numbered = label_numbers(texts, vocab, row_id, tags, "_ids").filter(F.size("_ids") > 0)
    ids = F.col("_ids")
    negatives = dealt_negatives(ids, F.size(ids) * F.lit(negatives_per_positive), n_labels, row_id, seed)
    flagged = F.concat(
        F.transform(ids, lambda i: F.struct(i.alias("label_idx"), F.lit(1).alias("label"))),
        F.transform(negatives, lambda i: F.struct(i.alias("label_idx"), F.lit(0).alias("label"))),
    )
    pairs = numbered.select(row_id, F.inline(flagged))
    return pairs.join(vocab, "label_idx").select(row_id, "label_key", "label")
