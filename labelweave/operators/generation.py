"""Template-filled texts: every try picks a template and fills its slots by hash."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .frames import without_seen
from .ranking import global_rank, hash_cut, hash_number, hash_order

_SLOT = re.compile(r"\{([^{}]+)\}")


def slot_values(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values of a column as choices for a slot."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in rows)


def slot_table(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``slot, number, value``: distinct values of a column for each slot, numbered in order.

    ``sources`` gives the table and column of a slot. Values stay in the table, of any size.
    """
    parts = [
        df.select(F.lit(slot).alias("slot"), F.col(column).cast("string").alias("value"))
        for slot, (df, column) in sources.items()
    ]
    values = reduce(DataFrame.unionByName, parts).filter("value is not null").distinct()
    ranked = global_rank(values, ["slot", "value"], "_at")
    first = ranked.groupBy("slot").agg(F.min("_at").alias("_first"))
    # one row a slot
    return ranked.join(F.broadcast(first), "slot").select(
        "slot", (F.col("_at") - F.col("_first")).alias("number"), "value"
    )


def _drawn(n: int, seed: int, *parts: Column | str) -> Column:
    return F.pmod(hash_number(hash_order(seed, *parts)), F.lit(n))


def _choose(values: Sequence[str], seed: int, *parts: Column | str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), _drawn(len(values), seed, *parts).cast("int"))


def fill_slots(
    template: str, slots: Mapping[str, Sequence[str]], seed: int, row_id: str, bucket: str
) -> Column:
    """Text of a template; repeated slots are drawn independently."""
    parts: list[Column] = []
    at = 0
    for number, mark in enumerate(_SLOT.finditer(template)):
        if mark.group(1) not in slots:
            raise KeyError(f"unknown slot {mark.group(0)} in template: {template}")
        parts.append(F.lit(template[at : mark.start()]))
        parts.append(
            _choose(slots[mark.group(1)], seed, row_id, F.lit(bucket), F.lit(number))
        )
        at = mark.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def filled_templates(
    tries: DataFrame,
    row_id: str,
    templates: Sequence[tuple[str, str]],
    slots: Mapping[str, Sequence[str]],
    seed: int = 42,
) -> DataFrame:
    """One text per try: ``row_id, label_key, text``.

    ``templates`` are (label key, template) pairs; a row-wise expression, so the
    work follows the partitioning of the tries.
    """
    which = _drawn(len(templates), seed, row_id, F.lit("template"))
    label, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (key, template) in enumerate(templates):
        mine = F.col("_which") == i
        label = F.when(mine, F.lit(key)).otherwise(label)
        text = F.when(mine, fill_slots(template, slots, seed, row_id, key)).otherwise(text)
    return tries.withColumn("_which", which).select(
        row_id, label.alias("label_key"), text.alias("text")
    )


def filled_from_table(
    tries: DataFrame,
    row_id: str,
    templates: Sequence[tuple[str, str]],
    slots: DataFrame,
    seed: int = 42,
) -> DataFrame:
    """``filled_templates`` with the values of a slot table, which are joined by number.

    Only the number of values of each slot is collected. The texts are the same.
    """
    n_values = {r["slot"]: r["count"] for r in slots.groupBy("slot").count().collect()}
    keyed = tries.select(row_id, _drawn(len(templates), seed, row_id, F.lit("template")).alias("_which"))
    draws = F.array().cast("array<struct<at:int,slot:string,number:bigint>>")
    for i, (key, template) in enumerate(templates):
        marks = []
        for at, mark in enumerate(_SLOT.finditer(template)):
            slot = mark.group(1)
            if slot not in n_values:
                raise KeyError(f"unknown slot {mark.group(0)} in template: {template}")
            number = _drawn(n_values[slot], seed, row_id, F.lit(key), F.lit(at))
            marks.append(F.struct(F.lit(at).alias("at"), F.lit(slot).alias("slot"), number.alias("number")))
        if marks:
            draws = F.when(F.col("_which") == i, F.array(*marks)).otherwise(draws)
    drawn = keyed.select(row_id, "_which", F.explode_outer(draws).alias("_d")).select(row_id, "_which", "_d.*")
    values = (
        drawn.join(slots, ["slot", "number"], "left")
        .groupBy(row_id, "_which")
        .agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_values"))
    )
    label, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (key, template) in enumerate(templates):
        fixed = _SLOT.split(template)[::2]
        parts = [F.lit(fixed[0])]
        for at, after in enumerate(fixed[1:]):
            parts += [F.get("_values", F.lit(at))["value"], F.lit(after)]
        label = F.when(F.col("_which") == i, F.lit(key)).otherwise(label)
        text = F.when(F.col("_which") == i, F.concat(*parts)).otherwise(text)
    return values.select(row_id, label.alias("label_key"), text.alias("text"))


def unique_texts(made: DataFrame, row_id: str) -> DataFrame:
    """The first try of every text."""
    return made.groupBy("text").agg(
        F.min(row_id).alias(row_id), F.min_by("label_key", row_id).alias("label_key")
    )


def generate(
    spark: SparkSession,
    n: int,
    templates: Sequence[tuple[str, str]],
    slots: Mapping[str, Sequence[str]] | DataFrame,
    seed: int = 42,
    avoid: DataFrame | None = None,
    tries_per_text: int = 50,
    fewer: bool = False,
) -> DataFrame:
    """Exactly n unique texts that do not occur in ``avoid``; fails when too few exist.

    With ``fewer`` all texts found are returned where the tries give less than n.
    ``slots`` are lists of values or a ``slot_table``.
    """
    tries = spark.range(n * tries_per_text).withColumnRenamed("id", "try_id")
    fill = filled_from_table if isinstance(slots, DataFrame) else filled_templates
    found = unique_texts(fill(tries, "try_id", templates, slots, seed), "try_id")
    if avoid is not None:
        found = without_seen(found, avoid)
    ensure_checkpoint_dir(spark)
    found = found.checkpoint()
    have = found.count()
    if have < n and not fewer:
        raise RuntimeError(f"only {have} unique texts after {n * tries_per_text} tries")
    return found.filter(hash_cut(found, "try_id", n, seed))
