"""Structured extraction: field scores, answer parsing and tuning examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sets
from ..functions.columns import with_each
from ..functions.labels import strip
from ..functions.text import extract_json, extraction_prompt, target_json, token_count
from .frames import extraction_fields, stacked

SCALAR, LIST, NESTED = "string", "array<string>", "array<array<string>>"


def item_lists(struct: str, fields: Mapping[str, str], present: Mapping[str, str]) -> dict[str, Column]:
    """Normalised items of each field of a struct column, empty when it is missing.

    ``fields`` gives the type every field is compared in, ``present`` the types
    the struct has.
    """
    out = {}
    for name, kind in fields.items():
        target = NESTED if kind == NESTED else LIST
        empty = F.expr(f"cast(array() as {target})")
        if name not in present:
            out[name] = empty
            continue
        value = F.col(struct)[name]
        if present[name] == SCALAR:
            value = F.when(value.isNotNull(), F.array(value))
        items = sets.normal_item_lists(value) if kind == NESTED else sets.normal_items(value)
        out[name] = F.coalesce(items, empty)
    return out


def struct_types(df: DataFrame, column: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema[column].dataType.fields}


def with_field_f1(df: DataFrame, gold: str, predicted: str, out: str = "f1_macro") -> DataFrame:
    """``f1_<field>`` for the union of both structs' fields and their mean.

    Every field that one of the structs has counts, as the structs fix the fields
    of a record; a record without any field scores 1. Records that hold a varying
    set of fields are scored by ``with_map_f1``.
    """
    have_gold, have_pred = struct_types(df, gold), struct_types(df, predicted)
    names = list(dict.fromkeys([*have_gold, *have_pred]))
    kinds = {
        n: NESTED if NESTED in (have_gold.get(n), have_pred.get(n)) else LIST for n in names
    }
    g, p = item_lists(gold, kinds, have_gold), item_lists(predicted, kinds, have_pred)
    scored = df.withColumns({f"f1_{n}": sets.field_f1(g[n], p[n]) for n in names})
    total = sum((F.col(f"f1_{n}") for n in names), F.lit(0.0))
    return scored.withColumn(out, total / F.lit(len(names)) if names else F.lit(1.0))


def with_map_f1(df: DataFrame, gold: str, predicted: str, out: str = "f1_macro") -> DataFrame:
    """Mean field F1 over the keys of two ``map<string, array<string>>`` columns."""
    keys = F.array_union(F.map_keys(gold), F.map_keys(predicted))
    empty = F.expr("cast(array() as array<string>)")

    def one(key: Column, both: Column) -> Column:
        return sets.field_f1(
            sets.normal_items(F.coalesce(F.element_at(both["g"], key), empty)),
            sets.normal_items(F.coalesce(F.element_at(both["p"], key), empty)),
        )

    both = F.struct(F.col(gold).alias("g"), F.col(predicted).alias("p"))
    per_field = with_each(keys, both, one)
    mean = F.aggregate(
        per_field, F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size(keys))
    )
    return df.withColumn(out, F.coalesce(mean, F.lit(1.0)))


def field_accuracy(
    df: DataFrame, generated: str, gold_json: str, fields: Sequence[str]
) -> DataFrame:
    """Exact-match accuracy per field and over all fields.

    The answer is the JSON object inside the generated text. Two missing values
    are equal; an answer that cannot be read misses every field and is counted.
    """
    parsed = df.select(
        extract_json(generated).alias("_p"), F.try_parse_json(F.col(gold_json)).alias("_g")
    )

    def value(side: str, field: str) -> Column:
        # 'None' is the text of a missing value on both sides
        text = F.try_variant_get(F.col(side), f"$['{field}']", "string")
        return F.coalesce(strip(text), F.lit("None"))

    is_object = F.col("_p").isNotNull()
    hits = [
        F.sum((is_object & (value("_p", f) == value("_g", f))).cast("int")).alias(f"_h{i}")
        for i, f in enumerate(fields)
    ]
    n, fails = F.col("n"), F.col("parse_failures")
    summed = parsed.agg(
        *hits,
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(~is_object, 1)).alias("parse_failures"),
    )
    rows = [
        (F.lit(f), F.col(f"_h{i}"), sets.ratio(F.col(f"_h{i}"), n), n, fails)
        for i, f in enumerate(fields)
    ]
    everything = sum((F.col(f"_h{i}") for i in range(len(fields))), F.lit(0))
    rows.append(
        (F.lit("ALL FIELDS (micro)"), everything, sets.ratio(everything, n * len(fields)), n, fails)
    )
    return stacked(
        summed,
        ["field", "hits", "accuracy", "n", "parse_failures"],
        [tuple([r[0], r[1].cast("bigint"), *r[2:]]) for r in rows],
    )


def tuning_examples(
    df: DataFrame,
    text: str = "text",
    max_len: int = 2048,
    keep: Sequence[str] = (),
    tokens=token_count,
) -> DataFrame:
    """Prompt, answer and the span that is supervised.

    The answer starts at ``prompt_len`` and the example is cut at ``max_len``;
    ``truncated`` marks examples whose answer is cut off whole. ``tokens`` maps a
    text column to its token count; white space by default.
    """
    fields = extraction_fields(df.drop(*keep), text)
    base = df.select(
        *keep,
        extraction_prompt(text, fields).alias("prompt"),
        target_json(fields, dict(df.dtypes)).alias("completion"),
    )
    return (
        base.withColumn("prompt_len", tokens("prompt"))
        .withColumn("total_len", F.col("prompt_len") + tokens("completion"))
        .withColumn("supervised_from", F.least("prompt_len", F.lit(max_len)))
        .withColumn("supervised_to", F.least("total_len", F.lit(max_len)))
        .withColumn("truncated", F.col("prompt_len") >= F.lit(max_len))
    )


def truncated_answers(examples: DataFrame) -> DataFrame:
    return examples.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("truncated"), 1)).alias("n_truncated")
    )
