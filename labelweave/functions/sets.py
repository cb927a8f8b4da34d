"""Set scores per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column
from .labels import strip


def ratio(top: Column, bottom: Column) -> Column:
    """Division where an empty denominator counts as zero."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def harmonic(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def set_f1(gold: Column | str, got: Column | str) -> Column:
    """F1 of two label sets; two empty sets score 1."""
    g = F.array_distinct(F.coalesce(as_column(gold), F.expr("cast(array() as array<string>)")))
    p = F.array_distinct(F.coalesce(as_column(got), F.expr("cast(array() as array<string>)")))
    hits = F.size(F.array_intersect(g, p))
    return F.when((F.size(g) == 0) & (F.size(p) == 0), F.lit(1.0)).otherwise(
        harmonic(ratio(hits, F.size(p)), ratio(hits, F.size(g)))
    )


def normal_items(values: Column | str) -> Column:
    """``array<string>`` with items stripped and lower-cased."""
    return F.transform(as_column(values), lambda x: F.lower(strip(x)))


def normal_item_lists(values: Column | str) -> Column:
    """``array<array<string>>`` with inner items stripped and lower-cased."""
    return F.transform(as_column(values), normal_items)


def field_f1(gold: Column, got: Column) -> Column:
    """F1 of one field on normalised items; both empty 1, one empty 0.

    Works on any array type, so inner lists are compared by value.
    """
    g, p = F.array_distinct(gold), F.array_distinct(got)
    ng, np_ = F.coalesce(F.size(g), F.lit(0)), F.coalesce(F.size(p), F.lit(0))
    ng = F.greatest(ng, F.lit(0))
    np_ = F.greatest(np_, F.lit(0))
    hits = F.size(F.array_intersect(g, p))
    return (
        F.when((ng == 0) & (np_ == 0), F.lit(1.0))
        .when((ng == 0) | (np_ == 0), F.lit(0.0))
        .otherwise(harmonic(ratio(hits, np_), ratio(hits, ng)))
    )
