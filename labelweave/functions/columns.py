"""Small helpers shared by the column functions.

A lambda evaluates the outer expressions it mentions once per element, and the
optimizer inlines computed columns into it. The helpers turn a value into a
lambda variable first. Inner lambdas do not use variables of outer ones: Spark
4.1 cannot move such an expression below a Python UDF on top of an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.transform(F.array(value), body)[0]


def with_each(items: Column, value: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body(item, value)`` per item with the value evaluated once."""
    return F.zip_with(items, F.array_repeat(value, F.size(items)), body)


def strict_json(text: Column) -> Column:
    """Variant of a text that is one JSON value and nothing else, NULL otherwise.

    The parser stops after the first value and ignores what follows. Here the
    text is put into a list in front of its own digest; only when the text is
    exactly one value is the digest the second item.
    """
    mark = F.md5(text)
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    return F.when(
        F.try_variant_get(wrapped, "$[1]", "string") == mark,
        F.try_variant_get(wrapped, "$[0]", "variant"),
    )
