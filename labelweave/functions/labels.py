"""Label parsing, keys and multi-hot encoding as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, strict_json, with_each

KEY_SEPARATOR = "::"
# all characters that count as white space in Python text, beyond ASCII too
WHITE_SPACE = r"[\s\x1c-\x1f]"
_ENDS = rf"(?U)^{WHITE_SPACE}+|{WHITE_SPACE}+\z"
NO_LABELS = "cast(array() as array<string>)"


def empty_labels() -> Column:
    return F.expr(NO_LABELS)


def strip(value: Column | str) -> Column:
    """Strip all leading and trailing white space, not only blanks."""
    return F.regexp_replace(as_column(value), _ENDS, "")


def parse_delimited(value: Column | str) -> Column:
    """``"a; b,c"`` -> ``[a, b, c]``; order and repeats are kept, blanks dropped."""
    parts = F.transform(F.split(as_column(value), "[,;]"), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), empty_labels())


def parse_json_list(value: Column | str) -> Column:
    """A JSON list, a single label, or nothing.

    Text that starts with ``[`` but is no valid JSON list stays one label.
    """
    text = strip(value)
    is_list = text.startswith("[")
    valid = strict_json(F.when(is_list, text)).isNotNull()
    parsed = F.from_json(F.when(valid, text), "array<string>", {"allowSingleQuotes": "false"})
    return (
        F.when(text.isNull() | (text == ""), empty_labels())
        .when(
            is_list,
            F.coalesce(F.filter(parsed, lambda x: x.isNotNull()), F.array(text)),
        )
        .otherwise(F.array(text))
    )


def parse_literal_list(value: Column | str) -> Column:
    """A list of strings written with single or double quotes."""
    parsed = F.from_json(strip(value), "array<string>", {"allowSingleQuotes": "true"})
    return F.coalesce(parsed, empty_labels())


def parse_any(value: Column | str) -> Column:
    """Text with a leading ``[`` is read as a list, everything else as delimited."""
    text = strip(value)
    return (
        F.when(text.rlike(r"^\[\s*'"), parse_literal_list(text))
        .when(text.startswith("["), parse_json_list(text))
        .otherwise(parse_delimited(text))
    )


def label_key(category: Column | str, label: Column | str) -> Column:
    return F.concat_ws(KEY_SEPARATOR, as_column(category), as_column(label))


def label_name(key: Column | str) -> Column:
    """The part of a key after the last separator."""
    return F.element_at(F.split(as_column(key), KEY_SEPARATOR), -1)


def label_names(keys: Column | str) -> Column:
    return F.transform(as_column(keys), label_name)


def label_text(label: Column | str, description: Column | str) -> Column:
    """The text that stands for a label when it is embedded."""
    return F.concat(as_column(label), F.lit(". "), as_column(description))


def normalize_tags(tags: Column | str) -> Column:
    """Strip, drop blanks and NULLs, keep the first of each repeat."""
    stripped = F.transform(as_column(tags), strip)
    return F.array_distinct(F.filter(stripped, lambda x: x.isNotNull() & (x != "")))


def class_array(classes: Sequence[str]) -> Column:
    if not classes:
        return empty_labels()
    return F.lit(list(classes))


def has_label(labels: Column, key: Column | str) -> Column:
    """True or false, also for NULL label arrays and NULL items."""
    return F.coalesce(F.array_contains(labels, key), F.lit(False))


def label_flags(labels: Column | str, classes: Sequence[str]) -> Column:
    """Boolean per class in class order; labels outside the classes are ignored."""
    return with_each(
        class_array(classes), as_column(labels), lambda c, have: has_label(have, c)
    )


def multi_hot(labels: Column | str, classes: Sequence[str]) -> Column:
    """0/1 per class in class order; labels outside the classes are ignored."""
    return F.transform(label_flags(labels, classes), lambda b: b.cast("int"))


def decode_multi_hot(hot: Column | str, classes: Sequence[str]) -> Column:
    """Names of the classes that are set, in class order."""
    names = F.zip_with(
        class_array(classes), as_column(hot), lambda c, bit: F.when(bit == 1, c)
    )
    return F.filter(names, lambda c: c.isNotNull())


def same_set(left: Column | str, right: Column | str) -> Column:
    return F.array_sort(F.array_distinct(as_column(left))) == F.array_sort(
        F.array_distinct(as_column(right))
    )


def matches_query(haystack: Column | str, query: str) -> Column:
    """True when every white-space term of the query occurs in the text; no case."""
    terms = query.lower().split()
    if not terms:
        return F.lit(True)
    text = F.lower(as_column(haystack))
    hit = F.contains(text, F.lit(terms[0]))
    for term in terms[1:]:
        hit = hit & F.contains(text, F.lit(term))
    return hit


def is_slug(value: Column | str) -> Column:
    """Lower-case slug without a double underscore and without a trailing newline."""
    text = as_column(value)
    return text.rlike(r"^[a-z0-9][a-z0-9_-]*\z") & ~F.contains(text, F.lit("__"))
