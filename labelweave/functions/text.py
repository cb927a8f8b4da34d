"""Prompts, target JSON and JSON extraction."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column, strict_json

# The wording of the prompts, needed for equal results.
PAIR_PROMPT = (
    "Product text:\n{text}\n\nCandidate tag:\n{tag}\n\n"
    "Determine whether the candidate tag applies to the product."
)
EXTRACTION_PROMPT = """Extract the following fields from the document and return a single JSON object.

Fields: {fields}

Rules:
- Use exactly these keys, in this order.
- Use null when a field is not present in the document. Never guess.
- Return only the JSON object.

Document:
{text}"""
ALLOWED_SUFFIX = "\n\nAllowed labels per field:\n"


def fill_prompt(template: str, **values: Column) -> Column:
    """Replace ``{name}`` marks of a constant template by columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def described_tag(tag: Column | str, description: Column | str) -> Column:
    """``tag: description``, or the bare tag when it has no description."""
    t, d = as_column(tag), as_column(description)
    return F.when(d.isNull() | (d == ""), t).otherwise(F.concat(t, F.lit(": "), d))


def pair_prompt(text: Column | str, tag_text: Column | str) -> Column:
    return fill_prompt(PAIR_PROMPT, text=as_column(text), tag=as_column(tag_text))


def extraction_prompt(text: Column | str, fields: Sequence[str]) -> Column:
    return fill_prompt(EXTRACTION_PROMPT, fields=F.lit(", ".join(fields)), text=as_column(text))


def with_allowed_labels(instruction: str, allowed: Mapping[str, Sequence[str]]) -> str:
    """Instruction text followed by the allowed vocabulary of every field."""
    listing = json.dumps({k: list(v) for k, v in allowed.items()}, ensure_ascii=False)
    return instruction + ALLOWED_SUFFIX + listing


def target_json(fields: Sequence[str], types: Mapping[str, str]) -> Column:
    """JSON object with the fields in column order, null where a value is missing.

    Numbers, booleans, text and nested values keep their JSON form, all other
    types are written as text.
    """
    plain = ("string", "int", "bigint", "smallint", "tinyint", "double", "float", "boolean")
    cols = []
    for f in fields:
        kind = types[f]
        keep = kind in plain or kind.startswith(("array", "struct", "map"))
        value = F.col(f) if keep else F.col(f).cast("string")
        if kind in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        cols.append(value.alias(f))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def extract_json(generated: Column | str) -> Column:
    """Variant read from the first ``{`` to the last ``}``; NULL when it is no JSON."""
    body = F.regexp_extract(as_column(generated), r"(?s)\{.*\}", 0)
    return strict_json(F.when(body != "", body))


def token_count(text: Column | str) -> Column:
    """Number of white-space separated tokens."""
    return F.regexp_count(as_column(text), F.lit(r"\S+"))
