"""Text functions. Numbers are matched as their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions.compare import Value, col


def concat(*values: Value) -> Column:
    """Concatenation; null if any part is."""
    return F.concat(*(col(v).cast("string") for v in values))


def like(value: Value, pattern: Value, escape: str | None = None) -> Column:
    text = col(value).cast("string")
    return F.like(text, col(pattern), F.lit(escape)) if escape else F.like(text, col(pattern))


def regexp_match(value: Value, pattern: str) -> Column:
    """Whether the whole text matches."""
    return col(value).cast("string").rlike(f"^(?:{pattern})$")


def starts_with(value: Value, prefix: Value) -> Column:
    return col(value).startswith(col(prefix))


def ends_with(value: Value, suffix: Value) -> Column:
    return col(value).endswith(col(suffix))


def contains(value: Value, part: Value) -> Column:
    return col(value).contains(col(part))


def upper(value: Value) -> Column:
    return F.upper(col(value))


def lower(value: Value) -> Column:
    return F.lower(col(value))


def trim(value: Value) -> Column:
    return F.trim(col(value))


def string_length(value: Value) -> Column:
    return F.length(col(value))
