"""Arrays, maps and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions.compare import Value, col


def array_of(*values: Value) -> Column:
    return F.array(*map(col, values))


def array_size(values: Column) -> Column:
    """Length; null for a null array."""
    return F.when(values.isNotNull(), F.size(values))


array_length = array_size


def array_at(values: Column, index: Value) -> Column:
    """Element by place from 0; null outside the array."""
    return F.get(values, col(index))


def make_array(length: Value, kind: str) -> Column:
    """An array of that many nulls."""
    return F.array_repeat(F.lit(None).cast(kind), col(length))


def make_array_2d(rows: Value, columns: Value, kind: str) -> Column:
    return F.array_repeat(make_array(columns, kind), col(rows))


def map_at(values: Column, key: Value) -> Column:
    return F.try_element_at(values, col(key))


def struct_of(**fields: Value) -> Column:
    return F.struct(*(col(v).alias(k) for k, v in fields.items()))


def field(value: Column, path: str) -> Column:
    """A nested field by a dotted path."""
    for name in path.split("."):
        value = value.getField(name)
    return value
