"""Comparison, logic, membership, conditionals and casts, with the engine's rules for nulls.

Where these rules equal SQL's, the function is the plain column operator; the others are written out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Any


def col(x: Value) -> Column:
    """A column as it is, any other value as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def equal(a: Value, b: Value) -> Column:
    return col(a) == col(b)


def not_equal(a: Value, b: Value) -> Column:
    return col(a) != col(b)


def is_(a: Value, b: Value) -> Column:
    """Equality that two nulls satisfy."""
    return col(a).eqNullSafe(col(b))


def is_not(a: Value, b: Value) -> Column:
    return ~is_(a, b)


def greater(a: Value, b: Value) -> Column:
    return col(a) > col(b)


def greater_or_equal(a: Value, b: Value) -> Column:
    return col(a) >= col(b)


def less(a: Value, b: Value) -> Column:
    return col(a) < col(b)


def less_or_equal(a: Value, b: Value) -> Column:
    return col(a) <= col(b)


def and_(*conditions: Value) -> Column:
    """Conjunction in three-valued logic; true for none."""
    return reduce(lambda a, b: a & b, map(col, conditions), F.lit(True)) if conditions else F.lit(True)


def or_(*conditions: Value) -> Column:
    return reduce(lambda a, b: a | b, map(col, conditions), F.lit(False)) if conditions else F.lit(False)


def not_(condition: Value) -> Column:
    return ~col(condition)


def in_(value: Value, *candidates: Value) -> Column:
    return col(value).isin(*candidates) if candidates else F.lit(False)


def not_in(value: Value, *candidates: Value) -> Column:
    return ~in_(value, *candidates)


def in_array(value: Value, values: Column) -> Column:
    return F.array_contains(values, col(value))


def in_map_keys(value: Value, values: Column) -> Column:
    return F.map_contains_key(values, col(value))


def between(value: Value, lower: Value, upper: Value, lower_inclusive: bool = True, upper_inclusive: bool = True) -> Column:
    """Range test that swaps reversed bounds and is false, not null, if any operand is null."""
    v, a, b = col(value), col(lower), col(upper)
    low, high = F.least(a, b), F.greatest(a, b)
    inside = (v >= low if lower_inclusive else v > low) & (v <= high if upper_inclusive else v < high)
    return F.coalesce(inside & a.isNotNull() & b.isNotNull(), F.lit(False))


def not_between(value: Value, lower: Value, upper: Value, lower_inclusive: bool = True, upper_inclusive: bool = True) -> Column:
    """Outside the range; false as well if any operand is null."""
    present = col(value).isNotNull() & col(lower).isNotNull() & col(upper).isNotNull()
    return present & ~between(value, lower, upper, lower_inclusive, upper_inclusive)


Comparison = Callable[[Column, Column], Column]


def any_of(value: Value, comparison: Comparison, candidates: Sequence[Value]) -> Column:
    """True if some comparison is; else null if some is null; else false."""
    return or_(*(comparison(col(value), col(c)) for c in candidates))


some_of = any_of


def all_of(value: Value, comparison: Comparison, candidates: Sequence[Value]) -> Column:
    """False if some comparison is; else null if some is null; else true."""
    return and_(*(comparison(col(value), col(c)) for c in candidates))


def any_in_array(value: Value, comparison: Comparison, values: Column) -> Column:
    return F.exists(values, lambda x: comparison(col(value), x))


def all_in_array(value: Value, comparison: Comparison, values: Column) -> Column:
    return F.forall(values, lambda x: comparison(col(value), x))


def is_null(value: Value) -> Column:
    return col(value).isNull()


def exists(dynamic: Column, path: str) -> Column:
    """Whether a VARIANT has the path at all; a present null counts. Missing and null are different states."""
    return F.try_variant_get(dynamic, path, "variant").isNotNull()


def is_missing(json: Column, path: str) -> Column:
    """Whether a JSON object lacks the top-level key."""
    return ~F.coalesce(F.array_contains(F.json_object_keys(json), path.removeprefix("$.")), F.lit(False))


def coalesce(*values: Value) -> Column:
    return F.coalesce(*map(col, values))


class Case:
    """Searched case: `Case().when(condition, result).else_(default)`; without `else_` the default is null."""

    def __init__(self, branches: tuple = ()):
        self.branches = branches

    def when(self, condition: Value, result: Value) -> Case:
        return Case((*self.branches, (col(condition), col(result))))

    def else_(self, default: Value = None) -> Column:
        return reduce(lambda rest, b: F.when(b[0], b[1]).otherwise(rest), reversed(self.branches), col(default))


class CaseValue(Case):
    """Simple case on a value; a null branch matches a null value."""

    def __init__(self, value: Value, branches: tuple = ()):
        super().__init__(branches)
        self.value = value

    def when(self, match: Value, result: Value) -> CaseValue:
        return CaseValue(self.value, (*self.branches, (is_(self.value, match), col(result))))


def if_then_else(condition: Value, then: Value, otherwise: Value) -> Column:
    return F.when(col(condition), col(then)).otherwise(col(otherwise))


def type_name(value: Value) -> Column:
    return F.typeof(col(value))


def instance_of(value: Value, *types: str) -> Column:
    """Whether the value is present and of one of the named Spark types."""
    return col(value).isNotNull() & F.typeof(col(value)).isin(*types)


def cast(value: Value, to: str) -> Column:
    """Cast that gives null where it fails."""
    return col(value).try_cast(to)


def cast_with_format(value: Value, pattern: str) -> Column:
    """Text to a timestamp by a Java date pattern; null where it does not fit."""
    return F.try_to_timestamp(col(value), F.lit(pattern))


def event_identity_equals(left: str = "left", right: str = "right") -> Column:
    """Whether two aliased sides of a join are the same event."""
    return F.col(f"{left}._seq") == F.col(f"{right}._seq")
