"""Enumeration methods over arrays. Lambdas get the element and, if they take two arguments, its place from 0.

All order-preserving unless said otherwise; null arrays give null.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions.compare import Value, col

Lambda = Callable[..., Column]


def where(values: Column, condition: Lambda) -> Column:
    return F.filter(values, condition)


def select(values: Column, change: Lambda) -> Column:
    return F.transform(values, change)


def any_of(values: Column, condition: Callable[[Column], Column]) -> Column:
    return F.exists(values, condition)


def all_of(values: Column, condition: Callable[[Column], Column]) -> Column:
    return F.forall(values, condition)


def count(values: Column, condition: Lambda | None = None) -> Column:
    return _size(values if condition is None else F.filter(values, condition))


def _size(values: Column) -> Column:
    return F.when(values.isNotNull(), F.size(values))


def _selected(values: Column, key: Lambda | None) -> Column:
    return values if key is None else F.transform(values, key)


def sum_of(values: Column, key: Lambda | None = None, kind: str = "double") -> Column:
    """Sum of the non-null elements; null if there is none."""
    present = F.filter(_selected(values, key), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind)))


def average(values: Column, key: Lambda | None = None) -> Column:
    present = F.filter(_selected(values, key), lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(present))


def min_of(values: Column, key: Lambda | None = None) -> Column:
    return F.array_min(_selected(values, key))


def max_of(values: Column, key: Lambda | None = None) -> Column:
    return F.array_max(_selected(values, key))


def _keyed(values: Column, key: Callable[[Column], Column]) -> Column:
    """Structs of key, place and element, without null keys."""
    return F.filter(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))), lambda s: s["k"].isNotNull())


def min_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first element with the least key."""
    return F.get(order_by(values, key), F.lit(0))


def max_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first element with the greatest key."""
    return F.get(order_by(values, key, descending=True), F.lit(0))


def aggregate(values: Column, start: Value, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    return F.aggregate(values, col(start), step, finish) if finish else F.aggregate(values, col(start), step)


def first_of(values: Column, condition: Lambda | None = None) -> Column:
    return F.get(values if condition is None else F.filter(values, condition), F.lit(0))


def last_of(values: Column, condition: Lambda | None = None) -> Column:
    kept = values if condition is None else F.filter(values, condition)
    return F.get(kept, F.size(kept) - 1)


def take(values: Column, n: Value) -> Column:
    return F.slice(values, F.lit(1), F.greatest(col(n).cast("int"), F.lit(0)))


def take_last(values: Column, n: Value) -> Column:
    k = F.least(F.greatest(col(n).cast("int"), F.lit(0)), F.size(values))
    return F.slice(values, F.size(values) - k + 1, k)


def take_while(values: Column, condition: Lambda) -> Column:
    """The elements before the first one that fails the condition (or for which it is null)."""
    two = len(inspect.signature(condition).parameters) > 1
    fails = F.transform(values, lambda x, i: ~F.coalesce(condition(x, i) if two else condition(x), F.lit(False)))
    first = F.array_position(fails, F.lit(True))
    return F.when(first > 0, F.slice(values, F.lit(1), (first - 1).cast("int"))).otherwise(values)


def take_while_last(values: Column, condition: Callable[[Column], Column]) -> Column:
    """The longest suffix whose elements all meet the condition."""
    return F.reverse(take_while(F.reverse(values), condition))


def distinct(values: Column) -> Column:
    return F.array_distinct(values)


def distinct_by(values: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key."""
    keys = F.transform(values, key)
    return F.filter(values, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def union(a: Column, b: Column) -> Column:
    """All elements of both, repeated ones too."""
    return F.concat(a, b)


def intersect(a: Column, b: Column) -> Column:
    """Elements of the first that the second has."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def except_(a: Column, b: Column) -> Column:
    """Elements of the first that the second lacks."""
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def sequence_equal(a: Column, b: Column) -> Column:
    return a == b


def reverse(values: Column) -> Column:
    return F.reverse(values)


def order_by(values: Column, key: Callable[[Column], Column], descending: bool = False) -> Column:
    """Stable order by a key; elements with a null key are left out."""

    def compare(a: Column, b: Column) -> Column:
        low, high = (F.lit(1), F.lit(-1)) if descending else (F.lit(-1), F.lit(1))
        return F.when(a["k"] < b["k"], low).when(a["k"] > b["k"], high).otherwise(a["i"] - b["i"])

    return F.transform(F.array_sort(_keyed(values, key), compare), lambda s: s["x"])


def order_by_natural(values: Column, descending: bool = False) -> Column:
    return F.sort_array(values, asc=not descending)


def group_by(values: Column, key: Callable[[Column], Column], value: Callable[[Column], Column] | None = None) -> Column:
    """A map from key to the elements, or what is selected of them, in order."""
    pick = value or (lambda x: x)
    keys = F.array_distinct(F.filter(F.transform(values, key), lambda k: k.isNotNull()))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(values, lambda x: key(x) == k), pick).alias("value"))))


def to_map(values: Column, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """A map; of elements with one key the last counts."""
    last = F.reverse(distinct_by(F.reverse(values), key))
    return F.map_from_entries(F.filter(F.transform(last, lambda x: F.struct(key(x).alias("key"), value(x).alias("value"))), lambda e: e["key"].isNotNull()))


def _frequency(values: Column, key: Callable[[Column], Column] | None, most: bool) -> Column:
    keys = _selected(values, key)
    counted = F.transform(F.array_distinct(keys), lambda k: F.struct(F.size(F.filter(keys, lambda x: x.eqNullSafe(k))).alias("n"), k.alias("k")))
    better = (lambda a, b: a["n"] > b["n"]) if most else (lambda a, b: a["n"] < b["n"])
    return F.aggregate(F.slice(counted, 2, F.greatest(F.size(counted), F.lit(1))), F.get(counted, F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))["k"]


def most_frequent(values: Column, key: Callable[[Column], Column] | None = None) -> Column:
    """The most frequent element or key; of equally frequent ones the first."""
    return _frequency(values, key, True)


def least_frequent(values: Column, key: Callable[[Column], Column] | None = None) -> Column:
    return _frequency(values, key, False)


def plugin(values: Column, method: Callable[[list], object], kind: str) -> Column:
    """A method of one's own over whole arrays, as a vectorised Python function."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else method(list(v)))

    return run(values)
