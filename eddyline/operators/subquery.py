"""Subqueries as joins: exists, in, quantified comparisons, scalars, rows and groups.

Each adds a column to the outer rows or filters them. Correlation is a list of (outer column, inner column); none
of them collects the inner rows of a key unless its value is the list itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pairs = Sequence[tuple[str, str]]


def exists(outer: DataFrame, inner: DataFrame, on: Pairs) -> DataFrame:
    return outer.join(inner, [outer[a] == inner[b] for a, b in on], "left_semi")


def not_exists(outer: DataFrame, inner: DataFrame, on: Pairs) -> DataFrame:
    return outer.join(inner, [outer[a] == inner[b] for a, b in on], "left_anti")


def _aggregated(outer: DataFrame, inner: DataFrame, on: Pairs, **made: Column) -> DataFrame:
    """Outer rows with aggregates of the inner rows of their key; without a correlation of all inner rows."""
    if not on:
        return outer.crossJoin(F.broadcast(inner.agg(*(c.alias(n) for n, c in made.items()))))  # one row
    sums = inner.groupBy(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on))).agg(*(c.alias(n) for n, c in made.items()))
    return outer.join(sums, [outer[a] == sums[f"_k{i}"] for i, (a, _) in enumerate(on)], "left").drop(*(f"_k{i}" for i in range(len(on))))


def value(outer: DataFrame, inner: DataFrame, on: Pairs, name: str, aggregate: Column) -> DataFrame:
    """A scalar aggregate of the inner rows; null where there is none (counts: see `count`)."""
    return _aggregated(outer, inner, on, **{name: aggregate})


def count(outer: DataFrame, inner: DataFrame, on: Pairs, name: str) -> DataFrame:
    return _aggregated(outer, inner, on, **{name: F.count("*")}).withColumn(name, F.coalesce(name, F.lit(0)))


def single(outer: DataFrame, inner: DataFrame, on: Pairs, name: str, pick: Column) -> DataFrame:
    """The value of the only inner row; null if there is none or more than one."""
    out = _aggregated(outer, inner, on, _v=F.any_value(pick), _n=F.count("*"))
    return out.withColumn(name, F.when(F.col("_n") == 1, F.col("_v"))).drop("_v", "_n")


def in_(outer: DataFrame, left: Column, inner: DataFrame, pick: Column, on: Pairs, name: str) -> DataFrame:
    """IN in three-valued logic as a boolean column; its negation is NOT IN.

    True on a match; else null if the value or some inner value is null and there are inner rows; else false.
    """
    match = inner.select(*(F.col(b).alias(f"_m{i}") for i, (_, b) in enumerate(on)), pick.alias("_pick")).where("_pick is not null").distinct()
    out = _aggregated(outer.withColumn("_left", left), inner, on, _n=F.count("*"), _nulls=F.count(F.when(pick.isNull(), 1)))
    match = match.withColumn("_hit", F.lit(True))
    out = out.join(match, [F.col("_left") == F.col("_pick"), *(out[a] == match[f"_m{i}"] for i, (a, _) in enumerate(on))], "left")
    n = F.coalesce("_n", F.lit(0))
    result = F.when(F.col("_hit"), True).when(n == 0, False).when(F.col("_left").isNull() | (F.col("_nulls") > 0), F.lit(None)).otherwise(False)
    return out.withColumn(name, result).drop("_left", "_n", "_nulls", "_pick", "_hit", *(f"_m{i}" for i in range(len(on))))


def quantified(outer: DataFrame, left: Column, comparison: str, every: bool, inner: DataFrame, pick: Column, on: Pairs, name: str) -> DataFrame:
    """`left < all (…)` and the like as a boolean column, by least and greatest inner values and a count of nulls.

    comparison: one of < <= > >= = <>. any over no row is false, all over no row is true.
    """
    out = _aggregated(outer.withColumn("_left", left), inner, on, _lo=F.min(pick), _hi=F.max(pick), _n=F.count("*"), _nulls=F.count(F.when(pick.isNull(), 1)))
    v, lo, hi = F.col("_left"), F.col("_lo"), F.col("_hi")
    tests = {
        "<": (v < hi, v < lo),
        "<=": (v <= hi, v <= lo),
        ">": (v > lo, v > hi),
        ">=": (v >= lo, v >= hi),
        "<>": ((v != lo) | (v != hi), None),
        "=": (None, (v == lo) & (v == hi)),
    }
    test = tests[comparison][every]
    if test is None:  # = any and <> all need the values themselves
        found = in_(out.drop("_lo", "_hi", "_n", "_nulls"), F.col("_left"), inner, pick, on, name).drop("_left")
        return found.withColumn(name, ~F.col(name)) if every else found
    n = F.coalesce("_n", F.lit(0))
    settled = ~test if every else test
    result = F.when(n == 0, every).when(F.coalesce(settled, F.lit(False)), not every).when(v.isNull() | (F.col("_nulls") > 0), F.lit(None)).otherwise(every)
    return out.withColumn(name, result).drop("_left", "_lo", "_hi", "_n", "_nulls")


def rows(outer: DataFrame, inner: DataFrame, on: Pairs, name: str, columns: Sequence[str], order: str) -> DataFrame:
    """The inner rows of a key as an array of structs in order; null where there is none."""
    return _aggregated(outer, inner, on, **{name: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("r")))), lambda x: x["r"])})


def grouped(outer: DataFrame, inner: DataFrame, on: Pairs, key: str, aggregate: Column, name: str, having=None) -> DataFrame:
    """A map from group key to aggregate over the inner rows of a key."""
    correlated = [b for _, b in on]
    groups = inner.groupBy(*dict.fromkeys([*correlated, key])).agg(aggregate.alias("_value"))
    if having is not None:
        groups = groups.where(having(F.col("_value")))
    return _aggregated(outer, groups, on, **{name: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("_value")))))})
