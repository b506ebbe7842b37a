"""Aggregate functions that work both in `groupBy().agg` and over frames, and grouping shapes.

Spark refuses DISTINCT and `median` over ordered frames; those are rewritten over the frame's values.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eddyline.operators.retain import Policy, ordered


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filtered(x: str | Column, condition: Column) -> Column:
    """The argument of an aggregate with a filter of its own."""
    return F.when(condition, _c(x))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def median(x: str | Column) -> Column:
    return F.percentile(_c(x), F.lit(0.5))


def stddev(x: str | Column) -> Column:
    return F.stddev_samp(_c(x))


def weighted_avg(x: str | Column, w: str | Column) -> Column:
    return F.try_divide(F.sum(_c(x) * _c(w)), F.sum(F.when(_c(x).isNotNull(), _c(w))))


def avedev(x: str | Column, frame: WindowSpec | None = None) -> Column:
    """Mean absolute deviation of the group or frame."""
    values = F.collect_list(_c(x).cast("double"))
    values = values.over(frame) if frame is not None else values
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / F.size(values))


def count_distinct(x: str | Column, frame: WindowSpec | None = None) -> Column:
    return F.count_distinct(_c(x)) if frame is None else F.size(F.collect_set(_c(x)).over(frame)).cast("long")


def sum_distinct(x: str | Column, frame: WindowSpec | None = None) -> Column:
    if frame is None:
        return F.sum_distinct(_c(x))
    values = F.array_sort(F.collect_set(_c(x).cast("double")).over(frame))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v))


def nth(x: str | Column, n: int, frame: WindowSpec) -> Column:
    """The n-th value from the newest of the frame; 0 is the newest."""
    values = F.collect_list(F.struct(_c(x).alias("v"))).over(frame)
    return F.get(values, F.size(values) - 1 - n)["v"]


def nth_from_oldest(x: str | Column, n: int, frame: WindowSpec) -> Column:
    return F.get(F.collect_list(F.struct(_c(x).alias("v"))).over(frame), F.lit(n))["v"]


def window_values(x: str | Column, frame: WindowSpec) -> Column:
    """The frame's values, oldest first."""
    return F.collect_list(_c(x)).over(frame)


def ever(by: Sequence[str] = ()) -> WindowSpec:
    """All events so far, whatever the window lets go: for the `ever` forms of count, min, max, first and last."""
    return ordered(by).rowsBetween(Window.unboundedPreceding, 0)


def max_by(x: str | Column, *keys: str | Column) -> Column:
    """The value with the greatest keys; of equal ones the earliest event's."""
    return F.max_by(_c(x), F.struct(*map(_c, keys), (-F.col("_seq")).alias("_first")))


def min_by(x: str | Column, *keys: str | Column) -> Column:
    return F.min_by(_c(x), F.struct(*map(_c, keys), F.col("_seq").alias("_first")))


def sorted_values(x: str | Column, *keys: str | Column) -> Column:
    """Values in order of keys, equal ones in order of arrival."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*(_c(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("_seq").alias("s"), _c(x).alias("x")))), lambda e: e["x"])


class SortedAccess:
    """Navigation in a sorted multimap of (key, event) collected from a group."""

    def __init__(self, key: str | Column, value: str | Column):
        self.entries = F.array_sort(F.collect_list(F.struct(_c(key).alias("k"), F.col("_seq").alias("s"), _c(value).alias("x"))))

    def first_key(self) -> Column:
        return F.get(self.entries, F.lit(0))["k"]

    def last_key(self) -> Column:
        return F.get(self.entries, F.size(self.entries) - 1)["k"]

    def lower_key(self, than: Column) -> Column:
        below = F.filter(self.entries, lambda e: e["k"] < than)
        return F.get(below, F.size(below) - 1)["k"]

    def higher_key(self, than: Column) -> Column:
        return F.get(F.filter(self.entries, lambda e: e["k"] > than), F.lit(0))["k"]

    def events(self, key: Column) -> Column:
        return F.transform(F.filter(self.entries, lambda e: e["k"] == key), lambda e: e["x"])

    def count_events(self) -> Column:
        return F.size(self.entries)

    def count_keys(self) -> Column:
        return F.size(F.array_distinct(F.transform(self.entries, lambda e: e["k"])))


def rate(us: int, by: Sequence[str] = ()) -> Column:
    """Events a second over the last d of engine time."""
    w = (Window.partitionBy(*by) if by else Window).orderBy("_ts").rangeBetween(-(us - 1), 0)
    return F.count("*").over(w) / F.lit(us / 1e6)


def rate_by_timestamp(ts_ms: str | Column, n: int, quantity: str | Column | None = None, by: Sequence[str] = ()) -> Column:
    """Events, or a quantity, a second by their own timestamps over the last n, once an event has left the window."""
    w = ordered(by)
    gone = F.lag(_c(ts_ms), n).over(w)
    total = F.sum(_c(quantity)).over(w.rowsBetween(-(n - 1), 0)) if quantity is not None else F.lit(n)
    return F.when(gone.isNotNull(), F.try_divide(total * 1000.0, _c(ts_ms) - gone))


def leaving(n: int, by: Sequence[str] = ()) -> Column:
    """Whether any event has left a length window of n."""
    return F.row_number().over(ordered(by)) > n


def linest(y: str | Column, x: str | Column) -> dict[str, Column]:
    """Linear regression of y on x: each part is an aggregate."""
    a, b = _c(y), _c(x)
    return {"slope": F.regr_slope(a, b), "y_intercept": F.regr_intercept(a, b), "x_average": F.regr_avgx(a, b), "y_average": F.regr_avgy(a, b), "n": F.regr_count(a, b), "sxx": F.regr_sxx(a, b), "syy": F.regr_syy(a, b), "sxy": F.regr_sxy(a, b), "r2": F.regr_r2(a, b)}


def univariate(x: str | Column) -> dict[str, Column]:
    c = _c(x)
    return {"datapoints": F.count(c), "total": F.sum(c), "average": F.avg(c), "variance": F.var_samp(c), "stddev": F.stddev_samp(c), "stddevpa": F.stddev_pop(c)}


def running(df: DataFrame, policy: Policy, by: Sequence[str] = (), **aggregates: Column) -> DataFrame:
    """A row for each event with the aggregates of what is retained after it."""
    frame = policy.frame(by)
    if frame is None:
        raise ValueError(f"{type(policy).__name__} has no contiguous frame; use running_totals")
    return df.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items()))


def running_spread(df: DataFrame, column: str, us: int, by: Sequence[str] = (), spans: int = 8, **aggregates: Column) -> DataFrame:
    """Aggregates of the events of the last d microseconds by a column, with each key spread over buckets of time.

    The same as `running` over Time or ExternallyTimed, for few keys with very many events: a bucket is some spans
    long and also sees the events of the span before it, so one row in `spans` is shuffled twice. Rows without a
    time are left where `running` has them, in a bucket of their own.
    """
    width = us * spans
    at = F.floor(F.col(column) / width)
    log = df.withColumn("_own", at).withColumn("_bucket", F.explode(F.when(F.floor((F.col(column) + (us - 1)) / width) > at, F.array(at, at + 1)).otherwise(F.array(at))))
    frame = Window.partitionBy(*by, "_bucket").orderBy(column).rangeBetween(-(us - 1), 0)
    made = log.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items()))
    return made.where(F.col("_bucket").eqNullSafe(F.col("_own"))).drop("_bucket", "_own")


def running_unkeyed(df: DataFrame, bucket_us: int = 3_600_000_000, by: Sequence[str] = (), **aggregates: tuple[str, str | Column]) -> DataFrame:
    """Running sum, count, min, max, first or last over a whole stream, or few keys of it, spread over buckets of time.

    aggregates: name=(kind, argument). Order matters within a bucket only; each bucket starts from the aggregates of
    all before it, and only those, a row a bucket and key, are one sequence. Events without a time come before all
    others.
    """
    at = F.struct("_ts", "_seq")
    partial = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "first": lambda x: F.min_by(x, at), "last": lambda x: F.max_by(x, at)}
    inside = partial | {"first": F.first, "last": F.last}
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "first": F.first, "last": F.last}
    log = df.withColumn("_bucket", F.floor(F.col("_ts") / bucket_us))
    sums = log.groupBy(*by, "_bucket").agg(*(partial[k](_c(x)).alias(n) for n, (k, x) in aggregates.items()))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*(F.col(b).alias(f"_of_{b}") for b in by), F.col("_bucket").alias("_of"), (F.count("*").over(before) > 0).alias("_later"), *(again[k](n).over(before).alias(f"_before_{n}") for n, (k, _) in aggregates.items()))
    w = Window.partitionBy(*by, "_bucket").orderBy("_ts", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    own = log.select("*", *(inside[k](_c(x)).over(w).alias(n) for n, (k, x) in aggregates.items())).join(carry, same)

    def joined(n: str, kind: str) -> Column:
        a, b = F.col(f"_before_{n}"), F.col(n)
        if kind in ("min", "max"):
            return (F.least if kind == "min" else F.greatest)(a, b)
        if kind == "first":
            return F.when(F.col("_later"), a).otherwise(b)
        if kind == "last":
            return b
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)

    return own.withColumns({n: joined(n, k) for n, (k, _) in aggregates.items()}).drop("_bucket", "_of", "_later", *(f"_of_{b}" for b in by), *(f"_before_{n}" for n in aggregates))


def with_old(df: DataFrame, names: Sequence[str], by: Sequence[str] = (), initial: dict[str, object] | None = None) -> DataFrame:
    """New and old rows of running aggregates: the old row of a change is the group's row before it.

    initial: what aggregates are before the first event, such as 0 for counts; null where it is not given.
    """
    w = ordered(by)
    old = df.select("*", *(F.lag(n, 1, (initial or {}).get(n)).over(w).alias(f"_old_{n}") for n in names)).drop(*names).withColumnsRenamed({f"_old_{n}": n for n in names})
    return df.withColumn("_op", F.lit("+")).unionByName(old.withColumn("_op", F.lit("-")))


def local_group(aggregate: Column, *keys: str | Column) -> Column:
    """An aggregate with group keys of its own, on every row."""
    return aggregate.over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))


def count_min_sketch(x: str | Column, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> Column:
    return F.count_min_sketch(_c(x), F.lit(eps), F.lit(confidence), F.lit(seed))


def _murmur3(data: bytes, seed: int) -> int:
    """MurmurHash3 of 32 bits as Spark's sketches take it: trailing bytes are blocks of their own, signed."""
    m = 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> 32 - r) & m
    h = seed & m
    n = len(data) // 4 * 4
    for k in [*struct.unpack(f"<{n // 4}I", data[:n]), *(b - 256 & m if b > 127 else b for b in data[n:])]:
        k = rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _wrapped(x: int, bits: int) -> int:
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> bits - 1 else x


def sketch_frequency(data: bytes, item: int | str | None) -> int | None:
    """How often a sketch has counted an item: never too low, too high by at most eps of all with its confidence."""
    if data is None or item is None:
        return None
    _, _, depth, width = struct.unpack_from(">iqii", data)
    factors = struct.unpack_from(f">{depth}q", data, 20)
    table = np.frombuffer(data, ">i8", depth * width, 20 + 8 * depth).reshape(depth, width)
    if isinstance(item, str):
        raw = item.encode()
        one = _murmur3(raw, 0)
        two = _murmur3(raw, one)
        places = [abs(int(np.fmod(_wrapped(one + i * two, 32), width))) for i in range(depth)]
    else:
        places = []
        for a in factors:
            h = _wrapped(a * int(item), 64)
            h = _wrapped(h + (h >> 32), 64)
            places.append((h & 0x7FFFFFFF) % width)
    return int(min(table[i, p] for i, p in enumerate(places)))


def count_min_frequency(sketch: Column, item: Column) -> Column:
    """The frequency of an item (text or a whole number) in a sketch made by `count_min_sketch`."""

    @F.pandas_udf("long")
    def run(sketches: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([sketch_frequency(s, None if i is None or i != i else i) for s, i in zip(sketches, items, strict=True)], dtype=object)

    return run(sketch, item)
