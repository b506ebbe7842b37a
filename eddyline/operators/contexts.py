"""Contexts: partitions of a stream by key, hash, category, time, or events that start and end them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Partition by keys; null keys share one."""
    return df.withColumn("context_key", F.struct(*keys))


def hashed(df: DataFrame, key: str, buckets: int, algorithm: str = "crc32") -> DataFrame:
    """Hash buckets by crc32, java (32-bit text hash) or fnv1a (32 bits)."""
    text = F.col(key).cast("string")
    if algorithm == "crc32":
        code = F.crc32(text.cast("binary"))
    elif algorithm == "java":
        bytes_ = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
        code = F.aggregate(F.filter(bytes_, lambda b: b > 0), F.lit(0).cast("long"), lambda h, b: (h * 31 + b).bitwiseAND(F.lit(0xFFFFFFFF)))
        code = F.when(code >= 1 << 31, code - (1 << 32)).otherwise(code)
    elif algorithm == "fnv1a":
        code = _fnv1a(text)
    else:
        raise ValueError(f"no hash algorithm {algorithm}")
    return df.withColumn("context_id", F.pmod(code, F.lit(buckets)).cast("int"))


def _fnv1a(text: Column) -> Column:
    def one(value: str) -> int:
        h = 2166136261
        for b in value.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return run(text)


def categories(df: DataFrame, **predicates: Column) -> DataFrame:
    """Named predicates; an event goes to every category whose predicate it meets."""
    labels = F.filter(F.array(*(F.when(p, F.lit(n)) for n, p in predicates.items())), lambda x: x.isNotNull())
    return df.withColumn("context_label", F.explode(labels))


def initiated(df: DataFrame, start: Column, end: Column, by: Sequence[str] = ()) -> DataFrame:
    """Non-overlapping partitions from a start event, included, to the next end event, excluded.

    A start while a partition is open is an ordinary event of it. `context_id` numbers a key's partitions from 0.
    """
    w = Window.partitionBy(*by).orderBy("_ts", "_seq") if by else Window.orderBy("_ts", "_seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(end, -1).when(start, 1)
    # a start opens if no start stands between it and the last end before it
    marked = df.withColumn("_mark", mark)
    before = F.last(F.col("_mark"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_opens", (F.col("_mark") == 1) & (before.isNull() | (before == -1)))
    marked = marked.withColumn("context_id", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(upto) - 1)
    marked = marked.withColumn("_state", F.last("_mark", ignorenulls=True).over(upto))
    return marked.where("_state = 1").drop("_mark", "_opens", "_state")


def overlapping(df: DataFrame, start: Column, us: int, by: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """A partition for each start event that lives for d; its events are joined to it by key and time.

    The interval table is cut into buckets of d, so the join is an equi-join with at most two buckets a partition.
    """
    starts = df.where(start).select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), F.col("_ts").alias("_from"), F.col("_seq").alias("context_id"), *(F.col(c).alias(f"init_{c}") for c in columns))
    starts = starts.withColumn("_bucket", F.explode(F.array(F.floor(F.col("_from") / us), F.floor(F.col("_from") / us) + 1)))
    events = df.withColumn("_bucket", F.floor(F.col("_ts") / us))
    on = [events["_bucket"] == starts["_bucket"], *(events[b] == starts[f"_k{i}"] for i, b in enumerate(by))]
    inside = (F.col("_seq") >= F.col("context_id")) & (F.col("_ts") >= F.col("_from")) & (F.col("_ts") < F.col("_from") + us)
    return events.join(starts, on).where(inside).drop(starts["_bucket"], *(f"_k{i}" for i in range(len(by)))).drop("_bucket", "_from")


def by_intervals(df: DataFrame, intervals: DataFrame, by: Sequence[str], inclusive: bool = False, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Partitions that patterns start and end: rows (by, `_from`, `_to`, further columns) of `intervals`, in microseconds.

    An event belongs to every interval of its key that it falls into: after the start (or at it, if inclusive) and
    before the end; an open end is null. `context_id` is the start. An equi-join on the key and a bucket of time: an
    interval is in every bucket that it covers, up to the last event's, so choose buckets near the usual interval.
    """
    end = df.agg((F.max("_ts") + 1).alias("_end"))
    spans = intervals.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), *(c for c in intervals.columns if c not in by)).withColumn("context_id", F.col("_from"))
    spans = spans.crossJoin(F.broadcast(end))  # one row
    low, high = F.floor(F.col("_from") / bucket_us), F.floor(F.least(F.coalesce("_to", "_end"), F.col("_end")) / bucket_us)
    spans = spans.withColumn("_bucket", F.explode(F.when(low <= high, F.sequence(low, high)))).drop("_end")
    events = df.withColumn("_bucket", F.floor(F.col("_ts") / bucket_us))
    inside = (F.col("_ts") >= F.col("_from") if inclusive else F.col("_ts") > F.col("_from")) & (F.col("_to").isNull() | (F.col("_ts") < F.col("_to")))
    on = [events["_bucket"] == spans["_bucket"], *(events[b] == spans[f"_k{i}"] for i, b in enumerate(by))]
    return events.join(spans, on).where(inside).drop(spans["_bucket"], *(f"_k{i}" for i in range(len(by)))).drop("_bucket", "_from", "_to")


def daily(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Events between two times of day (hh:mm:ss), the end excluded; over midnight if the end is the earlier."""
    t = F.date_format(ts, "HH:mm:ss")
    inside = (t >= start) & (t < end) if start <= end else (t >= start) | (t < end)
    day = F.to_date(F.col(ts)) if start <= end else F.when(t < end, F.date_sub(F.to_date(F.col(ts)), 1)).otherwise(F.to_date(F.col(ts)))
    return df.where(inside).withColumn("context_day", day)


def periods(df: DataFrame, start: int, us: int) -> DataFrame:
    """Fixed periods from a start; the end instant is excluded."""
    return df.where(F.col("_ts") >= start).withColumn("context_id", F.floor((F.col("_ts") - start) / us))


def nested(df: DataFrame, *contexts) -> DataFrame:
    """Nested contexts: partitions are the product. Each is a function of the stream; columns are numbered."""
    for i, make in enumerate(contexts):
        before = set(df.columns)
        df = make(df)
        df = df.withColumnsRenamed({c: f"{c}_{i}" for c in df.columns if c not in before and c.startswith("context_")})
    return df


def descriptors(df: DataFrame) -> DataFrame:
    """The partitions of a context with their numbers of events."""
    return df.groupBy(*(c for c in df.columns if c.startswith("context_"))).count()


def select_partitions(df: DataFrame, **chosen: Sequence) -> DataFrame:
    """Only some partitions: context columns and the values asked for."""
    for name, wanted in chosen.items():
        df = df.where(F.col(name).isin(*wanted))
    return df
