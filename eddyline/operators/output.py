"""Output rate limiting over a change log or stream in order, and cron schedules.

A policy names for each row the batch in which it is delivered. Batches count per key of `by`, which groups the
output (a context partition); without one the whole stream is a single sequence, as the semantics demand.
"""

from __future__ import annotations

import calendar
import datetime as dt
import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.operators.retain import ordered


def every_events(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """All rows, delivered after every n-th; rows of an unfinished batch are not delivered."""
    w = ordered(by)
    numbered = df.withColumn("_batch", F.floor((F.row_number().over(w) - 1) / n))
    return numbered.withColumn("_k", F.count("*").over(Window.partitionBy(*by, "_batch"))).where(F.col("_k") == n).drop("_k")


def every_time(df: DataFrame, us: int, start: int | Column) -> DataFrame:
    """All rows, delivered at the end of intervals of d from a start."""
    return df.withColumn("_batch", F.floor((F.col("_ts") - start) / us))


def first_of_batch(batches: DataFrame, by: Sequence[str] = (), group: Sequence[str] = ()) -> DataFrame:
    """The first row of each batch, for each group."""
    w = Window.partitionBy(*by, "_batch", *group).orderBy("_ts", "_seq")
    return batches.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def last_of_batch(batches: DataFrame, by: Sequence[str] = (), group: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by, "_batch", *group).orderBy(F.col("_ts").desc(), F.col("_seq").desc())
    return batches.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def all_groups(batches: DataFrame, group: Sequence[str]) -> DataFrame:
    """At each batch the last row of every group seen so far, repeated for groups without news.

    Groups meet only the batches from their first on, found by the gap to their next own batch: no cross join.
    """
    last = last_of_batch(batches, (), group)
    end = batches.agg(F.max("_batch").alias("_end"))
    w = Window.partitionBy(*group).orderBy("_batch")
    spans = last.withColumn("_next", F.lead("_batch").over(w)).crossJoin(F.broadcast(end))  # one row
    spans = spans.withColumn("_tick", F.explode(F.sequence("_batch", F.coalesce(F.col("_next") - 1, F.col("_end")))))
    return spans.withColumn("_batch", F.col("_tick")).drop("_tick", "_next", "_end")


def after_events(df: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Suppress the first n rows."""
    return df.withColumn("_k", F.row_number().over(ordered(by))).where(F.col("_k") > n).drop("_k")


def after_time(df: DataFrame, us: int, start: int | Column) -> DataFrame:
    return df.where(F.col("_ts") >= start + us)


def limit_batch(batches: DataFrame, order: Sequence[Column], limit: int = -1, offset: int = 0) -> DataFrame:
    """Order by and limit within each batch; a negative limit is none."""
    numbered = batches.withColumn("_k", F.row_number().over(Window.partitionBy("_batch").orderBy(*order)))
    kept = numbered.where(F.col("_k") > max(0, offset))
    return (kept if limit < 0 else kept.where(F.col("_k") <= max(0, offset) + limit)).drop("_k")


def distinct_batch(batches: DataFrame, columns: Sequence[str]) -> DataFrame:
    return batches.select("_batch", *columns).distinct()


def snapshot_at(live: DataFrame, start: int, stop: int, us: int) -> DataFrame:
    """The rows retained at each tick (column `tick`, microseconds): start + d, start + 2 d and so on up to `stop`.

    Each row makes the ticks of its own lifetime, so nothing is joined and the work is the size of the result.
    """
    nth = lambda at: F.ceil((at - F.lit(start)) / F.lit(us)).cast("long")
    first = F.greatest(F.lit(1).cast("long"), nth(F.col("_in.ts")))
    last = F.floor(F.lit((stop - start) / us)).cast("long") if stop >= start else F.lit(0).cast("long")
    last = F.least(last, F.when(F.col("_out").isNotNull(), nth(F.col("_out.ts")) - 1).otherwise(last))
    own = F.when((first <= last) & F.col("_in.ts").isNotNull(), F.sequence(first, last))
    return live.withColumn("_n", F.explode(own)).withColumn("tick", F.lit(start) + F.col("_n") * us).drop("_n")


def ticks(spark: SparkSession, start: int, stop: int, us: int) -> DataFrame:
    return spark.range(start + us, stop + 1, us).withColumnRenamed("id", "tick")


def at_termination(df: DataFrame, partition: Sequence[str]) -> DataFrame:
    """The last row of each context partition, delivered when it ends; its instant is that row's."""
    return last_of_batch(df.withColumn("_batch", F.lit(0)), partition)


def terminated(df: DataFrame, partition: Sequence[str], take: str = "last", condition: Column | None = None, group: Sequence[str] = ()) -> DataFrame:
    """What is delivered when a context partition ends: all rows of it, the first, the last, or the last of each group.

    condition: partitions whose last row does not meet it deliver nothing.
    """
    batches = df.withColumn("_batch", F.lit(0))
    if condition is not None:
        last = F.max_by(F.coalesce(condition, F.lit(False)), F.struct("_ts", "_seq")).over(Window.partitionBy(*partition))
        batches = batches.withColumn("_ok", last).where("_ok").drop("_ok")
    if take == "first":
        return first_of_batch(batches, partition, group)
    if take in ("last", "snapshot"):
        return last_of_batch(batches, partition, group)
    if take != "all":
        raise ValueError(f"no way to take {take}")
    return batches


def and_when_terminated(batches: DataFrame, df: DataFrame, partition: Sequence[str]) -> DataFrame:
    """The rows that a policy delivers, and at a partition's end those it has not delivered yet, as one more batch."""
    end = df.join(batches.select("_seq").distinct(), "_seq", "left_anti")
    last = batches.groupBy(*partition).agg((F.max("_batch") + 1).alias("_end"))
    rest = end.join(last, list(partition), "left").withColumn("_batch", F.coalesce("_end", F.lit(0).cast("long"))).drop("_end")
    return batches.unionByName(rest.select(batches.columns))


def at_instants(df: DataFrame, instants: Sequence[int]) -> DataFrame:
    """Each row with `tick`, the first of the instants at or after it, at which it is delivered; rows after all are not.

    instants: a bounded calendar in order (microseconds), such as a schedule's within the events' time.
    """
    due = np.asarray(sorted(instants), np.int64)

    @F.pandas_udf("long")
    def next_of(ts: pd.Series) -> pd.Series:
        at = np.searchsorted(due, ts.to_numpy(np.int64))
        return pd.Series(np.append(due, 0)[at]).astype("Int64").mask(at == len(due))

    return df.where("_ts is not null").withColumn("tick", next_of("_ts")).where("tick is not null")


def iso_instants(text: str, start: dt.datetime | None = None) -> Iterator[dt.datetime]:
    """Instants of an ISO 8601 repeating interval R[n]/[date]/[period]; without a date they count from `start`.

    R without a number repeats for ever. Months and years move the date by the calendar, a day beyond a month's end
    becomes its last.
    """
    parts = text.split("/")
    times: int | None = 1
    if parts[0].startswith("R"):
        head = parts.pop(0)
        times = int(head[1:]) if len(head) > 1 else None
    first = dt.datetime.fromisoformat(parts.pop(0).replace("Z", "+00:00")).replace(tzinfo=None) if parts and not parts[0].startswith("P") else None
    period = parts[0] if parts else None
    if first is not None and times != 0:
        yield first
    base = first if first is not None else start
    if period is None or base is None:
        return
    for i in itertools.count(1):
        if times is not None and i >= times + (first is None):
            return
        try:
            at = _moved(base, period, i)
        except (OverflowError, ValueError):
            if re.fullmatch(_PERIOD, period) is None:
                raise
            return  # beyond the last year that a date can have
        if at <= base:
            raise ValueError(f"{period} does not move the time")
        yield at


def iso_schedule(text: str, start: dt.datetime | None = None, stop: dt.datetime | None = None) -> list[dt.datetime]:
    """The instants of an ISO schedule as a list, up to `stop` if given; one that repeats for ever needs a `stop`."""
    if stop is None and re.match(r"R(/|$)", text):
        raise ValueError(f"{text} repeats for ever: give a stop, or iterate over iso_instants")
    return list(itertools.takewhile(lambda t: stop is None or t <= stop, iso_instants(text, start)))


def schedule_ticks(spark: SparkSession, text: str, start: dt.datetime, stop: dt.datetime) -> DataFrame:
    """The instants of an ISO schedule in (start, stop] as microseconds."""
    due = iso_schedule(text, start, stop)
    return spark.createDataFrame([(calendar.timegm(t.timetuple()) * 1_000_000 + t.microsecond,) for t in due if t > start], "tick long")


_PERIOD = r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?)?"


def _moved(t: dt.datetime, period: str, times: int) -> dt.datetime:
    m = re.fullmatch(_PERIOD, period)
    if m is None:
        raise ValueError(f"{period} is no ISO 8601 period")
    years, months, weeks, days, hours, minutes, seconds = (float(x or 0) * times for x in m.groups())
    n = t.year * 12 + t.month - 1 + int(years) * 12 + int(months)
    day = min(t.day, calendar.monthrange(n // 12, n % 12 + 1)[1])
    return t.replace(year=n // 12, month=n % 12 + 1, day=day) + dt.timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)


@dataclass(frozen=True)
class Counters:
    """What an output condition sees."""

    count_insert: int
    count_insert_total: int
    count_remove: int
    count_remove_total: int
    last_output_time: int | None
    time: int


@dataclass(frozen=True)
class InsertsFrom:
    """An output condition that is a count: n rows or more came in since the last output."""

    n: int

    def __call__(self, c: Counters) -> bool:
        return c.count_insert >= self.n


def when(df: DataFrame, condition: Callable[[Counters], bool], by: Sequence[str] = ()) -> DataFrame:
    """Flush when a condition over counters becomes true: a fold over each key's rows in order, InsertsFrom as a plan."""
    if isinstance(condition, InsertsFrom):
        own = F.when(F.col("_op") == "-", 0).otherwise(1) if "_op" in df.columns else F.lit(1)
        upto = ordered(by).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*by)
        numbered = df.withColumn("_came", own).withColumn("_n", F.sum("_came").over(upto) - F.col("_came"))
        numbered = numbered.withColumn("_batch", F.floor(F.col("_n") / condition.n)).withColumn("_full", F.floor(F.sum("_came").over(whole) / condition.n))
        return numbered.where("_batch < _full").drop("_came", "_n", "_full")
    schema = T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])
    has_op = "_op" in df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_ts", "_seq"], ignore_index=True)
        batch, since, total, last = 0, [0, 0], [0, 0], None
        marks = []
        for t, op in zip(pdf["_ts"], pdf["_op"] if has_op else ["+"] * len(pdf), strict=True):
            side = int(op == "-")
            since[side] += 1
            total[side] += 1
            marks.append(batch)
            if condition(Counters(since[0], total[0], since[1], total[1], last, int(t))):
                batch, since, last = batch + 1, [0, 0], int(t)
        return pdf.assign(_batch=marks)[[b < batch for b in marks]]

    return df.groupBy(*(list(by) or [F.lit("all")])).applyInPandas(run, schema)


# ---- cron --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cron:
    """A cron field: which values of its range it admits, given the date for day fields."""

    admits: Callable[[int, dt.datetime], bool]


def wildcard() -> Cron:
    return Cron(lambda v, d: True)


def step(n: int) -> Cron:
    return Cron(lambda v, d: v % n == 0)


def span(first: int, last: int) -> Cron:
    return Cron(lambda v, d: first <= v <= last if first <= last else v >= first or v <= last)


def values(*admitted: int) -> Cron:
    return Cron(lambda v, d: v in admitted)


def _month_days(d: dt.datetime) -> int:
    return calendar.monthrange(d.year, d.month)[1]


def last_day() -> Cron:
    return Cron(lambda v, d: v == _month_days(d))


def last_weekday() -> Cron:
    """The last Monday-to-Friday of the month."""

    def admits(v: int, d: dt.datetime) -> bool:
        n = _month_days(d)
        while d.replace(day=n).weekday() > 4:
            n -= 1
        return v == n

    return Cron(admits)


def last_day_of_week(day: int) -> Cron:
    """The month's last given weekday, Sunday = 0; for the weekday field."""
    return Cron(lambda v, d: v == day and d.day + 7 > _month_days(d))


def nearest_weekday(day: int) -> Cron:
    """The Monday-to-Friday nearest to a day, within the month."""

    def admits(v: int, d: dt.datetime) -> bool:
        n = min(day, _month_days(d))
        weekday = d.replace(day=n).weekday()
        if weekday == 5:
            n += -1 if n > 1 else 2
        elif weekday == 6:
            n += 1 if n < _month_days(d) else -2
        return v == n

    return Cron(admits)


@dataclass(frozen=True)
class Schedule:
    """minute, hour, day of month, month, weekday (Sunday = 0), second. Both day fields must admit a day."""

    minute: Cron
    hour: Cron
    day: Cron
    month: Cron
    weekday: Cron
    second: Cron = values(0)

    def after(self, t: dt.datetime, years: int = 10) -> Iterator[dt.datetime]:
        """The instants after t, for some years ahead."""
        day, end = t.replace(hour=0, minute=0, second=0, microsecond=0), t.replace(year=t.year + years)
        while day < end:
            if self.month.admits(day.month, day) and self.day.admits(day.day, day) and self.weekday.admits(day.isoweekday() % 7, day):
                for h in range(24):
                    if self.hour.admits(h, day):
                        for m in range(60):
                            if self.minute.admits(m, day):
                                for s in range(60):
                                    at = day.replace(hour=h, minute=m, second=s)
                                    if at > t and self.second.admits(s, day):
                                        yield at
            day += dt.timedelta(days=1)

    def ticks(self, spark: SparkSession, start: dt.datetime, stop: dt.datetime) -> DataFrame:
        """The instants in (start, stop] as microseconds."""
        found = []
        for t in self.after(start):
            if t > stop:
                break
            found.append((calendar.timegm(t.timetuple()) * 1_000_000,))
        return spark.createDataFrame(found, "tick long")
