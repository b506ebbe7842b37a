"""Data windows: which events a stream retains, and for how long.

A stream is a DataFrame with `_ts` (engine time, microseconds) and `_seq` (total order). A policy gives every event
a lifetime: the instants `_in` and `_out` at which it enters and leaves, structs of (ts, seq) that compare as the
engine processes them: the clock moves to an instant before that instant's events, so expiry by time is (ts, -1).
`_out` is null for what is still retained; events that never enter are dropped.

Lifetimes compose: a union of windows retains until the last child lets go, an intersection until the first. From
them follow the change log (`changes`), the state at any instant (`snapshot`) and windowed joins. Policies whose
lifetimes are contiguous also give a window frame, so that running aggregates stay inside Spark's window operator.

Order within a key is inherent to these operators, so the key of `by` is their unit of work; a stream without a
key is one unit. Policies that need a state machine (sort, rank, expression, time batches) fold a key's events as a stream.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSTANT = T.StructType([T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType())])
SECOND = 1_000_000


def stream(df: DataFrame, ts: str | Column, seq: str | Column) -> DataFrame:
    """A table as a stream: its time column and its order."""
    t = F.col(ts) if isinstance(ts, str) else ts
    s = F.col(seq) if isinstance(seq, str) else seq
    return df.withColumn("_ts", F.unix_micros(t.cast("timestamp"))).withColumn("_seq", s.cast("long"))


def instant(ts: Column, seq: Column) -> Column:
    return F.struct(ts.cast("long").alias("ts"), seq.cast("long").alias("seq"))


def now() -> Column:
    return instant(F.col("_ts"), F.col("_seq"))


def timer(ts: Column) -> Column:
    return F.when(ts.isNotNull(), instant(ts, F.lit(-1)))


def never() -> Column:
    return F.lit(None).cast(INSTANT)


def ordered(by: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("_ts", "_seq") if by else Window.orderBy("_ts", "_seq")


class Policy:
    """A retention policy."""

    def lifetimes(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        raise NotImplementedError

    def frame(self, by: Sequence[str] = ()) -> WindowSpec | None:
        """The frame of what is retained just after an event, where that is contiguous."""
        return None

    def span(self) -> int | None:
        """Microseconds that no event outlives, if there is such a bound: joins cut time into buckets of it."""
        return None

    def retained(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """What is retained at the end of the events."""
        return snapshot(self.lifetimes(df, by)).drop("_in", "_out")


@dataclass(frozen=True)
class KeepAll(Policy):
    def lifetimes(self, df, by=()):
        return df.withColumn("_in", now()).withColumn("_out", never())

    def frame(self, by=()):
        return ordered(by).rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Length(Policy):
    """The last n events."""

    n: int

    def lifetimes(self, df, by=()):
        return df.withColumn("_in", now()).withColumn("_out", F.lead("_in", self.n).over(ordered(by)))

    def frame(self, by=()):
        return ordered(by).rowsBetween(-(self.n - 1), 0)


@dataclass(frozen=True)
class Time(Policy):
    """The events of the last d microseconds; an event leaves at exactly its arrival + d."""

    us: int

    def lifetimes(self, df, by=()):
        return df.withColumn("_in", now()).withColumn("_out", timer(F.col("_ts") + self.us))

    def frame(self, by=()):
        w = Window.partitionBy(*by) if by else Window
        return w.orderBy("_ts").rangeBetween(-(self.us - 1), 0)

    def span(self):
        return self.us


@dataclass(frozen=True)
class TimeCalendar(Policy):
    """A sliding window of calendar months, days and microseconds."""

    months: int = 0
    days: int = 0
    us: int = 0

    def lifetimes(self, df, by=()):
        t = F.timestamp_micros("_ts") + F.make_interval(months=F.lit(self.months), days=F.lit(self.days))
        return df.withColumn("_in", now()).withColumn("_out", timer(F.unix_micros(t) + self.us))


@dataclass(frozen=True)
class ExternallyTimed(Policy):
    """Sliding by a property (microseconds) that does not decrease; driven by the newest event."""

    column: str
    us: int

    def lifetimes(self, df, by=()):
        return _until_reached(df, self.column, F.col(self.column) + self.us, by)

    def frame(self, by=()):
        return (Window.partitionBy(*by) if by else Window).orderBy(self.column).rangeBetween(-(self.us - 1), 0)


@dataclass(frozen=True)
class LengthBatch(Policy):
    """Batches of n: a batch enters as a whole with its last event and leaves with the next batch's."""

    n: int

    def lifetimes(self, df, by=()):
        numbered = df.withColumn("_batch", F.floor((F.row_number().over(ordered(by)) - 1) / self.n))
        last = F.max(now()).over(Window.partitionBy(*by, "_batch"))
        size = F.count("*").over(Window.partitionBy(*by, "_batch"))
        numbered = numbered.withColumn("_in", last).withColumn("_size", size)
        w = ordered(by)
        out = F.when(F.lead("_size", self.n).over(w) == self.n, F.lead("_in", self.n).over(w))  # an unfinished batch replaces none
        return numbered.withColumn("_out", out).where(F.col("_size") == self.n).drop("_size")


@dataclass(frozen=True)
class ExternallyTimedBatch(Policy):
    """Batches by a property, in steps of d from a reference point or the first event; closed by a later event."""

    column: str
    us: int
    reference: int | None = None

    def lifetimes(self, df, by=()):
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        anchor = F.lit(self.reference) if self.reference is not None else F.min(self.column).over(whole)
        bucket = F.floor((F.col(self.column) - anchor) / self.us)
        first = df.withColumn("_batch", bucket).groupBy(*by, "_batch").agg(F.min(now()).alias("_first"))
        w = (Window.partitionBy(*by) if by else Window).orderBy("_batch")
        spans = first.select(*by, "_batch", F.lead("_first", 1).over(w).alias("_in"), F.lead("_first", 2).over(w).alias("_out"))
        return df.withColumn("_batch", bucket).join(spans, [*by, "_batch"]).where("_in is not null")


@dataclass(frozen=True)
class TimeAccum(Policy):
    """Accumulate until d of silence, then let the whole window go."""

    us: int

    def lifetimes(self, df, by=()):
        gap = F.col("_ts") - F.lag("_ts").over(ordered(by)) >= self.us
        numbered = df.withColumn("_session", F.sum(F.when(gap, 1).otherwise(0)).over(ordered(by)))
        last = F.max("_ts").over(Window.partitionBy(*by, "_session"))
        return numbered.withColumn("_in", now()).withColumn("_out", timer(last + self.us))


def _calendar(ts: Column, months: int, days: int) -> Column:
    """Microseconds moved by calendar months and days; a day beyond the month's end becomes its last."""
    return F.unix_micros(F.timestamp_micros(ts) + F.make_interval(months=F.lit(months), days=F.lit(days)))


def _until_reached(df: DataFrame, column: str, end: Column, by: Sequence[str], bucket_us: int = 3600 * SECOND) -> DataFrame:
    """Lifetimes up to the first event of the key whose `column` (microseconds) is at or beyond an event's end.

    Events and ends meet in buckets of time, latest first: Spark computes a frame to the end of a partition anew for
    each row, one from its start goes on. A bucket begins with the first event of all later ones; only those, a row
    a bucket and key, are one sequence. An event without end stays; one without place in the order evicts none.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    live = df.withColumn("_in", now())
    whole = F.struct(*live.columns)
    mark = lambda t, kind, row, at: F.struct(t.cast("long").alias("_t"), F.lit(kind).alias("_kind"), row.alias("_row"), at.alias("_at"))
    reached = F.when(F.col(column).isNotNull() & F.col("_seq").isNotNull(), F.col("_in"))
    both = F.array(mark(end, 0, whole, never()), mark(F.col(column), 1, F.when(F.lit(False), whole), reached))
    marks = live.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.inline(both)).withColumn("_bucket", F.floor(F.col("_t") / bucket_us))
    later = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = marks.groupBy(*keys, "_bucket").agg(F.min("_at").alias("_at")).withColumn("_at", F.min("_at").over(later))
    carried = firsts.withColumns({"_t": F.lit((1 << 63) - 1), "_kind": F.lit(1), "_row": F.lit(None).cast(marks.schema["_row"].dataType)})
    w = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    out = marks.unionByName(carried).withColumn("_out", F.min("_at").over(w)).where("_kind = 0")
    return out.select("_row.*", F.when(F.col("_t").isNotNull(), F.col("_out")).alias("_out"))


@dataclass(frozen=True)
class TimeAccumCalendar(Policy):
    """Accumulate until calendar months and days of silence."""

    months: int = 0
    days: int = 0

    def lifetimes(self, df, by=()):
        due = _calendar(F.col("_ts"), self.months, self.days)
        gap = F.col("_ts") >= F.lag(due).over(ordered(by))
        numbered = df.withColumn("_due", due).withColumn("_session", F.sum(F.when(gap, 1).otherwise(0)).over(ordered(by)))
        return numbered.withColumn("_in", now()).withColumn("_out", timer(F.max("_due").over(Window.partitionBy(*by, "_session")))).drop("_due")


@dataclass(frozen=True)
class TimeOrderCalendar(Policy):
    """By an event timestamp, for calendar months and days of engine time."""

    column: str
    months: int = 0
    days: int = 0

    def lifetimes(self, df, by=()):
        due = df.withColumn("_due", _calendar(F.col(self.column), self.months, self.days))
        return TimeToLive("_due").lifetimes(due, by).drop("_due")


@dataclass(frozen=True)
class First(Policy):
    """The first n events (1: the first event)."""

    n: int = 1

    def lifetimes(self, df, by=()):
        return df.withColumn("_rn", F.row_number().over(ordered(by))).where(F.col("_rn") <= self.n).drop("_rn").withColumn("_in", now()).withColumn("_out", never())


@dataclass(frozen=True)
class FirstTime(Policy):
    """Events that arrive within d of the start."""

    us: int
    start: int

    def lifetimes(self, df, by=()):
        return KeepAll().lifetimes(df.where(F.col("_ts") < self.start + self.us), by)


@dataclass(frozen=True)
class FirstTimeCalendar(Policy):
    """Events that arrive within calendar months and days of the start."""

    months: int
    days: int
    start: int

    def lifetimes(self, df, by=()):
        end = F.unix_micros(F.timestamp_micros(F.lit(self.start)) + F.make_interval(months=F.lit(self.months), days=F.lit(self.days)))
        return KeepAll().lifetimes(df.where(F.col("_ts") < end), by)


@dataclass(frozen=True)
class ExternallyTimedCalendar(Policy):
    """Sliding by a property over calendar months and days: an event leaves with the first one at its end or later."""

    column: str
    months: int = 0
    days: int = 0

    def lifetimes(self, df, by=()):
        live = _until_reached(df, self.column, _calendar(F.col(self.column), self.months, self.days), by)
        for b in by:  # without its key an event has no others beside it
            live = live.withColumn("_out", F.when(F.col(b).isNotNull(), F.col("_out")))
        return live


@dataclass(frozen=True)
class FirstUnique(Policy):
    """The first event of each key."""

    keys: tuple[str, ...]

    def lifetimes(self, df, by=()):
        return First(1).lifetimes(df, [*by, *self.keys])


@dataclass(frozen=True)
class Unique(Policy):
    """The latest event of each key; what it replaces leaves. Without keys: the last event."""

    keys: tuple[str, ...] = ()

    def lifetimes(self, df, by=()):
        return Length(1).lifetimes(df, [*by, *self.keys])


def LastEvent() -> Policy:  # noqa: N802
    return Unique(())


@dataclass(frozen=True)
class TimeOrder(Policy):
    """By an event timestamp: an event leaves at that + d of engine time; a late one enters and leaves at once."""

    column: str
    us: int

    def lifetimes(self, df, by=()):
        due = F.col(self.column) + self.us
        return df.withColumn("_in", now()).withColumn("_out", F.when(due <= F.col("_ts"), now()).otherwise(timer(due)))


@dataclass(frozen=True)
class TimeToLive(Policy):
    """An absolute expiry (microseconds) for each event."""

    column: str

    def lifetimes(self, df, by=()):
        return TimeOrder(self.column, 0).lifetimes(df, by)


@dataclass(frozen=True)
class Group(Policy):
    """A window of its own for each key."""

    keys: tuple[str, ...]
    inner: Policy

    def lifetimes(self, df, by=()):
        return self.inner.lifetimes(df, [*by, *self.keys])

    def frame(self, by=()):
        return self.inner.frame([*by, *self.keys])

    def span(self):
        return self.inner.span()


class _Composite(Policy):
    def __init__(self, *children: Policy):
        self.children = children

    def lifetimes(self, df, by=()):
        for i, child in enumerate(self.children):
            df = child.lifetimes(df, by).withColumnsRenamed({"_in": f"_in{i}", "_out": f"_out{i}"})
        ins, outs = ([F.col(f"{n}{i}") for i in range(len(self.children))] for n in ("_in", "_out"))
        return df.withColumn("_in", F.greatest(*ins)).withColumn("_out", self.combine(outs)).drop(*(f"{n}{i}" for n in ("_in", "_out") for i in range(len(self.children))))


class UnionOf(_Composite):
    """Retained while any child retains it."""

    def span(self):
        spans = [c.span() for c in self.children]
        return None if None in spans else max(spans)

    def combine(self, outs):
        kept = outs[0].isNull()
        for o in outs[1:]:
            kept |= o.isNull()
        return F.when(~kept, F.greatest(*outs))


class IntersectOf(_Composite):
    """Retained while all children do."""

    def span(self):
        return min((x for c in self.children if (x := c.span()) is not None), default=None)

    def combine(self, outs):
        return F.least(*outs)


# ---- policies that fold ------------------------------------------------------------------------------------


Step = Callable[[int, "int | None", "int | None", Any], "list[tuple]"]


class Fold(Policy):
    """A state machine over a key's events in order, as a stream: a task holds the events whose lifetime is open.

    `machine` makes one for a key: a function of an event's number, ts, seq and `needs`, and one without arguments for
    the end. Both return the lifetimes that have become known: (number, in ts, in seq, out ts, out seq); an in seq of
    None never enters, an out seq of None never leaves.
    """

    def machine(self) -> tuple[Step, Callable[[], list[tuple]]]:
        raise NotImplementedError

    def needs(self) -> Sequence[str] | None:
        """Columns whose values `machine` gets as a tuple; None: all, as a dict."""
        return ()

    def lifetimes(self, df, by=()):
        return self._folded(df, by, True)

    def retained(self, df, by=()):
        return self._folded(df, by, False).drop("_in", "_out")

    def _folded(self, df: DataFrame, by: Sequence[str], gone: bool) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("_in", INSTANT), T.StructField("_out", INSTANT)])
        names, keys, needs, machine = df.columns, [f"_k{i}" for i in range(len(by))], self.needs(), self.machine
        # 0.0 and -0.0 are one key, and so is NaN
        made = {k: (F.col(b) + F.lit(0.0)).cast("string") if isinstance(df.schema[b].dataType, T.FloatType | T.DoubleType) else F.col(b) for k, b in zip(keys, by, strict=True)}

        def run(batches):
            current, step, close, number = None, None, None, 0
            waiting: dict[int, tuple] = {}
            done: dict[int, tuple] = {}

            def known(lives):
                for i, *life in lives:
                    batch, place = waiting.pop(i)
                    if life[1] is not None and (gone or life[3] is None):
                        _, places, spans = done.setdefault(id(batch), (batch, [], []))
                        places.append(place)
                        spans.append(life)

            def shown():
                for batch, places, spans in done.values():
                    taken = batch.take(pa.array(places, pa.int64()))
                    columns = list(zip(*spans, strict=True))
                    ends = (_instants(*columns[:2]), _instants(*columns[2:]))
                    yield pa.RecordBatch.from_arrays([*(taken.column(n) for n in names), *ends], [*names, "_in", "_out"])
                done.clear()

            for batch in batches:
                size = batch.num_rows
                ks = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * size
                if needs is None:
                    rows = batch.select(names).to_pylist()
                else:
                    rows = list(zip(*(batch.column(n).to_pylist() for n in needs), strict=True)) if needs else [()] * size
                events = zip(ks, batch.column("_ts").to_pylist(), batch.column("_seq").to_pylist(), rows, strict=True)
                for place, (k, t, s, row) in enumerate(events):
                    if step is None or k != current:
                        if close is not None:
                            known(close())
                        current, (step, close) = k, machine()
                    waiting[number] = batch, place
                    known(step(number, t, s, row))
                    number += 1
                yield from shown()
                left = [(i, place) for i, (b, place) in waiting.items() if b is batch]
                if left:
                    few = batch.take(pa.array([place for _, place in left], pa.int64()))
                    waiting.update((i, (few, n)) for n, (i, _) in enumerate(left))
            if close is not None:
                known(close())
            yield from shown()

        keyed = df.withColumns(made)
        dealt = keyed.repartition(*keys) if keys else keyed.repartition(1)
        return dealt.sortWithinPartitions(*keys, F.asc_nulls_last("_ts"), "_seq").mapInArrow(run, schema)


def _instants(ts: Sequence, seq: Sequence) -> pa.Array:
    ends = [pa.array(ts, pa.int64()), pa.array(seq, pa.int64())]
    return pa.StructArray.from_arrays(ends, ["ts", "seq"], mask=pa.array([x is None for x in seq]))


def _keys(row: tuple, keys: Sequence[str]) -> tuple:
    """A sort key; a leading minus sorts numbers downwards. NaN and, after it, null come last either way."""
    return tuple((2, 0) if v is None else (1, 0) if v != v else (0, -v if k.startswith("-") else v) for v, k in zip(row, keys, strict=True))


@dataclass(frozen=True)
class Sort(Fold):
    """The first n by sort keys; the worst is evicted, of equal keys the oldest is the worst."""

    n: int
    keys: tuple[str, ...]

    def retained(self, df, by=()):
        """The first n of all events: what is evicted once is worse than n others for good. Spark takes partial ones first."""
        order = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in self.keys]
        w = Window.partitionBy(*by).orderBy(*order, F.desc("_ts"), F.desc("_seq"))
        return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= self.n).drop("_place")

    def needs(self):
        return [k.removeprefix("-") for k in self.keys]

    def machine(self):
        held: list[tuple] = []

        def step(i, t, s, row):
            bisect.insort(held, (_keys(row, self.keys), -i, t, s))
            if len(held) <= self.n:
                return []
            _, j, *enter = held.pop()
            return [(-j, *enter, t, s)]

        return step, lambda: [(-j, *enter, None, None) for _, j, *enter in held]


@dataclass(frozen=True)
class Rank(Fold):
    """The first n by sort keys of the latest events by unique keys."""

    n: int
    unique: tuple[str, ...]
    keys: tuple[str, ...]

    def needs(self):
        return [*self.unique, *(k.removeprefix("-") for k in self.keys)]

    def machine(self):
        held: list[tuple] = []
        latest: dict[tuple, tuple] = {}
        width = len(self.unique)

        def step(i, t, s, row):
            u, gone = row[:width], []
            if u in latest:
                gone.append(latest.pop(u))
                held.remove(gone[0])
            entry = (_keys(row[width:], self.keys), -i, t, s, u)
            bisect.insort(held, entry, key=lambda x: x[:2])
            latest[u] = entry
            if len(held) > self.n:
                gone.append(held.pop())
                del latest[gone[-1][4]]
            return [(-j, a, b, t, s) for _, j, a, b, _ in gone]

        return step, lambda: [(-j, a, b, None, None) for _, j, a, b, _ in held]


@dataclass(frozen=True)
class TimeBatch(Fold):
    """Batches of d of engine time, anchored at the first arrival or at a reference point.

    A batch enters when it is full and leaves with the next flush. After a flush without new events the schedule
    stops, and the next event anchors it anew (unless there is a reference point or updates are forced).
    """

    us: int
    reference: int | None = None
    force: bool = False

    def lifetimes(self, df, by=()):
        if self.reference is None and not self.force:
            return super().lifetimes(df, by)
        start = F.lit(self.reference) if self.reference is not None else F.min("_ts").over(Window.partitionBy(*by))
        flush = F.col("_ts") - F.pmod(F.col("_ts") - start, F.lit(self.us)) + self.us
        timed = df.withColumn("_flush", flush)
        return timed.withColumn("_in", instant(F.col("_flush"), F.lit(-1))).withColumn("_out", instant(F.col("_flush") + self.us, F.lit(-1))).drop("_flush")

    def retained(self, df, by=()):
        return Policy.retained(self, df, by)

    def machine(self):
        us, end = self.us, None

        def step(i, t, s, row):
            nonlocal end
            if t is None:  # such events come last: they are of the last batch
                return [(i, end, -1, None if end is None else end + us, -1)]
            if end is None or t >= end + us:
                end = t + us
            elif t >= end:
                end += us
            return [(i, end, -1, end + us, -1)]

        return step, list


@dataclass(frozen=True)
class TimeBatchCalendar(Fold):
    """Batches of calendar months, anchored at the first arrival; after a silent flush the next event anchors anew."""

    months: int

    def _end(self, anchor: pd.Timestamp, k: int) -> int:
        return (anchor + pd.DateOffset(months=self.months * k)).value // 1000

    def machine(self):
        k, anchor, end, after = 0, None, None, None

        def step(i, t, s, row):
            nonlocal k, anchor, end, after
            if t is not None and (end is None or t >= end):
                if end is None or t >= after:
                    anchor, k = pd.Timestamp(t, unit="us"), 0
                k += 1
                end, after = self._end(anchor, k), self._end(anchor, k + 1)
            return [(i, end, -1, after, -1)]

        return step, list


@dataclass(frozen=True)
class TimeLengthBatch(Fold):
    """Flush after n events or d, whichever is first; d counts from the last flush or the first event after it.

    With a start, an eager one, d counts from there, and empty intervals flush as well, so that the schedule goes on.
    """

    us: int
    n: int
    start: int | None = None

    def machine(self):
        us = self.us
        due = None if self.start is None else self.start + us
        held: list[int] = []
        before: list[int] = []
        entered: tuple = ()

        def flush(at: tuple) -> list[tuple]:
            nonlocal held, before, entered
            left = [(i, *entered, *at) for i in before]
            held, before, entered = [], held, at
            return left

        def step(i, t, s, row):
            nonlocal due
            out = []
            while due is not None and t is not None and t >= due:
                full = bool(held)
                out += flush((due, -1))
                if full:
                    due += us
                else:  # the flushes of further empty intervals change nothing
                    due = None if self.start is None else due + ((t - due) // us + 1) * us
            if due is None and t is not None:
                due = t + us
            held.append(i)
            if len(held) == self.n:
                out += flush((t, s))
                due = None if t is None else t + us
            return out

        def close():
            out = flush((due, -1)) if held else []
            return out + flush((None if entered[0] is None else entered[0] + us, -1)) if before else out

        return step, close


@dataclass(frozen=True)
class WindowState:
    """What an expression window's predicate sees."""

    current_count: int
    expired_count: int
    oldest_timestamp: int
    newest_timestamp: int
    oldest: Any
    newest: Any


@dataclass(frozen=True)
class CountBelow:
    """A predicate of expression windows that is a length: fewer than n events are held."""

    n: int

    def __call__(self, s: WindowState) -> bool:
        return s.current_count < self.n


@dataclass(frozen=True)
class CountFrom:
    """A predicate of expression batches that is a length: n events or more are held."""

    n: int

    def __call__(self, s: WindowState) -> bool:
        return s.current_count >= self.n


@dataclass(frozen=True)
class AgeBelow:
    """A predicate of expression windows that is a time: the newest event is less than d after the oldest."""

    us: int

    def __call__(self, s: WindowState) -> bool:
        return s.newest_timestamp - s.oldest_timestamp < self.us


@dataclass(frozen=True)
class Expression(Fold):
    """Let the oldest event go as long as the predicate is false. CountBelow and AgeBelow run as plans."""

    keep: Callable[[WindowState], bool]

    def lifetimes(self, df, by=()):
        if isinstance(self.keep, CountBelow) and self.keep.n > 1:
            return Length(self.keep.n - 1).lifetimes(df, by)
        if isinstance(self.keep, AgeBelow) and self.keep.us > 0:
            return ExternallyTimed("_ts", self.keep.us).lifetimes(df, by)
        return super().lifetimes(df, by)

    def needs(self):
        return None

    def machine(self):
        held: deque[tuple] = deque()

        def step(i, t, s, row):
            held.append((i, t, s, row))
            out: list[tuple] = []
            while held and not self.keep(WindowState(len(held), len(out), held[0][1], t, held[0][3], row)):
                j, *enter, _ = held.popleft()
                out.append((j, *enter, t, s))
            return out

        return step, lambda: [(j, *enter, None, None) for j, *enter, _ in held]


@dataclass(frozen=True)
class ExpressionBatch(Fold):
    """Flush the batch when the predicate is true, with or without the event that made it so. CountFrom runs as a plan."""

    flush: Callable[[WindowState], bool]
    include_trigger: bool = True

    def lifetimes(self, df, by=()):
        if isinstance(self.flush, CountFrom) and self.include_trigger and self.flush.n > 0:
            return LengthBatch(self.flush.n).lifetimes(df, by).drop("_batch")
        return super().lifetimes(df, by)

    def needs(self):
        return None

    def machine(self):
        held: list[tuple] = []
        before: list[int] = []
        entered: tuple = ()

        def step(i, t, s, row):
            nonlocal held, before, entered
            held.append((i, t, row))
            if not self.flush(WindowState(len(held), 0, held[0][1], t, held[0][2], row)):
                return []
            batch, rest = (held, []) if self.include_trigger else (held[:-1], held[-1:])
            out = [(j, *entered, t, s) for j in before]
            before, held, entered = [j for j, *_ in batch], rest, (t, s)
            return out

        return step, lambda: [(j, *entered, None, None) for j in before] + [(j, None, None, None, None) for j, *_ in held]


# ---- what follows from lifetimes ---------------------------------------------------------------------------


def changes(live: DataFrame, volatile: Sequence[str] = ()) -> DataFrame:
    """The change log: `_op` + and -, with the instant (`_at`) of each; old rows come before new ones of an instant.

    volatile: columns that look at the window, such as previous events; a row that leaves has none (null).
    """
    old = live.where("_out is not null").withColumn("_op", F.lit("-")).withColumn("_at", F.col("_out"))
    old = old.withColumns({c: F.lit(None).cast(live.schema[c].dataType) for c in volatile}) if volatile else old
    return live.withColumn("_op", F.lit("+")).withColumn("_at", F.col("_in")).unionByName(old)


def snapshot(live: DataFrame, at: int | None = None) -> DataFrame:
    """What is retained after the clock has reached `at` (microseconds), or at the end of the events."""
    if at is None:
        return live.where("_out is null")
    moment = instant(F.lit(at), F.lit((1 << 63) - 1))
    return live.where((F.col("_in") <= moment) & (F.col("_out").isNull() | (F.col("_out") > moment)))


def snapshot_at_end(live: DataFrame) -> DataFrame:
    """What is retained when the clock stands at the last event."""
    last = live.agg(F.max("_ts").alias("_end"))
    return live.crossJoin(F.broadcast(last)).where("_in.ts <= _end and (_out is null or _out.ts > _end)").drop("_end")  # one row


def running_totals(live: DataFrame, by: Sequence[str], **values: str | Column) -> DataFrame:
    """Sums and counts over what is retained after each change, for any policy: additions less removals."""
    log = changes(live).withColumn("_sign", F.when(F.col("_op") == "+", 1).otherwise(-1))
    w = (Window.partitionBy(*by) if by else Window).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    made = {name: F.sum((F.col(v) if isinstance(v, str) else v) * F.col("_sign")).over(w) for name, v in values.items()}
    return log.select("*", F.sum("_sign").over(w).alias("n_retained"), *(c.alias(n) for n, c in made.items()))

