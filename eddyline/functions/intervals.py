"""Allen's interval algebra on (start, end) columns; usable as a join condition. Points have equal start and end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions import datetime as dt
from eddyline.functions.compare import Value, col


@dataclass(frozen=True)
class Bounds:
    """An interval of numbers (milliseconds) or timestamps."""

    start: Column
    end: Column

    def point(self) -> Bounds:
        return replace(self, end=self.start)

    def moved(self, change) -> Bounds:
        """The start changed by a calendar function, the length kept."""
        start = change(self.start)
        return Bounds(start, start + (self.end - self.start))

    def with_date(self, y: Value, m: Value, d: Value) -> Bounds:
        return self.moved(lambda t: dt.with_date(t, y, m, d))

    def with_time(self, h: Value, m: Value, s: Value, ms: Value) -> Bounds:
        return self.moved(lambda t: dt.with_time(t, h, m, s, ms))

    def set(self, field: str, n: Value) -> Bounds:
        return self.moved(lambda t: dt.set_field(t, field, n))


def bounds(start: Value, end: Value | None = None) -> Bounds:
    return Bounds(col(start), col(start if end is None else end))


def _gap(distance: Column, least: Value | None, most: Value | None) -> Column:
    out = F.lit(True)
    if least is not None:
        out &= distance >= col(least)
    if most is not None:
        out &= distance <= col(most)
    return out


def before(a: Bounds, b: Bounds, least: Value | None = None, most: Value | None = None) -> Column:
    """a ends before b starts, or by a distance from `least` to `most`."""
    distance = b.start - a.end
    return a.end < b.start if least is None and most is None else _gap(distance, least, most)


def after(a: Bounds, b: Bounds, least: Value | None = None, most: Value | None = None) -> Column:
    distance = a.start - b.end
    return a.start > b.end if least is None and most is None else _gap(distance, least, most)


def coincides(a: Bounds, b: Bounds, start_within: Value = 0, end_within: Value | None = None) -> Column:
    end_within = start_within if end_within is None else end_within
    return (F.abs(a.start - b.start) <= col(start_within)) & (F.abs(a.end - b.end) <= col(end_within))


def during(a: Bounds, b: Bounds, least: Value | None = None, most: Value | None = None) -> Column:
    """a lies inside b, with distances at both ends from `least` to `most` if given."""
    if least is None and most is None:
        return (b.start < a.start) & (a.end < b.end)
    return _gap(a.start - b.start, least, most) & _gap(b.end - a.end, least, most)


def includes(a: Bounds, b: Bounds, least: Value | None = None, most: Value | None = None) -> Column:
    return during(b, a, least, most)


def finishes(a: Bounds, b: Bounds, within: Value = 0) -> Column:
    return (b.start < a.start) & (F.abs(a.end - b.end) <= col(within))


def finished_by(a: Bounds, b: Bounds, within: Value = 0) -> Column:
    return finishes(b, a, within)


def meets(a: Bounds, b: Bounds, within: Value = 0) -> Column:
    return F.abs(a.end - b.start) <= col(within)


def met_by(a: Bounds, b: Bounds, within: Value = 0) -> Column:
    return meets(b, a, within)


def overlaps(a: Bounds, b: Bounds, least: Value | None = None, most: Value | None = None) -> Column:
    """a starts first and they overlap, by a length from `least` to `most` if given."""
    base = (a.start < b.start) & (a.end > b.start) & (a.end < b.end)
    return base if least is None and most is None else base & _gap(a.end - b.start, least, most)


def overlapped_by(a: Bounds, b: Bounds, least: Value | None = None, most: Value | None = None) -> Column:
    return overlaps(b, a, least, most)


def starts(a: Bounds, b: Bounds, within: Value = 0) -> Column:
    return (F.abs(a.start - b.start) <= col(within)) & (a.end < b.end)


def started_by(a: Bounds, b: Bounds, within: Value = 0) -> Column:
    return starts(b, a, within)


RELATIONS = {f.__name__: f for f in (before, after, coincides, during, includes, finishes, finished_by, meets, met_by, overlaps, overlapped_by, starts, started_by)}
