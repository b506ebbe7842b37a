"""Date-time functions. Values are timestamps; the session time zone is the calendar's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions.compare import Value, between, col

#: field name -> column of a timestamp. get('month') counts from 0, day_of_week from Sunday = 1, week is ISO.
FIELDS = {
    "year": F.year,
    "month": lambda t: F.month(t) - 1,
    "day": F.dayofmonth,
    "day_of_month": F.dayofmonth,
    "day_of_week": F.dayofweek,
    "day_of_year": F.dayofyear,
    "hour": F.hour,
    "minute": F.minute,
    "second": lambda t: F.second(t),
    "millisecond": lambda t: F.pmod(F.unix_millis(t.cast("timestamp")), F.lit(1000)).cast("int"),
    "week": F.weekofyear,
}
UNITS = {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "second": "second", "millisecond": "millisecond"}


def get(value: Column, field: str) -> Column:
    return FIELDS[field](value).cast("long")


def year(value: Column) -> Column:
    return F.year(value)


def month(value: Column) -> Column:
    """Month of the year from 1."""
    return F.month(value)


def day_of_month(value: Column) -> Column:
    return F.dayofmonth(value)


def millis(n: Value) -> Column:
    return F.make_dt_interval(secs=col(n).cast("decimal(18,6)") / F.lit(1000))


def plus(value: Column, ms: Value) -> Column:
    return value + millis(ms)


def minus(value: Column, ms: Value) -> Column:
    return value - millis(ms)


def duration(days: Value = 0, hours: Value = 0, minutes: Value = 0, seconds: Value = 0, milliseconds: Value = 0) -> Column:
    """A duration from its parts, summed."""
    secs = col(seconds).cast("decimal(18,6)") + (col(milliseconds).cast("decimal(18,6)") / F.lit(1000))
    return F.make_dt_interval(col(days), col(hours), col(minutes), secs.cast("decimal(18,6)"))


def plus_duration(value: Column, length: Column) -> Column:
    return value + length


def minus_duration(value: Column, length: Column) -> Column:
    return value - length


def _shift(value: Column, unit: str, n: Column) -> Column:
    if unit == "millisecond":
        return plus(value, n)
    return F.timestamp_add(unit.upper(), n.cast("int"), value)


def set_field(value: Column, field: str, n: Value) -> Column:
    """Set a calendar field; values beyond its range carry over. Months count from 1."""
    now = F.month(value) if field == "month" else get(value, "day" if field == "day_of_month" else field)
    return _shift(value, "day" if field == "day_of_month" else UNITS[field], col(n) - now)


def with_date(value: Column, y: Value, m: Value, d: Value) -> Column:
    return set_field(set_field(set_field(set_field(value, "day", 1), "year", y), "month", m), "day", d)


def with_time(value: Column, h: Value, m: Value, s: Value, ms: Value) -> Column:
    out = value
    for field, n in (("hour", h), ("minute", m), ("second", s), ("millisecond", ms)):
        out = set_field(out, field, n)
    return out


def with_min(value: Column, field: str) -> Column:
    """The field at its least value: 1 for months and days, else 0."""
    return set_field(value, field, 1 if field in ("month", "day", "day_of_month") else 0)


# The largest value of each field whose range does not depend on the date.
LARGEST = {"month": 12, "hour": 23, "minute": 59, "second": 59, "millisecond": 999}


def with_max(value: Column, field: str) -> Column:
    return set_field(value, field, LARGEST[field] if field in LARGEST else F.dayofmonth(F.last_day(value)))


def round_floor(value: Column, unit: str) -> Column:
    return F.date_trunc(unit, value)


def round_ceiling(value: Column, unit: str) -> Column:
    """The next boundary; a value on a boundary advances as well."""
    return _shift(F.date_trunc(unit, value), unit, F.lit(1))


#: unit -> the field below it and where its upper half starts.
_HALVES = {"year": ("month", 6), "day": ("hour", 12), "hour": ("minute", 30), "minute": ("second", 30), "second": ("millisecond", 500)}


def round_half(value: Column, unit: str) -> Column:
    """To the nearer boundary, half a unit and more upwards; a month is halved by its own length."""
    if unit == "month":
        upper = (F.dayofmonth(value) - 1) * 2 >= F.dayofmonth(F.last_day(value))
    else:
        field, half = _HALVES[unit]
        upper = get(value, field) >= half
    return F.when(upper, round_ceiling(value, unit)).otherwise(round_floor(value, unit))


def to_millis(value: Column) -> Column:
    return F.unix_millis(value.cast("timestamp"))


def to_time(ms: Value) -> Column:
    return F.timestamp_millis(col(ms))


def format_pattern(value: Column, pattern: str) -> Column:
    return F.date_format(value, pattern)


def format_iso(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def format_iso_zoned(value: Column) -> Column:
    return F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")


def format_default(value: Column) -> Column:
    return F.date_format(value.cast("timestamp"), "EEE MMM dd HH:mm:ss zzz yyyy")


def format_date(value: Column) -> Column:
    return F.date_format(value, "MMM d, yyyy")


def datetime_between(value: Column, lower: Value, upper: Value, lower_inclusive: bool = True, upper_inclusive: bool = True) -> Column:
    return between(value, lower, upper, lower_inclusive, upper_inclusive)


def before(value: Column, bound: Value) -> Column:
    return value < col(bound)


def after(value: Column, bound: Value) -> Column:
    return value > col(bound)


class Plugins:
    """Date-time methods of one's own, by name: functions of a timestamp column and further columns."""

    def __init__(self):
        self._methods: dict[str, object] = {}

    def register(self, name: str, method) -> None:
        if name in self._methods:
            raise ValueError(f"date-time method {name} exists")
        self._methods[name] = method

    def call(self, name: str, value: Column, *arguments: Value) -> Column:
        return self._methods[name](value, *map(col, arguments))
