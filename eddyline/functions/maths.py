"""Arithmetic without exceptions, exact decimals, least and greatest with nulls, bits."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_DOWN, ROUND_FLOOR, ROUND_HALF_DOWN, ROUND_HALF_EVEN, ROUND_HALF_UP, ROUND_UP, Context, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions.compare import Value, col


def add(a: Value, b: Value) -> Column:
    return F.try_add(col(a), col(b))


def subtract(a: Value, b: Value) -> Column:
    return F.try_subtract(col(a), col(b))


def multiply(a: Value, b: Value) -> Column:
    return F.try_multiply(col(a), col(b))


def divide(a: Value, b: Value) -> Column:
    """Quotient as a double; null if the divisor is zero."""
    return F.try_divide(col(a), col(b))


def divide_with(a: Value, b: Value, integer: bool = False, zero_gives_null: bool = True) -> Column:
    """Quotient by policy: integer division truncates towards zero; a zero divisor gives null or IEEE infinity."""
    x, y = col(a), col(b)
    if integer:
        return F.when(y != 0, F.call_function("div", x.cast("long"), y.cast("long")))
    if zero_gives_null:
        return divide(x, y)
    x = x.cast("double")
    infinite = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))
    return F.when(y == 0, infinite).otherwise(F.try_divide(x, y))


def modulo(a: Value, b: Value) -> Column:
    """Remainder with the sign of the dividend; null if the divisor is zero."""
    return F.try_mod(col(a), col(b))


def negate(a: Value) -> Column:
    return -col(a)


def absolute(a: Value) -> Column:
    return F.abs(col(a))


def signum(a: Value) -> Column:
    return F.signum(col(a))


def _guarded(pick, values: tuple[Value, ...]) -> Column:
    columns = [col(v) for v in values]
    present = columns[0].isNotNull()
    for c in columns[1:]:
        present &= c.isNotNull()
    return F.when(present, pick(*columns) if len(columns) > 1 else columns[0])


def min_of(*values: Value) -> Column:
    """The least value; null if any is null."""
    return _guarded(F.least, values)


def max_of(*values: Value) -> Column:
    return _guarded(F.greatest, values)


# ---- exact numbers -----------------------------------------------------------------------------------------

# The eight rounding modes by name.
ROUNDING = {
    "UP": ROUND_UP,
    "DOWN": ROUND_DOWN,
    "CEILING": ROUND_CEILING,
    "FLOOR": ROUND_FLOOR,
    "HALF_UP": ROUND_HALF_UP,
    "HALF_DOWN": ROUND_HALF_DOWN,
    "HALF_EVEN": ROUND_HALF_EVEN,
    "UNNECESSARY": None,
}


def exact(a: Value, precision: int = 38, scale: int = 10) -> Column:
    return col(a).cast(f"decimal({precision},{scale})")


def add_exact(a: Value, b: Value, scale: int = 10) -> Column:
    return F.try_add(exact(a, 37, scale), exact(b, 37, scale))


def subtract_exact(a: Value, b: Value, scale: int = 10) -> Column:
    return F.try_subtract(exact(a, 37, scale), exact(b, 37, scale))


def multiply_exact(a: Value, b: Value, scale: int = 8) -> Column:
    return F.try_multiply(exact(a, 18, scale), exact(b, 18, scale))


def divide_exact(a: Value, b: Value, scale: int = 10) -> Column:
    return F.try_divide(exact(a, 25, scale), exact(b, 25, scale))


def round_decimal(a: Value, precision: int, mode: str = "HALF_UP") -> Column:
    """Round to significant digits, as arbitrary-precision text: a vectorised Python function.

    UNNECESSARY gives null where rounding would change the value.
    """
    rounding = ROUNDING[mode]

    def one(text):
        if text is None or text != text:
            return None
        value = Decimal(text)
        out = Context(prec=precision, rounding=rounding or ROUND_DOWN).create_decimal(value)
        return None if rounding is None and out != value else format(out, "f")

    @F.pandas_udf("string")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(one)

    return rounded(col(a).cast("string"))


# ---- bits --------------------------------------------------------------------------------------------------


def bitwise_and(a: Value, b: Value) -> Column:
    return col(a).bitwiseAND(col(b))


def bitwise_or(a: Value, b: Value) -> Column:
    return col(a).bitwiseOR(col(b))


def bitwise_xor(a: Value, b: Value) -> Column:
    return col(a).bitwiseXOR(col(b))


def binary_and(a: Value, b: Value) -> Column:
    """Both conditions, evaluated without short-circuit; null if either is."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), col(a) & col(b))


def binary_or(a: Value, b: Value) -> Column:
    return F.when(col(a).isNotNull() & col(b).isNotNull(), col(a) | col(b))


def binary_xor(a: Value, b: Value) -> Column:
    return col(a) != col(b)
