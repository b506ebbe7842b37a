"""User functions of any arity, scripts and methods; vectorised in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from eddyline.functions.compare import Value, col


def function(call: Callable, kind: str, rethrow: bool = False) -> Callable[..., Column]:
    """A column function of a Python callable. An exception gives null unless it is to be rethrown."""

    def one(*args):
        try:
            return call(*(None if a is pd.NA else a for a in args))
        except Exception:
            if rethrow:
                raise
            return None

    @F.pandas_udf(kind)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([one(*row) for row in zip(*series, strict=True)], dtype=object)

    def apply(*arguments: Value) -> Column:
        return run(*map(col, arguments)) if arguments else run(F.lit(0))

    if not call.__code__.co_argcount and not call.__code__.co_flags & 4:
        inner, call = call, lambda _: inner()
    return apply


def method(value: Column, name: str, kind: str, *arguments: Value) -> Column:
    """Call a method of a Python value (text, list) by name; null if it has none."""
    return function(lambda v, *args: getattr(v, name)(*args), kind)(value, *arguments)


class Scripts:
    """Named scripts with a dialect, a result type and argument checks."""

    def __init__(self):
        self._scripts: dict[str, tuple[str, Callable, str, int | None]] = {}

    def register(self, name: str, call: Callable, kind: str, dialect: str = "python", arguments: int | None = None) -> None:
        if name in self._scripts:
            raise ValueError(f"script {name} exists")
        self._scripts[name] = (dialect, call, kind, arguments)

    def call(self, name: str, *arguments: Value) -> Column:
        if name not in self._scripts:
            raise KeyError(f"no script {name}")
        _, call, kind, n = self._scripts[name]
        if n is not None and n != len(arguments):
            raise TypeError(f"script {name} takes {n} arguments")
        return function(call, kind)(*arguments)


class Aggregates:
    """Aggregate functions of one's own: pandas functions of a group's or a frame's values."""

    def __init__(self):
        self._made: dict[str, Callable] = {}

    def register(self, name: str, call: Callable[..., object], kind: str) -> None:
        if name in self._made:
            raise ValueError(f"aggregate {name} exists")
        self._made[name] = F.pandas_udf(call, kind)

    def call(self, name: str, *arguments: Column) -> Column:
        """The aggregate; use it in `agg` or over a bounded frame."""
        return self._made[name](*arguments)


class MultiAggregates:
    """Aggregate providers with one state and several accessors: the state of a group is made once."""

    def __init__(self):
        self._made: dict[str, tuple[Callable, str]] = {}

    def register(self, provider: str, state: Callable[..., object], accessors: dict[str, tuple[str, Callable[[object], object]]]) -> None:
        """state: a function of the group's values (pandas series); accessors: name -> (type, function of the state)."""
        if provider in self._made:
            raise ValueError(f"aggregate provider {provider} exists")

        def run(*series: pd.Series) -> str:
            held = state(*series)
            return json.dumps({n: f(held) for n, (_, f) in accessors.items()}, default=lambda x: x.item() if hasattr(x, "item") else str(x))

        made = F.pandas_udf(_arity(run, state), "string")
        self._made[provider] = (made, ", ".join(f"{n} {kind}" for n, (kind, _) in accessors.items()))

    def call(self, provider: str, *arguments: Column) -> Column:
        """All accessors of a group as a struct; use it in `agg` and take its fields."""
        if provider not in self._made:
            raise KeyError(f"no aggregate provider {provider}")
        call, schema = self._made[provider]
        return F.from_json(call(*arguments), schema)


def _arity(run: Callable[..., str], like: Callable) -> Callable[..., str]:
    """`run` with as many annotated arguments as `like` has: Spark takes a grouped function's kind from them."""
    n = like.__code__.co_argcount
    if n == 1:

        def one(a: pd.Series) -> str:
            return run(a)

        return one
    if n == 2:

        def two(a: pd.Series, b: pd.Series) -> str:
            return run(a, b)

        return two
    raise TypeError("a provider's state is made from one or two columns")
