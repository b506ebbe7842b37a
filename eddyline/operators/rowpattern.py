"""Row-pattern recognition: a regular expression over the rows of a key, in order.

Two forms run as window plans where definitions are columns (`plan`): variables in a row, and a variable followed by
rows of another. In all others the expression becomes a matcher that tries rows in order of preference (greedy before reluctant, alternatives in
order) and keeps its choices on a stack of its own, so long runs need no recursion. Definitions see the row, what
each variable has caught so far, and earlier rows of the key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.operators.retain import ordered

Row = dict[str, Any]
Tags = dict[str, list[Row]]


class Term:
    def one_or_more(self) -> Term:
        return Repeat(self, 1, None)

    def zero_or_more(self) -> Term:
        return Repeat(self, 0, None)

    def optional(self) -> Term:
        return Repeat(self, 0, 1)

    def repeat(self, low: int, high: int | None = None) -> Term:
        return Repeat(self, low, high)

    def reluctant(self) -> Term:
        raise TypeError("only a repetition can be reluctant")


@dataclass(frozen=True)
class Var(Term):
    name: str


@dataclass(frozen=True)
class Seq(Term):
    parts: tuple[Term, ...]


@dataclass(frozen=True)
class Alt(Term):
    options: tuple[Term, ...]


@dataclass(frozen=True)
class Repeat(Term):
    part: Term
    low: int
    high: int | None
    greedy: bool = True

    def reluctant(self) -> Term:
        return Repeat(self.part, self.low, self.high, False)


def var(name: str) -> Term:
    return Var(name)


def sequence(*parts: Term) -> Term:
    return Seq(parts)


def alternation(*options: Term) -> Term:
    return Alt(options)


def permute(*parts: Term) -> Term:
    """All orders of the parts, earlier orders preferred."""
    return Alt(tuple(Seq(p) for p in itertools.permutations(parts)))


# A compiled program: ("var", name, next), ("split", first, second), ("mark", slot), ("check", slot, next), ("end",)


class Program:
    """Instructions of a backtracking matcher."""

    def __init__(self, term: Term):
        self.code: list[tuple] = []
        self._slots = 0
        self._emit(term)
        self.code.append(("end",))

    def _emit(self, t: Term) -> None:
        code = self.code
        if isinstance(t, Var):
            code.append(("var", t.name))
        elif isinstance(t, Seq):
            for p in t.parts:
                self._emit(p)
        elif isinstance(t, Alt):
            jumps = []
            for i, p in enumerate(t.options):
                if i + 1 < len(t.options):
                    split = len(code)
                    code.append(None)
                    self._emit(p)
                    jumps.append(len(code))
                    code.append(None)
                    code[split] = ("split", split + 1, len(code))
                else:
                    self._emit(p)
            for j in jumps:
                code[j] = ("jump", len(code))
        elif isinstance(t, Repeat):
            for _ in range(t.low):
                self._emit(t.part)
            if t.high is None:
                slot, self._slots = self._slots, self._slots + 1
                top = len(code)
                code += [None, ("mark", slot)]
                self._emit(t.part)
                code += [("check", slot), ("jump", top)]
                code[top] = ("split", top + 1, len(code)) if t.greedy else ("split", len(code), top + 1)
            else:
                splits = []
                for _ in range(t.high - t.low):
                    splits.append(len(code))
                    code.append(None)
                    self._emit(t.part)
                for s in splits:
                    code[s] = ("split", s + 1, len(code)) if t.greedy else ("split", len(code), s + 1)

    def matches(self, rows: Sequence[Row], start: int, define: dict[str, Callable], limit: int | None = None) -> Iterator[tuple[int, list[tuple[str, int]]]]:
        """(end, captures) of the matches that start at a row, best first. limit: states looked at, then it stops."""
        stack: list[tuple[int, int, tuple, tuple]] = [(0, start, (), ())]
        looked = 0
        while stack:
            pc, at, caught, marks = stack.pop()
            while True:
                looked += 1
                if limit is not None and looked > limit:
                    return
                op = self.code[pc]
                if op[0] == "var":
                    if at >= len(rows):
                        break
                    test = define.get(op[1])
                    if test is not None and not test(rows[at], _Lazy(rows, caught), _Before(rows, at)):
                        break
                    caught, at, pc = (caught, op[1], at), at + 1, pc + 1
                elif op[0] == "split":
                    stack.append((op[2], at, caught, marks))
                    pc = op[1]
                elif op[0] == "jump":
                    pc = op[1]
                elif op[0] == "mark":
                    marks, pc = (marks, op[1], at), pc + 1
                elif op[0] == "check":
                    m = marks
                    while m[1] != op[1]:
                        m = m[0]
                    if m[2] == at:  # an empty round would go on for ever
                        break
                    pc += 1
                else:
                    out = []
                    c = caught
                    while c:
                        out.append((c[1], c[2]))
                        c = c[0]
                    yield at, out[::-1]
                    break


class _Lazy(dict):
    """Rows caught by each variable so far, built when asked for."""

    def __init__(self, rows, caught):
        super().__init__()
        self._rows, self._caught = rows, caught

    def __missing__(self, name):
        out, c = [], self._caught
        while c:
            if c[1] == name:
                out.append(self._rows[c[2]])
            c = c[0]
        self[name] = out[::-1]
        return self[name]


class _Before:
    """prev(n, column): a column of the n-th row before, or None."""

    def __init__(self, rows, at):
        self._rows, self._at = rows, at

    def __call__(self, n: int, column: str):
        i = self._at - n
        return self._rows[i][column] if 0 <= i < len(self._rows) else None


def recognise(rows: Sequence[Row], term: Term, define: dict[str, Callable], all_matches: bool = False, skip: str = "past_last_row", interval: int | None = None, most_states: int | None = None) -> list[tuple[int | None, Tags]]:
    """Matches over the rows of one key, with the instant each is emitted (the last row's, or start + interval).

    skip: past_last_row, to_next_row or to_current_row (overlapping matches from every row, all of them if
    `all_matches`). With an interval a match ends before start + interval.
    """
    program = Program(term)
    out: list[tuple[int | None, Tags]] = []
    start = 0
    while start < len(rows):
        bound = rows
        if interval is not None:
            end_at = rows[start]["_ts"] + interval
            n = start
            while n < len(rows) and rows[n]["_ts"] < end_at:
                n += 1
            bound = rows[:n]
        last = None
        for end, caught in program.matches(bound, start, define, most_states):
            if end == start:
                continue
            tags: Tags = {}
            for name, i in caught:
                tags.setdefault(name, []).append(rows[i])
            out.append((rows[start]["_ts"] + interval if interval is not None else rows[end - 1].get("_ts"), tags))
            last = end if last is None else last
            if not all_matches:
                break
        start = last if last is not None and skip == "past_last_row" else start + 1
    return out


def match_recognize(df: DataFrame, term: Term, by: Sequence[str], define: dict[str, Callable | Column], measures: dict[str, tuple[str, Callable[[Tags], Any]]], **options) -> DataFrame:
    """Row-pattern matches of each key: its columns, `_at` and the measures (name: (type, function of the caught rows)).

    define: a variable's condition, as a function of (row, caught so far, prev) or as a column, which may look at
    earlier rows of the key with `prev`.
    """
    made = plan(df, term, by, define, measures, **options)
    if made is not None:
        return made
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "_at long", *(f"{n} {k}" for n, (k, _) in measures.items())])
    flags = {v: f"_is{i}" for i, (v, c) in enumerate(define.items()) if isinstance(c, Column | Shifted)}
    df = df.withColumns({n: F.coalesce(over(define[v], by), F.lit(False)) for v, n in flags.items()}) if flags else df
    tests = {v: (lambda row, tags, before, n=flags[v]: bool(row[n])) if v in flags else c for v, c in define.items()}

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["_ts", "_seq"]).to_dict("records")
        made = [(*key[: len(by)], at, *(f(tags) for _, f in measures.values())) for at, tags in recognise(rows, term, tests, **options)]
        return pd.DataFrame(made, columns=[*by, "_at", *measures])

    return df.groupBy(*(list(by) or [F.lit("all")])).applyInPandas(fold, schema)


@dataclass(frozen=True)
class Shifted:
    """A condition that compares a row with earlier ones of its key: a function of prev(column, n)."""

    make: Callable[[Callable[..., Column]], Column]


def over(condition: Column | Shifted, by: Sequence[str]) -> Column:
    return condition.make(lambda column, n=1: F.lag(column, n).over(ordered(by))) if isinstance(condition, Shifted) else condition


def plan(df: DataFrame, term: Term, by: Sequence[str], define: dict[str, Any], measures: dict[str, tuple[str, Any]], skip: str = "past_last_row", **options) -> DataFrame | None:
    """The matches as a window plan, or None. Conditions must be columns, measures those of this module.

    Forms: variables in a row, skipping to the next row; A B{low,} with A free, skipping past the last row: a run of
    rows that meet B, with the row before it.
    """
    if options or not all(isinstance(c, Column | Shifted) for c in define.values()) or not all(isinstance(f, Measure) for _, f in measures.values()):
        return None
    if not isinstance(term, Seq):
        return None
    meets = {v: F.coalesce(over(c, by), F.lit(False)) for v, c in define.items()}
    if skip == "to_next_row" and all(isinstance(p, Var) for p in term.parts) and len({p.name for p in term.parts}) == len(term.parts):
        flags = df.withColumns({f"_is_{v}": c for v, c in meets.items()})
        w = ordered(by)
        n = len(term.parts)
        ok = F.lead(F.lit(True), n - 1, False).over(w)
        for k, p in enumerate(term.parts):
            if p.name in meets:
                ok &= F.coalesce(F.lead(f"_is_{p.name}", k).over(w), F.lit(False))
        places = {p.name: k for k, p in enumerate(term.parts)}
        values = {}
        for name, (kind, m) in measures.items():
            if m.kind == "size":
                values[name] = F.lit(n).cast(kind)
            elif m.kind == "count":
                values[name] = F.lit(int(m.tag in places)).cast(kind)
            elif m.tag not in places:
                values[name] = F.lit(None).cast(kind)
            else:
                values[name] = F.lead(m.column, places[m.tag]).over(w).cast(kind)
        found = flags.select(*by, F.lead("_ts", n - 1).over(w).alias("_at"), ok.alias("_ok"), *(c.alias(x) for x, c in values.items()))
        return found.where("_ok").drop("_ok")
    if skip == "past_last_row" and len(term.parts) == 2 and isinstance(term.parts[0], Var) and isinstance(term.parts[1], Repeat):
        a, many = term.parts
        b = many.part
        if not (isinstance(b, Var) and many.high is None and many.greedy and many.low > 0 and a.name not in define and b.name in meets and a.name != b.name):
            return None
        w = ordered(by)
        runs = df.withColumn("_is", meets[b.name]).withColumn("_run", F.sum(F.when(F.col("_is"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        # rows that meet B before any that does not: the first of them is A
        start = F.row_number().over(Window.partitionBy(*by, "_run").orderBy("_ts", "_seq")) == 1
        runs = runs.withColumn("_a", start)
        at = F.struct("_ts", "_seq")
        pick = {"first": F.min_by, "last": F.max_by, "total": lambda x, _: F.sum(x), "least": lambda x, _: F.min(x), "greatest": lambda x, _: F.max(x)}
        values = []
        for name, (kind, m) in measures.items():
            mine = {a.name: F.col("_a"), b.name: ~F.col("_a")}.get(m.tag, F.lit(False))
            if m.kind in ("size", "count"):
                c = F.count("*") if m.kind == "size" else F.count(F.when(mine, 1))
            else:
                c = pick[m.kind](F.when(mine, F.col(m.column)) if m.kind not in ("first", "last") else F.col(m.column), F.when(mine, at))
            values.append(c.cast(kind).alias(name))
        found = runs.groupBy(*by, "_run").agg(F.count("*").alias("_rows"), F.max("_ts").alias("_at"), *values)
        return found.where(F.col("_rows") > many.low).drop("_run", "_rows")
    return None


# Measures over caught rows.


@dataclass(frozen=True)
class Measure:
    """A function of the caught rows that a plan can state as well."""

    kind: str
    tag: str | None = None
    column: str | None = None

    def __call__(self, tags: Tags) -> Any:
        if self.kind == "size":
            return sum(map(len, tags.values()))
        rows = tags.get(self.tag, [])
        if self.kind == "count":
            return len(rows)
        values = [r[self.column] for r in rows]
        if not values:
            return None
        return {"first": lambda v: v[0], "last": lambda v: v[-1], "total": sum, "least": min, "greatest": max}[self.kind](values)


def first(tag: str, column: str) -> Measure:
    return Measure("first", tag, column)


def last(tag: str, column: str) -> Measure:
    return Measure("last", tag, column)


def count(tag: str) -> Measure:
    return Measure("count", tag)


def size() -> Measure:
    """All rows of the match."""
    return Measure("size")


def total(tag: str, column: str) -> Measure:
    return Measure("total", tag, column)


def least(tag: str, column: str) -> Measure:
    return Measure("least", tag, column)


def greatest(tag: str, column: str) -> Measure:
    return Measure("greatest", tag, column)


def any_of(tag: str, condition: Callable[[Row], bool]) -> Callable[[Tags], bool]:
    return lambda t: any(condition(r) for r in t.get(tag, ()))
