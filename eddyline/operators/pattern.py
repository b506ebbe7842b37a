"""Event-sequence patterns.

Two ways to run one: forms that a window or an aggregation can state run as DataFrame plans (`plan`,
`every_followed_by`, `absent_within`); all others run as state machines over a key's events in order. `match` takes
the first way where predicates and selected values are columns and the form has a plan.

Nodes are declared as a tree; running it, each becomes a state that reports to its parent: `true` with the captured
events and whether it is finished, or `false` for good. The clock moves to an event's time before the event, so a
guard that ends at that instant has ended. An event reaches the leaves that were listening before it came.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Event = dict[str, Any]
Match = dict[str, Any]

# ---- declaration -------------------------------------------------------------------------------------------


class Node:
    def every(self) -> Node:
        return Every(self)

    def then(self, other: Node, at_most: int | None = None) -> Node:
        return Sequence_((self, other), at_most)

    def and_(self, other: Node) -> Node:
        return And((self, other))

    def or_(self, other: Node) -> Node:
        return Or((self, other))

    def not_(self) -> Node:
        return Not(self)

    def within(self, us: int, at_most: int | None = None) -> Node:
        return Within(self, us, at_most)

    def while_(self, condition: Callable[[Match], bool]) -> Node:
        return While(self, condition)

    def until(self, end: Node | None = None, low: int = 0, high: int | None = None) -> Node:
        return Until(self, end, low, high)

    def every_distinct(self, key: Callable[[Match], Any], us: int | None = None) -> Node:
        return EveryDistinct(self, key, us)

    def start(self, parent: State, match: Match, run: Run) -> State:
        raise NotImplementedError


@dataclass(frozen=True)
class Atom(Node):
    """An event that meets a predicate, captured under a tag: a column, or a function of (event, captured so far)."""

    tag: str
    predicate: Callable[[Event, Match], bool] | Column
    consume: int | None = None

    def start(self, parent, match, run):
        return _Atom(self, parent, match, run)


@dataclass(frozen=True)
class Every(Node):
    child: Node

    def start(self, parent, match, run):
        return _Every(self, parent, match, run)


@dataclass(frozen=True)
class EveryDistinct(Node):
    child: Node
    key: Callable[[Match], Any] | Column
    us: int | None

    def start(self, parent, match, run):
        return _Every(self, parent, match, run)


@dataclass(frozen=True)
class Sequence_(Node):
    children: tuple[Node, ...]
    at_most: int | None = None

    def start(self, parent, match, run):
        return _Sequence(self, parent, match, run)


@dataclass(frozen=True)
class And(Node):
    children: tuple[Node, ...]

    def start(self, parent, match, run):
        return _And(self, parent, match, run)


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]

    def start(self, parent, match, run):
        return _Or(self, parent, match, run)


@dataclass(frozen=True)
class Not(Node):
    child: Node

    def start(self, parent, match, run):
        return _Not(self, parent, match, run)


@dataclass(frozen=True)
class Within(Node):
    child: Node
    us: int
    at_most: int | None = None

    def start(self, parent, match, run):
        return _Within(self, parent, match, run)


@dataclass(frozen=True)
class While(Node):
    child: Node
    condition: Callable[[Match], bool]

    def start(self, parent, match, run):
        return _While(self, parent, match, run)


@dataclass(frozen=True)
class Until(Node):
    """low to high repetitions, up to an end pattern; each tag of the child holds a list."""

    child: Node
    end: Node | None
    low: int
    high: int | None

    def start(self, parent, match, run):
        return _Until(self, parent, match, run)


@dataclass(frozen=True)
class Timer(Node):
    """Fires d after it starts to listen."""

    us: int

    def start(self, parent, match, run):
        return _Timer(self, parent, match, run, run.now + self.us)


@dataclass(frozen=True)
class TimerAt(Node):
    """Fires at the next of the instants (microseconds, in order), once for each if under `every`."""

    instants: tuple[int, ...]

    def start(self, parent, match, run):
        return _Timer(self, parent, match, run, next((t for t in self.instants if t > run.now), None))


def atom(tag: str, predicate: Callable[..., bool] | Column = lambda e, m: True, consume: int | None = None) -> Node:
    return Atom(tag, predicate, consume)


# ---- execution ---------------------------------------------------------------------------------------------


class State:
    """A running node."""

    def __init__(self, node: Node, parent: State | None, match: Match, run: Run):
        self.node, self.parent, self.match, self.run, self.alive = node, parent, match, run, True
        if not run.enter(self):
            self.alive = False

    def begin(self) -> None:
        raise NotImplementedError

    def quit(self) -> None:
        if self.alive:
            self.alive = False
            self.run.leave(self)
            for c in self.kids():
                c.quit()

    def kids(self) -> Iterator[State]:
        return iter(())

    def spawn(self, node: Node, match: Match) -> State:
        return node.start(self, match, self.run)

    def true(self, child: State, match: Match, done: bool) -> None:
        raise NotImplementedError

    def false(self, child: State) -> None:
        raise NotImplementedError

    def tell_true(self, match: Match, done: bool) -> None:
        if done:
            self.quit()
        self.parent.true(self, match, done)

    def tell_false(self) -> None:
        self.quit()
        self.parent.false(self)


class _Atom(State):
    def begin(self):
        self.run.listening[id(self)] = self

    def quit(self):
        self.run.listening.pop(id(self), None)
        super().quit()

    def event(self, e: Event) -> None:
        self.tell_true({**self.match, self.node.tag: e}, True)


class _Timer(State):
    def __init__(self, node, parent, match, run, due):
        super().__init__(node, parent, match, run)
        self.due = due

    def begin(self):
        if self.due is not None:
            if self.due <= self.run.now:
                self.tell_true(self.match, True)
            else:
                self.run.schedule(self.due, self)

    def time(self) -> None:
        self.tell_true(self.match, True)


class _Every(State):
    def begin(self):
        self.children: list[State] = []
        self.seen: dict[Any, int] = {}
        self.starting = False
        self._again()

    def kids(self):
        return iter(self.children)

    def _again(self):
        if self.starting:  # a child that is true at once, such as an absence, would start others for ever
            return
        child = self.spawn(self.node.child, self.match)
        if child.alive:
            self.children.append(child)
            self.starting = True
            child.begin()
            self.starting = False

    def true(self, child, match, done):
        if done:
            self.children = [c for c in self.children if c is not child]
        self._again()
        if isinstance(self.node, EveryDistinct):
            key, now = self.node.key(match), self.run.now
            last = self.seen.get(key)
            if last is not None and (self.node.us is None or now - last < self.node.us):
                return
            self.seen[key] = now
        if self.alive:
            self.parent.true(self, match, False)

    def false(self, child):
        self.children = [c for c in self.children if c is not child]
        self._again()


class _Sequence(State):
    def begin(self):
        self.active: dict[int, tuple[int, State]] = {}
        self._go(0, self.match)

    def kids(self):
        return (s for _, s in list(self.active.values()))

    def _go(self, i, match):
        if i and self.node.at_most is not None and sum(k == i for k, _ in self.active.values()) >= self.node.at_most:
            return
        child = self.spawn(self.node.children[i], match)
        if child.alive:
            self.active[id(child)] = (i, child)
            child.begin()

    def true(self, child, match, done):
        if id(child) not in self.active:
            return
        i, _ = self.active[id(child)]
        if done:
            del self.active[id(child)]
        if i + 1 < len(self.node.children):
            self._go(i + 1, match)
        else:
            self.tell_true(match, not self.active)

    def false(self, child):
        self.active.pop(id(child), None)
        if not self.active and self.alive:
            self.tell_false()


class _And(State):
    def begin(self):
        self.children = [self.spawn(c, self.match) for c in self.node.children]
        self.found: list[list[Match]] = [[] for _ in self.children]
        self.open = set(range(len(self.children)))
        for c in list(self.children):
            if self.alive:
                c.begin()

    def kids(self):
        return iter(self.children)

    def true(self, child, match, done):
        i = self.children.index(child)
        if done:
            self.open.discard(i)
        own = [match]
        others = [f for k, f in enumerate(self.found) if k != i]
        if isinstance(self.node.children[i], Not):
            self.found[i] = own
        else:
            self.found[i].append(match)
        if all(others):
            finished = not any(k for k in self.open if not isinstance(self.node.children[k], Not))
            combined = [dict(itertools.chain.from_iterable(m.items() for m in [*ms, own[0]])) for ms in itertools.product(*others)]
            if finished:
                self.quit()
            for m in combined:
                self.parent.true(self, m, finished)

    def false(self, child):
        if self.alive:
            if isinstance(child.node, Not) or not self.found[self.children.index(child)]:
                self.tell_false()


class _Or(State):
    def begin(self):
        self.children = [self.spawn(c, self.match) for c in self.node.children]
        for c in list(self.children):
            if self.alive:
                c.begin()

    def kids(self):
        return iter(self.children)

    def true(self, child, match, done):
        if self.alive:
            self.tell_true(match, done)

    def false(self, child):
        self.children = [c for c in self.children if c is not child]
        if not self.children and self.alive:
            self.tell_false()


class _Not(State):
    def begin(self):
        self.child = self.spawn(self.node.child, self.match)
        self.child.begin()
        if self.alive:
            self.parent.true(self, self.match, False)

    def kids(self):
        return iter((self.child,)) if hasattr(self, "child") else iter(())

    def true(self, child, match, done):
        if done and self.alive:
            self.tell_false()

    def false(self, child):
        pass


class _Guard(State):
    def begin(self):
        self.child = self.spawn(self.node.child, self.match)
        self.child.begin()

    def kids(self):
        return iter((self.child,)) if hasattr(self, "child") else iter(())

    def true(self, child, match, done):
        if self.alive:
            self.tell_true(match, done)

    def false(self, child):
        if self.alive:
            self.tell_false()


class _Within(_Guard):
    def begin(self):
        self.count = 0
        self.run.schedule(self.run.now + self.node.us, self)
        super().begin()

    def time(self):
        self.tell_false()

    def true(self, child, match, done):
        if not self.alive:
            return
        self.count += 1
        if self.node.at_most is not None and self.count > self.node.at_most:
            self.tell_false()
        else:
            self.tell_true(match, done)


class _While(_Guard):
    def true(self, child, match, done):
        if not self.alive:
            return
        if self.node.condition(match):
            self.tell_true(match, done)
        else:
            self.tell_false()


class _Until(State):
    def begin(self):
        self.caught: list[Match] = []
        self.end = self.spawn(self.node.end, self.match) if self.node.end else None
        self.child = None
        self._next()
        if self.end and self.alive:
            self.end.begin()

    def kids(self):
        return (s for s in (self.child, self.end) if s)

    def _next(self):
        self.child = self.spawn(self.node.child, self.match)
        self.child.begin()

    def _all(self, match):
        out = dict(match)
        for m in self.caught:
            for k, v in m.items():
                if k not in self.match:
                    out.setdefault(k, [])
                    out[k] = [*out[k], v]
        return out

    def true(self, child, match, done):
        if not self.alive:
            return
        if child is self.end:
            if len(self.caught) >= self.node.low:
                self.tell_true(self._all(match), True)
            else:
                self.tell_false()
            return
        self.caught.append(match)
        if self.node.high is not None and len(self.caught) >= self.node.high:
            if self.end is None or self.node.high == self.node.low:
                self.tell_true(self._all(self.match), True)
                return
            child.quit()
            self.child = None
        elif done:
            self._next()

    def false(self, child):
        if child is self.child:
            self.child = None


class _Root(State):
    def __init__(self, run):
        self.run, self.alive, self.parent, self.node = run, True, None, None

    def true(self, child, match, done):
        self.run.found.append(match)

    def false(self, child):
        pass


@dataclass
class Run:
    """One pattern over one sequence of events."""

    node: Node
    most_states: int | None = None
    discard_partials: bool = False
    suppress_overlaps: bool = False
    now: int = 0
    states: int = 0
    refused: int = 0
    found: list[Match] = field(default_factory=list)
    listening: dict[int, _Atom] = field(default_factory=dict)
    due: list[tuple[int, int, State]] = field(default_factory=list)
    _order: Iterator[int] = field(default_factory=itertools.count)

    def begin(self, at: int) -> None:
        self.now = at
        root = self.node.start(_Root(self), {}, self)
        root.begin()

    def enter(self, state: State) -> bool:
        if self.most_states is not None and self.states >= self.most_states:
            self.refused += 1
            return False
        self.states += 1
        return True

    def leave(self, state: State) -> None:
        self.states -= 1

    def schedule(self, at: int, state: State) -> None:
        heapq.heappush(self.due, (at, next(self._order), state))

    def advance(self, to: int) -> Iterator[tuple[int, list[Match]]]:
        """Move the clock; yields the matches that timers make, with their instants."""
        while self.due and self.due[0][0] <= to:
            at, _, state = heapq.heappop(self.due)
            self.now = at
            if state.alive:
                state.time()
            if self.found:
                yield at, self.taken()
        self.now = to

    def send(self, e: Event) -> list[Match]:
        heard = [s for s in list(self.listening.values()) if s.node.predicate(e, s.match)]
        levels = [s.node.consume for s in heard if s.node.consume is not None]
        if levels:
            heard = [s for s in heard if s.node.consume == max(levels)]
        for s in heard:
            if s.alive:
                s.event(e)
        return self.taken()

    def taken(self) -> list[Match]:
        out, self.found = self.found, []
        if self.suppress_overlaps:
            kept, used = [], set()
            for m in out:
                own = {id(v) for v in m.values() if isinstance(v, dict)}
                if not own & used:
                    kept.append(m)
                    used |= own
            out = kept
        if out and self.discard_partials:
            self.listening.clear()
            self.due.clear()
            self.states = 0
            self.begin(self.now)
        return out


def run_pattern(node: Node, events: Sequence[Event], start: int | None = None, end: int | None = None, **options) -> list[tuple[int, Match]]:
    """All matches with their instants over events in order (dicts with `_ts`); the reference form for tests."""
    run, out = Run(node, **options), []
    run.begin(start if start is not None else events[0]["_ts"] if events else 0)
    for e in events:
        for at, ms in run.advance(e["_ts"]):
            out += [(at, m) for m in ms]
        out += [(e["_ts"], m) for m in run.send(e)]
    if end is not None:
        for at, ms in run.advance(end):
            out += [(at, m) for m in ms]
    return out


def match(df: DataFrame, node: Node, by: Sequence[str], select: dict[str, tuple[str, Callable[[Match], Any]] | Column], end: int | None = None, **options) -> DataFrame:
    """Matches of each key: its `by` columns, `_at` and the selected columns.

    select: name -> (type, function of the match), or columns over the tags' structs, for forms that have a plan.
    """
    if any(isinstance(c, Column) for c in select.values()):
        made = plan(df, node, by) if not options and end is None else None
        if made is None:
            raise TypeError("columns can be selected only from a pattern that has a plan")
        return made.select(*by, "_at", *(c.alias(n) for n, c in select.items()))
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{b} {fields[b]}" for b in by), "_at long", *(f"{n} {kind}" for n, (kind, _) in select.items())])
    names = [*by, "_at", *select]
    df, node = evaluated(df, node)

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        events = pdf.sort_values(["_ts", "_seq"]).to_dict("records")
        rows = [(*key[: len(by)], at, *(pick(m) for _, pick in select.values())) for at, m in run_pattern(node, events, end=end, **options)]
        return pd.DataFrame(rows, columns=names)

    return df.groupBy(*(list(by) or [F.lit("all")])).applyInPandas(fold, schema)


def evaluated(df: DataFrame, node: Node) -> tuple[DataFrame, Node]:
    """The events with a flag for each predicate that is a column, and the pattern over those flags."""
    made: dict[str, Column] = {}

    def walk(n: Any) -> Any:
        if isinstance(n, Atom):
            if not isinstance(n.predicate, Column):
                return n
            name = f"_meets{len(made)}"
            made[name] = F.coalesce(n.predicate, F.lit(False))
            return replace(n, predicate=lambda e, m: bool(e[name]))
        if isinstance(n, tuple):
            return tuple(map(walk, n))
        if not isinstance(n, Node):
            return n
        changed = {f: walk(getattr(n, f)) for f in ("child", "children", "end") if hasattr(n, f)}
        return replace(n, **changed) if changed else n

    node = walk(node)
    return df.withColumns(made) if made else df, node


# ---- forms that are plans ----------------------------------------------------------------------------------


def _plain(*nodes: Node | None) -> bool:
    return all(isinstance(n, Atom) and isinstance(n.predicate, Column) and n.consume is None for n in nodes)


def _met(n: Atom) -> Column:
    return F.coalesce(n.predicate, F.lit(False))


def plan(df: DataFrame, node: Node, by: Sequence[str]) -> DataFrame | None:
    """The matches as a plan: `by`, `_at` and for each tag its event as a struct; None if the form has none.

    Forms, over atoms whose predicates are columns: a and b; a or b; every a -> b (within d); every distinct a; a
    until b (the tag of a is a list); low repetitions at least. All but every a -> b match once a key, or once a
    distinct value, and are aggregations with partial results before the shuffle.
    """
    event = F.struct("_ts", "_seq", *(c for c in df.columns if c not in ("_ts", "_seq")))
    at = F.struct("_ts", "_seq")
    first = lambda ok: F.min_by(event, F.when(ok, at))  # noqa: E731  null where none is
    if isinstance(node, And) and _plain(*node.children):
        tags = [n.tag for n in node.children]
        found = df.groupBy(*by).agg(*(F.when(F.max(_met(n)), first(_met(n))).alias(n.tag) for n in node.children))
        for t in tags:
            found = found.where(F.col(t).isNotNull())
        return found.withColumn("_at", F.greatest(*(F.col(f"{t}._ts") for t in tags)) if len(tags) > 1 else F.col(f"{tags[0]}._ts"))
    if isinstance(node, Or) and _plain(*node.children):
        any_ = reduce(lambda a, b: a | b, map(_met, node.children))
        which = F.coalesce(*(F.when(_met(n), F.lit(i)) for i, n in enumerate(node.children)))
        found = df.where(any_).groupBy(*by).agg(F.min_by(event, at).alias("_event"), F.min_by(which, at).alias("_which"))
        return found.select(*by, F.col("_event._ts").alias("_at"), *(F.when(F.col("_which") == i, F.col("_event")).alias(n.tag) for i, n in enumerate(node.children)))
    if isinstance(node, EveryDistinct) and _plain(node.child) and isinstance(node.key, Column) and node.us is None:
        found = df.where(_met(node.child)).groupBy(*by, node.key.alias("_key")).agg(F.min_by(event, at).alias(node.child.tag))
        return found.withColumn("_at", F.col(f"{node.child.tag}._ts")).drop("_key")
    if isinstance(node, Until) and node.end is not None and _plain(node.child, node.end) and node.high is None:
        a, b = node.child, node.end
        stop = F.min(F.when(_met(b), at)).over(Window.partitionBy(*by))
        upto = df.withColumn("_stop", stop).where(at <= F.col("_stop"))
        caught = F.transform(F.array_sort(F.collect_list(F.when(_met(a), F.struct(at.alias("k"), event.alias("e"))))), lambda x: x["e"])
        found = upto.groupBy(*by).agg(caught.alias(a.tag), F.max_by(event, at).alias(b.tag)).where(F.size(a.tag) >= node.low)
        return found.withColumn("_at", F.col(f"{b.tag}._ts"))
    if isinstance(node, Sequence_) and len(node.children) == 2 and node.at_most is None and isinstance(node.children[0], Every):
        a, b = node.children[0].child, node.children[1]
        us = None
        if isinstance(b, Within) and b.at_most is None:
            b, us = b.child, b.us
        if _plain(a, b):
            found = every_followed_by(df, _met(a), _met(b), by, [c for c in df.columns if c not in ("_ts", "_seq", *by)], us)
            return found.select(*by, F.col("b._ts").alias("_at"), F.col("a").alias(a.tag), F.col("b").alias(b.tag))
    return None


def every_followed_by(df: DataFrame, a: Column, b: Column, by: Sequence[str], columns: Sequence[str], within: int | None = None) -> DataFrame:
    """every A -> B: each A with the first B after it, within d if given. One window over each key, no join."""
    w = Window.partitionBy(*by).orderBy(F.desc("_ts"), F.desc("_seq")).rowsBetween(Window.unboundedPreceding, -1)  # latest first: a frame to the end is computed anew for each row
    row = F.struct("_ts", "_seq", *columns)
    found = df.withColumn("b", F.last(F.when(b, row), ignorenulls=True).over(w)).where(a & F.col("b").isNotNull())
    if within is not None:
        found = found.where(F.col("b._ts") < F.col("_ts") + within)
    return found.select(*by, row.alias("a"), "b")


def absent_within(df: DataFrame, a: Column, b: Column, by: Sequence[str], columns: Sequence[str], us: int) -> DataFrame:
    """every A -> (timer d and not B): each A after which no B comes for d; fires at A + d."""
    w = Window.partitionBy(*by).orderBy(F.desc("_ts"), F.desc("_seq")).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.min(F.when(b, F.col("_ts"))).over(w)
    quiet = df.withColumn("_b", nxt).where(a & (F.col("_b").isNull() | (F.col("_b") >= F.col("_ts") + us)))
    return quiet.select(*by, F.struct("_ts", "_seq", *columns).alias("a"), (F.col("_ts") + us).alias("_at"))
