"""Dataflow graphs: operators with ports, wired by name, each a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ports = dict[str, DataFrame]


@dataclass
class Operator:
    name: str
    run: Callable[[list[DataFrame]], Ports]
    inputs: int = 1
    outputs: tuple[str, ...] = ("out",)
    properties: dict[str, Any] = field(default_factory=dict)

    def property(self, name: str, kind: type, default: Any = None) -> Any:
        """A property that is given and of the type asked for, or the default."""
        v = self.properties.get(name, default)
        if v is not None and not isinstance(v, kind):
            raise TypeError(f"{self.name}.{name} is {type(v).__name__}, not {kind.__name__}")
        return v


@dataclass(frozen=True)
class Signal:
    """What goes through a graph besides rows: the end of a source's rows, or a marker of one's own."""

    name: str = "final"
    port: str = "out"


@dataclass
class Dataflow:
    """A graph. `connect` wires an output port to the next input; a feedback edge is marked and bounded."""

    name: str
    operators: dict[str, Operator] = field(default_factory=dict)
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    feedback: list[tuple[str, str, str, int]] = field(default_factory=list)
    emitted: dict[tuple[str, str], list[DataFrame]] = field(default_factory=dict)
    _handlers: dict[str, list[Callable[[Signal], None]]] = field(default_factory=dict)

    def add(self, op: Operator) -> Dataflow:
        if op.name in self.operators:
            raise ValueError(f"operator {op.name} exists")
        self.operators[op.name] = op
        return self

    def connect(self, source: str, target: str, port: str = "out") -> Dataflow:
        for n in (source, target):
            if n not in self.operators:
                raise KeyError(f"no operator {n}")
        if port not in self.operators[source].outputs:
            raise KeyError(f"{source} has no port {port}")
        self.edges.append((source, port, target))
        return self

    def connect_feedback(self, source: str, target: str, rounds: int, port: str = "out") -> Dataflow:
        """Rows of a port return to an operator, at most so many times."""
        self.feedback.append((source, port, target, rounds))
        return self

    def emit(self, name: str, rows: DataFrame, port: str = "out") -> Dataflow:
        """Rows for a port of an emitter, added to those given before."""
        if name not in self.operators or port not in self.operators[name].outputs:
            raise KeyError(f"no port {port} of {name}")
        self.emitted.setdefault((name, port), []).append(rows)
        return self

    def on_signal(self, name: str, handler: Callable[[Signal], None]) -> Dataflow:
        if name not in self.operators:
            raise KeyError(f"no operator {name}")
        self._handlers.setdefault(name, []).append(handler)
        return self

    def submit_signal(self, source: str, signal: Signal) -> list[str]:
        """Send a signal from an operator along its edges; returns the operators it reached, in order."""
        reached = {source}
        for n in self.order():
            if any(s in reached and (s != source or p == signal.port) for s, p, t in self.edges if t == n):
                reached.add(n)
        out = [n for n in self.order() if n in reached and n != source]
        for n in out:
            for handler in self._handlers.get(n, ()):
                handler(signal)
        return out

    def finish(self) -> None:
        """The end of all rows: a final signal from every source, once for each of its ports."""
        for op in self.operators.values():
            if not op.inputs:
                for port in op.outputs:
                    self.submit_signal(op.name, Signal("final", port))

    def order(self) -> list[str]:
        done: list[str] = []
        path: list[str] = []

        def visit(n: str) -> None:
            if n in done:
                return
            if n in path:
                raise ValueError(f"{self.name} has a cycle through {n}; mark the edge as feedback")
            path.append(n)
            for s, _, t in self.edges:
                if t == n:
                    visit(s)
            path.pop()
            done.append(n)

        for n in self.operators:
            visit(n)
        return done

    def _pass(self, extra: dict[str, DataFrame]) -> dict[str, Ports]:
        made: dict[str, Ports] = {}
        for n in self.order():
            op = self.operators[n]
            inputs = [made[s][p] for s, p, t in self.edges if t == n]
            if n in extra:
                inputs = [extra[n]] if not inputs else [inputs[0].unionByName(extra[n]), *inputs[1:]]
            if len(inputs) != op.inputs:
                raise ValueError(f"{n} takes {op.inputs} inputs, {len(inputs)} are connected")
            made[n] = op.run(inputs)
            for port in op.outputs:
                for rows in self.emitted.get((n, port), ()):
                    made[n][port] = made[n][port].unionByName(rows, allowMissingColumns=True)
        return made

    def run(self) -> dict[str, Ports]:
        """The DataFrames of all ports.

        In each round every feedback edge that has rounds left returns the rows its port had in the round before;
        several edges into one operator bring the union of theirs.
        """
        made = self._pass({})
        for turn in range(max((rounds for *_, rounds in self.feedback), default=0)):
            extra: dict[str, DataFrame] = {}
            for source, port, target, rounds in self.feedback:
                if turn < rounds:
                    back = made[source][port]
                    extra[target] = extra[target].unionByName(back) if target in extra else back
            made = self._pass(extra)
        return made


def source(name: str, df: DataFrame) -> Operator:
    return Operator(name, lambda _: {"out": df}, 0)


def emitter(name: str, empty: DataFrame | dict[str, DataFrame]) -> Operator:
    """A source whose ports get their rows from `emit`; `empty` gives each port's columns."""
    ports = empty if isinstance(empty, dict) else {"out": empty}
    return Operator(name, lambda _: {p: df.limit(0) for p, df in ports.items()}, 0, tuple(ports))


def bus_source(name: str, engine: Any, event_type: str, where: Column | str | None = None, collect: Callable[[DataFrame], DataFrame] | None = None) -> Operator:
    """The events of a type from the engine's bus: filtered, then through a collector."""

    def run(_: list[DataFrame]) -> Ports:
        df = engine.source(event_type)
        df = df if where is None else df.where(where)
        return {"out": df if collect is None else collect(df)}

    return Operator(name, run, 0)


def bus_sink(name: str, engine: Any, event_type: str, collect: Callable[[DataFrame], DataFrame] | None = None) -> Operator:
    """Publishes its rows as events of a type, and passes them on."""

    def run(i: list[DataFrame]) -> Ports:
        df = i[0] if collect is None else collect(i[0])
        engine.publish(event_type, df)
        return {"out": df}

    return Operator(name, run)


def statement_source(name: str, engine: Any, statement: str | Callable[[str], bool], where: Column | str | None = None, collect: Callable[[DataFrame], DataFrame] | None = None) -> Operator:
    """The rows of a deployed statement, or of all whose names a function admits, with the name in `_statement`."""

    def run(_: list[DataFrame]) -> Ports:
        names = [statement] if isinstance(statement, str) else [n for n in engine.statements() if statement(n)]
        if not names:
            raise KeyError(f"{name}: no statement is deployed that it admits")
        parts = [engine.execute(n).withColumn("_statement", F.lit(n)) for n in names]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p, allowMissingColumns=True)
        df = df if where is None else df.where(where)
        return {"out": df if collect is None else collect(df)}

    return Operator(name, run, 0)


def filter_(name: str, condition: Column) -> Operator:
    """Ports matched and rejected; null counts as rejected."""
    ok = F.coalesce(condition, F.lit(False))
    return Operator(name, lambda i: {"matched": i[0].where(ok), "rejected": i[0].where(~ok)}, 1, ("matched", "rejected"))


def select(name: str, *columns: Column | str, keep_input: bool = False) -> Operator:
    return Operator(name, lambda i: {"out": i[0].select(*(["*"] if keep_input else []), *columns)})


def join(name: str, on: Sequence[str], how: str = "inner", inputs: int = 2) -> Operator:
    def run(i: list[DataFrame]) -> Ports:
        out = i[0]
        for other in i[1:]:
            out = out.join(other, list(on), how)
        return {"out": out}

    return Operator(name, run, inputs)


def custom(name: str, call: Callable[..., DataFrame | Ports], inputs: int = 1, outputs: Sequence[str] = ("out",)) -> Operator:
    def run(i: list[DataFrame]) -> Ports:
        made = call(*i)
        return made if isinstance(made, dict) else {"out": made}

    return Operator(name, run, inputs, tuple(outputs))


def log_sink(name: str, write: Callable[[str], None] = print, rows: int | None = None) -> Operator:
    """Writes all rows as JSON, one partition at a time, and passes them on; `rows` asks for the first ones only."""

    def run(i: list[DataFrame]) -> Ports:
        for line in (i[0] if rows is None else i[0].limit(rows)).toJSON().toLocalIterator():
            write(line)
        return {"out": i[0]}

    return Operator(name, run)
