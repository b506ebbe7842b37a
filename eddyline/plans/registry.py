"""Event types and names: schemas in seven representations, inheritance, variants, variables, modules, deployments."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPRESENTATIONS = ("struct", "map", "object_array", "json", "avro", "xml", "variant")


@dataclass(frozen=True)
class EventType:
    name: str
    schema: T.StructType
    representation: str = "struct"
    parents: tuple[str, ...] = ()
    dynamic: bool = False
    members: tuple[str, ...] = ()
    getters: tuple[tuple[str, Any], ...] = ()
    adapters: tuple[tuple[str, Callable[[Column], Column]], ...] = ()
    defaults: tuple[tuple[str, Any], ...] = ()
    ignore_case: bool = False


class Registry:
    """Types by name. Fields of parents come first; a field may not change its type."""

    def __init__(self):
        self.types: dict[str, EventType] = {}

    def register(self, name: str, schema: T.StructType | str, representation: str = "struct", parents: Sequence[str] = (), copied_from: Sequence[str] = (), dynamic: bool = False, getters: dict[str, Column | str] | None = None, adapters: dict[str, Callable[[Column], Column]] | None = None, defaults: dict[str, Any] | None = None, ignore_case: bool = False) -> EventType:
        """getters: properties that an expression or a path makes; adapters: how a field's text becomes its value;
        defaults: values of fields that are null; ignore_case: fields may be written in either case."""
        if name in self.types:
            raise ValueError(f"event type {name} exists")
        if representation not in REPRESENTATIONS:
            raise ValueError(f"no representation {representation}")
        own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        fields: dict[str, T.StructField] = {}
        for source in (*(self.get(p).schema for p in (*parents, *copied_from)), own):
            for f in source.fields:
                if f.name in fields and fields[f.name].dataType != f.dataType:
                    raise TypeError(f"{name}.{f.name}: {fields[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
                fields[f.name] = f
        made = self.types[name] = EventType(name, T.StructType(list(fields.values())), representation, tuple(parents), dynamic, (), tuple((getters or {}).items()), tuple((adapters or {}).items()), tuple((defaults or {}).items()), ignore_case)
        return made

    def auto_name(self, df: DataFrame, name: str | None = None) -> EventType:
        """The type of a frame's columns: one that has them already, else a new one named after them (or `name`)."""
        schema = T.StructType([f for f in df.schema.fields if not f.name.startswith("_")])
        for t in self.types.values():
            if {(f.name, f.dataType.simpleString()) for f in t.schema.fields} == {(f.name, f.dataType.simpleString()) for f in schema.fields} and name in (None, t.name):
                return t
        return self.register(name or "auto_" + hashlib.sha256(schema.simpleString().encode()).hexdigest()[:12], schema)

    def register_variant(self, name: str, *members: str) -> EventType:
        """A stream of several types; without members of any type."""
        if len(set(members)) != len(members):
            raise ValueError(f"{name}: a member is named twice")
        common: dict[str, T.StructField] = {}
        for m in members:
            for f in self.get(m).schema.fields:
                if f.name in common and common[f.name].dataType != f.dataType:
                    raise TypeError(f"{name}.{f.name} differs between members")
                common.setdefault(f.name, f)
        made = self.types[name] = EventType(name, T.StructType(list(common.values())), "variant", members=tuple(members))
        return made

    def get(self, name: str) -> EventType:
        if name not in self.types:
            raise KeyError(f"no event type {name}")
        return self.types[name]

    def is_a(self, name: str, ancestor: str) -> bool:
        return name == ancestor or any(self.is_a(p, ancestor) for p in self.get(name).parents)

    def check(self, name: str, df: DataFrame) -> DataFrame:
        """The frame with the type's columns in order and cast; missing required columns raise."""
        t = self.get(name)
        if t.ignore_case:
            there = {c.lower(): c for c in df.columns}
            df = df.withColumnsRenamed({there[f.name.lower()]: f.name for f in t.schema.fields if f.name not in df.columns and f.name.lower() in there})
        for n, change in t.adapters:
            df = df.withColumn(n, change(F.col(n)))
        for n, value in t.defaults:
            df = df.withColumn(n, F.coalesce(F.col(n), F.lit(value)) if n in df.columns else F.lit(value))
        lacking = [f.name for f in t.schema.fields if f.name not in df.columns and not f.nullable]
        if lacking:
            raise TypeError(f"{name} lacks {', '.join(lacking)}")
        own = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema.fields]
        more = [c for c in df.columns if c not in t.schema.names] if t.dynamic else [c for c in df.columns if c in ("_ts", "_seq", "_type")]
        out = df.select(*own, *more)
        return out.withColumns({n: F.expr(g) if isinstance(g, str) else g for n, g in t.getters}) if t.getters else out


@dataclass
class Variable:
    name: str
    kind: str
    value: Any
    constant: bool = False


class Variables:
    """Runtime variables with listeners; constants do not change."""

    def __init__(self):
        self._all: dict[str, Variable] = {}
        self._listeners: list[Callable[[str, Any, Any], None]] = []

    def define(self, name: str, kind: str, value: Any = None, constant: bool = False) -> None:
        if name in self._all:
            raise ValueError(f"variable {name} exists")
        self._all[name] = Variable(name, kind, value, constant)

    def get(self, name: str) -> Any:
        return self._all[name].value

    def ref(self, name: str) -> Column:
        v = self._all[name]
        return F.lit(v.value).cast(v.kind)

    def set(self, **values: Any) -> None:
        """Assign in order, all or none."""
        for n in values:
            if self._all[n].constant:
                raise ValueError(f"variable {n} is constant")
        for n, v in values.items():
            old, self._all[n].value = self._all[n].value, v
            for listener in self._listeners:
                listener(n, old, v)

    def on_change(self, listener: Callable[[str, Any, Any], None]) -> None:
        self._listeners.append(listener)

    def values(self, *names: str) -> dict[str, Any]:
        return {n: self._all[n].value for n in names or self._all}


@dataclass(frozen=True)
class Plan:
    """A query built and checked: its analysed schema, text and hash."""

    name: str
    build: Callable[..., DataFrame]
    schema: T.StructType
    text: str
    uses: tuple[str, ...] = ()
    hints: tuple[str, ...] = ()
    annotations: tuple[tuple[str, Any], ...] = ()

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.text.encode()).hexdigest()

    def artifact(self) -> bytes:
        return json.dumps({"name": self.name, "schema": json.loads(self.schema.json()), "text": self.text, "hash": self.hash, "uses": self.uses}, sort_keys=True).encode()


def _plan_text(df: DataFrame) -> str:
    """The analysed plan without the numbers that Spark gives to columns and relations."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    text = out.getvalue()
    analysed = text[text.find("== Analyzed Logical Plan ==") : text.find("== Optimized Logical Plan ==")]
    return re.sub(r"#\d+L?", "", analysed)


def load_artifact(data: bytes) -> dict:
    """An artifact, its hash verified."""
    out = json.loads(data)
    if hashlib.sha256(out["text"].encode()).hexdigest() != out["hash"]:
        raise ValueError("the artifact's text does not have its hash")
    return out


def order_modules(modules: dict[str, Iterable[str]], deployed: Iterable[str] = (), allow_unresolved: bool = False) -> list[str]:
    """Modules after those they use; cycles and unknown uses raise."""
    done, out, path = set(deployed), [], []

    def visit(name: str) -> None:
        if name in done:
            return
        if name in path:
            raise ValueError("modules use each other in a circle: " + " -> ".join([*path[path.index(name) :], name]))
        if name not in modules:
            if not allow_unresolved:
                raise KeyError(f"no module {name}")
            return
        path.append(name)
        for other in modules[name]:
            visit(other)
        path.pop()
        done.add(name)
        out.append(name)

    for name in modules:
        visit(name)
    return out


@dataclass
class Module:
    name: str
    visibility: str = "public"
    uses: tuple[str, ...] = ()
    members: dict[str, Any] = field(default_factory=dict)

    def visible_to(self, other: str | None) -> bool:
        return self.visibility == "public" or other == self.name


class Engine:
    """Types, variables, state and deployed statements of one session; results are DataFrames."""

    def __init__(self, spark: SparkSession):
        from eddyline.operators.state import Store

        self.spark, self.types, self.variables, self.state = spark, Registry(), Variables(), Store()
        self.expressions: dict[str, Callable[..., Column]] = {}
        self.modules: dict[str, Module] = {}
        self._sources: dict[str, DataFrame] = {}
        self._statements: dict[str, Plan] = {}
        self._listeners: dict[str, list[Callable[[DataFrame], None]]] = {}
        self._deployment_listeners: list[Callable[[str, str], None]] = []
        self.now: int | None = None

    # ---- the engine's clock: a replay up to an instant

    def advance_time(self, to: int) -> None:
        """Move the clock (microseconds): from then on sources hold the events up to it. It does not go back."""
        if self.now is not None and to < self.now:
            raise ValueError(f"the clock stands at {self.now}, after {to}")
        self.now = to

    def advance_span(self, to: int, step: int) -> list[int]:
        """Move the clock in steps; returns the instants, the last one included."""
        if step <= 0:
            raise ValueError("a step must be positive")
        first = self.now if self.now is not None else to
        out = [*range(first + step, to, step), to]
        for t in out:
            self.advance_time(t)
        return out

    def _until_now(self, df: DataFrame) -> DataFrame:
        return df if self.now is None or "_ts" not in df.columns else df.where(F.col("_ts") <= self.now)

    # ---- ingest

    def publish(self, name: str, df: DataFrame) -> None:
        """More events of a type, which is registered from the frame if it is new."""
        if name not in self.types.types:
            self.types.auto_name(df, name)
        made = self.types.check(name, df)
        self._sources[name] = self._sources[name].unionByName(made, allowMissingColumns=True) if name in self._sources else made

    def send(self, name: str, *rows: dict[str, Any] | Sequence[Any], ts: int | None = None) -> None:
        """Events as mappings or positional arrays, at `ts` or the clock's instant."""
        t = self.types.get(name)
        at = ts if ts is not None else self.now or 0
        plain = [tuple(r.get(n) for n in t.schema.names) if isinstance(r, dict) else tuple(r) for r in rows]
        if bad := [r for r in plain if len(r) != len(t.schema.names)]:
            raise TypeError(f"{name} has {len(t.schema.names)} fields, not {len(bad[0])}")
        seq = self._sent = getattr(self, "_sent", 0) + len(plain)
        schema = T.StructType([*t.schema.fields, T.StructField("_ts", T.LongType()), T.StructField("_seq", T.LongType())])
        self.publish(name, self.spark.createDataFrame([(*r, at, seq - len(plain) + i) for i, r in enumerate(plain)], schema))

    def send_text(self, name: str, texts: Sequence[str], form: str = "json", ts: int | None = None) -> None:
        """Events as JSON, XML or Avro's JSON encoding (of the type's representation schema)."""
        t = self.types.get(name)
        ddl = t.schema.simpleString()
        df = self.spark.createDataFrame([(x, ts if ts is not None else self.now or 0, i) for i, x in enumerate(texts)], "_text string, _ts long, _seq long")
        reader = {"json": lambda c: F.from_json(c, ddl), "xml": lambda c: F.from_xml(c, ddl)}[form]
        self.publish(name, df.select(reader(F.col("_text")).alias("_e"), "_ts", "_seq").where("_e is not null").select("_e.*", "_ts", "_seq"))

    def bind(self, name: str, df: DataFrame) -> None:
        """Attach the events of a registered type."""
        self._sources[name] = self.types.check(name, df)

    def source(self, name: str) -> DataFrame:
        """The events of a type and of its subtypes or members, with `_type`."""
        t = self.types.get(name)
        wanted = [n for n in self._sources if self.types.is_a(n, name) or n in t.members]
        if not wanted:
            raise KeyError(f"no events are bound to {name}")
        parts = [self._until_now(self._sources[n]).withColumn("_type", F.lit(n)) for n in wanted]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def define_expression(self, name: str, make: Callable[..., Column]) -> None:
        if name in self.expressions:
            raise ValueError(f"expression {name} exists")
        self.expressions[name] = make

    def expression(self, name: str, *arguments) -> Column:
        return self.expressions[name](*arguments)

    def compile(self, name: str, build: Callable[..., DataFrame], uses: Sequence[str] = (), hints: Sequence[str] = (), annotations: dict[str, Any] | None = None, **parameters) -> Plan:
        """Analyse a query: errors in names and types surface here, before any data are read.

        hints and annotations are kept with the plan; hints on indexes and sharing name nothing that Spark has.
        """
        df = build(self, **parameters)
        return Plan(name, build, df.schema, _plan_text(df), tuple(uses), tuple(dict.fromkeys(hints)), tuple((annotations or {}).items()))

    def context_of(self, statement: str, partition: Column | None = None) -> Column:
        """What an expression can know of where it runs: application, statement, context partition, instant."""
        return F.struct(F.lit(self.spark.sparkContext.applicationId).alias("runtime"), F.lit(statement).alias("statement"), (partition if partition is not None else F.lit(None)).cast("string").alias("partition"), F.lit(self.now).cast("long").alias("time"))

    def deploy(self, *plans: Plan) -> None:
        """Deploy statements, all or none; what they use must be there."""
        names = {p.name for p in plans}
        for p in plans:
            if p.name in self._statements:
                raise ValueError(f"statement {p.name} is deployed")
            if missing := [u for u in p.uses if u not in self._statements and u not in names]:
                raise KeyError(f"{p.name} needs {', '.join(missing)}")
        for p in plans:
            self._statements[p.name] = p
            for listener in self._deployment_listeners:
                listener("deployed", p.name)

    def undeploy(self, name: str) -> None:
        if users := [p.name for p in self._statements.values() if name in p.uses]:
            raise ValueError(f"{name} is used by {', '.join(users)}")
        del self._statements[name]
        for listener in self._deployment_listeners:
            listener("undeployed", name)

    def statements(self) -> list[str]:
        return list(self._statements)

    def execute(self, name: str, **parameters) -> DataFrame:
        """A deployed statement's result over the bound events."""
        return self._statements[name].build(self, **parameters)

    def insert_into(self, name: str, target: str) -> None:
        """A statement's rows become events of a type (registered from its schema if new)."""
        df = self.execute(name)
        if target not in self.types.types:
            self.types.register(target, T.StructType([f for f in df.schema.fields if not f.name.startswith("_")]))
        made = self.types.check(target, df)
        self._sources[target] = self._sources[target].unionByName(made, allowMissingColumns=True) if target in self._sources else made

    def subscribe(self, name: str, listener: Callable[[DataFrame], None]) -> None:
        self._listeners.setdefault(name, []).append(listener)

    def deliver(self, name: str) -> None:
        for listener in self._listeners.get(name, ()):
            listener(self.execute(name))

    def on_deployment(self, listener: Callable[[str, str], None]) -> None:
        self._deployment_listeners.append(listener)
