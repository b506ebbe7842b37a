"""Named windows and tables: shared mutable state from streams, triggers, merges, fire-and-forget statements.

State over a log is the fold of its changes. Where only the last change of a key counts, that is one aggregation
(`latest`, `into_table`); where actions depend on the row they find, it is a state machine for each primary key
(`merge`). Statements on demand build a new version of a DataFrame, so a statement that fails changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eddyline.operators.retain import Policy


def latest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert: the last row of each key. Partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*rest), F.struct("_ts", "_seq"))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def table_from_changes(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A keyed table from a change log with `_op`: keys whose last change is a removal are gone."""
    return latest(log, keys).where(F.col("_op") != "-").drop("_op")


def first_wins(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert with a unique index: later rows of a key are rejected."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_ts", "_seq")).alias("_row")).select(*keys, "_row.*")


def into_table(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates held in table columns."""
    return df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))


def reset_epochs(df: DataFrame, reset: Column, by: Sequence[str] = ()) -> DataFrame:
    """Number the stretches between reset events, which are left out; aggregates group by `_epoch`."""
    w = (Window.partitionBy(*by) if by else Window).orderBy("_ts", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_epoch", F.sum(F.when(reset, 1).otherwise(0)).over(w)).where(~reset)


def on_select(triggers: DataFrame, state: DataFrame, policy: Policy, on: Sequence[tuple[str, str]] = (), where: Column | None = None) -> DataFrame:
    """For each trigger (alias t) the rows a named window (alias w) retains just then.

    Where the window has a span, time is cut into buckets of it that join the key; a row is in the bucket of its
    arrival and the next one.
    """
    held_rows = policy.lifetimes(state)
    if (span := policy.span()) is not None:
        triggers = triggers.withColumn("_bucket", F.floor(F.col("_ts") / span))
        b = F.floor(F.col("_in.ts") / span)
        held_rows = held_rows.withColumn("_bucket", F.explode(F.array(b, b + 1)))
        on = [*on, ("_bucket", "_bucket")]
    t, w = triggers.alias("t"), held_rows.alias("w")
    at = F.struct(F.col("t._ts").alias("ts"), F.col("t._seq").alias("seq"))
    held = (F.col("w._in") < at) & (F.col("w._out").isNull() | (F.col("w._out") > at))
    condition = reduce(lambda a, b: a & b, [*(F.col(f"t.{a}") == F.col(f"w.{b}") for a, b in on), held, *([where] if where is not None else [])])
    return t.join(w, condition)


def on_delete(live: DataFrame, triggers: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Lifetimes cut short by the first later delete trigger of the key; an anti-join would forget the time.

    One window over rows and triggers of a key in order, no join. Rows with a null in their key are never deleted.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    rows = live.select("*", *(F.col(b).alias(k) for k, (_, b) in zip(keys, on, strict=True)), F.col("_in").alias("_at"), F.lit(1).alias("_row"))
    cuts = triggers.select(*(F.col(a).alias(k) for k, (a, _) in zip(keys, on, strict=True)), F.struct(F.col("_ts").alias("ts"), F.col("_seq").alias("seq")).alias("_at"), F.lit(0).alias("_row"))
    both = rows.unionByName(cuts, allowMissingColumns=True)
    later = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, -1)  # latest first: a frame to the end is computed anew for each row
    del_ = F.last(F.when(F.col("_row") == 0, F.col("_at")), ignorenulls=True).over(later)
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    out = both.withColumn("_del", del_).where("_row = 1")
    return out.withColumn("_out", F.least("_out", F.when(whole, F.col("_del")))).select(live.columns)


def on_select_delete(live: DataFrame, triggers: DataFrame, on: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Triggers that select and delete: what each takes (with `_at`, the trigger's instant), and the lifetimes left."""
    left = on_delete(live, triggers, on)
    cut = left.withColumnRenamed("_out", "_at").join(live.select("_in", F.col("_out").alias("_was")), "_in")
    taken = cut.where("_at is not null and (_was is null or _at < _was)").drop("_was")
    return taken, left


def since_last(df: DataFrame, keys: Sequence[str], reset: Column, **aggregates: Column) -> DataFrame:
    """A table of aggregates that a reset event deletes: those of each key's events after its last reset, if there are any.

    The set form of a merge whose branches insert or add to a row and delete it.
    """
    last = F.max(F.when(reset, F.struct("_ts", "_seq"))).over(Window.partitionBy(*keys))
    after = df.withColumn("_last", last).where(F.col("_last").isNull() | (F.struct("_ts", "_seq") > F.col("_last")))
    return after.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))


# ---- merge -------------------------------------------------------------------------------------------------

Row = dict[str, Any]


@dataclass(frozen=True)
class Action:
    """One branch of a merge: applies if `when` holds of (event, row or None)."""

    matched: bool
    kind: str  # insert, update, delete, insert_into
    assign: Callable[[Row, Row | None], Row] | None = None
    when: Callable[[Row, Row | None], bool] = lambda e, r: True
    target: str | None = None


def when_matched_update(assign, when=lambda e, r: True) -> Action:
    return Action(True, "update", assign, when)


def when_matched_delete(when=lambda e, r: True) -> Action:
    return Action(True, "delete", None, when)


def when_not_matched_insert(assign, when=lambda e, r: True) -> Action:
    return Action(False, "insert", assign, when)


def then_insert_into(target: str, assign, matched: bool, when=lambda e, r: True) -> Action:
    return Action(matched, "insert_into", assign, when, target)


def merge(df: DataFrame, key: str, schema: str, actions: Sequence[Action], all_branches: bool = False) -> DataFrame:
    """The change log of a table keyed by `key` as events merge into it, in order, one key at a time.

    schema: the table's columns besides the key. The first branch that applies acts (or all of them in order).
    The log has key, columns, `_op` (+ new, - old, > sent to `_target`), `_ts`, `_seq`.
    """
    own = T.StructType.fromDDL(schema)
    names = own.names
    kind = df.schema[key].dataType.simpleString()
    out_schema = f"{key} {kind}, {schema}, _op string, _target string, _ts long, _seq long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        row: Row | None = None
        log = []
        for e in pdf.sort_values(["_ts", "_seq"]).to_dict("records"):

            def put(values, op, target=None, e=e):
                log.append((e[key], *(values.get(n) for n in names), op, target, e["_ts"], e["_seq"]))

            matched = row is not None
            for a in actions:
                if a.matched != matched or not a.when(e, row):
                    continue
                if a.kind == "insert_into":
                    put(a.assign(e, row), ">", a.target)
                else:
                    if row is not None:
                        put(row, "-")
                    row = None if a.kind == "delete" else {**(row or {}), **a.assign(e, row)}
                    if row is not None:
                        put(row, "+")
                if not all_branches:
                    break
        return pd.DataFrame(log, columns=[key, *names, "_op", "_target", "_ts", "_seq"])

    return df.groupBy(key).applyInPandas(fold, out_schema)


def merged_state(log: DataFrame, key: str) -> DataFrame:
    """The table that a merge's log leaves: per key the last change, unless it is a removal."""
    last = log.where(F.col("_op") != ">").groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.struct("_ts", "_seq", F.col("_op") == "+")).alias("_row"))
    return last.select(key, "_row.*").where(F.col("_op") == "+").drop("_op", "_target")


def merge_batch(table: DataFrame, source: DataFrame, key: str, update: dict[str, Column], insert: dict[str, Column], delete: Column | None = None) -> DataFrame:
    """Set-based merge of one source row a key, as a full join: matched rows are updated or deleted, others inserted.

    Expressions see the table as t and the source as s.
    """
    t, s = table.alias("t"), source.alias("s")
    both = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full")
    has_t, has_s = F.col(f"t.{key}").isNotNull(), F.col(f"s.{key}").isNotNull()
    if delete is not None:
        both = both.where(~F.coalesce(has_t & has_s & delete, F.lit(False)))
    out = [F.coalesce(F.col(f"t.{key}"), F.col(f"s.{key}")).alias(key)]
    for c in (c for c in table.columns if c != key):
        out.append(F.when(has_t & has_s, update.get(c, F.col(f"t.{c}"))).when(has_t, F.col(f"t.{c}")).otherwise(insert.get(c, F.lit(None))).alias(c))
    return both.select(*out)


# ---- statements on demand ----------------------------------------------------------------------------------


class Store:
    """Named windows and tables by name, each a version of a DataFrame. A failed statement leaves all as it was.

    With a folder (shared by the cluster) each version is written there as Parquet and read back, so that statements
    do not pile up in one plan and a version survives lost executors; without, versions are plans over each other.
    """

    def __init__(self, folder: str | None = None):
        self._folder, self._version = folder, 0
        self._states: dict[str, DataFrame] = {}
        self._keys: dict[str, tuple[str, ...]] = {}

    def create(self, name: str, rows: DataFrame, primary_key: Sequence[str] = (), retention: Policy | None = None) -> None:
        if name in self._states:
            raise ValueError(f"{name} exists")
        self._states[name] = self._stored(name, rows if retention is None else retention.retained(rows))
        self._keys[name] = tuple(primary_key)

    def _stored(self, name: str, rows: DataFrame) -> DataFrame:
        if self._folder is None:
            return rows
        self._version += 1
        path = f"{self._folder.rstrip('/')}/{name}-{self._version:08d}"
        rows.write.parquet(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        if name not in self._states:
            raise KeyError(f"no window or table {name}")
        return self._states[name]

    def drop(self, name: str) -> None:
        self.read(name)
        del self._states[name], self._keys[name]

    def _put(self, name: str, rows: DataFrame) -> None:
        keys = self._keys[name]
        rows = self._stored(name, rows)
        if keys and not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"{name}: more than one row for a primary key")
        self._states[name] = rows

    def insert(self, name: str, rows: DataFrame) -> None:
        self._put(name, self.read(name).unionByName(rows, allowMissingColumns=True))

    def update(self, name: str, where: Column, **assign: Column) -> None:
        """Assignments in order, each seeing those before it."""
        df = self.read(name)
        kept = df.withColumn("_hit", F.coalesce(where, F.lit(False)))
        for c, v in assign.items():
            kept = kept.withColumn(c, F.when(F.col("_hit"), v).otherwise(F.col(c)).cast(df.schema[c].dataType))
        self._put(name, kept.drop("_hit"))

    def delete(self, name: str, where: Column) -> None:
        self._put(name, self.read(name).where(~F.coalesce(where, F.lit(False))))

    def select_delete(self, name: str, where: Column) -> DataFrame:
        """The rows that meet a condition, which are deleted."""
        hit = F.coalesce(where, F.lit(False))
        df = self.read(name)
        self._put(name, df.where(~hit))
        return df.where(hit)

    def prepare(self, statement: Callable[..., Any]) -> Callable[..., Any]:
        """A statement with parameters, run with the state as it then is: `statement(store, *values)`."""
        return lambda *values, **named: statement(self, *values, **named)

    def delete_all(self, name: str) -> None:
        self._put(name, self.read(name).limit(0))

    def select(self, name: str, where: Column | None = None) -> DataFrame:
        df = self.read(name)
        return df if where is None else df.where(where)

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Insert or replace by primary key; of several rows of one key any may count, so give one."""
        keys = self._keys[name]
        old = self.read(name).join(rows.select(*keys).distinct(), list(keys), "left_anti")
        self._put(name, old.unionByName(rows, allowMissingColumns=True))

    def atomically(self, *statements: Callable[[Store], None]) -> None:
        """All statements or none."""
        before = dict(self._states)
        try:
            for s in statements:
                s(self)
        except BaseException:
            self._states = before
            raise


# ---- splitting and updating streams ------------------------------------------------------------------------


def split(df: DataFrame, *branches: tuple[str, Column | None], first: bool = True) -> dict[str, DataFrame]:
    """Route events to branches (target, condition): the first that holds, or all. Without a condition a branch takes all.

    What no branch takes is under the key None.
    """
    conditions = [(t, F.coalesce(c, F.lit(False)) if c is not None else F.lit(True)) for t, c in branches]
    if first:
        choice = F.lit(None).cast("int")
        for i, (_, c) in reversed(list(enumerate(conditions))):
            choice = F.when(c, F.lit(i)).otherwise(choice)
        marked = df.withColumn("_branch", choice)
        out = {t: marked.where(F.col("_branch") == i).drop("_branch") for i, (t, _) in enumerate(conditions)}
        return out | {None: marked.where("_branch is null").drop("_branch")}
    none = reduce(lambda a, b: a & ~b, (c for _, c in conditions), F.lit(True))
    return {t: df.where(c) for t, c in conditions} | {None: df.where(none)}


def update_stream(df: DataFrame, where: Column, **assign: Column) -> DataFrame:
    """Rewrite properties of arriving events."""
    return df.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in assign.items()})


def variable_as_of(df: DataFrame, settings: DataFrame, name: str, initial: Any, bucket_us: int = 3_600_000_000) -> DataFrame:
    """The value of a variable at each event: the last setting (`value`) before it in order.

    A variable is one sequence for the whole stream. To keep it from being one task, time is cut into buckets: order
    matters within a bucket, and each bucket starts with what the last setting before it left. Only that carry, a
    row a bucket, is a single sequence. Events and settings without a time come before all others.
    """
    kind = settings.schema["value"].dataType
    events = df.withColumn("_value", F.lit(None).cast(kind)).withColumn("_set", F.lit(False))
    sets = settings.where("value is not null").select("_ts", "_seq", F.col("value").alias("_value")).withColumn("_set", F.lit(True))
    log = events.unionByName(sets, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_ts") / bucket_us))
    last = log.groupBy("_bucket").agg(F.max_by("_value", F.when(F.col("_set"), F.struct("_ts", "_seq"))).alias("_last"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(F.col("_bucket").alias("_of"), F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    w = Window.partitionBy("_bucket").orderBy("_ts", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = log.withColumn("_own", F.last("_value", ignorenulls=True).over(w)).where(~F.col("_set")).join(carry, F.col("_bucket").eqNullSafe(F.col("_of")))
    return seen.withColumn(name, F.coalesce("_own", "_carry", F.lit(initial))).drop("_value", "_set", "_own", "_carry", "_bucket", "_of")


def by_priority(df: DataFrame, *statements: tuple[str, int, Column, bool]) -> DataFrame:
    """Which statements (name, priority, condition, drop) see each event, highest priority first.

    A statement with drop keeps an event it takes from all of lower priority. One row for an event and statement.
    """
    taken = F.lit(False)
    hits = []
    ranked = sorted(enumerate(statements), key=lambda s: (-s[1][1], s[0]))
    level, pending = None, F.lit(False)
    for _, (name, priority, condition, drop) in ranked:
        if priority != level:
            taken, pending, level = taken | pending, F.lit(False), priority
        hit = F.coalesce(condition, F.lit(False)) & ~taken
        hits.append(F.when(hit, F.lit(name)))
        if drop:
            pending = pending | hit
    return df.withColumn("statement", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
