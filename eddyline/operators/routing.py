"""Routing results into streams: precedence, promoted payloads, copies by name, delivery by group, own-stream subqueries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eddyline.operators.retain import ordered


def transpose(df: DataFrame, payload: str) -> DataFrame:
    """Rows whose event is the value of a struct column; rows without one are no events."""
    own = [c for c in ("_ts", "_seq") if c in df.columns]
    return df.where(F.col(payload).isNotNull()).select(*own, f"{payload}.*")


def copy_matching(df: DataFrame, target: DataFrame) -> DataFrame:
    """The target's columns, filled by name and cast from the rows; null where a row has no such column."""
    kinds = {f.name: f.dataType for f in target.schema.fields}
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()))


def by_precedence(*routed: tuple[DataFrame, Column | int]) -> DataFrame:
    """Events that statements route for the same input event, in the order they are processed: `_order` within `_seq`.

    routed: (rows with `_ts` and `_seq` of the input event, precedence as a column or a number). The higher precedence
    goes first, equal ones in the order given; a null precedence counts as 0.
    """
    parts = [df.withColumn("_precedence", F.coalesce((F.lit(p) if isinstance(p, int) else p).cast("int"), F.lit(0))).withColumn("_branch", F.lit(i)) for i, (df, p) in enumerate(routed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("_ts", "_seq").orderBy(F.desc("_precedence"), "_branch")
    return out.withColumn("_order", F.row_number().over(w) - 1).drop("_branch")


def grouped_delivery(batches: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Each output batch in groups of equal keys: `_delivery` numbers a batch's groups by their first row."""
    w = Window.partitionBy(*by, "_batch", *keys)
    first = batches.withColumn("_first", F.min(F.struct("_ts", "_seq")).over(w))
    return first.withColumn("_delivery", F.dense_rank().over(Window.partitionBy(*by, "_batch").orderBy("_first")) - 1).drop("_first")


def discrete_delivery(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each row of an output batch is delivered alone: `_delivery` is its place in the batch."""
    return batches.withColumn("_delivery", F.row_number().over(Window.partitionBy(*by, "_batch").orderBy("_ts", "_seq")) - 1)


def deliver(df: DataFrame, listener: Callable[[list[dict]], None]) -> None:
    """Call a listener on the driver with each delivery's rows in order; one delivery is held at a time."""
    order = [c for c in ("_batch", "_delivery", "_ts", "_seq") if c in df.columns]

    def groups() -> Iterator[list[dict]]:
        now, held = None, []
        for r in df.orderBy(*order).toLocalIterator():
            key = (r["_batch"], r["_delivery"])
            if held and key != now:
                yield held
                held = []
            now = key
            held.append(r.asDict())
        if held:
            yield held

    for rows in groups():
        listener(rows)


def self_subquery(df: DataFrame, by: Sequence[str], preeval: bool, **aggregates: Column) -> DataFrame:
    """Each event with aggregates of a subquery on its own stream.

    preeval: the subquery is evaluated before the event is added, so the event does not see itself.
    """
    frame = ordered(by).rowsBetween(Window.unboundedPreceding, -1 if preeval else 0)
    return df.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items()))


def iterable_unbound(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What iterating a statement without a window gives: the last row, of each group if there are keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_ts", "_seq")).alias("_row")).select(*keys, "_row.*").where("_seq is not null")
