"""The fluent builder: a continuous query declared step by step, lowered to one DataFrame plan.

    Stream.of(events, "ts", "event_id").filter("value > 100").group_by("user_id").window(Length(10))
        .aggregate(total=F.sum("value")).having("total > 500").output(every=6).select("user_id", "total").rows()

Each step returns a new stream, so parts can be shared; nothing runs before an action on the DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyline.operators import aggregate, contained, contexts, joins, output, pattern, retain, rowpattern, state


@dataclass(frozen=True)
class Stream:
    """Events with `_ts` and `_seq`, the keys they are grouped by and the window that retains them."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    policy: retain.Policy = retain.KeepAll()

    @classmethod
    def of(cls, df: DataFrame, ts: str | Column, seq: str | Column) -> Stream:
        return cls(retain.stream(df, ts, seq))

    # ---- shape of the stream

    def filter(self, condition: Column | str) -> Stream:
        """Events that meet a condition; null counts as no."""
        return replace(self, df=self.df.where(condition))

    where = filter

    def with_columns(self, **columns: Column) -> Stream:
        return replace(self, df=self.df.withColumns(columns))

    def update(self, where: Column, **assign: Column) -> Stream:
        return replace(self, df=state.update_stream(self.df, where, **assign))

    def unnest(self, values: Column, name: str, position: str | None = None) -> Stream:
        return replace(self, df=contained.unnest(self.df, values, name, position))

    def merge(self, other: Stream) -> Stream:
        """The events of both streams, in order of time."""
        return replace(self, df=self.df.unionByName(other.df, allowMissingColumns=True))

    def group_by(self, *keys: str) -> Stream:
        return replace(self, keys=keys)

    def window(self, policy: retain.Policy) -> Stream:
        return replace(self, policy=policy)

    def context(self, make: Callable[[DataFrame], DataFrame]) -> Stream:
        """Partition by a context of `operators.contexts`; its columns become keys."""
        df = make(self.df)
        return replace(self, df=df, keys=(*self.keys, *(c for c in df.columns if c.startswith("context_") and c not in self.df.columns)))

    def split(self, *branches: tuple[str, Column | None], first: bool = True) -> dict[str, Stream]:
        return {name: replace(self, df=df) for name, df in state.split(self.df, *branches, first=first).items()}

    # ---- results for each event

    def aggregate(self, **aggregates: Column) -> Stream:
        """A row for each event with aggregates of what its group then retains."""
        return replace(self, df=aggregate.running(self.df, self.policy, self.keys, **aggregates))

    def totals(self, **values: str | Column) -> Stream:
        """Sums after each arrival and expiry, for windows without a contiguous frame."""
        out = retain.running_totals(self.policy.lifetimes(self.df, self.keys), self.keys, **values)
        return replace(self, df=out.withColumn("_ts", F.col("_at.ts")).withColumn("_seq", F.col("_at.seq")))

    def having(self, condition: Column | str) -> Stream:
        return self.filter(condition)

    def with_old(self, *names: str) -> Stream:
        """Old rows of running aggregates beside the new ones, told apart by `_op`."""
        return replace(self, df=aggregate.with_old(self.df, names, self.keys))

    def output(self, every: int | None = None, every_us: int | None = None, start: int = 0, take: str = "all", after: int = 0) -> Stream:
        """Rate limiting: batches of n rows or of d, of which all, the first or the last row (by key) is delivered."""
        df = output.after_events(self.df, after, self.keys) if after else self.df
        df = output.every_events(df, every, self.keys) if every is not None else output.every_time(df, every_us, start)
        if take != "all":
            df = {"first": output.first_of_batch, "last": output.last_of_batch}[take](df, self.keys)
        return replace(self, df=df)

    def limit(self, order: Sequence[Column], limit: int, offset: int = 0) -> Stream:
        """Order and limit within each output batch."""
        return replace(self, df=output.limit_batch(self.df, order, limit, offset))

    def prior(self, n: int, column: str, name: str) -> Stream:
        return replace(self, df=self.df.withColumn(name, F.lag(column, n).over(retain.ordered(self.keys))))

    # ---- what the window holds

    def changes(self) -> DataFrame:
        """Insert and remove stream of the window."""
        return retain.changes(self.policy.lifetimes(self.df, self.keys))

    def snapshot(self, at: int | None = None) -> DataFrame:
        return retain.snapshot(self.policy.lifetimes(self.df, self.keys), at)

    # ---- several streams

    def join(self, other: Stream, on: Sequence[tuple[str, str]], where: Column | None = None) -> DataFrame:
        """Pairs that both windows hold at the same time; sides are aliased l and r."""
        return joins.windowed(self.df, other.df, on, self.policy, other.policy, where)

    def latest_of(self, passive: Stream, columns: Sequence[str]) -> Stream:
        """Each event with the last earlier event of the other stream with its key."""
        return replace(self, df=joins.unidirectional(self.df, passive.df, self.keys, columns))

    # ---- sequences

    def pattern(self, node: pattern.Node, select: dict[str, tuple[str, Callable[[dict], Any]]], **options) -> DataFrame:
        return pattern.match(self.df, node, self.keys, select, **options)

    def match_recognize(self, term: rowpattern.Term, define: dict[str, Callable], measures: dict[str, tuple[str, Callable]], **options) -> DataFrame:
        return rowpattern.match_recognize(self.df, term, self.keys, define, measures, **options)

    # ---- result

    def select(self, *columns: str | Column) -> Stream:
        return replace(self, df=self.df.select("_ts", "_seq", *columns))

    def rows(self) -> DataFrame:
        """The result without the stream's own columns."""
        return self.df.drop(*(c for c in self.df.columns if c.startswith("_")))


def keyed_context(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: contexts.keyed(df, *keys)
