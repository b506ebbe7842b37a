"""The same operators on live streams: Structured Streaming with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eddyline.operators.pattern import Node, Run


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, ts: str, length: str, late: str, by: Sequence[str], start: str | None = None, **aggregates: Column) -> DataFrame:
    window = F.window(ts, length, startTime=start) if start else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(*(a.alias(n) for n, a in aggregates.items()))


def sliding(events: DataFrame, ts: str, length: str, slide: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), *by).agg(*(a.alias(n) for n, a in aggregates.items()))


def accumulating(events: DataFrame, ts: str, gap: str, late: str, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Session windows: accumulate until a gap of silence."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*(a.alias(n) for n, a in aggregates.items()))


def first_unique(events: DataFrame, ts: str, late: str, keys: Sequence[str]) -> DataFrame:
    """The first event of each key within the watermark's horizon; state of older keys is let go."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def joined(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, late: str, how: str = "inner") -> DataFrame:
    """A join of two streams; `on` should bound their times, so that state can be let go."""
    return left.withWatermark(left_ts, late).join(right.withWatermark(right_ts, late), on, how)


def match(events: DataFrame, node: Node, by: Sequence[str], select: dict[str, tuple[str, Callable[[dict], Any]]]) -> DataFrame:
    """A pattern over each key of a live stream, with the events of a trigger in order of `_ts`, `_seq`.

    The key's running state machine is pickled between triggers, so predicates must be module-level functions.
    """
    from pyspark import cloudpickle

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), "_at long", *(f"{n} {k}" for n, (k, _) in select.items())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["_ts", "_seq"]).to_dict("records")
        if state.exists:
            run = cloudpickle.loads(state.get[0])
        else:
            run = Run(node)
            run.begin(rows[0]["_ts"])
        run.listening = {id(s): s for s in run.listening.values()}  # a state's id is new after unpickling
        found = []
        for e in rows:
            for at, ms in run.advance(e["_ts"]):
                found += [(at, m) for m in ms]
            found += [(e["_ts"], m) for m in run.send(e)]
        state.update((cloudpickle.dumps(run),))
        yield pd.DataFrame([(*key, at, *(f(m) for _, f in select.values())) for at, m in found], columns=[*by, "_at", *select])

    return events.groupBy(*by).applyInPandasWithState(step, schema, "run binary", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(key: Sequence[str], table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key in a table, in two alternating versions.

    A batch that is run again gives the same version, so the sink is idempotent.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = f"{table}_{(epoch + 1) % 2}"
        rows = batch
        if spark.catalog.tableExists(old):
            rows = spark.table(old).unionByName(batch, allowMissingColumns=True)
        rest = [c for c in rows.columns if c not in key]
        latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_ts", "_seq")).alias("_row")).select(*key, "_row.*")
        latest.write.mode("overwrite").saveAsTable(f"{table}_{epoch % 2}")

    return write


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a query over all that is there into a table in memory: for tests and small replays."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
