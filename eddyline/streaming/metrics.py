"""Metrics and audit of running queries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Keeps the last progress of each live query and tells listeners: rows in, rows a second, batch, state rows.

    Register with `spark.streams.addListener(metrics)`.
    """

    def __init__(self, include: Callable[[str], bool] = lambda name: True):
        self.include, self.last, self._listeners = include, {}, []

    def subscribe(self, listener: Callable[[str, dict], None]) -> None:
        self._listeners.append(listener)

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        name = p.name or str(p.id)
        if self.include(name):
            self.last[name] = {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
            for listener in self._listeners:
                listener(name, self.last[name])

    def onQueryTerminated(self, event):  # noqa: N802
        self.last.pop(str(event.id), None)


def observed(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """The frame with measures that its first action fills in."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in measures.items())), seen


def audit(statement: str, stage: str, time_us: int, **fields) -> str:
    """One audit line."""
    return json.dumps({"statement": statement, "stage": stage, "time": time_us, **fields}, default=str)
