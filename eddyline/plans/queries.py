"""Registration of queries: a function of the tables, and SQL for the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eddyline.operators.retain import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by name, and `log`: the events as a stream with engine time and order."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    @property
    def log(self) -> DataFrame:
        return stream(self.events, "ts", "event_id")


def query(sql: str | None = None, name: str | None = None):
    def register(make: Callable[[Tables], DataFrame]):
        key = name or make.__name__
        QUERIES[key] = lambda spark, sf_dir: make(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql
        return make

    return register
