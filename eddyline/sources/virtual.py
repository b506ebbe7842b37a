"""External data behind a named window: a Python data source of Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


def virtual_window(spark: SparkSession, name: str, schema: str, rows: Callable[[int], Iterator[tuple]], partitions: int = 1) -> DataFrame:
    """Register and read a source whose partition i yields `rows(i)`, on the executors, each time it is read."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Part(i) for i in range(partitions)]

        def read(self, partition):
            yield from rows(partition.number)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
