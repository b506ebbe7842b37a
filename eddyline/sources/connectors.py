"""Sources and sinks outside Spark's files: databases, HTTP, Kafka, sockets; all work on partitions, in parallel.

A sink may see a row again when a task is retried, so statements should be idempotent; `upsert` is.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterable, Sequence
from typing import Any
from urllib import request

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# ---- databases ---------------------------------------------------------------------------------------------


def read_jdbc(spark: SparkSession, url: str, query: str, fetch_size: int = 1000, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch_size), **options).load()


def lookup(df: DataFrame, keys: Sequence[str], poll: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """Join rows to what a method returns for their keys (0 to n rows), asked once for each distinct key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                rows += [(*(r[k] for k in keys), *(found.get(f) for f in fields)) for found in poll(r)]
            yield pd.DataFrame(rows, columns=[*keys, *fields])

    asked = df.select(*keys).distinct()
    made = asked.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema]))
    return df.join(made, list(keys))


def db_execute(df: DataFrame, driver: str, connect: dict[str, Any], statement: str, columns: Sequence[str], batch: int = 500, retries: int = 2) -> None:
    """Run a parameterised statement for each row through a DB-API driver, a transaction a batch, a connection a partition."""

    def run(rows: Iterable[Row]) -> None:
        connection = importlib.import_module(driver).connect(**connect)
        try:
            held: list[tuple] = []

            def flush() -> None:
                for attempt in range(retries + 1):
                    try:
                        cursor = connection.cursor()
                        cursor.executemany(statement, held)
                        connection.commit()
                        break
                    except Exception:
                        connection.rollback()
                        if attempt == retries:
                            raise
                        time.sleep(0.05 * 2**attempt)
                held.clear()

            for r in rows:
                held.append(tuple(r[c] for c in columns))
                if len(held) >= batch:
                    flush()
            if held:
                flush()
        finally:
            connection.close()

    df.foreachPartition(run)


def db_upsert(df: DataFrame, driver: str, connect: dict[str, Any], table: str, keys: Sequence[str], columns: Sequence[str], mark: str = "?") -> None:
    """Insert or update by key (the `on conflict` form of SQL)."""
    names = [*keys, *columns]
    change = ", ".join(f"{c} = excluded.{c}" for c in columns)
    statement = f"insert into {table} ({', '.join(names)}) values ({', '.join([mark] * len(names))}) on conflict ({', '.join(keys)}) do update set {change}"
    db_execute(df, driver, connect, statement, names)


# ---- HTTP --------------------------------------------------------------------------------------------------


def http_post(df: DataFrame, url: str, timeout: float = 10, headers: dict[str, str] | None = None) -> None:
    """Send each row as JSON."""

    def run(rows: Iterable[Row]) -> None:
        for r in rows:
            body = json.dumps(r.asDict(recursive=True), default=str).encode()
            with request.urlopen(request.Request(url, body, {"Content-Type": "application/json", **(headers or {})}), timeout=timeout):
                pass

    df.foreachPartition(run)


# ---- messaging ---------------------------------------------------------------------------------------------


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: str, live: bool = True, **options: str) -> DataFrame:
    """Kafka records with JSON values; offsets are kept by the query's checkpoint. Needs the Kafka package of Spark."""
    reader = (spark.readStream if live else spark.read).format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options})
    return reader.load().select("timestamp", F.from_json(F.col("value").cast("string"), schema).alias("v")).select("timestamp", "v.*")


def write_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    out = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct("*")).alias("value"))
    out.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def read_socket(spark: SparkSession, host: str, port: int, schema: str, mode: str = "csv") -> DataFrame:
    """Lines from a TCP socket, as CSV or as name=value pairs."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    if mode == "csv":
        return lines.select(F.from_csv("value", schema).alias("v")).select("v.*")
    pairs = F.str_to_map(F.col("value"), F.lit(","), F.lit("="))
    return lines.select(*(pairs[n].cast(k).alias(n) for n, k in (x.split() for x in schema.split(", "))))


def client(module: str) -> Any:
    """A messaging client library (AMQP, JMS bridges) that may not be installed."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise RuntimeError(f"this connector needs the package {module}") from e


def send_messages(df: DataFrame, module: str, send: Callable[[Any, dict], None]) -> None:
    """Send each row with a client library of the worker: for queues without a Spark sink."""

    def run(rows: Iterable[Row]) -> None:
        lib = client(module)
        for r in rows:
            send(lib, r.asDict(recursive=True))

    df.foreachPartition(run)
