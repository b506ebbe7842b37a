"""Live sources that are polled on the driver: an HTTP server, message queues with a client library.

For sources of modest rate without partitions of their own; Kafka and files are read in parallel by Spark's own
sources. Rows of a batch are kept until it is committed, so that a batch run again is the same.
"""

from __future__ import annotations

import inspect
import json
import threading
from collections.abc import Callable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from queue import Empty, Full, Queue
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class Client(Protocol):
    """What a source polls."""

    def poll(self, most: int) -> list[tuple]:
        """Rows that have come, without waiting."""

    def acknowledge(self, n: int) -> None:
        """The first n rows of all that were polled are stored; later ones may be asked for again after a crash."""


def confirm(client: Client, n: int, polled: int) -> None:
    """Acknowledge the first n of the rows polled. A client that can only confirm all of them is told once all are stored."""
    if inspect.signature(client.acknowledge).parameters:
        client.acknowledge(n)
    elif n == polled:
        client.acknowledge()


def polled(spark: SparkSession, name: str, schema: str, connect: Callable[[], Client], most: int = 1000) -> DataFrame:
    """Register and read a live source; `connect` runs once, in the process that polls."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self):
            self.client: Client | None = None
            self.held: list[tuple] = []
            self.first = self.origin = 0

        def initialOffset(self):  # noqa: N802
            return {"n": 0}

        def read(self, start):
            if self.client is None:
                self.client, self.first = connect(), start["n"]
                self.origin = self.first
            new = self.client.poll(most)
            self.held = self.held[: start["n"] - self.first] + new
            return iter(new), {"n": start["n"] + len(new)}

        def readBetweenOffsets(self, start, end):  # noqa: N802
            return iter(self.held[start["n"] - self.first : end["n"] - self.first])

        def commit(self, end):
            self.held, self.first = self.held[end["n"] - self.first :], end["n"]
            if self.client is not None:
                confirm(self.client, end["n"] - self.origin, self.first + len(self.held) - self.origin)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def simpleStreamReader(self, schema):  # noqa: N802
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format(name).load()


class HttpServer:
    """Events posted as JSON objects to a port; rows hold the named fields, null where absent.

    At most `most` events wait; beyond that a post is answered 503 and may be sent again. If `durable` is a number of
    seconds, a post is answered 204 only once its row is stored, and 503 if that takes longer; otherwise as soon as
    it waits in memory, so a crash loses what was accepted and not yet stored.
    """

    def __init__(self, host: str, port: int, fields: list[str], most: int = 10_000, durable: float | None = None):
        queue: Queue[tuple[tuple, threading.Event]] = Queue(most)

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                try:
                    event = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                    row, stored = tuple(event.get(f) for f in fields), threading.Event()
                    queue.put_nowait((row, stored))
                    self.send_response(204 if durable is None or stored.wait(durable) else 503)
                except Full:
                    self.send_response(503)
                except (ValueError, AttributeError):
                    self.send_response(400)
                self.end_headers()

            def log_message(self, *args):
                pass

        self.queue = queue
        self.polled: list[threading.Event] = []
        self.confirmed = 0
        self.server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def poll(self, most: int) -> list[tuple]:
        out: list[tuple] = []
        while len(out) < most:
            try:
                row, stored = self.queue.get_nowait()
            except Empty:
                break
            out.append(row)
            self.polled.append(stored)
        return out

    def acknowledge(self, n: int) -> None:
        for stored in self.polled[: n - self.confirmed]:
            stored.set()
        del self.polled[: n - self.confirmed]
        self.confirmed = max(n, self.confirmed)


def http_server(spark: SparkSession, name: str, schema: str, host: str, port: int) -> DataFrame:
    """Events that others post to this driver."""
    fields = [x.split()[0] for x in schema.split(", ")]
    return polled(spark, name, schema, lambda: HttpServer(host, port, fields))


def batches(client: Client, most: int = 1000) -> Iterator[list[tuple]]:
    """What a client has, batch by batch, outside a stream."""
    n = 0
    while rows := client.poll(most):
        yield rows
        n += len(rows)
        confirm(client, n, n)
