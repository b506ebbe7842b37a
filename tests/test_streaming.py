"""Live streams give what the batch gives."""

from pyspark.sql import functions as F

from eddyline.operators import pattern as P
from eddyline.streaming import live

SF = "/root/testdata/sf0.001"


def is_signup(e, m):
    return e["event_type"] == "signup"


def is_purchase(e, m):
    return e["event_type"] == "purchase"


def source(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("_ts", F.unix_micros("ts")).withColumn("_seq", F.col("event_id"))
    events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    return events, live.read_events(spark, str(tmp_path / "in"), events.schema, files_per_trigger=10)


def test_tumbling_window(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    out = live.run_to_end(live.tumbling(stream, "ts", "1 hour", "1 minute", ["event_type"], n=F.count("*")), "tumbling", "complete")
    want = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert sorted((r["w"]["start"], r["event_type"], r["n"]) for r in out.collect()) == sorted((r["w"]["start"], r["event_type"], r["count"]) for r in want.collect())


def test_pattern(spark, tmp_path):
    events, stream = source(spark, tmp_path)
    node = P.atom("a", is_signup).every().then(P.atom("b", is_purchase))
    pick = {"a_id": ("long", lambda m: m["a"]["event_id"]), "b_id": ("long", lambda m: m["b"]["event_id"])}
    columns = ["_ts", "_seq", "user_id", "event_id", "event_type"]
    got = live.run_to_end(live.match(stream.select(*columns), node, ["user_id"], pick), "pattern")
    want = P.match(events.select(*columns), node, ["user_id"], pick)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_upsert_sink_is_idempotent(spark):
    sink = live.upsert_sink(["k"], "upserted")
    a = spark.createDataFrame([(1, "x", 1, 1)], "k int, v string, _ts long, _seq long")
    b = spark.createDataFrame([(1, "y", 2, 2), (2, "z", 2, 3)], "k int, v string, _ts long, _seq long")
    for batch, epoch in ((a, 0), (b, 1), (b, 1)):
        sink(batch, epoch)
    assert sorted((r["k"], r["v"]) for r in spark.table("upserted_1").collect()) == [(1, "y"), (2, "z")]


class Letters:
    def __init__(self):
        self.rows = [(i, chr(97 + i)) for i in range(5)]

    def poll(self, most):
        out, self.rows = self.rows[:2], self.rows[2:]
        return out

    def acknowledge(self):
        pass


def test_polled_source(spark):
    from eddyline.sources.polled import polled

    q = polled(spark, "letters", "k int, v string", Letters).writeStream.format("memory").queryName("letters").start()
    try:
        for _ in range(40):
            q.processAllAvailable()
            if spark.table("letters").count() == 5:
                break
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("letters").collect())) == [(i, chr(97 + i)) for i in range(5)]


def test_http_server_client():
    import socket
    from urllib import error, request

    import pytest

    from eddyline.sources.polled import HttpServer, batches

    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    server = HttpServer("127.0.0.1", port, ["a", "b"])
    request.urlopen(request.Request(f"http://127.0.0.1:{port}/", b'{"a": 1}'), timeout=5)
    with pytest.raises(error.HTTPError):
        request.urlopen(request.Request(f"http://127.0.0.1:{port}/", b"no json"), timeout=5)
    assert list(batches(server)) == [[(1, None)]]
    server.server.shutdown()
