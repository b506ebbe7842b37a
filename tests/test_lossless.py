"""Rows that once went missing: null times, outer joins of salted sides, unbounded schedules, logs, feedback."""

import datetime as dt
import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eddyline.operators import aggregate, joins, output, retain, state
from eddyline.plans import dataflow as D

HOUR = 3_600_000_000


def test_events_without_a_time_come_first(spark):
    log = spark.createDataFrame([(None, 1, 5.0), (None, 2, 1.0), (10, 3, 2.0), (HOUR * 3, 4, None), (HOUR * 3, 5, 4.0)], "_ts long, _seq long, v double")
    got = {r["_seq"]: (r["n"], r["total"], r["low"]) for r in aggregate.running_unkeyed(log, n=("count", F.lit(1)), total=("sum", "v"), low=("min", "v")).collect()}
    assert got == {1: (1, 5.0, 5.0), 2: (2, 6.0, 1.0), 3: (3, 8.0, 1.0), 4: (4, 8.0, 1.0), 5: (5, 12.0, 1.0)}
    sets = spark.createDataFrame([(None, 2, 7.0), (HOUR, 9, 8.0)], "_ts long, _seq long, value double")
    events = log.withColumn("_seq", F.col("_seq") * 2 - 1)
    seen = {r["_seq"]: r["x"] for r in state.variable_as_of(events, sets, "x", -1.0).collect()}
    assert seen == {1: -1.0, 3: 7.0, 5: 7.0, 7: 8.0, 9: 8.0}


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_outer", "full_outer", "left_semi", "left_anti"])
def test_salted_joins_equal_plain_ones(spark, how):
    left = spark.createDataFrame([(k, v, {"m": v}) for k, v in [(1, 1), (1, 1), (1, 2), (2, 3), (4, 4), (None, 5)]], "k int, a int, tags map<string,int>").drop("tags")
    right = spark.createDataFrame([(1, 10), (3, 30), (3, 31), (None, 50)], "k int, b int")
    want = Counter(tuple(r) for r in left.join(right, ["k"], how).collect())
    made = joins.salted(left, right, ["k"], how, 8)
    assert made.columns == left.join(right, ["k"], how).columns
    assert Counter(tuple(r) for r in made.collect()) == want
    with_map = left.withColumn("m", F.create_map(F.lit("x"), F.col("a")))
    assert joins.salted(with_map, right, ["k"]).count() == 3


def test_endless_schedules():
    from eddyline.operators.output import iso_instants, iso_schedule

    start = dt.datetime(2024, 1, 1)
    assert next(itertools.islice(iso_instants("R/PT1S", start), 20_000, None)) == start + dt.timedelta(seconds=20_001)
    assert len(iso_schedule("R/PT1S", start, start + dt.timedelta(seconds=15_000))) == 15_000
    assert iso_schedule("R0/PT1S", start) == [] and iso_schedule("R1/2024-01-01T00:00:00Z/P1D") == [start]
    assert list(iso_instants("R/P4000Y", start))[-1].year == 6024
    with pytest.raises(ValueError):
        iso_schedule("R/PT1S", start)
    with pytest.raises(ValueError):
        iso_schedule("R/PT0S", start, start)
    with pytest.raises(ValueError):
        iso_schedule("R2/1D", start)


def test_ticks_of_a_schedule(spark):
    start = dt.datetime(2024, 1, 31)
    got = [r["tick"] for r in output.schedule_ticks(spark, "R/P1M", start, dt.datetime(2024, 4, 1)).orderBy("tick").collect()]
    assert got == [int(dt.datetime(2024, m, d, tzinfo=dt.UTC).timestamp() * 1e6) for m, d in ((2, 29), (3, 31))]


def test_snapshots_at_ticks_against_every_pair(spark):
    rows = [(0, 5), (3, None), (4, 4), (7, 12), (20, None), (30, 31), (None, None), (10, 20)]
    live = spark.createDataFrame([(i, None if a is None else (a, 1), None if b is None else (b, -1)) for i, (a, b) in enumerate(rows)], "id int, _in struct<ts: long, seq: long>, _out struct<ts: long, seq: long>")
    for start, stop, step in ((0, 24, 4), (2, 2, 5), (-7, 40, 3), (10, 5, 1)):
        want = {(i, t) for i, (a, b) in enumerate(rows) for t in range(start + step, stop + 1, step) if a is not None and a <= t and (b is None or t < b)}
        assert {(r["id"], r["tick"]) for r in output.snapshot_at(live, start, stop, step).collect()} == want
    plan = output.snapshot_at(live, 0, 24, 4)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_log_sink_writes_all(spark):
    lines: list[str] = []
    df = spark.range(57)
    flow = D.Dataflow("f").add(D.source("s", df)).add(D.log_sink("log", lines.append)).connect("s", "log")
    assert flow.run()["log"]["out"].count() == 57 and len(lines) == 57
    assert retain.KeepAll().frame() is not None


def test_two_feedback_edges_bring_both_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    flow = D.Dataflow("loop").add(D.source("s", df)).add(D.custom("inc", lambda d: d.selectExpr("n + 10 as n"))).add(D.custom("twice", lambda d: d.selectExpr("n * 100 as n")))
    flow.connect("s", "inc").connect("inc", "twice")
    flow.connect_feedback("inc", "inc", 1).connect_feedback("twice", "inc", 1)
    got = sorted(r["n"] for r in flow.run()["inc"]["out"].collect())
    assert got == sorted([11, 12, 21, 22, 1110, 1210])


def test_only_stored_rows_are_acknowledged():
    from eddyline.sources import polled as L

    class All:
        told = 0

        def acknowledge(self):
            self.told += 1

    class Some:
        told = 0

        def acknowledge(self, n):
            self.told = n

    a, b = All(), Some()
    for n, polled in ((2, 5), (5, 5)):
        L.confirm(a, n, polled)
        L.confirm(b, n, polled)
        assert b.told == n
    assert a.told == 1


def test_http_server_refuses_what_it_cannot_hold():
    import json
    import threading
    import urllib.error
    import urllib.request

    from eddyline.sources.polled import HttpServer

    def post(server, value):
        url = f"http://127.0.0.1:{server.server.server_address[1]}"
        try:
            return urllib.request.urlopen(urllib.request.Request(url, json.dumps({"a": value}).encode()), timeout=20).status
        except urllib.error.HTTPError as e:
            return e.code

    server = HttpServer("127.0.0.1", 0, ["a"], most=2)
    assert [post(server, i) for i in range(3)] == [204, 204, 503]
    assert server.poll(10) == [(0,), (1,)] and post(server, 3) == 204
    sure = HttpServer("127.0.0.1", 0, ["a"], durable=10.0)
    seen = []
    sender = threading.Thread(target=lambda: seen.append(post(sure, 1)))
    sender.start()
    while not (rows := sure.poll(5)):
        pass
    assert rows == [(1,)] and not seen
    sure.acknowledge(1)
    sender.join(20)
    assert seen == [204]
    hasty = HttpServer("127.0.0.1", 0, ["a"], durable=0.05)
    assert post(hasty, 1) == 503
    for s in (server, sure, hasty):
        s.server.shutdown()
