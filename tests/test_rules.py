"""Rules of the surveyed engine that are easy to get wrong: eager batches, leaving rows, old aggregates, ticks, periods."""

import pytest
from pyspark.sql import functions as F

from eddyline.operators import aggregate as A
from eddyline.operators import contexts as C
from eddyline.operators import output as O
from eddyline.operators import pattern as P
from eddyline.operators import retain as R
from eddyline.operators import rowpattern as M
from eddyline.plans.stream import Stream


@pytest.fixture
def stream(spark):
    return lambda *rows: spark.createDataFrame([(t, i, *r) for i, (t, *r) in enumerate(rows)], "_ts long, _seq long, k string, v double")


def lives(df):
    return {r["_seq"]: (r["_in"]["ts"], r["_out"]["ts"] if r["_out"] else None) for r in df.collect()}


def test_eager_time_length_batches_count_from_the_start(stream):
    log = stream((3, "a", 1.0), (12, "a", 2.0), (13, "a", 3.0), (14, "a", 4.0), (47, "a", 5.0))
    lazy = lives(R.TimeLengthBatch(10, 3).lifetimes(log))
    eager = lives(R.TimeLengthBatch(10, 3, start=0).lifetimes(log))
    assert lazy[0] == (13, 23) and lazy[4] == (57, 67)
    assert eager[0] == (10, 14) and eager[1] == (14, 24) and eager[4] == (54, 64)
    assert {eager[i] for i in (1, 2, 3)} == {(14, 24)}


def test_previous_events_are_null_on_leaving_rows_and_prior_ones_stay(stream):
    log = stream((0, "a", 1.0), (1, "a", 2.0), (2, "a", 3.0), (3, "a", 4.0))
    seen = log.withColumn("prev", F.lag("v").over(R.ordered([]))).withColumn("prior", F.lag("v").over(R.ordered([])))
    out = R.changes(R.Length(2).lifetimes(seen), volatile=["prev"]).where("_op = '-'").orderBy("_seq").collect()
    assert [(r["_seq"], r["prev"], r["prior"]) for r in out] == [(0, None, None), (1, None, 1.0)]


def test_old_aggregates_start_where_they_were(stream):
    log = stream((0, "a", 5.0), (1, "a", 7.0))
    out = A.with_old(A.running(log, R.KeepAll(), n=F.count("*"), s=F.sum("v")), ["n", "s"], initial={"n": 0})
    assert sorted((r["_seq"], r["_op"], r["n"], r["s"]) for r in out.collect()) == [(0, "+", 1, 5.0), (0, "-", 0, None), (1, "+", 2, 12.0), (1, "-", 1, 5.0)]


def test_plain_statements_give_new_rows_and_local_groups_a_row_an_event(stream):
    log = stream((0, "a", 5.0), (1, "b", 7.0), (2, "a", 1.0))
    s = Stream(log).group_by("k").window(R.Length(1))
    assert "_op" not in s.aggregate(n=F.count("*")).df.columns and s.aggregate(n=F.count("*")).df.count() == 3
    assert log.select("_seq", A.local_group(F.sum("v"), "k").alias("s")).count() == 3


def test_output_conditions_on_patterns_count_matches(stream):
    log = stream(*((i, "a" if i % 3 else "b", float(i)) for i in range(20)))
    found = P.match(log, P.atom("x", lambda e, m: e["k"] == "b").every(), [], {"_seq": ("long", lambda m: m["x"]["_seq"])}).withColumnRenamed("_at", "_ts")
    assert found.count() == 7 and O.every_events(found, 2).count() == 6


def test_a_tick_comes_after_the_expiry_of_its_instant(stream):
    live = R.Time(10).lifetimes(stream((0, "a", 1.0), (5, "a", 2.0)))
    assert sorted((r["tick"], r["_seq"]) for r in O.snapshot_at(live, 0, 15, 5).collect()) == [(5, 0), (5, 1), (10, 1)]


def test_intervals_of_row_patterns_delay_their_output(stream):
    log = stream((1, "a", 1.0), (13, "a", 2.0), (15, "b", 3.0), (30, "c", 4.0))
    kind = lambda x: lambda row, tags, prev: row["k"] == x
    out = M.match_recognize(log, M.sequence(M.var("A"), M.var("B").zero_or_more()), [], {"A": kind("a"), "B": kind("b")}, {"n": ("long", M.count("B"))}, interval=10)
    assert sorted((r["_at"], r["n"]) for r in out.collect()) == [(11, 0), (23, 1)]


def test_periods_leave_their_end_out(stream):
    log = stream((0, "a", 1.0), (9, "a", 1.0), (10, "a", 1.0), (19, "a", 1.0), (20, "a", 1.0))
    assert [r["context_id"] for r in C.periods(log, 0, 10).orderBy("_seq").collect()] == [0, 0, 1, 1, 2]
    out = C.overlapping(log.withColumn("k", F.when(F.col("_seq") == 0, "s").otherwise("a")).withColumn("g", F.lit(1)), F.col("k") == "s", 10, ["g"])
    assert sorted(r["_seq"] for r in out.collect()) == [0, 1]
