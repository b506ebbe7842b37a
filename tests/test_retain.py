"""Lifetimes of data windows on small traces."""

import random

from pyspark.sql import functions as F

from eddyline.operators import retain as R

S = R.SECOND


def stream(spark, rows):
    return spark.createDataFrame([(i, int(t * S), v) for i, (t, v) in enumerate(rows)], "_seq long, _ts long, v double")


def lives(df):
    return {r["_seq"]: (r["_in"] and tuple(r["_in"]), r["_out"] and tuple(r["_out"])) for r in df.collect()}


def test_length_window_evicts_the_oldest(spark):
    got = lives(R.Length(2).lifetimes(stream(spark, [(0, 10.0), (1, 11.0), (2, 12.0), (3, 13.0)])))
    assert got[0] == ((0, 0), (2 * S, 2)) and got[2][1] is None


def test_time_window_ends_at_exactly_its_length(spark):
    live = R.Time(S).lifetimes(stream(spark, [(0, 1.0)]))
    assert R.snapshot(live, S - 1).count() == 1
    assert R.snapshot(live, S).count() == 0


def test_time_batch_anchors_and_falls_silent(spark):
    got = lives(R.TimeBatch(10 * S).lifetimes(stream(spark, [(1, 1.0), (2, 2.0), (11, 3.0), (45, 4.0)])))
    assert got[0] == ((11 * S, -1), (21 * S, -1)) == got[1]
    assert got[2] == ((21 * S, -1), (31 * S, -1))
    assert got[3] == ((55 * S, -1), (65 * S, -1))  # the schedule had stopped; a late event starts anew


def test_time_accum_lets_all_go_together(spark):
    got = lives(R.TimeAccum(10 * S).lifetimes(stream(spark, [(0, 1.0), (5, 2.0), (20, 3.0)])))
    assert got[0][1] == got[1][1] == (15 * S, -1) and got[2][1] == (30 * S, -1)


def test_late_event_of_time_order_enters_and_leaves(spark):
    df = stream(spark, [(25, 1.0)]).withColumn("stamp", F.lit(15 * S).cast("long"))
    assert lives(R.TimeOrder("stamp", 10 * S).lifetimes(df))[0] == ((25 * S, 0), (25 * S, 0))


def test_sort_and_rank_against_a_plain_reference(spark):
    rnd = random.Random(5)
    rows = [(i, float(rnd.randrange(20))) for i in range(60)]
    df = stream(spark, rows).withColumn("u", F.col("_seq") % 7)
    held: list = []
    for i, (_, v) in enumerate(rows):
        held = sorted([*held, (v, -i)])[:4]
    assert {r["_seq"] for r in R.snapshot(R.Sort(4, ("v",)).lifetimes(df)).collect()} == {-i for _, i in held}
    held = []
    for i, (_, v) in enumerate(rows):
        held = sorted([*(h for h in held if -h[1] % 7 != i % 7), (v, -i)])[:3]
    assert {r["_seq"] for r in R.snapshot(R.Rank(3, ("u",), ("v",)).lifetimes(df)).collect()} == {-i for _, i in held}


def test_time_length_batch_flushes_by_count_or_time(spark):
    got = lives(R.TimeLengthBatch(10 * S, 3).lifetimes(stream(spark, [(0, 1.0), (1, 1.0), (2, 1.0), (5, 1.0), (20, 1.0)])))
    assert got[0][0] == got[2][0] == (2 * S, 2)
    assert got[3][0] == (12 * S, -1) and got[0][1] == (12 * S, -1)


def test_expression_batch_without_its_trigger(spark):
    df = stream(spark, [(i, float(i)) for i in range(6)])
    got = lives(R.ExpressionBatch(lambda s: s.current_count >= 3, include_trigger=False).lifetimes(df))
    assert got[0][0] == got[1][0] == (2 * S, 2) and got[2][0] == (4 * S, 4)


def test_composites(spark):
    df = stream(spark, [(0, 1.0), (1, 1.0), (2, 1.0), (30, 1.0)])
    union = R.snapshot_at_end(R.UnionOf(R.Length(2), R.Time(10 * S)).lifetimes(df))
    both = R.snapshot_at_end(R.IntersectOf(R.Length(2), R.Time(10 * S)).lifetimes(df))
    assert {r["_seq"] for r in union.collect()} == {2, 3} and {r["_seq"] for r in both.collect()} == {3}


def test_empty_stream(spark):
    df = stream(spark, [(0, 1.0)]).where("false")
    for p in (R.Length(2), R.Time(S), R.TimeBatch(S), R.Sort(2, ("v",)), R.TimeAccum(S)):
        assert p.lifetimes(df).count() == 0


def test_calendar_batches(spark):
    day = 86400
    df = stream(spark, [(30 * day, 1.0), (31 * day, 1.0), (59 * day, 1.0), (400 * day, 1.0)])  # from 31 January 1970
    got = lives(R.TimeBatchCalendar(1).lifetimes(df))
    assert got[0] == got[1] == ((58 * day * S, -1), (89 * day * S, -1)) and got[2][0] == (89 * day * S, -1)
    assert got[3][0][0] > 400 * day * S


def test_ends_of_externally_timed_windows_over_buckets(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.randrange(200 * 86400) * S, rnd.choice("abc")) for i in range(300)] + [(300, 5 * S, None), (300, 6 * S, "a")]
    rows = [(i, t, k) for (i, _, k), t in zip(rows, sorted(t for _, t, _ in rows), strict=True)]
    df = spark.createDataFrame(rows, "_seq long, _ts long, k string")

    def want(end):
        return sorted((i, t, min((u, j) for j, u, x in rows if x == k and u >= end(t)) if any(x == k and u >= end(t) for _, u, x in rows) else None) for i, t, k in rows if k)

    def got(policy):
        live = policy.lifetimes(df, ["k"])
        assert "unboundedfollowing" not in live._jdf.queryExecution().toString().lower()  # such a frame is quadratic
        return sorted((r["_seq"], r["_ts"], r["_out"] and tuple(r["_out"])) for r in live.where("k is not null").collect())

    assert got(R.ExternallyTimed("_ts", 3 * 86400 * S)) == want(lambda t: t + 3 * 86400 * S)
    assert got(R.ExternallyTimedCalendar("_ts", days=3)) == want(lambda t: t + 3 * 86400 * S)
    assert R.ExternallyTimedCalendar("_ts", days=3).lifetimes(df, ["k"]).count() == len(rows)


def small_batches(spark, df, policy, by):
    """Lifetimes with a key's events over many batches, from a fold that never holds a whole key."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        live = policy.lifetimes(df, by)
        assert "FlatMapGroups" not in live._jdf.queryExecution().toString()
        return lives(live)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rank_streams_over_batches_with_nulls_as_the_worst(spark):
    rnd = random.Random(3)
    rows = [(i, i * S, rnd.choice([0.0, -0.0, float("nan")]), i * 7 % 11, None if i % 9 == 4 else float(rnd.randrange(20))) for i in range(200)]
    df = spark.createDataFrame(rows, "_seq long, _ts long, k double, u long, v double")
    want, held = {}, {}
    for i, t, k, u, v in rows:
        mine = held.setdefault("nan" if k != k else 0.0, [])
        new = sorted([*(h for h in mine if h[2] != u), (0 if v is None else -v, -i, u)], key=lambda h: (h[0] == 0 and rows[-h[1]][4] is None, *h))[:3]
        for _, j, _ in mine:
            if -j not in {-h[1] for h in new}:
                want[-j] = ((rows[-j][1], -j), (t, i))
        want[i] = ((t, i), None if -i in {h[1] for h in new} else (t, i))
        held["nan" if k != k else 0.0] = new
    assert small_batches(spark, df, R.Rank(3, ("u",), ("-v",)), ["k"]) == want
    assert {r["_seq"] for r in R.Rank(3, ("u",), ("-v",)).retained(df, ["k"]).collect()} == {i for i, (_, out) in want.items() if out is None}


def test_time_batches_of_many_keys_stream_over_batches(spark):
    rnd = random.Random(4)
    rows = [(i, t, f"u{rnd.randrange(6)}") for i, t in enumerate(sorted(rnd.randrange(900) for _ in range(200)))]
    df = spark.createDataFrame(rows, "_seq long, _ts long, k string")
    want, due = {}, {}
    for i, t, k in rows:
        if k not in due or t >= due[k] + 20:
            due[k] = t + 20
        elif t >= due[k]:
            due[k] += 20
        want[i] = ((due[k], -1), (due[k] + 20, -1))
    assert small_batches(spark, df, R.TimeBatch(20), ["k"]) == want
    fixed = {i: ((t // 20 * 20 + 20, -1), (t // 20 * 20 + 40, -1)) for i, t, _ in rows}
    assert small_batches(spark, df, R.TimeBatch(20, reference=40), ["k"]) == fixed
