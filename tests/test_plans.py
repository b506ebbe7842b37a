"""Plans against the state machines and plain loops they replace, on random streams."""

import random

import pytest
from pyspark.sql import functions as F

from eddyline.operators import contexts as C
from eddyline.operators import joins as J
from eddyline.operators import output as O
from eddyline.operators import pattern as P
from eddyline.operators import retain as R
from eddyline.operators import rowpattern as M
from eddyline.operators import state as S
from eddyline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
NO_PYTHON = ["pattern_and", "pattern_or", "pattern_until", "pattern_every_distinct", "rowpattern_rise", "rowpattern_runs", "output_when", "window_expression", "window_expression_batch", "window_sort", "table_merge"]


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(7)
    rows = [(i * 10 + rnd.randrange(3), i, rnd.choice([1, 2, 3, None]), rnd.choice("abcd"), float(rnd.randrange(6)) if rnd.random() < 0.95 else None) for i in range(400)]
    return spark.createDataFrame(rows, "_ts long, _seq long, k int, t string, v double").cache()


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_in_the_plan(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text and "NestedLoop" not in text


def kind(x):
    return F.col("t") == x, lambda e, m: e["t"] == x


def test_patterns_by_plan_and_by_states(log):
    (ca, fa), (cb, fb), (cc, fc) = kind("a"), kind("b"), kind("c")
    forms = [
        lambda a, b, c, k: a.and_(b),
        lambda a, b, c, k: a.or_(b),
        lambda a, b, c, k: a.until(b, low=2),
        lambda a, b, c, k: a.until(b),
        lambda a, b, c, k: a.every().then(b),
        lambda a, b, c, k: a.every().then(b.within(150)),
        lambda a, b, c, k: a.every_distinct(k),
    ]
    for form in forms:
        plain = form(P.atom("a", ca), P.atom("b", cb), P.atom("c", cc), F.col("v"))
        states = form(P.atom("a", fa), P.atom("b", fb), P.atom("c", fc), lambda m: None if m["a"]["v"] != m["a"]["v"] else m["a"]["v"])
        made = P.plan(log, plain, ["k"])
        assert made is not None
        one = lambda tag: lambda m: (m[tag][0] if m[tag] else {"_seq": None})["_seq"] if isinstance(m.get(tag), list) else (m.get(tag) or {"_seq": None})["_seq"]
        has = lambda tag: (F.get(F.col(tag), F.lit(0)) if made.schema[tag].dataType.typeName() == "array" else F.col(tag))["_seq"] if tag in made.columns else F.lit(None).cast("long")
        want = P.match(log, states, ["k"], {"x": ("long", one("a")), "y": ("long", one("b"))})
        assert bag(made.select("k", "_at", has("a").alias("x"), has("b").alias("y"))) == bag(want)
        flagged = P.match(log, plain, ["k"], {"x": ("long", one("a")), "y": ("long", one("b"))}) if not isinstance(plain, P.EveryDistinct) else want
        assert bag(flagged) == bag(want)


def test_columns_need_a_plan(log):
    with pytest.raises(TypeError):
        P.match(log, P.atom("a", F.col("t") == "a").then(P.atom("b", F.col("t") == "b")), ["k"], {"x": F.col("a._seq")})


@pytest.mark.parametrize("low", [1, 2, 3])
def test_row_patterns_by_plan_and_by_matcher(log, low):
    log = log.where("v is not null")  # pandas has no null among numbers
    rise = M.Shifted(lambda prev: F.col("v") > prev("v"))
    slow = lambda row, tags, prev: prev(1, "v") is not None and row["v"] > prev(1, "v")
    measures = {"a": ("long", M.first("A", "_seq")), "b": ("long", M.last("B", "_seq")), "f": ("long", M.first("B", "_seq")), "n": ("long", M.size()), "nb": ("long", M.count("B")), "s": ("double", M.total("B", "v")), "lo": ("double", M.least("B", "v")), "hi": ("double", M.greatest("A", "_seq"))}
    runs = M.sequence(M.var("A"), M.var("B").repeat(low))
    made = M.plan(log, runs, ["k"], {"B": rise}, measures)
    assert bag(made) == bag(M.match_recognize(log, runs, ["k"], {"B": slow}, measures))
    row = M.sequence(M.var("A"), M.var("B"), M.var("C"))
    high = F.col("v") >= 3
    made = M.plan(log, row, ["k"], {"B": rise, "C": high}, measures, skip="to_next_row")
    want = M.match_recognize(log, row, ["k"], {"B": slow, "C": lambda r, tags, prev: r["v"] >= 3}, measures, skip="to_next_row")
    assert made.count() > 5 and bag(made) == bag(want)
    assert M.plan(log, row, ["k"], {"B": rise}, measures) is None
    mixed = M.match_recognize(log, row, ["k"], {"B": rise, "C": high}, measures)
    assert mixed.count() > 0


def test_expression_windows_and_outputs_by_plan_and_by_fold(log):
    shown = lambda d: bag(d.select("_seq", "_in", "_out"))
    for n in (2, 5):
        assert shown(R.Expression(R.CountBelow(n)).lifetimes(log, ["k"])) == shown(R.Expression(lambda s: s.current_count < n).lifetimes(log, ["k"]))
        assert shown(R.ExpressionBatch(R.CountFrom(n)).lifetimes(log, ["k"])) == shown(R.ExpressionBatch(lambda s: s.current_count >= n).lifetimes(log, ["k"]))
        marked = log.withColumn("_op", F.when(F.col("t") == "a", "-").otherwise("+"))
        for df in (log, marked):
            assert bag(O.when(df, O.InsertsFrom(n), ["k"]).select("_seq", "_batch")) == bag(O.when(df, lambda c: c.count_insert >= n, ["k"]).select("_seq", "_batch"))
    assert shown(R.Expression(R.AgeBelow(100)).lifetimes(log, ["k"])) == shown(R.Expression(lambda s: s.newest_timestamp - s.oldest_timestamp < 100).lifetimes(log, ["k"]))
    whole = log.where("v is not null")
    one = R.Sort(3, ("-v",))
    assert bag(one.retained(whole, ["k"]).select("_seq")) == bag(R.snapshot(one.lifetimes(whole, ["k"])).select("_seq"))


def test_bucketed_joins_against_every_pair(spark, log):
    rows = [r.asDict() for r in log.collect()]
    a, b = log.where("t = 'a'"), log.where("t = 'b'")
    for x, y in ((70, 70), (30, 200), (1, 5)):
        want = sorted((i["_seq"], j["_seq"]) for i in rows for j in rows if i["t"] == "a" and j["t"] == "b" and i["k"] is not None and i["k"] == j["k"] and max((i["_ts"], i["_seq"]), (j["_ts"], j["_seq"])) < min((i["_ts"] + x, -1), (j["_ts"] + y, -1)))
        got = J.windowed(a, b, [("k", "k")], R.Time(x), R.Time(y))
        assert sorted((r[0], r[1]) for r in got.select(F.col("l._seq"), F.col("r._seq").alias("s")).collect()) == want
    want = sorted((i["_seq"], j["_seq"]) for i in rows for j in rows if i["t"] == "a" and i["k"] is not None and i["k"] == j["k"] and (j["_ts"], j["_seq"]) < (i["_ts"], i["_seq"]) < (j["_ts"] + 90, -1))
    got = S.on_select(a, log, R.Time(90), [("k", "k")])
    assert sorted((r[0], r[1]) for r in got.select(F.col("t._seq"), F.col("w._seq").alias("s")).collect()) == want
    spans = spark.createDataFrame([(1, 15, 400), (1, 900, None), (2, 40, 41), (2, 100, 90), (3, 0, 10**9), (None, 0, 50)], "k int, _from long, _to long")
    want = sorted((r["_seq"], f) for r in rows for k, f, to in ((1, 15, 400), (1, 900, None), (2, 40, 41), (3, 0, 10**9)) if r["k"] == k and r["_ts"] > f and (to is None or r["_ts"] < to))
    assert sorted((r["_seq"], r["context_id"]) for r in C.by_intervals(log, spans, ["k"], bucket_us=100).collect()) == want


def test_deletes_and_resets_against_loops(log):
    rows = [r.asDict() for r in log.collect()]
    live = R.Time(120).lifetimes(log.where("t <> 'd'"), ["k"])
    got = {r["_seq"]: r["_out"] for r in S.on_delete(live, log.where("t = 'd'"), [("k", "k")]).collect()}
    for r in rows:
        if r["t"] != "d":
            cuts = [(d["_ts"], d["_seq"]) for d in rows if d["t"] == "d" and r["k"] is not None and d["k"] == r["k"] and (d["_ts"], d["_seq"]) > (r["_ts"], r["_seq"])]
            assert tuple(got[r["_seq"]]) == min([*cuts, (r["_ts"] + 120, -1)])
    made = {r["k"]: r["n"] for r in S.since_last(log, ["k"], F.col("t") == "d", n=F.count("*")).collect()}
    want = {}
    for r in sorted(rows, key=lambda r: (r["_ts"], r["_seq"])):
        if r["t"] == "d":
            want.pop(r["k"], None)
        else:
            want[r["k"]] = want.get(r["k"], 0) + 1
    assert made == want


def test_spread_keys_against_one_task_a_key(log):
    from eddyline.operators import aggregate as A

    w = A.ever(["k"])
    both = log.unionByName(log.where("_seq < 3").withColumn("_ts", F.lit(None).cast("long")).withColumn("_seq", F.col("_seq") - 10))
    want = both.select("_seq", F.first("v").over(w).alias("a"), F.last("v").over(w).alias("b"), F.max("v").over(w).alias("c"), F.count("v").over(w).alias("d"), F.sum("v").over(w).alias("e"))
    got = A.running_unkeyed(both, 130, ["k"], a=("first", "v"), b=("last", "v"), c=("max", "v"), d=("count", "v"), e=("sum", "v"))
    assert bag(got.select("_seq", "a", "b", "c", "d", "e")) == bag(want)
    for us, spans in ((70, 8), (70, 1), (1, 3), (5000, 2)):
        want = A.running(log, R.Time(us), ["k"], n=F.count("*"), s=F.sum("v"))
        got = A.running_spread(log, "_ts", us, ["k"], spans, n=F.count("*"), s=F.sum("v"))
        assert bag(got.select("_seq", "n", "s")) == bag(want.select("_seq", "n", "s"))
