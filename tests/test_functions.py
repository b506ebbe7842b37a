"""Functions, registry, state, dataflow, formats, connectors: small cases beyond the SQL comparison."""

import datetime as dt
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eddyline.functions import arrays, collections, compare, intervals, maths, udf
from eddyline.functions import datetime as dtf
from eddyline.operators import contexts, output, retain, state
from eddyline.plans import dataflow
from eddyline.plans.registry import Engine, load_artifact, order_modules
from eddyline.sources import connectors, formats


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_null_rules(spark):
    none = F.lit(None).cast("int")
    got = one(
        spark,
        between_null=compare.between(none, 1, 2),
        not_between_null=compare.not_between(none, 1, 2),
        swapped=compare.between(5, 9, 1),
        case_null=compare.CaseValue(none).when(None, "n").else_("x"),
        all_false=compare.all_of(1, compare.greater, [5, None]),
        any_null=compare.any_of(1, compare.greater, [5, None]),
        min_null=maths.min_of(1, none),
        zero=maths.divide(1, 0),
        infinite=maths.divide_with(1, 0, zero_gives_null=False),
        trunc=maths.divide_with(-7, 2, integer=True),
        failed=compare.cast(F.lit("x"), "int"),
        beyond=arrays.array_at(F.array(F.lit(1)), 4),
        both=maths.binary_and(F.lit(False), F.lit(None).cast("boolean")),
    )
    assert got == {"between_null": False, "not_between_null": False, "swapped": True, "case_null": "n", "all_false": False, "any_null": None, "min_null": None, "zero": None, "infinite": float("inf"), "trunc": -3, "failed": None, "beyond": None, "both": None}


def test_missing_is_not_null(spark):
    df = spark.createDataFrame([('{"a": null}',), ('{"b": 1}',), (None,)], "j string")
    assert [r[0] for r in df.select(compare.is_missing(F.col("j"), "a")).collect()] == [False, True, True]
    assert [r[0] for r in df.select(compare.exists(F.try_parse_json("j"), "$.a")).collect()] == [True, False, False]


def test_decimal_rounding_modes(spark):
    df = spark.createDataFrame([("2.5",), ("-2.5",), ("123456",)], "x string")
    show = lambda mode, p: [r[0] for r in df.select(maths.round_decimal(F.col("x"), p, mode)).collect()]
    assert show("HALF_UP", 1) == ["3", "-3", "100000"]
    assert show("HALF_EVEN", 1)[:2] == ["2", "-2"] and show("CEILING", 1)[:2] == ["3", "-2"]
    assert show("UNNECESSARY", 2) == ["2.5", "-2.5", None]


def test_calendar(spark):
    t = F.lit("2024-01-31 12:30:00").cast("timestamp_ntz")
    got = one(spark, carried=dtf.set_field(t, "day", 32).cast("string"), half=dtf.round_half(t, "month").cast("string"), top=dtf.round_ceiling(F.lit("2024-01-01").cast("timestamp_ntz"), "month").cast("string"), most=dtf.with_max(F.lit("2024-02-03").cast("timestamp_ntz"), "day").cast("string"), month0=dtf.get(t, "month"))
    assert got == {"carried": "2024-02-01 12:30:00", "half": "2024-02-01 00:00:00", "top": "2024-02-01 00:00:00", "most": "2024-02-29 00:00:00", "month0": 0}


def test_intervals_exclude_each_other(spark):
    rows = [(a, b, c, d) for a in range(4) for b in range(a, 4) for c in range(4) for d in range(c, 4)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    x, y = intervals.bounds(F.col("a"), F.col("b")), intervals.bounds(F.col("c"), F.col("d"))
    for r in df.select(*(f(x, y).alias(n) for n, f in intervals.RELATIONS.items()), "a", "b", "c", "d").collect():
        if r["a"] < r["b"] and r["c"] < r["d"]:  # proper intervals: exactly one relation holds
            assert sum(r[n] for n in intervals.RELATIONS) == 1, r


def test_collections(spark):
    v = F.array(*(F.lit(x) for x in (2, 3, 2, 1)))
    got = one(spark, d=collections.distinct(v), f=collections.most_frequent(v), l=collections.least_frequent(v), w=collections.take_while_last(v, lambda x: x < 3), m=collections.min_by(v, lambda x: -x), t=collections.to_map(v, lambda x: x % 2, lambda x: x), n=collections.sum_of(F.array().cast("array<int>")), p=collections.plugin(v, lambda xs: sum(xs), "long"))
    assert got == {"d": [2, 3, 1], "f": 2, "l": 3, "w": [2, 1], "m": 3, "t": {1: 1, 0: 2}, "n": None, "p": 8}


def test_scripts_and_udfs(spark):
    s = udf.Scripts()
    s.register("twice", lambda x: x * 2, "long", arguments=1)
    assert one(spark, a=s.call("twice", F.lit(4)), b=udf.method(F.lit("ab"), "upper", "string"), c=udf.method(F.lit("ab"), "nope", "string")) == {"a": 8, "b": "AB", "c": None}
    with pytest.raises(TypeError):
        s.call("twice")


def test_registry_and_engine(spark):
    e = Engine(spark)
    e.types.register("Parent", "id long")
    e.types.register("Child", "name string", parents=["Parent"])
    assert e.types.get("Child").schema.names == ["id", "name"]
    e.bind("Child", spark.createDataFrame([(1, "x")], "id long, name string"))
    assert e.source("Parent").first()["_type"] == "Child"
    with pytest.raises(TypeError):
        e.types.register("Bad", "id string", parents=["Parent"])
    plan = e.compile("all", lambda en: en.source("Parent").select("id"))
    with pytest.raises(Exception):  # noqa: B017
        e.compile("wrong", lambda en: en.source("Parent").select("nope"))
    e.deploy(plan)
    with pytest.raises(KeyError):
        e.deploy(e.compile("user", lambda en: en.execute("all"), uses=["missing"]))
    e.deploy(e.compile("user", lambda en: en.execute("all"), uses=["all"]))
    with pytest.raises(ValueError):
        e.undeploy("all")
    assert e.execute("user").first()["id"] == 1 and load_artifact(plan.artifact())["name"] == "all"
    e.insert_into("user", "Copies")
    assert e.source("Copies").count() == 1
    assert order_modules({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        order_modules({"a": ["b"], "b": ["a"]})
    e.variables.define("v", "int", 1)
    heard = []
    e.variables.on_change(lambda *x: heard.append(x))
    e.variables.set(v=2)
    assert heard == [("v", 1, 2)] and one(spark, v=e.variables.ref("v")) == {"v": 2}


def test_store_rolls_back(spark):
    s = state.Store()
    s.create("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    with pytest.raises(ValueError):
        s.atomically(lambda x: x.update("t", F.lit(True), v=F.lit("z")), lambda x: x.insert("t", spark.createDataFrame([(1, "dup")], "k int, v string")))
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "b")]
    s.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted(map(tuple, s.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_split_all_and_default(spark):
    parts = state.split(spark.range(6), ("even", F.col("id") % 2 == 0), ("big", F.col("id") > 3), first=False)
    assert [parts[k].count() for k in ("even", "big", None)] == [3, 2, 2]


def test_dataflow_feedback_and_cycles(spark):
    f = dataflow.Dataflow("f").add(dataflow.source("s", spark.range(1)))
    f.add(dataflow.custom("plus", lambda d: d.withColumn("id", F.col("id") + 1))).connect("s", "plus").connect_feedback("plus", "plus", 3)
    assert sorted(r["id"] for r in f.run()["plus"]["out"].collect()) == [1, 2, 3, 4]
    bad = dataflow.Dataflow("b").add(dataflow.custom("x", lambda d: d)).add(dataflow.custom("y", lambda d: d)).connect("x", "y").connect("y", "x")
    with pytest.raises(ValueError):
        bad.order()


def test_cron(spark):
    five = output.Schedule(output.step(5), output.values(9), output.wildcard(), output.wildcard(), output.span(1, 5))
    got = [t for t, _ in zip(five.after(dt.datetime(2024, 1, 5, 9, 52)), range(3))]
    assert got == [dt.datetime(2024, 1, 5, 9, 55), dt.datetime(2024, 1, 8, 9, 0), dt.datetime(2024, 1, 8, 9, 5)]
    last = output.Schedule(output.values(0), output.values(0), output.last_day(), output.wildcard(), output.wildcard())
    assert next(last.after(dt.datetime(2024, 2, 1))) == dt.datetime(2024, 2, 29)
    near = output.Schedule(output.values(0), output.values(0), output.nearest_weekday(1), output.wildcard(), output.wildcard())
    assert next(near.after(dt.datetime(2024, 5, 31, 12))) == dt.datetime(2024, 6, 3)


def test_hash_contexts(spark):
    df = spark.createDataFrame([("E1",), ("hello",)], "k string")
    java = [r["context_id"] for r in contexts.hashed(df, "k", 1 << 20, "java").collect()]
    assert java == [2188 % (1 << 20), 99162322 % (1 << 20)]
    assert [r["context_id"] for r in contexts.hashed(df, "k", 1 << 16, "fnv1a").collect()][1] == 0x4F9F2CAB % (1 << 16)


def test_formats(spark):
    df = spark.createDataFrame([('{"a": 1, "z": 2}', "<r a='x'><b>2</b></r>", "a=1,b=2")], "j string, x string, p string")
    assert formats.parse_json(df, "j", "a int", reject_unknown=True).count() == 0
    assert formats.parse_json(df, "j", "a int, c int", defaults={"c": 7}).select("a", "c").first().asDict() == {"a": 1, "c": 7}
    assert formats.parse_xml(df, "x", "`@a` string, b int").first()["b"] == 2
    assert formats.parse_properties(df, "p", ["a", "b"]).first()["b"] == "2"
    assert formats.beacon(spark, 3, 10, n=F.col("id") * 2).agg(F.sum("n")).first()[0] == 6


def test_database_sinks_and_lookup(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as c:
        c.execute("create table t (k integer primary key, v text)")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1)
    connectors.db_upsert(df, "sqlite3", {"database": path}, "t", ["k"], ["v"])
    connectors.db_upsert(df.withColumn("v", F.lit("z")).where("k = 2"), "sqlite3", {"database": path}, "t", ["k"], ["v"])
    with sqlite3.connect(path) as c:
        assert c.execute("select * from t order by k").fetchall() == [(1, "a"), (2, "z")]
    found = connectors.lookup(df, ["k"], lambda r: [{"n": r["k"] * 10}, {"n": r["k"]}], "n long")
    assert sorted(r["n"] for r in found.collect()) == [1, 2, 10, 20]
    with pytest.raises(RuntimeError):
        connectors.client("no_such_client")


def test_csv_round_trip(spark, tmp_path):
    formats.write_csv(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "c"))
    assert formats.read_csv(spark, str(tmp_path / "c"), "k int, v string").first().asDict() == {"k": 1, "v": "a"}


def test_grouped_plugin_aggregate(spark):
    a = udf.Aggregates()
    a.register("spread", spread, "double")
    df = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0)], "k int, v double")
    assert {r["k"]: r["s"] for r in df.groupBy("k").agg(a.call("spread", F.col("v")).alias("s")).collect()} == {1: 3.0, 2: 0.0}


def spread(s: pd.Series) -> float:
    return float(s.max() - s.min())


def test_retained_names():
    assert retain.KeepAll().frame() is not None and retain.Sort(1, ("v",)).frame() is None


def test_iso_schedules():
    got = output.iso_schedule("R3/2012-10-01T05:52:00Z/PT2S")
    assert got == [dt.datetime(2012, 10, 1, 5, 52, s) for s in (0, 2, 4)]
    assert output.iso_schedule("R2/P1M", dt.datetime(2024, 1, 31)) == [dt.datetime(2024, 2, 29), dt.datetime(2024, 3, 31)]
    assert output.iso_schedule("2024-01-01T00:00:00Z") == [dt.datetime(2024, 1, 1)]


def test_virtual_window_and_observation(spark):
    from eddyline.sources.virtual import virtual_window
    from eddyline.streaming.metrics import observed

    df = virtual_window(spark, "numbers", "k int", lambda i: iter([(i,), (i + 10,)]), 2)
    seen, result = observed(df, "o", n=F.count("*"))
    assert sorted(r["k"] for r in seen.collect()) == [0, 1, 10, 11] and result.get["n"] == 4
