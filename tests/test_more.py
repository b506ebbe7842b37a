"""Routing, engine, formats and sketches: what the registered queries do not reach."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from eddyline.functions import udf
from eddyline.operators import aggregate as A
from eddyline.operators import output as O
from eddyline.operators import routing as G
from eddyline.operators import state as S
from eddyline.plans import dataflow as D
from eddyline.plans.registry import Engine
from eddyline.sources import avro, placeholders


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(1)
    return spark.createDataFrame([(i * 10, i, rnd.choice("ab"), rnd.choice("xyz"), float(rnd.randrange(9))) for i in range(60)], "_ts long, _seq long, k string, t string, v double")


def test_placeholders():
    sql = "select '?', \"a?\", `b?`, x -- is it?\n from t /* ? */ where a = ? and b = ? and c = 'it''s ?'"
    assert placeholders.positional(sql, "dollar").count("$") == 2 and "a = $1 and b = $2" in placeholders.positional(sql, "dollar")
    assert "a = :5 and b = :6" in placeholders.positional(sql, "colon", 5) and placeholders.positional(sql) == sql
    assert placeholders.named("a = ${x} or b = ${y} or c = ${x} or '${z}'", "at") == ("a = @p1 or b = @p2 or c = @p3 or '${z}'", ["x", "y", "x"])
    assert placeholders.bound("a = ${x}", {"x": 3}) == ("a = ?", [3])
    with pytest.raises(KeyError):
        placeholders.bound("a = ${x}", {})
    with pytest.raises(ValueError):
        placeholders.positional("?", "roman")


SCHEMA = {
    "type": "record",
    "name": "R",
    "fields": [
        {"name": "b", "type": "boolean"},
        {"name": "i", "type": "int"},
        {"name": "l", "type": ["null", "long"]},
        {"name": "f", "type": "float"},
        {"name": "d", "type": ["double", "null"]},
        {"name": "s", "type": "string"},
        {"name": "y", "type": "bytes"},
        {"name": "e", "type": {"type": "enum", "name": "E", "symbols": ["A", "B"]}},
        {"name": "x", "type": {"type": "fixed", "name": "X", "size": 3}},
        {"name": "a", "type": {"type": "array", "items": "long"}},
        {"name": "m", "type": {"type": "map", "values": "string"}},
        {"name": "r", "type": {"type": "record", "name": "S", "fields": [{"name": "z", "type": "string"}]}},
    ],
}


def test_avro_round_trip_and_bad_records(spark):
    rows = [
        (True, -1, None, 1.5, 2.25, "é", b"\0\xff", "A", b"abc", [1, -(1 << 62), 1 << 62], {"k": "v"}, ("n",)),
        (False, 2**31 - 1, -(1 << 63), 0.0, None, "", b"", "B", b"\0\0\0", [], {}, ("",)),
    ]
    df = spark.createDataFrame(rows, ", ".join(f"{f['name']} {avro.spark_type(f['type'])}" for f in SCHEMA["fields"]))
    raw = df.select("*", avro.to_avro(F.struct(*df.columns), SCHEMA).alias("raw"))
    back = raw.select("raw", avro.from_avro("raw", SCHEMA).alias("b")).select("b.*")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    first = bytes(raw.where("b").first()["raw"])
    assert first[:3] == b"\x01\x01\x00"  # true, -1 in zigzag, first branch of the union
    odd = spark.createDataFrame([(first[:5],), (b"",), (None,), (first + b"more",)], "raw binary").select(avro.from_avro("raw", SCHEMA).alias("b"))
    assert [r["b"] is None for r in odd.collect()] == [True, True, True, False]
    bad = spark.createDataFrame([("C",)], "e string").select(avro.to_avro(F.struct("e"), {"type": "record", "name": "Q", "fields": [SCHEMA["fields"][7]]}).alias("r"))
    assert bad.first()["r"] is None


def test_avro_json_unions_defaults_and_enums(spark):
    schema = '{"type":"record","name":"T","fields":[{"name":"s","type":"string"},{"name":"q","type":["null","long"]},{"name":"e","type":{"type":"enum","name":"E","symbols":["A"]}}]}'
    texts = ['{"s":"a","q":{"long":4},"e":"A"}', '{"s":"b","q":null,"e":"Z"}', '{"s":"c","q":5,"e":"A"}', "junk", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", avro.parse_avro_json("t", schema).alias("r")).orderBy("i").collect()
    assert [(r["r"]["s"], r["r"]["q"], r["r"]["e"]) for r in got[:3]] == [("a", 4, "A"), ("b", None, None), ("c", 5, "A")]
    assert got[4]["r"] is None
    with pytest.raises(ValueError):
        avro.spark_type(["int", "string"])


@pytest.mark.parametrize("kind", ["long", "string", "int"])
def test_sketch_frequencies(spark, kind):
    rnd = random.Random(2)
    values = [rnd.randrange(-40, 40) ** 3 for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(F.col("v").cast(kind))
    sketch = df.agg(A.count_min_sketch(F.col("v"), 0.01, 0.99, 3).alias("s"))
    found = df.groupBy("v").count().crossJoin(sketch).select("v", "count", A.count_min_frequency(F.col("s"), F.col("v")).alias("f")).collect()
    assert all(r["count"] <= r["f"] <= r["count"] + 80 for r in found) and sum(r["f"] == r["count"] for r in found) > len(found) * 0.8
    assert A.sketch_frequency(None, 1) is None and A.sketch_frequency(b"", None) is None


def test_delivery_by_group_and_row_by_row(log):
    batches = O.every_events(log, 10)
    seen: list[list[dict]] = []
    G.deliver(G.grouped_delivery(batches, ["t"]), seen.append)
    assert sum(map(len, seen)) == 60 and all(len({r["t"] for r in rows}) == 1 for rows in seen)
    firsts = [(rows[0]["_batch"], rows[0]["_seq"]) for rows in seen]
    assert firsts == sorted(firsts) and len(seen) == len({(r["_batch"], r["t"]) for rows in seen for r in rows})
    one: list[list[dict]] = []
    G.deliver(G.discrete_delivery(batches), one.append)
    assert [rows[0]["_seq"] for rows in one] == list(range(60)) and all(len(rows) == 1 for rows in one)


def test_routing_edges(spark, log):
    low = log.withColumn("p", F.when(F.col("k") == "a", F.lit(None)).otherwise(F.lit(-1)))
    out = G.by_precedence((low, F.col("p")), (log, 0)).collect()
    order = {(r["_seq"], r["_precedence"], r["_order"]) for r in out}
    assert all((r["_seq"], 0, 0) in order for r in out)
    assert G.iterable_unbound(log).first()["_seq"] == 59 and G.iterable_unbound(log.where("false")).count() == 0
    target = spark.createDataFrame([], "v string, w int")
    assert [tuple(r) for r in G.copy_matching(log.limit(1), target).collect()][0][1] is None


def test_select_and_delete(log):
    from eddyline.operators import retain as R

    live = R.KeepAll().lifetimes(log.where("t <> 'z'"))
    taken, left = S.on_select_delete(live, log.where("t = 'z'"), [("k", "k")])
    assert taken.count() + R.snapshot(left).count() == log.where("t <> 'z'").count()
    rows = log.collect()
    for r in taken.collect():
        later = [x["_seq"] for x in rows if x["t"] == "z" and x["k"] == r["k"] and x["_seq"] > r["_seq"]]
        assert r["_at"]["seq"] == later[0]


def test_terminated_forms(log):
    assert O.terminated(log, ["k"], "all").count() == 60 and O.terminated(log, ["k"], "first").count() == 2
    assert O.terminated(log, ["k"], "last", F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        O.terminated(log, ["k"], "some")
    assert sorted((r["_seq"], r["tick"]) for r in O.at_instants(log, [-5, 0, 95, 300]).collect()) == [(i, 0 if i == 0 else 95 if i < 10 else 300) for i in range(31)]


def test_clock_sending_and_types(spark):
    e = Engine(spark)
    e.types.register("p", "a int, b string", ignore_case=True, adapters={"a": lambda c: c.cast("int")}, defaults={"b": "?"})
    e.publish("p", spark.createDataFrame([("7", None, 5, 0)], "A string, B string, _ts long, _seq long"))
    e.advance_time(10)
    e.send("p", {"a": 1, "b": "x"}, [2, None])
    e.send_text("p", ['{"a": 3, "b": "j"}', "junk"], ts=50)
    assert sorted((r["a"], r["b"]) for r in e.source("p").collect()) == [(1, "x"), (2, "?"), (7, "?")]
    assert e.advance_span(60, 20) == [30, 50, 60] and e.source("p").where("a = 3").count() == 1
    with pytest.raises(ValueError):
        e.advance_time(3)
    with pytest.raises(TypeError):
        e.send("p", [1])
    t = e.types.auto_name(spark.createDataFrame([], "x int, _ts long"))
    assert e.types.auto_name(spark.createDataFrame([], "x int")) is t and t.name.startswith("auto_")
    plan = e.compile("s", lambda en: en.source("p"), hints=["index", "index"], annotations={"note": 1})
    assert plan.hints == ("index",) and dict(plan.annotations) == {"note": 1}
    got = spark.range(1).select(e.context_of("s", F.lit("k1")).alias("c")).first()["c"]
    assert (got["statement"], got["partition"], got["time"]) == ("s", "k1", 60)


def test_dataflow_properties_signals_and_emitters(spark):
    rows = spark.range(3)
    flow = D.Dataflow("f").add(D.emitter("a", rows)).add(D.Operator("b", lambda i: {"out": i[0]}, properties={"enabled": True, "n": "x"}))
    flow.connect("a", "b")
    assert flow.operators["b"].property("enabled", bool) is True and flow.operators["b"].property("other", int, 4) == 4
    with pytest.raises(TypeError):
        flow.operators["b"].property("n", int)
    assert flow.run()["b"]["out"].count() == 0
    assert flow.emit("a", rows).emit("a", rows).run()["b"]["out"].count() == 6
    with pytest.raises(KeyError):
        flow.emit("a", rows, "none")
    seen = []
    flow.on_signal("b", seen.append)
    assert flow.submit_signal("a", D.Signal("window")) == ["b"] and seen[0].name == "window"
    with pytest.raises(KeyError):
        flow.on_signal("c", print)


def test_multi_aggregates(spark):
    m = udf.MultiAggregates()
    m.register("both", lambda a, b: (a.sum(), b.max()), {"total": ("double", lambda s: float(s[0])), "top": ("long", lambda s: s[1])})
    df = spark.createDataFrame([(1, 2.0, 3), (1, 4.0, 1), (2, 1.0, 9)], "k int, a double, b long")
    got = {r["k"]: (r["m"]["total"], r["m"]["top"]) for r in df.groupBy("k").agg(m.call("both", F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {1: (6.0, 3), 2: (1.0, 9)}
    with pytest.raises(ValueError):
        m.register("both", len, {})
    with pytest.raises(KeyError):
        m.call("none", F.col("a"))


def test_sketch_header_is_what_is_read(spark):
    data = bytes(spark.range(10).agg(A.count_min_sketch(F.col("id"), 0.1, 0.9, 1).alias("s")).first()["s"])
    version, total, depth, width = struct.unpack_from(">iqii", data)
    assert (version, total) == (1, 10) and len(data) == 20 + 8 * depth + 8 * depth * width


def test_versions_of_a_store_in_a_folder(spark, tmp_path):
    plain, kept = S.Store(), S.Store(f"file://{tmp_path}/store")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k int, v string")
    for store in (plain, kept):
        store.create("t", rows, ["k"])
        store.update("t", F.col("k") > 3, v=F.lit("new"))
        store.insert("t", spark.createDataFrame([(9, "nine")], "k int, v string"))
        store.delete("t", F.col("k") == 0)
        with pytest.raises(ValueError):
            store.insert("t", spark.createDataFrame([(9, "again")], "k int, v string"))
        with pytest.raises(ZeroDivisionError):
            store.atomically(lambda s: s.delete_all("t"), lambda s: 1 / 0)
    assert sorted(map(tuple, plain.read("t").collect())) == sorted(map(tuple, kept.read("t").collect()))
    assert "Union" not in kept.read("t")._jdf.queryExecution().optimizedPlan().toString()
