"""The builder lowers to the operators."""

from pyspark.sql import functions as F

from eddyline.operators import contexts, retain
from eddyline.operators import pattern as P
from eddyline.plans.stream import Stream

SF = "/root/testdata/sf0.001"


def test_chain(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    s = Stream.of(events, "ts", "event_id").filter("value > 100").group_by("user_id").window(retain.Length(3))
    got = s.aggregate(n=F.count("*"), total=F.sum("value")).having("n = 3").output(every=2, take="last").select("user_id", "event_id", "total").rows()
    rows = sorted((r["user_id"], r["event_id"], r["value"]) for r in events.where("value > 100").collect())
    want = {}
    for user in {u for u, *_ in rows}:
        own = [(e, v) for u, e, v in rows if u == user]
        full = [(own[i][0], sum(v for _, v in own[i - 2 : i + 1])) for i in range(2, len(own))]
        want |= {e: t for e, t in full[1::2]}
    assert {r["event_id"]: round(r["total"], 6) for r in got.collect()} == {e: round(t, 6) for e, t in want.items()}
    assert s.snapshot().groupBy("user_id").count().where("count > 3").count() == 0
    assert s.changes().where("_op = '-'").count() == s.snapshot().count() * 0 + events.where("value > 100").count() - s.snapshot().count()


def test_contexts_splits_and_patterns(spark):
    s = Stream.of(spark.read.parquet(f"{SF}/events.parquet"), "ts", "event_id")
    by = s.context(lambda d: contexts.hashed(d, "user_id", 4))
    assert by.keys == ("context_id",)
    parts = s.split(("hot", F.col("value") > 100), first=True)
    assert parts["hot"].df.count() + parts[None].df.count() == s.df.count()
    node = P.atom("a").every()
    assert s.group_by("user_id").pattern(node, {"id": ("long", lambda m: m["a"]["event_id"])}).count() == s.df.count()
    pairs = s.window(retain.Unique(("user_id",))).join(s.window(retain.Unique(("user_id",))), [("event_id", "event_id")])
    assert pairs.count() == s.df.count()
    assert "p_value" in s.group_by("user_id").latest_of(s, ["value"]).df.columns
