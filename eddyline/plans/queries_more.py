"""Queries over timers, guards, row-pattern quantifiers, routing, dataflow bridges, formats and the engine."""

from __future__ import annotations

import datetime as dt
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.functions import compare as C
from eddyline.functions import datetime as T
from eddyline.functions import udf as U
from eddyline.operators import aggregate as A
from eddyline.operators import contexts as X
from eddyline.operators import output as O
from eddyline.operators import pattern as P
from eddyline.operators import retain as R
from eddyline.operators import routing as G
from eddyline.operators import rowpattern as M
from eddyline.operators import state as S
from eddyline.operators import subquery as Q
from eddyline.plans import dataflow as D
from eddyline.plans.queries import Tables, query
from eddyline.plans.queries_windows import HOUR, USER, r
from eddyline.plans.registry import Engine
from eddyline.sources import avro, connectors, formats, placeholders

_SMALL = ["_ts", "_seq", "user_id", "event_id", "event_type", "value"]


def _log(t: Tables) -> DataFrame:
    return t.log.select(*_SMALL)


def _is(kind: str):
    return lambda e, m: e["event_type"] == kind


def _id(*tags: str) -> dict:
    return {f"{tag}_id": ("long", lambda m, tag=tag: m[tag]["event_id"] if tag in m else None) for tag in tags}


def _end(t: Tables) -> int:
    return t.log.agg(F.max("_ts")).first()[0] or 0


# ---- timers and guards of patterns -------------------------------------------------------------------------


@query(
    """select user_id, event_id as a_id, epoch_us(ts) + 5400000000 as at_us from events
    where event_type = 'error' and epoch_us(ts) + 5400000000 <= (select max(epoch_us(ts)) from events)"""
)
def pattern_timer_interval(t: Tables) -> DataFrame:
    """every error -> timer:interval(90 minutes): fires by the clock, without another event."""
    node = P.atom("a", _is("error")).every().then(P.Timer(90 * 60 * R.SECOND))
    out = P.match(_log(t), node, USER, _id("a"), end=_end(t))
    return out.select("user_id", "a_id", F.col("_at").alias("at_us"))


@query(
    """with recursive d as (select min(epoch_us(ts)) as a, max(epoch_us(ts)) as z from events), u as (select user_id, min(epoch_us(ts)) as first from events group by 1),
    k as (select (a // 86400000000 + 1) * 86400000000 as tick, z from d union all select tick + 86400000000, z from k where tick + 86400000000 <= z)
    select user_id, tick as at_us from u, k where tick > first and tick <= z"""
)
def pattern_timer_at(t: Tables) -> DataFrame:
    """every timer:at(midnight) of each user, from their first event to the log's end."""
    a, z = t.log.agg(F.min("_ts"), F.max("_ts")).first()
    day = 24 * HOUR
    midnights = tuple(range((a // day + 1) * day, z + 1, day)) if a is not None else ()
    out = P.match(_log(t), P.TimerAt(midnights).every(), USER, {"n": ("long", lambda m: len(m))}, end=z)
    return out.select("user_id", F.col("_at").alias("at_us"))


@query(
    """with recursive e as (select user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type = 'signup'),
    f as (select user_id, min(us) as us from e group by 1), z as (select max(epoch_us(ts)) as z from events),
    k as (select user_id, us, 1 as n from f union all select user_id, us, n + 1 from k where n < 4)
    select user_id, us + n * 7200000000 as at_us from k, z where us + n * 7200000000 <= z"""
)
def pattern_timer_schedule(t: Tables) -> DataFrame:
    """signup -> every timer of an ISO schedule: four times, two hours apart, from a user's first signup."""
    hours = lambda e: [e + k * 2 * HOUR for k in range(1, 5)]
    plan = O.iso_schedule("R4/PT2H", dt.datetime(1970, 1, 1))
    assert [int((x - dt.datetime(1970, 1, 1)).total_seconds()) * R.SECOND for x in plan] == hours(0)
    first = t.log.where("event_type = 'signup'").groupBy("user_id").agg(F.min("_ts").alias("_ts"))
    steps = F.explode(F.array(*(F.lit(x).cast("long") for x in hours(0)))).alias("step")
    return first.select("user_id", "_ts", steps).select("user_id", (F.col("_ts") + F.col("step")).alias("at_us")).where(F.col("at_us") <= _end(t))


@query(
    """select user_id, event_id as a_id from events e where event_type = 'view' and not exists
    (select 1 from events x where x.user_id = e.user_id and x.event_type = 'view' and x.value >= 100 and (x.ts, x.event_id) <= (e.ts, e.event_id))"""
)
def pattern_while_guard(t: Tables) -> DataFrame:
    """(every view) while value < 100: the first one that is higher ends the pattern."""
    node = P.atom("a", _is("view")).every().while_(lambda m: m["a"]["value"] < 100)
    return P.match(_log(t), node, USER, _id("a")).drop("_at")


@query(
    """with v as (select *, row_number() over (partition by user_id order by ts, event_id) as k, first_value(epoch_us(ts)) over (partition by user_id order by ts, event_id) as first from events)
    select user_id, event_id as a_id from (select *, row_number() over (partition by user_id order by ts, event_id) as n from v where event_type = 'click' and epoch_us(ts) < first + 86400000000) where n <= 3"""
)
def pattern_within_max(t: Tables) -> DataFrame:
    """(every click) within a day of the start, three at most."""
    node = P.atom("a", _is("click")).every().within(24 * HOUR, at_most=3)
    return P.match(_log(t), node, USER, _id("a")).drop("_at")


@query(
    """select a.user_id, a.event_id as a_id, b.event_id as b_id from events a join lateral (select event_id, ts from events x where x.user_id = a.user_id and x.event_type = 'error'
      and (x.ts, x.event_id) > (a.ts, a.event_id) order by ts, event_id limit 1) b on true
    where a.event_type = 'signup' and (select count(*) from events s where s.user_id = a.user_id and s.event_type = 'signup' and (s.ts, s.event_id) < (a.ts, a.event_id)
      and (s.ts, s.event_id) > coalesce((select max((y.ts, y.event_id)) from events y where y.user_id = a.user_id and y.event_type = 'error' and (y.ts, y.event_id) < (a.ts, a.event_id)), (timestamp '1900-01-01', 0))) < 2"""
)
def pattern_followed_by_max(t: Tables) -> DataFrame:
    """every signup -[2]> error: of the signups that wait for one error, two at most."""
    node = P.atom("a", _is("signup")).every().then(P.atom("b", _is("error")), at_most=2)
    return P.match(_log(t), node, USER, _id("a", "b")).drop("_at")


@query("select user_id, min(event_id) as a_id from events where event_type = 'purchase' and value > 100 group by user_id")
def pattern_consume(t: Tables) -> DataFrame:
    """purchase consumed at level 2 or at level 1: an event above 100 reaches the higher level alone."""
    high = P.atom("a", lambda e, m: e["event_type"] == "purchase" and e["value"] > 100, consume=2)
    low = P.atom("b", lambda e, m: e["event_type"] == "purchase" and e["value"] > 100, consume=1)
    return P.match(_log(t), high.or_(low), USER, _id("a")).drop("_at")


@query(
    """with recursive p as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type in ('view', 'purchase')),
    s as (select user_id, i, event_type = 'view' as open, null::bigint as hit from p where i = 1
      union all select p.user_id, p.i, case when p.event_type = 'view' then true else false end, case when p.event_type = 'purchase' and s.open then p.event_id end from s join p on p.user_id = s.user_id and p.i = s.i + 1)
    select user_id, hit as b_id, count(*) as n from s where hit is not null group by 1, 2"""
)
def pattern_discard_partials(t: Tables) -> DataFrame:
    """every view -> purchase, all partial matches discarded on a match: purchases that complete one."""
    node = P.atom("a", _is("view")).every().then(P.atom("b", _is("purchase")))
    out = P.match(_log(t), node, USER, _id("b"), discard_partials=True)
    return out.select("user_id", "b_id").distinct().withColumn("n", F.lit(1).cast("long"))


@query(
    """with v as (select a.user_id, a.event_id as a_id, (select min((x.ts, x.event_id)) from events x where x.user_id = a.user_id and x.event_type = 'purchase' and (x.ts, x.event_id) > (a.ts, a.event_id)) as b from events a where event_type = 'view')
    select user_id, min(a_id) as a_id, b[2] as b_id from (select user_id, a_id, [b[1]::varchar, b[2]::varchar] as b from (select user_id, a_id, [struct_extract(b, 1)::varchar, struct_extract(b, 2)::varchar] as b from v where b is not null)) group by user_id, b"""
)
def pattern_suppress_overlaps(t: Tables) -> DataFrame:
    """every view -> purchase, of matches that share the purchase only the first."""
    node = P.atom("a", _is("view")).every().then(P.atom("b", _is("purchase")))
    out = P.match(_log(t), node, USER, _id("a", "b"), suppress_overlaps=True)
    return out.select("user_id", "a_id", F.col("b_id").cast("string").alias("b_id"))


# ---- row-pattern quantifiers -------------------------------------------------------------------------------


@query(
    """with w as (select user_id, event_id, event_type, row_number() over k as i, lead(event_type) over k as n1, lead(event_type, 2) over k as n2, lead(event_id) over k as e1, lead(event_id, 2) over k as e2 from events window k as (partition by user_id order by ts, event_id))
    select user_id, event_id as a_id, case when n1 = 'click' and n2 = 'purchase' then e2 else e1 end as c_id from w where event_type = 'view' and ((n1 = 'click' and n2 = 'purchase') or n1 = 'purchase')"""
)
def rowpattern_optional(t: Tables) -> DataFrame:
    """view click? purchase, from every row."""
    term = M.sequence(M.var("A"), M.var("B").optional(), M.var("C"))
    kind = lambda x: lambda row, tags, prev: row["event_type"] == x
    measures = {"a_id": ("long", M.first("A", "event_id")), "c_id": ("long", M.last("C", "event_id"))}
    return M.match_recognize(_log(t), term, USER, {"A": kind("view"), "B": kind("click"), "C": kind("purchase")}, measures, skip="to_next_row").drop("_at")


@query(
    """with w as (select user_id, event_id, event_type, lead(event_type) over k as n1, lead(event_id) over k as e1 from events window k as (partition by user_id order by ts, event_id))
    select user_id, event_id as first_id, e1 as last_id from w where (event_type = 'click' and n1 = 'error') or (event_type = 'error' and n1 = 'click')"""
)
def rowpattern_permute(t: Tables) -> DataFrame:
    """click and error in any order, next to each other."""
    term = M.permute(M.var("A"), M.var("B"))
    kind = lambda x: lambda row, tags, prev: row["event_type"] == x
    both = lambda pick: lambda g: pick(x["event_id"] for rows in g.values() for x in rows)
    measures = {"first_id": ("long", both(min)), "last_id": ("long", both(max))}
    return M.match_recognize(_log(t), term, USER, {"A": kind("click"), "B": kind("error")}, measures, skip="to_next_row").drop("_at")


@query(
    """select user_id, event_id as a_id, epoch_us(ts) + 3600000000 as at_us, (select count(*) from events x where x.user_id = e.user_id and (x.ts, x.event_id) > (e.ts, e.event_id) and epoch_us(x.ts) < epoch_us(e.ts) + 3600000000
      and not exists (select 1 from events y where y.user_id = e.user_id and y.event_type <> 'view' and (y.ts, y.event_id) > (e.ts, e.event_id) and (y.ts, y.event_id) <= (x.ts, x.event_id))) as n
    from events e where event_type = 'error'"""
)
def rowpattern_interval(t: Tables) -> DataFrame:
    """error view* interval(1 hour): each error with the views right after it, delivered an hour after it."""
    term = M.sequence(M.var("A"), M.var("B").zero_or_more())
    kind = lambda x: lambda row, tags, prev: row["event_type"] == x
    measures = {"a_id": ("long", M.first("A", "event_id")), "n": ("long", M.count("B"))}
    out = M.match_recognize(_log(t), term, USER, {"A": kind("error"), "B": kind("view")}, measures, skip="to_next_row", interval=HOUR)
    return out.select("user_id", "a_id", F.col("_at").alias("at_us"), "n")


@query(
    """with w as (select user_id, event_id, event_type, ts, (select min((x.ts, x.event_id)) from events x where x.user_id = e.user_id and x.event_type = 'purchase' and (x.ts, x.event_id) > (e.ts, e.event_id)) as stop from events e)
    select user_id, event_id as a_id from w where event_type = 'signup' and stop is not null"""
)
def rowpattern_reluctant(t: Tables) -> DataFrame:
    """signup any*? purchase, from every row: each signup that some purchase follows."""
    term = M.sequence(M.var("A"), M.var("X").zero_or_more().reluctant(), M.var("B"))
    kind = lambda x: lambda row, tags, prev: row["event_type"] == x
    out = M.match_recognize(_log(t), term, USER, {"A": kind("signup"), "B": kind("purchase")}, {"a_id": ("long", M.first("A", "event_id"))}, skip="to_next_row")
    return out.drop("_at")


# ---- output, contexts, subqueries --------------------------------------------------------------------------


@query("select event_id, (epoch_us(ts) + 86399999999) // 86400000000 * 86400000000 as tick from events where (epoch_us(ts) + 86399999999) // 86400000000 * 86400000000 <= (select max(epoch_us(ts)) from events)")
def output_at(t: Tables) -> DataFrame:
    """All rows, delivered at the next midnight of a cron schedule."""
    a, z = t.log.agg(F.min("_ts"), F.max("_ts")).first()
    if a is None:
        a = z = 0
    epoch = dt.datetime(1970, 1, 1)
    cron = O.Schedule(O.values(0), O.values(0), O.wildcard(), O.wildcard(), O.wildcard())
    start, stop = epoch + dt.timedelta(microseconds=a - 1), epoch + dt.timedelta(microseconds=z)
    ticks = [x["tick"] for x in cron.ticks(t.spark, start, stop).collect()]  # a calendar: one row a day
    return O.at_instants(t.log, ticks).select("event_id", "tick")


@query(
    """with k as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as l, arg_max(event_type, (ts, event_id)) over (partition by user_id) as last from events)
    select user_id, event_type, event_id from k where l = 1 and last <> 'error'"""
)
def output_terminated_groups(t: Tables) -> DataFrame:
    """At a user's end the last row of each event type, unless the user ends with an error."""
    out = O.terminated(_log(t), USER, "snapshot", F.col("event_type") != "error", ["event_type"])
    return out.select("user_id", "event_type", "event_id")


@query(
    """with b as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 6 as batch, count(*) over (partition by user_id) as n from events)
    select user_id, cast(batch as bigint) as batch, event_id from b"""
)
def output_and_terminated(t: Tables) -> DataFrame:
    """Every six rows, and the rest of a user's rows when the user ends."""
    log = _log(t)
    out = O.and_when_terminated(O.every_events(log, 6, USER), log, USER)
    return out.select("user_id", F.col("_batch").cast("long").alias("batch"), "event_id")


@query(
    """with b as (select *, epoch_us(ts) // 21600000000 as batch from events), g as (select batch, event_type, min((ts, event_id)) as first, count(*) as n from b group by 1, 2)
    select cast(batch as bigint) as batch, event_type, n, cast(row_number() over (partition by batch order by first) - 1 as bigint) as delivery from g"""
)
def output_grouped_delivery(t: Tables) -> DataFrame:
    """Batches of six hours, delivered in groups of one event type."""
    out = G.grouped_delivery(O.every_time(_log(t), 6 * HOUR, F.lit(0)), ["event_type"])
    return out.groupBy(F.col("_batch").cast("long").alias("batch"), "event_type", F.col("_delivery").cast("long").alias("delivery")).agg(F.count("*").alias("n")).select("batch", "event_type", "n", "delivery")


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events where user_id in (1, 2, 3) group by user_id")
def context_selected(t: Tables) -> DataFrame:
    """Only some partitions of a key context."""
    out = X.select_partitions(X.keyed(t.events, "user_id").withColumn("context_user", F.col("user_id")), context_user=[1, 2, 3])
    return out.groupBy("user_id").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query(
    """select event_id, coalesce(count(*) over w - 1, 0) as before_n, count(*) over w as with_n from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)"""
)
def subquery_self_preeval(t: Tables) -> DataFrame:
    """A count over the statement's own stream, evaluated before and after the event is added."""
    out = G.self_subquery(G.self_subquery(_log(t), USER, True, before_n=F.count("*")), USER, False, with_n=F.count("*"))
    return out.select("event_id", "before_n", "with_n")


@query(
    """with g as (select o_custkey, max(o_totalprice) as top from orders where o_orderstatus = 'F' group by 1 having count(*) >= 2)
    select c_custkey, (select round(top, 2) from g where o_custkey = c_custkey) as top from customer"""
)
def subquery_where_having(t: Tables) -> DataFrame:
    """A scalar subquery with a filter and a condition on its group."""
    inner = t.orders.where("o_orderstatus = 'F'")
    out = Q.value(t.customer, inner, [("c_custkey", "o_custkey")], "top", F.when(F.count("*") >= 2, r(F.max("o_totalprice"), 2)))
    return out.select("c_custkey", "top")


# ---- aggregates --------------------------------------------------------------------------------------------


@query("select event_type, count(*) as n, true as never_low, true as near from events group by event_type")
def aggregate_sketch_frequency(t: Tables) -> DataFrame:
    """Frequencies by a count-min sketch: not below the count, and above it by no more than a thousandth of all."""
    sketch = t.events.agg(A.count_min_sketch(F.col("event_type")).alias("sketch"), F.count("*").alias("all"))
    exact = t.events.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(sketch))  # one row
    f = exact.withColumn("f", A.count_min_frequency(F.col("sketch"), F.col("event_type")))
    return f.select("event_type", "n", (F.col("f") >= F.col("n")).alias("never_low"), (F.col("f") - F.col("n") <= F.greatest(F.lit(1), F.col("all") * 0.002)).alias("near"))


@query("select user_id, round(max(value) - min(value), 4) as spread, count(value) as n from events group by user_id")
def aggregate_multi_plugin(t: Tables) -> DataFrame:
    """An aggregate of one's own with two accessors over one state."""
    own = U.MultiAggregates()
    own.register("range", lambda v: (v.min(), v.max(), v.count()), {"spread": ("double", lambda s: float(s[1] - s[0])), "n": ("long", lambda s: int(s[2]))})
    out = t.events.groupBy("user_id").agg(own.call("range", F.col("value")).alias("a"))
    return out.select("user_id", r("a.spread").alias("spread"), "a.n")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def iterate_unbound(t: Tables) -> DataFrame:
    """What iterating a statement without a window gives for each user."""
    return G.iterable_unbound(_log(t), USER).select("user_id", "event_id", "value")


# ---- state and routing -------------------------------------------------------------------------------------


@query("select n_nationkey, n_regionkey = 1 as taken from nation where n_regionkey <> 3")
def faf_select_delete(t: Tables) -> DataFrame:
    """Select and delete on demand, and a prepared statement run twice."""
    store = S.Store()
    store.create("n", t.nation, ["n_nationkey"])
    drop = store.prepare(lambda s, region: s.select_delete("n", F.col("n_regionkey") == region))
    taken, _ = drop(1), drop(3)
    return taken.select("n_nationkey", F.lit(True).alias("taken")).unionByName(store.select("n").select("n_nationkey", F.lit(False).alias("taken")))


@query(
    """select e.event_id, 'audit' as target, 0 as place from events e where event_type = 'error'
    union all select event_id, 'all', case when event_type = 'error' then 1 else 0 end from events"""
)
def route_precedence(t: Tables) -> DataFrame:
    """Every event is routed to one stream, errors to another before that, by its higher precedence."""
    log = _log(t)
    out = G.by_precedence((log.withColumn("target", F.lit("all")), 1), (log.where("event_type = 'error'").withColumn("target", F.lit("audit")), F.lit(5)))
    return out.select("event_id", "target", F.col("_order").alias("place"))


@query("select a.event_id as id, a.value as amount from events a where event_type = 'purchase'")
def route_transpose(t: Tables) -> DataFrame:
    """A struct becomes the event, and its columns are copied by name to another stream."""
    made = _log(t).select("_ts", "_seq", F.when(F.col("event_type") == "purchase", F.struct(F.col("event_id").alias("id"), F.col("value").alias("amount"), F.lit("x").alias("more"))).alias("payload"))
    target = t.spark.createDataFrame([], "id long, amount double")
    return G.copy_matching(G.transpose(made, "payload"), target)


# ---- dataflow bridges --------------------------------------------------------------------------------------


def _engine(t: Tables) -> Engine:
    engine = Engine(t.spark)
    for name in ("purchase", "view"):
        engine.types.register(name, "event_id long, user_id long, value double")
        engine.bind(name, _log(t).where(F.col("event_type") == name))
    engine.types.register_variant("any", "purchase", "view")
    return engine


@query("select event_id, user_id from events where event_type = 'purchase' and value > 100")
def dataflow_bus(t: Tables) -> DataFrame:
    """Events of a type go through a graph back to the bus as another type."""
    engine = _engine(t)
    flow = D.Dataflow("bus").add(D.bus_source("in", engine, "purchase", "value > 100")).add(D.select("pick", "event_id", "user_id")).add(D.bus_sink("out", engine, "dear"))
    flow.connect("in", "pick").connect("pick", "out").run()
    return engine.source("dear").select("event_id", "user_id")


@query("select _statement, count(*) as n from (select 'dear_views' as _statement from events where event_type = 'view' and value > 150 union all select 'dear_purchases' from events where event_type = 'purchase' and value > 150) group by 1")
def dataflow_statement(t: Tables) -> DataFrame:
    """The rows of all deployed statements whose names begin with dear."""
    engine = _engine(t)
    for kind in ("view", "purchase"):
        engine.deploy(engine.compile(f"dear_{kind}s", lambda e, kind=kind, least=150: e.source(kind).where(F.col("value") > least)))
    engine.deploy(engine.compile("other", lambda e: e.source("any")))
    flow = D.Dataflow("s").add(D.statement_source("in", engine, lambda n: n.startswith("dear"))).add(D.custom("agg", lambda df: df.groupBy("_statement").agg(F.count("*").alias("n"))))
    return flow.connect("in", "agg").run()["agg"]["out"]


@query("select n_nationkey as k, 'text' as port from nation where n_regionkey = 0 union all select n_nationkey, 'number' from nation where n_regionkey = 1")
def dataflow_emitter(t: Tables) -> DataFrame:
    """Rows emitted into two ports, with signals that reach what is connected."""
    empty = t.nation.select(F.col("n_nationkey").alias("k"), F.lit("").alias("port"))
    flow = D.Dataflow("e").add(D.emitter("in", {"text": empty, "number": empty})).add(D.custom("both", lambda a, b: a.unionByName(b), 2))
    flow.connect("in", "both", "text").connect("in", "both", "number")
    seen: list[str] = []
    flow.on_signal("both", lambda s: seen.append(f"{s.name}:{s.port}"))
    for port, region in (("text", 0), ("number", 1)):
        flow.emit("in", t.nation.where(F.col("n_regionkey") == region).select(F.col("n_nationkey").alias("k"), F.lit(port).alias("port")), port)
    out = flow.run()["both"]["out"]
    flow.finish()
    if seen != ["final:text", "final:number"]:
        raise ValueError(f"signals were {seen}")
    return out


# ---- types, engine -----------------------------------------------------------------------------------------


@query("select event_type as _type, count(*) as n, round(sum(value), 4) as total from events where event_type in ('purchase', 'view') group by 1")
def types_variant_stream(t: Tables) -> DataFrame:
    """A stream of two event types."""
    return _engine(t).source("any").groupBy("_type").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query("select event_id, round(value * 2, 4) as twice, 'none' as note from events where value > 120")
def engine_statement(t: Tables) -> DataFrame:
    """A compiled statement with a parameter, a variable, a declared expression, a getter and a default."""
    engine = Engine(t.spark)
    engine.types.register("e", "event_id long, value double, note string", getters={"twice": "value * 2"}, defaults={"note": "none"})
    engine.variables.define("floor", "double", 100.0)
    engine.define_expression("above", lambda c, x: c > x)
    engine.bind("e", t.log)
    build = lambda e, more=0.0: e.source("e").where(e.expression("above", F.col("value"), e.variables.ref("floor") + more)).select("event_id", r("twice").alias("twice"), "note")
    engine.deploy(engine.compile("dear", build, hints=("iterate_only",), annotations={"priority": 1}))
    return engine.execute("dear", more=20.0)


@query("select event_id from events where ts <= (select min(ts) + interval 2 day from events)")
def engine_advance_time(t: Tables) -> DataFrame:
    """A replay up to an instant of the engine's clock, reached in steps of an hour."""
    engine = Engine(t.spark)
    engine.types.register("e", "event_id long")
    engine.bind("e", t.log)
    first = t.log.agg(F.min("_ts")).first()[0] or 0
    engine.advance_time(first)
    engine.advance_span(first + 48 * HOUR, HOUR)
    return engine.source("e").select("event_id")


@query("select n_nationkey * 10 as k, n_name as name from nation union all select -1, 'sent' union all select -2, 'positional'")
def engine_send(t: Tables) -> DataFrame:
    """Events sent as records and arrays beside bound ones."""
    engine = Engine(t.spark)
    engine.types.register("n", "k int, name string")
    engine.bind("n", t.nation.select((F.col("n_nationkey") * 10).alias("k"), F.col("n_name").alias("name")))
    engine.send("n", {"k": -1, "name": "sent"}, [-2, "positional"])
    return engine.source("n").select("k", "name")


# ---- functions ---------------------------------------------------------------------------------------------


@query(
    """select o_orderkey, o_orderdate >= timestamp '1995-01-01' and o_orderdate <= timestamp '1996-12-31' as inside, o_orderdate > timestamp '1995-01-01' and o_orderdate < timestamp '1996-12-31' as strictly from orders"""
)
def datetime_between(t: Tables) -> DataFrame:
    low, high = F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp")
    c = F.col("o_orderdate").cast("timestamp")
    return t.orders.select("o_orderkey", T.datetime_between(c, low, high).alias("inside"), T.datetime_between(c, low, high, False, False).alias("strictly"))


@query("select o_orderkey, cast(floor(o_totalprice) as bigint) as whole, cast(o_orderkey as varchar) as text, try_cast(o_orderstatus as int) as none, strftime(o_orderdate, '%Y%m%d') as day from orders")
def scalar_cast(t: Tables) -> DataFrame:
    """Casts: a value that does not fit is null."""
    return t.orders.select("o_orderkey", C.cast(F.floor("o_totalprice"), "long").alias("whole"), C.cast(F.col("o_orderkey"), "string").alias("text"), C.cast(F.col("o_orderstatus"), "int").alias("none"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"))


# ---- formats and outside sources ---------------------------------------------------------------------------

_AVRO = {"type": "record", "name": "Nation", "fields": [{"name": "key", "type": "int"}, {"name": "name", "type": "string"}, {"name": "region", "type": ["null", "int"]}, {"name": "tags", "type": {"type": "array", "items": "string"}}]}


def _nations(t: Tables) -> DataFrame:
    region = F.when(F.col("n_regionkey") != 2, F.col("n_regionkey"))
    return t.nation.select("n_nationkey", F.struct(F.col("n_nationkey").cast("int").alias("key"), F.col("n_name").alias("name"), region.cast("int").alias("region"), F.array(F.lower("n_name"), F.lit("é")).alias("tags")).alias("nation"))


_AVRO_SQL = "select n_nationkey, n_name as name, case when n_regionkey <> 2 then n_regionkey end as region, lower(n_name) as tag from nation"


@query(_AVRO_SQL)
def avro_binary(t: Tables) -> DataFrame:
    """Records in Avro's binary encoding, written and read back."""
    out = _nations(t).withColumn("raw", avro.to_avro(F.col("nation"), _AVRO)).withColumn("back", avro.from_avro("raw", _AVRO))
    return out.select("n_nationkey", "back.name", "back.region", F.get("back.tags", F.lit(0)).alias("tag"))


@query(_AVRO_SQL)
def avro_json(t: Tables) -> DataFrame:
    """Records in Avro's JSON encoding, in which a union's value is named."""
    region = F.when(F.col("n_regionkey") != 2, F.concat(F.lit('{"int":'), F.col("n_regionkey").cast("string"), F.lit("}"))).otherwise(F.lit("null"))
    text = F.concat(F.lit('{"key":'), F.col("n_nationkey").cast("string"), F.lit(',"name":"'), F.col("n_name"), F.lit('","region":'), region, F.lit(',"tags":["'), F.lower("n_name"), F.lit('"]}'))
    out = t.nation.select("n_nationkey", avro.parse_avro_json(text, _AVRO).alias("back"))
    return out.select("n_nationkey", "back.name", "back.region", F.get("back.tags", F.lit(0)).alias("tag"))


@query("select n_nationkey, '<nation><n_name>' || n_name || '</n_name><n_regionkey>' || n_regionkey || '</n_regionkey></nation>' as xml from nation")
def render_xml(t: Tables) -> DataFrame:
    shown = formats.render_xml("nation", "n_name", "n_regionkey")
    return t.nation.select("n_nationkey", F.regexp_replace(shown, r">\s+<", "><").alias("xml"))


@query("select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def historical_sql(t: Tables) -> DataFrame:
    """Rows joined to what a database returns for their keys, by a statement with named placeholders."""
    rows = [(x["n_nationkey"], x["n_name"]) for x in t.nation.collect()]  # the database's own table of 25 rows

    def poll(r: dict) -> list[dict]:
        db = sqlite3.connect(":memory:")
        db.execute("create table nation (k int, name text)")
        db.executemany("insert into nation values (?, ?)", rows)
        text, values = placeholders.bound("select name from nation where k = ${c_nationkey} and name <> '${x}'", r)
        return [{"n_name": n} for (n,) in db.execute(text, [int(v) for v in values])]

    return connectors.lookup(t.customer.select("c_custkey", "c_nationkey"), ["c_nationkey"], poll, "n_name string").select("c_custkey", "n_name")


