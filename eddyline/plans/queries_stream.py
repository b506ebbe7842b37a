"""Queries with joins, subqueries, patterns, contexts, state, contained events and dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.operators import contained as N
from eddyline.operators import contexts as C
from eddyline.operators import joins as J
from eddyline.operators import pattern as P
from eddyline.operators import retain as R
from eddyline.operators import rowpattern as M
from eddyline.operators import state as S
from eddyline.operators import subquery as Q
from eddyline.plans import dataflow as D
from eddyline.plans.queries import Tables, query
from eddyline.plans.queries_windows import HOUR, USER, r
from eddyline.sources import connectors, formats

# ---- joins -------------------------------------------------------------------------------------------------


@query("select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 200000")
def join_equal(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 200000").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query(
    """select v.event_id as view_id, c.event_id as click_id, greatest(epoch_us(v.ts), epoch_us(c.ts)) as at_us
    from events v join events c on v.user_id = c.user_id and v.event_type = 'view' and c.event_type = 'click'
      and abs(epoch_us(v.ts) - epoch_us(c.ts)) < 3600000000"""
)
def join_windowed(t: Tables) -> DataFrame:
    """Views and clicks of a user that an hour's windows hold at the same time."""
    log = t.log.select("_ts", "_seq", "user_id", "event_type", "event_id")
    pairs = J.windowed(log.where("event_type = 'view'"), log.where("event_type = 'click'"), [("user_id", "user_id")], R.Time(HOUR), R.Time(HOUR))
    return pairs.select(F.col("l.event_id").alias("view_id"), F.col("r.event_id").alias("click_id"), F.col("_at.ts").alias("at_us"))


@query(
    """select n_name, s_name, c_name from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000
    full join (select * from customer where c_acctbal > 9000) c on c_nationkey = n_nationkey"""
)
def join_outer_chain(t: Tables) -> DataFrame:
    s, c = t.supplier.where("s_acctbal > 5000"), t.customer.where("c_acctbal > 9000")
    served = J.chain(t.nation, (s, F.col("s_nationkey") == F.col("n_nationkey"), "left"))
    return J.dealt(served, c, "n_nationkey", "c_nationkey", "full").select("n_name", "s_name", "c_name")


@query(
    """select e.event_id, p.event_id as last_purchase, p.value as purchase_value from (select * from events where event_type = 'error') e
    left join lateral (select event_id, value from events x where x.user_id = e.user_id and x.event_type = 'purchase' and (x.ts, x.event_id) < (e.ts, e.event_id)
      order by x.ts desc, x.event_id desc limit 1) p on true"""
)
def join_unidirectional(t: Tables) -> DataFrame:
    """Each error with the user's last purchase before it."""
    log = t.log.select("_ts", "_seq", "user_id", "event_id", "value", "event_type")
    out = J.unidirectional(log.where("event_type = 'error'").select("_ts", "_seq", "user_id", "event_id"), log.where("event_type = 'purchase'"), USER, ["event_id", "value"])
    return out.select("event_id", F.col("p_event_id").alias("last_purchase"), F.col("p_value").alias("purchase_value"))


@query("select c_custkey, s_suppkey from customer, supplier where c_nationkey = s_nationkey or c_custkey = s_suppkey")
def join_any(t: Tables) -> DataFrame:
    return J.any_join(t.customer, t.supplier, [("c_nationkey", "s_nationkey"), ("c_custkey", "s_suppkey")], ["c_custkey", "s_suppkey"], few=[("c_nationkey", "s_nationkey")])


@query(
    """select event_id, o_orderkey from events, (select o_orderkey, o_totalprice / 1000 as low, o_totalprice / 1000 + 0.05 as high from orders)
    where value between low and high"""
)
def join_range(t: Tables) -> DataFrame:
    bands = t.orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("low"), (F.col("o_totalprice") / 1000 + 0.05).alias("high"))
    return J.range_join(t.events.select("event_id", "value"), "value", bands, "low", "high", 0.1).select("event_id", "o_orderkey")


@query(
    """select r_name, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where l_shipdate >= timestamp '1995-01-01' group by r_name"""
)
def join_many(t: Tables) -> DataFrame:
    li = t.lineitem.where("l_shipdate >= timestamp '1995-01-01'").select("l_orderkey", "l_extendedprice", "l_discount")
    wide = J.chain(li, (t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "inner"), (t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner"), (t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner"), (t.region, F.col("n_regionkey") == F.col("r_regionkey"), "inner"))
    return wide.groupBy("r_name").agg(F.count("*").alias("n"), r(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("select event_type, count(*) as n from events join (select user_id, max(value) as top from events group by 1) using (user_id) where value > top * 0.9 group by 1")
def join_salted(t: Tables) -> DataFrame:
    top = t.events.groupBy("user_id").agg(F.max("value").alias("top"))
    return J.salted(t.events, top, ["user_id"]).where("value > top * 0.9").groupBy("event_type").agg(F.count("*").alias("n"))


# ---- subqueries --------------------------------------------------------------------------------------------


@query("select c_custkey from customer c where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def subquery_exists(t: Tables) -> DataFrame:
    return Q.exists(t.customer, t.orders.where("o_totalprice > 250000"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("select c_custkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey)")
def subquery_not_exists(t: Tables) -> DataFrame:
    return Q.not_exists(t.customer, t.orders, [("c_custkey", "o_custkey")]).select("c_custkey")


_NULLED = "(select o_custkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as price from orders)"


def _nulled(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"))


@query(f"select c_custkey, c_nationkey in (select cast(floor(price) as int) % 30 from {_NULLED} x where o_custkey = c_custkey) as found from customer")
def subquery_in(t: Tables) -> DataFrame:
    out = Q.in_(t.customer, F.col("c_nationkey"), _nulled(t), F.floor("price").cast("int") % 30, [("c_custkey", "o_custkey")], "found")
    return out.select("c_custkey", "found")


@query(
    f"""select c_custkey, 150000 < any (select price from {_NULLED} x where o_custkey = c_custkey) as less_any,
      90000 < all (select price from {_NULLED} x where o_custkey = c_custkey) as less_all from customer"""
)
def subquery_quantified(t: Tables) -> DataFrame:
    on = [("c_custkey", "o_custkey")]
    out = Q.quantified(t.customer, F.lit(150000), "<", False, _nulled(t), F.col("price"), on, "less_any")
    out = Q.quantified(out, F.lit(90000), "<", True, _nulled(t), F.col("price"), on, "less_all")
    return out.select("c_custkey", "less_any", "less_all")


@query(
    """select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n, (select round(sum(o_totalprice), 2) from orders where o_custkey = c_custkey) as total,
      (select case when count(*) = 1 then max(o_orderkey) end from orders where o_custkey = c_custkey) as only_order from customer"""
)
def subquery_scalar(t: Tables) -> DataFrame:
    on = [("c_custkey", "o_custkey")]
    out = Q.count(t.customer, t.orders, on, "n")
    out = Q.value(out, t.orders, on, "total", r(F.sum("o_totalprice"), 2))
    return Q.single(out, t.orders, on, "only_order", F.col("o_orderkey")).select("c_custkey", "n", "total", "only_order")


@query(
    """select c_custkey, (select string_agg(o_orderkey::varchar, ',' order by o_orderkey) from orders where o_custkey = c_custkey) as orders from customer"""
)
def subquery_rows(t: Tables) -> DataFrame:
    out = Q.rows(t.customer, t.orders, [("c_custkey", "o_custkey")], "list", ["o_orderkey"], "o_orderkey")
    return out.select("c_custkey", F.array_join(F.transform("list", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


@query(
    """with g as (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2 having count(*) > 3)
    select c_custkey, coalesce((select sum(n)::bigint from g where o_custkey = c_custkey), 0) as in_groups from customer"""
)
def subquery_grouped(t: Tables) -> DataFrame:
    out = Q.grouped(t.customer, t.orders, [("c_custkey", "o_custkey")], "o_orderstatus", F.count("*"), "by_status", having=lambda v: v > 3)
    return out.select("c_custkey", F.coalesce(F.aggregate(F.map_values("by_status"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("in_groups"))


# ---- patterns ----------------------------------------------------------------------------------------------

_FOLLOWED = """select a.user_id, a.event_id as a_id, b.event_id as b_id from events a
    join lateral (select event_id, ts from events x where x.user_id = a.user_id and x.event_type = 'purchase' and (x.ts, x.event_id) > (a.ts, a.event_id) order by ts, event_id limit 1) b on true
    where a.event_type = 'signup' and epoch_us(b.ts) < epoch_us(a.ts) + 21600000000"""


@query(_FOLLOWED)
def pattern_followed_by(t: Tables) -> DataFrame:
    """every signup -> purchase within 6 hours, as a window plan."""
    out = P.every_followed_by(t.log, F.col("event_type") == "signup", F.col("event_type") == "purchase", USER, ["event_id"], 6 * HOUR)
    return out.select("user_id", F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"))


def _is(kind: str):
    return lambda e, m: e["event_type"] == kind


def _of(kind: str):
    return F.col("event_type") == kind


def _picked(**tags: str) -> dict:
    return {n: ("long", lambda m, tag=tag: m[tag]["event_id"] if tag in m else None) for n, tag in tags.items()}


@query(_FOLLOWED)
def pattern_followed_by_states(t: Tables) -> DataFrame:
    """The same pattern run by the state machine: every (signup -> purchase) restarted by each signup."""
    node = P.atom("a", _is("signup")).every().then(P.atom("b", _is("purchase")).within(6 * HOUR))
    return P.match(t.log.select("_ts", "_seq", "user_id", "event_id", "event_type"), node, USER, _picked(a_id="a", b_id="b")).drop("_at")


@query(
    """select user_id, event_id as a_id, epoch_us(ts) + 3600000000 as at_us from events a where event_type = 'error'
    and not exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'view' and (b.ts, b.event_id) > (a.ts, a.event_id) and epoch_us(b.ts) < epoch_us(a.ts) + 3600000000)"""
)
def pattern_absence(t: Tables) -> DataFrame:
    """every error -> an hour without a view."""
    out = P.absent_within(t.log, F.col("event_type") == "error", F.col("event_type") == "view", USER, ["event_id"], HOUR)
    return out.select("user_id", F.col("a.event_id").alias("a_id"), F.col("_at").alias("at_us"))


@query(
    """select user_id, min(event_id) filter (where event_type = 'click') as a_id, min(event_id) filter (where event_type = 'error') as b_id
    from events group by user_id having count(*) filter (where event_type = 'click') > 0 and count(*) filter (where event_type = 'error') > 0"""
)
def pattern_and(t: Tables) -> DataFrame:
    """click and error in either order, once."""
    node = P.atom("a", _of("click")).and_(P.atom("b", _of("error")))
    return P.match(t.log.select("_ts", "_seq", "user_id", "event_id", "event_type"), node, USER, {"a_id": F.col("a.event_id"), "b_id": F.col("b.event_id")}).drop("_at")


@query("select user_id, min(event_id) as event_id from events where event_type in ('purchase', 'error') group by user_id")
def pattern_or(t: Tables) -> DataFrame:
    node = P.atom("a", _of("purchase")).or_(P.atom("b", _of("error")))
    pick = {"event_id": F.coalesce("a.event_id", "b.event_id")}
    return P.match(t.log.select("_ts", "_seq", "user_id", "event_id", "event_type"), node, USER, pick).drop("_at")


@query(
    """with m as (select *, count(*) filter (where event_type = 'click') over w as c from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
    select user_id, min(event_id) as end_id, cast(arg_min(c, event_id) as bigint) as n from m where event_type = 'purchase' and c >= 2
    and event_id = (select min(event_id) from events x where x.user_id = m.user_id and x.event_type = 'purchase') group by user_id"""
)
def pattern_until(t: Tables) -> DataFrame:
    """Two or more clicks until the first purchase."""
    node = P.atom("a", _of("click")).until(P.atom("b", _of("purchase")), low=2)
    pick = {"end_id": F.col("b.event_id"), "n": F.size("a").cast("long")}
    return P.match(t.log.select("_ts", "_seq", "user_id", "event_id", "event_type"), node, USER, pick).drop("_at")


@query(
    """select user_id, event_type, min(event_id) as event_id from events group by 1, 2"""
)
def pattern_every_distinct(t: Tables) -> DataFrame:
    node = P.atom("a", F.lit(True)).every_distinct(F.col("event_type"))
    pick = {"event_type": F.col("a.event_type"), "event_id": F.col("a.event_id")}
    return P.match(t.log.select("_ts", "_seq", "user_id", "event_id", "event_type"), node, USER, pick).drop("_at")


@query("select user_id, event_id as a_id, nxt as b_id from (select *, lead(event_id) over w as nxt, lead(value) over w as nv from events window w as (partition by user_id order by ts, event_id)) where nv > value")
def rowpattern_rise(t: Tables) -> DataFrame:
    """A B with B above A, from every row."""
    term = M.sequence(M.var("A"), M.var("B"))
    define = {"B": M.Shifted(lambda prev: F.col("value") > prev("value"))}
    measures = {"a_id": ("long", M.first("A", "event_id")), "b_id": ("long", M.first("B", "event_id"))}
    return M.match_recognize(t.log.select("_ts", "_seq", "user_id", "event_id", "value"), term, USER, define, measures, skip="to_next_row").drop("_at")


@query(
    """with f as (select *, case when value > lag(value) over w then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
    g as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from f)
    select user_id, min(event_id) as first_id, max(event_id) as last_id, count(*) as n from g group by user_id, run having count(*) >= 3"""
)
def rowpattern_runs(t: Tables) -> DataFrame:
    """Maximal rising runs of three rows or more: A B{2,}."""
    term = M.sequence(M.var("A"), M.var("B").repeat(2))
    define = {"B": M.Shifted(lambda prev: F.col("value") > prev("value"))}
    measures = {"first_id": ("long", M.first("A", "event_id")), "last_id": ("long", M.last("B", "event_id")), "n": ("long", M.size())}
    return M.match_recognize(t.log.select("_ts", "_seq", "user_id", "event_id", "value"), term, USER, define, measures).drop("_at")


# ---- contexts ----------------------------------------------------------------------------------------------


@query("select user_id, count(*) as n from events group by user_id")
def context_key(t: Tables) -> DataFrame:
    return C.descriptors(C.keyed(t.events, "user_id")).select(F.col("context_key.user_id").alias("user_id"), F.col("count").alias("n"))


@query(
    """with k as (select event_type || user_id as key, [ord(x) for x in string_split(event_type || user_id, '')] as b from events),
    t as (select list(c order by n) as tab from (select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(n))),
    h as (select key, xor(list_reduce(list_prepend(4294967295::bigint, b::bigint[]), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) as crc32,
      list_reduce(list_prepend(0::bigint, b::bigint[]), lambda c, x: (c * 31 + x) % 4294967296) as java,
      list_reduce(list_prepend(2166136261::bigint, b::bigint[]), lambda c, x: (xor(c, x) * 16777619) % 4294967296) as fnv1a from k, t),
    a as (select 'crc32' as algorithm, crc32 as code from h union all select 'java', case when java >= 2147483648 then java - 4294967296 else java end from h union all select 'fnv1a', fnv1a from h)
    select algorithm, cast(((code % 8) + 8) % 8 as int) as context_id, count(*) as n from a group by 1, 2"""
)
def context_hash(t: Tables) -> DataFrame:
    """Three hash algorithms."""
    rows = t.events.withColumn("key", F.concat("event_type", F.col("user_id").cast("string")))
    parts = [C.descriptors(C.hashed(rows, "key", 8, a)).select(F.lit(a).alias("algorithm"), "context_id", F.col("count").alias("n")) for a in ("crc32", "java", "fnv1a")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select 'low' as label, count(*) as n from events where value < 50 union all select 'high', count(*) from events where value > 100 union all select 'buy', count(*) from events where event_type = 'purchase'")
def context_category(t: Tables) -> DataFrame:
    v = F.col("value")
    out = C.categories(t.events, low=v < 50, high=v > 100, buy=F.col("event_type") == "purchase")
    return C.descriptors(out).select(F.col("context_label").alias("label"), F.col("count").alias("n"))


@query(
    """with m as (select *, case when event_type = 'purchase' then -1 when event_type = 'error' then 1 end as mark from events),
    s as (select *, last_value(mark ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as state,
      last_value(mark ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from m),
    n as (select *, sum(case when mark = 1 and (before is null or before = -1) then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) - 1 as ctx from s)
    select user_id, cast(ctx as bigint) as context_id, count(*) as n, min(event_id) as first_event from n where state = 1 group by user_id, ctx"""
)
def context_initiated(t: Tables) -> DataFrame:
    """From an error to the user's next purchase."""
    out = C.initiated(t.log, F.col("event_type") == "error", F.col("event_type") == "purchase", USER)
    return out.groupBy("user_id", "context_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(
    """select s.event_id as context_id, count(*) as n, round(sum(e.value), 4) as total from events s join events e on s.user_id = e.user_id and s.event_type = 'signup'
      and e.event_id >= s.event_id and epoch_us(e.ts) >= epoch_us(s.ts) and epoch_us(e.ts) < epoch_us(s.ts) + 7200000000 group by 1"""
)
def context_overlapping(t: Tables) -> DataFrame:
    """Two hours after each signup."""
    out = C.overlapping(t.log, F.col("event_type") == "signup", 2 * HOUR, USER)
    return out.groupBy("context_id").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query(
    """select strftime(case when strftime(ts, '%H:%M:%S') < '06:00:00' then ts - interval 1 day else ts end, '%Y-%m-%d') as day, count(*) as n from events
    where strftime(ts, '%H:%M:%S') >= '22:00:00' or strftime(ts, '%H:%M:%S') < '06:00:00' group by 1"""
)
def context_daily(t: Tables) -> DataFrame:
    """Ten in the evening to six in the morning."""
    return C.daily(t.events, "ts", "22:00:00", "06:00:00").groupBy(F.col("context_day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("select cast(epoch_us(ts) // 3600000000 as bigint) as context_id, event_type, count(*) as n from events group by 1, 2")
def context_nested(t: Tables) -> DataFrame:
    """Periods of an hour, by event type within."""
    out = C.nested(t.log, lambda d: C.periods(d, 0, HOUR), lambda d: C.keyed(d, "event_type"))
    return out.groupBy(F.col("context_id_0").cast("long").alias("context_id"), F.col("context_key_1.event_type").alias("event_type")).agg(F.count("*").alias("n"))


# ---- state -------------------------------------------------------------------------------------------------


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def table_upsert(t: Tables) -> DataFrame:
    return S.latest(t.log, USER).select("user_id", "event_id", "event_type", "value")


@query("select user_id, count(*) as n, round(sum(value), 4) as total, max(value) as top from events group by user_id")
def table_into(t: Tables) -> DataFrame:
    return S.into_table(t.events, USER, n=F.count("*"), total=r(F.sum("value")), top=F.max("value"))


@query(
    """with l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) select user_id, event_id from l where k = 1 and event_type <> 'error'"""
)
def table_delete(t: Tables) -> DataFrame:
    """Events upsert their user's row, errors delete it."""
    log = t.log.withColumn("_op", F.when(F.col("event_type") == "error", "-").otherwise("+"))
    return S.table_from_changes(log, USER).select("user_id", "event_id")


_MERGED = """with x as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as epoch from events)
    select user_id, count(*) filter (where event_type <> 'error') as n, cast(max(epoch) as bigint) as resets from x
    where epoch = (select max(epoch) from x y where y.user_id = x.user_id) group by user_id having count(*) filter (where event_type <> 'error') > 0"""


@query(_MERGED)
def table_merge(t: Tables) -> DataFrame:
    """A counter for each user: errors delete the row (and count), others insert or add one."""
    log = t.log.select("_ts", "_seq", "user_id", "event_type")
    state = S.since_last(log, USER, _of("error"), n=F.count("*"))
    resets = log.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("resets"))
    return state.join(resets, "user_id", "left").select("user_id", "n", F.coalesce("resets", F.lit(0)).alias("resets"))


@query(_MERGED)
def table_merge_states(t: Tables) -> DataFrame:
    """The same by the state machine of a merge's branches."""
    actions = [
        S.when_matched_delete(lambda e, row: e["event_type"] == "error"),
        S.when_matched_update(lambda e, row: {"n": row["n"] + 1}),
        S.when_not_matched_insert(lambda e, row: {"n": 1}, lambda e, row: e["event_type"] != "error"),
    ]
    log = t.log.select("_ts", "_seq", "user_id", "event_type")
    state = S.merged_state(S.merge(log, "user_id", "n long", actions), "user_id")
    resets = log.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("resets"))
    return state.join(resets, "user_id", "left").select("user_id", "n", F.coalesce("resets", F.lit(0)).alias("resets"))


@query(
    """with s as (select c_nationkey as k, count(*) as n from customer group by 1), b as (select s_nationkey as k, count(*) as n from supplier group by 1)
    select coalesce(s.k, b.k) as k, cast(coalesce(s.n, 0) + coalesce(b.n, 0) as bigint) as n from s full join b on s.k = b.k where not coalesce(s.n > 65 and b.n is not null, false)"""
)
def table_merge_batch(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return S.merge_batch(a, b, "k", update={"n": F.col("t.n") + F.col("s.n")}, insert={"n": F.col("s.n")}, delete=F.col("t.n") > 65)


@query(
    """select e.event_id as trigger_id, count(*) as n from events e join events w on w.user_id = e.user_id and e.event_type = 'error'
      and w.event_id < e.event_id and epoch_us(w.ts) + 3600000000 > epoch_us(e.ts) group by 1"""
)
def window_on_select(t: Tables) -> DataFrame:
    """For each error what an hour's named window holds of its user."""
    log = t.log.select("_ts", "_seq", "user_id", "event_id", "event_type")
    out = S.on_select(log.where("event_type = 'error'"), log, R.Time(HOUR), [("user_id", "user_id")])
    return out.groupBy(F.col("t.event_id").alias("trigger_id")).agg(F.count("*").alias("n"))


@query(
    """select user_id, count(*) as n from events e where event_type <> 'error' and not exists (select 1 from events d where d.user_id = e.user_id and d.event_type = 'error' and d.event_id > e.event_id) group by user_id"""
)
def window_on_delete(t: Tables) -> DataFrame:
    """What a keep-all window holds at the end if errors clear their user's rows."""
    log = t.log.select("_ts", "_seq", "user_id", "event_id", "event_type")
    live = R.KeepAll().lifetimes(log.where("event_type <> 'error'"))
    left = S.on_delete(live, log.where("event_type = 'error'"), [("user_id", "user_id")])
    return R.snapshot(left).groupBy("user_id").agg(F.count("*").alias("n"))


@query(
    """with x as (select *, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as epoch from events)
    select user_id, cast(epoch as bigint) as epoch, round(sum(value), 4) as total from x where event_type <> 'error' group by 1, 2"""
)
def table_reset(t: Tables) -> DataFrame:
    out = S.reset_epochs(t.log, F.col("event_type") == "error", USER)
    return out.groupBy("user_id", F.col("_epoch").alias("epoch")).agg(r(F.sum("value")).alias("total"))


@query(
    """select n_nationkey, case when n_regionkey = 1 then 'one' else n_name end as n_name from nation where n_regionkey <> 2 union all select 100, 'new'"""
)
def faf_statements(t: Tables) -> DataFrame:
    """Insert, update and delete on demand."""
    store = S.Store()
    store.create("nations", t.nation, ["n_nationkey"])
    store.insert("nations", t.spark.createDataFrame([(100, "new", 9)], "n_nationkey int, n_name string, n_regionkey int"))
    store.update("nations", F.col("n_regionkey") == 1, n_name=F.lit("one"))
    store.delete("nations", F.col("n_regionkey") == 2)
    return store.select("nations").select("n_nationkey", "n_name")


@query("select case when value > 150 then 'high' when event_type = 'error' then 'bad' else 'rest' end as branch, count(*) as n from events group by 1")
def split_first(t: Tables) -> DataFrame:
    parts = S.split(t.events, ("high", F.col("value") > 150), ("bad", F.col("event_type") == "error"))
    counts = [df.agg(F.lit(n or "rest").alias("branch"), F.count("*").alias("n")) for n, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).where("n > 0")


@query("select event_id, case when event_type = 'error' then 0.0 else value end as value from events")
def update_stream(t: Tables) -> DataFrame:
    return S.update_stream(t.events, F.col("event_type") == "error", value=F.lit(0.0)).select("event_id", "value")


@query(
    """select event_id, coalesce(last_value(case when event_type = 'signup' then value end ignore nulls) over (order by ts, event_id rows between unbounded preceding and 1 preceding), -1.0) as threshold
    from events where true"""
)
def variable_as_of(t: Tables) -> DataFrame:
    """A variable that every signup sets, as each event sees it; a global variable is one sequence by nature."""
    sets = t.log.where("event_type = 'signup'").select("_ts", (F.col("_seq") * 2 + 1).alias("_seq"), "value")
    return S.variable_as_of(t.log.withColumn("_seq", F.col("_seq") * 2), sets, "threshold", -1.0).select("event_id", "threshold")


# ---- contained events, formats, dataflow -------------------------------------------------------------------


@query("select word, count(*) as n from (select unnest(string_split_regex(lower(text), '\\s+')) as word from documents) where word <> '' group by word having count(*) > 50")
def contained_words(t: Tables) -> DataFrame:
    return N.words(t.documents.withColumn("text", F.lower("text")), "text").groupBy("word").agg(F.count("*").alias("n")).where("n > 50")


@query("select vec_id, pos - 1 as position, round(x::double, 6) as x from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)")
def contained_array(t: Tables) -> DataFrame:
    return N.unnest(t.embeddings, F.col("embedding"), "v", "position").select("vec_id", F.col("position").cast("long").alias("position"), r(F.col("v").cast("double"), 6).alias("x"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def parse_json(t: Tables) -> DataFrame:
    return formats.parse_json(t.events, "props", "k long").select("event_id", "k")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, false as missing_k, true as missing_z from events")
def parse_json_dynamic(t: Tables) -> DataFrame:
    out = formats.parse_json_dynamic(t.events, "props")
    keys = F.json_object_keys("props")
    return out.select("event_id", formats.dynamic(F.col("event"), "$.k", "long").alias("k"), (~F.array_contains(keys, "k")).alias("missing_k"), (~F.array_contains(keys, "z")).alias("missing_z"))


@query("""select n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as json from nation""")
def render_json(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", formats.render_json("n_name", "n_regionkey").alias("json"))


@query("select event_type, count(*) as n, round(avg(value), 4) as mean from events where value > 100 group by 1")
def dataflow_graph(t: Tables) -> DataFrame:
    flow = D.Dataflow("graph").add(D.source("events", t.events)).add(D.filter_("filter", F.col("value") > 100))
    flow.add(D.custom("agg", lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))))
    return flow.connect("events", "filter").connect("filter", "agg", "matched").run()["agg"]["out"]


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def dataflow_join(t: Tables) -> DataFrame:
    flow = D.Dataflow("join").add(D.source("n", t.nation.withColumnRenamed("n_regionkey", "k"))).add(D.source("r", t.region.withColumnRenamed("r_regionkey", "k")))
    flow.add(D.join("j", ["k"])).add(D.select("s", "n_name", "r_name"))
    return flow.connect("n", "j").connect("r", "j").connect("j", "s").run()["s"]["out"]


@query(
    """select event_id, 'audit' as statement from events where event_type = 'error' union all select event_id, 'alarm' from events where value > 150 and event_type <> 'error'
    union all select event_id, 'rest' from events where event_type <> 'error'"""
)
def statement_priority(t: Tables) -> DataFrame:
    """A statement of high priority takes errors from all below it."""
    kind = F.col("event_type")
    out = S.by_priority(t.events, ("rest", 0, F.lit(True), False), ("audit", 5, kind == "error", True), ("alarm", 2, F.col("value") > 150, False))
    return out.select("event_id", "statement")


@query("select n_nationkey, n_name, n_regionkey as region, 'x' as tag from nation")
def parse_xml(t: Tables) -> DataFrame:
    """XML text with an attribute, rendered and parsed back."""
    text = F.concat(F.lit("<nation tag='x'><name>"), F.col("n_name"), F.lit("</name><region>"), F.col("n_regionkey").cast("string"), F.lit("</region></nation>"))
    out = formats.parse_xml(t.nation.select("n_nationkey", text.alias("xml")), "xml", "`@tag` string, name string, region int")
    return out.select("n_nationkey", F.col("name").alias("n_name"), "region", F.col("@tag").alias("tag"))


@query("select n_nationkey * 2 as twice, 'k' || n_nationkey as key from nation where n_nationkey < 10")
def dataflow_beacon(t: Tables) -> DataFrame:
    return formats.beacon(t.spark, 10, 1000, twice=(F.col("id") * 2).cast("int"), key=F.concat(F.lit("k"), F.col("id").cast("string"))).select("twice", "key")


@query("select c_custkey, n_name, n_regionkey from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9500")
def method_lookup(t: Tables) -> DataFrame:
    """Rows from a method asked once for each distinct key."""
    known = {r["n_nationkey"]: r.asDict() for r in t.nation.collect()}  # the method's own table of 25 rows
    rows = t.customer.where("c_acctbal > 9500").select("c_custkey", "c_nationkey")
    out = connectors.lookup(rows, ["c_nationkey"], lambda r: [known[r["c_nationkey"]]], "n_name string, n_regionkey int")
    return out.select("c_custkey", "n_name", "n_regionkey")


@query(
    """with a as (select user_id, event_id, ts, (select min(x.ts) from events x where x.user_id = e.user_id and x.event_type = 'purchase' and (x.ts, x.event_id) > (e.ts, e.event_id)) as b from events e where event_type = 'signup')
    select a.user_id, epoch_us(a.ts) as context_id, count(*) as n from a join events e on e.user_id = a.user_id and e.ts > a.ts and e.ts < a.b where a.b is not null group by 1, 2"""
)
def context_by_pattern(t: Tables) -> DataFrame:
    """Partitions from a signup to the purchase that a pattern finds after it."""
    found = P.every_followed_by(t.log, F.col("event_type") == "signup", F.col("event_type") == "purchase", USER, [])
    spans = found.select("user_id", F.col("a._ts").alias("_from"), F.col("b._ts").alias("_to"))
    return C.by_intervals(t.log, spans, USER).groupBy("user_id", "context_id").agg(F.count("*").alias("n"))
