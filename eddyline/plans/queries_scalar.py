"""Queries of scalar, date-time, interval and collection functions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eddyline.functions import arrays as X
from eddyline.functions import collections as E
from eddyline.functions import compare as C
from eddyline.functions import datetime as T
from eddyline.functions import intervals as I
from eddyline.functions import maths as M
from eddyline.functions import text as S
from eddyline.functions import udf as U
from eddyline.plans.queries import Tables, query
from eddyline.plans.queries_windows import r


def _v():
    return F.col("value")


@query(
    """select event_id, value is not distinct from null as is_null, value between 50 and 100 as inside, value between 50 and 100 as swapped, false as null_bound, value > 50 and value < 100 as open_range,
      value not between 50 and 100 as outside, event_type in ('view', 'click') as in_set, value > 20 or null as or_null from events"""
)
def scalar_compare(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.is_(_v(), None).alias("is_null"), C.between(_v(), 50, 100).alias("inside"), C.between(_v(), 100, 50).alias("swapped"), C.between(_v(), None, 100).alias("null_bound"), C.between(_v(), 50, 100, False, False).alias("open_range"), C.not_between(_v(), 50, 100).alias("outside"), C.in_(F.col("event_type"), "view", "click").alias("in_set"), C.or_(_v() > 20, F.lit(None).cast("boolean")).alias("or_null"))


@query(
    """select event_id, case when value < 50 then 'low' when value < 150 then 'mid' else 'high' end as band, case event_type when 'view' then 1 when 'click' then 2 end as code,
      coalesce(nullif(event_type, 'view'), 'none') as other, try_cast(event_type as int) as failed, cast(value as int) as whole from (select event_id, event_type, floor(value) as value from events)"""
)
def scalar_conditional(t: Tables) -> DataFrame:
    v = F.floor(_v())
    band = C.Case().when(v < 50, "low").when(v < 150, "mid").else_("high")
    code = C.CaseValue(F.col("event_type")).when("view", 1).when("click", 2).else_(None)
    return t.events.select("event_id", band.alias("band"), code.alias("code"), C.coalesce(F.nullif("event_type", F.lit("view")), "none").alias("other"), C.cast(F.col("event_type"), "int").alias("failed"), C.cast(v, "int").alias("whole"))


@query("select event_id, value > 50 and value > 100 as gt_all, value > 50 or value > 100 as gt_any, list_contains([1, 2, 3], event_id % 5) as member from events")
def scalar_quantified(t: Tables) -> DataFrame:
    return t.events.select("event_id", C.all_of(_v(), C.greater, [50, 100]).alias("gt_all"), C.any_of(_v(), C.greater, [50, 100]).alias("gt_any"), C.in_array(F.col("event_id") % 5, F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("member"))


@query(
    """select event_id, round(value / nullif(event_id % 3, 0), 6) as ratio, case when event_id % 4 <> 0 then event_id // (event_id % 4) end as whole, case when event_id % 4 <> 0 then event_id % (event_id % 4) end as rest,
      cast(sign(value - 100) as double) as sgn, round(abs(value - 100), 6) as dist, least(value, 100) as low, cast(null as double) as no_low, event_id & 6 as a, event_id | 6 as o, xor(event_id, 6) as x from events"""
)
def scalar_math(t: Tables) -> DataFrame:
    k = F.col("event_id")
    return t.events.select("event_id", r(M.divide(_v(), k % 3), 6).alias("ratio"), M.divide_with(k, k % 4, integer=True).alias("whole"), M.modulo(k, k % 4).alias("rest"), M.signum(_v() - 100).alias("sgn"), r(M.absolute(_v() - 100), 6).alias("dist"), M.min_of(_v(), 100.0).alias("low"), M.min_of(_v(), F.lit(None).cast("double")).alias("no_low"), M.bitwise_and(k, 6).alias("a"), M.bitwise_or(k, 6).alias("o"), M.bitwise_xor(k, 6).alias("x"))


@query(
    """select l_orderkey, l_linenumber, l_extendedprice, cast(cast(l_extendedprice as decimal(18,2)) + cast(l_quantity as decimal(18,2)) as decimal(20,2)) as plus,
      cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(18,2)) as decimal(20,4)) as times from lineitem"""
)
def scalar_exact(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", M.add_exact(F.col("l_extendedprice"), F.col("l_quantity"), 2).cast("decimal(20,2)").alias("plus"), M.multiply_exact(F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_tax").cast("decimal(18,2)"), 2).cast("decimal(20,4)").alias("times"))


@query(
    """select p_partkey, p_name || '-' || p_brand as joined, p_name like '%a%e%' as liked, regexp_full_match(p_brand, 'Brand#[1-3].*') as matched, starts_with(p_type, 'S') as s, p_type like '%L' as e,
      contains(p_name, 'an') as c, upper(p_name) as u, length(p_name) as n, cast(p_size as varchar) like '1%' as number_like from part"""
)
def scalar_text(t: Tables) -> DataFrame:
    c = F.col
    return t.part.select("p_partkey", S.concat(c("p_name"), "-", c("p_brand")).alias("joined"), S.like(c("p_name"), "%a%e%").alias("liked"), S.regexp_match(c("p_brand"), "Brand#[1-3].*").alias("matched"), S.starts_with(c("p_type"), "S").alias("s"), S.ends_with(c("p_type"), "L").alias("e"), S.contains(c("p_name"), "an").alias("c"), S.upper(c("p_name")).alias("u"), S.string_length(c("p_name")).cast("long").alias("n"), S.like(c("p_size"), "1%").alias("number_like"))


@query(
    """select vec_id, len(embedding) as n, round(embedding[1]::double, 6) as first, cast(null as double) as beyond from embeddings"""
)
def scalar_array(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", X.array_length(e).cast("long").alias("n"), r(X.array_at(e, 0).cast("double"), 6).alias("first"), X.array_at(e, 100000).cast("double").alias("beyond"))


# ---- date and time -----------------------------------------------------------------------------------------


@query(
    """select event_id, year(ts) as y, month(ts) - 1 as month0, day(ts) as d, dayofweek(ts) + 1 as dow, hour(ts) as h, weekofyear(ts) as w, dayofyear(ts) as doy, epoch_us(ts) // 1000 as ms from events"""
)
def datetime_fields(t: Tables) -> DataFrame:
    c = F.col("ts")
    return t.events.select("event_id", T.get(c, "year").alias("y"), T.get(c, "month").alias("month0"), T.get(c, "day").alias("d"), T.get(c, "day_of_week").alias("dow"), T.get(c, "hour").alias("h"), T.get(c, "week").alias("w"), T.get(c, "day_of_year").alias("doy"), T.to_millis(c).alias("ms"))


@query(
    """select event_id, ts + interval 1500 milliseconds as later, ts - interval 90 minutes as earlier, date_trunc('hour', ts) as low, date_trunc('hour', ts) + interval 1 hour as high,
      case when minute(ts) >= 30 then date_trunc('hour', ts) + interval 1 hour else date_trunc('hour', ts) end as near, date_trunc('month', ts) as month_low,
      case when (day(ts) - 1) * 2 >= day(last_day(ts)) then date_trunc('month', ts) + interval 1 month else date_trunc('month', ts) end as month_near, strftime(ts, '%Y/%m/%d %H') as text from events"""
)
def datetime_shift_round(t: Tables) -> DataFrame:
    c = F.col("ts")
    out = t.events.select("event_id", T.plus(c, 1500).alias("later"), T.minus_duration(c, T.duration(minutes=90)).alias("earlier"), T.round_floor(c, "hour").alias("low"), T.round_ceiling(c, "hour").alias("high"), T.round_half(c, "hour").alias("near"), T.round_floor(c, "month").alias("month_low"), T.round_half(c, "month").alias("month_near"), T.format_pattern(c, "yyyy/MM/dd HH").alias("text"))
    return out.select("event_id", "text", *(F.col(n).cast("timestamp_ntz").alias(n) for n in ("later", "earlier", "low", "high", "near", "month_low", "month_near")))


@query(
    """select event_id, date_trunc('day', ts) + (ts - date_trunc('day', ts)) - to_hours(hour(ts)) + interval 7 hours as h7, ts - to_days(cast(day(ts) - 1 as int)) as first_day,
      ts + to_days(cast(day(last_day(ts)) - day(ts) as int)) as last_day, ts >= timestamp '2024-01-10' and ts <= timestamp '2024-02-01' as inside from events"""
)
def datetime_set(t: Tables) -> DataFrame:
    c = F.col("ts")
    low, high = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")
    out = t.events.select("event_id", T.set_field(c, "hour", 7).alias("h7"), T.with_min(c, "day").alias("first_day"), T.with_max(c, "day").alias("last_day"), T.datetime_between(c, high, low).alias("inside"))
    return out.select("event_id", "inside", *(F.col(n).cast("timestamp_ntz").alias(n) for n in ("h7", "first_day", "last_day")))


_INTERVALS = """with i as (select o_orderkey, (epoch_us(o_orderdate) // 1000) // 86400000 as a, (epoch_us(o_orderdate) // 1000) // 86400000 + o_orderkey % 40 as b, 9500 + o_custkey % 300 as c, 9500 + o_custkey % 300 + o_orderkey % 25 as d from orders)
    select o_orderkey, b < c as before, a > d as after, a = c and b = d as coincides, c < a and b < d as during, a < c and d < b as includes, c < a and b = d as finishes, a < c and b = d as finished_by,
      b = c as meets, a = d as met_by, a < c and b > c and b < d as overlaps, c < a and d > a and d < b as overlapped_by, a = c and b < d as starts, a = c and d < b as started_by, c - b between 5 and 50 as before_within from i"""


@query(_INTERVALS)
def interval_algebra(t: Tables) -> DataFrame:
    day = F.floor(T.to_millis(F.col("o_orderdate")) / 86400000)
    k = F.col("o_orderkey")
    c = F.lit(9500) + F.col("o_custkey") % 300
    a, b = I.bounds(day, day + k % 40), I.bounds(c, c + k % 25)
    return t.orders.select("o_orderkey", *(f(a, b).alias(n) for n, f in I.RELATIONS.items()), I.before(a, b, 5, 50).alias("before_within"))


# ---- collections -------------------------------------------------------------------------------------------

_LISTS = "(select user_id, list(value order by event_id) as l, list(event_type order by event_id) as k from events group by user_id)"


def _lists(t: Tables) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value", "event_type")))
    made = t.events.groupBy("user_id").agg(rows.alias("rows"))
    return made.select("user_id", F.transform("rows", lambda x: x["value"]).alias("l"), F.transform("rows", lambda x: x["event_type"]).alias("k"))


@query(
    f"""select user_id, len(l) as n, len(list_filter(l, lambda x: x > 150)) as n_high, round(list_sum(l), 4) as total, round(list_avg(l), 4) as mean, list_min(l) as low, list_max(l) as high,
      l[1] as first, l[-1] as last, len(list_filter(l, lambda x: x > 190)) > 0 as any_high, len(list_filter(l, lambda x: x > 120)) = len(l) as all_over from {_LISTS}"""
)
def enum_aggregates(t: Tables) -> DataFrame:
    c = F.col("l")
    return _lists(t).select("user_id", E.count(c).cast("long").alias("n"), E.count(c, lambda x: x > 150).cast("long").alias("n_high"), r(E.sum_of(c)).alias("total"), r(E.average(c)).alias("mean"), E.min_of(c).alias("low"), E.max_of(c).alias("high"), E.first_of(c).alias("first"), E.last_of(c).alias("last"), E.any_of(c, lambda x: x > 190).alias("any_high"), E.all_of(c, lambda x: x > 120).alias("all_over"))


@query(
    f"""select user_id, l[1:3] as taken, l[greatest(len(l) - 1, 1):] as last_two, list_reverse(l) as reversed, list_sort(l) as ordered, list_reverse_sort(l) as falling, [x * 2 for x in l] as doubled, list_filter(l, lambda x, i: i % 2 = 1) as odd
    from {_LISTS}"""
)
def enum_lists(t: Tables) -> DataFrame:
    c = F.col("l")
    return _lists(t).select("user_id", E.take(c, 3).alias("taken"), E.take_last(c, 2).alias("last_two"), E.reverse(c).alias("reversed"), E.order_by(c, lambda x: x).alias("ordered"), E.order_by_natural(c, True).alias("falling"), E.select(c, lambda x: x * 2).alias("doubled"), E.where(c, lambda x, i: i % 2 == 0).alias("odd"))


@query(
    f"""with p as (select user_id, k, l, unnest(k) as e, generate_subscripts(k, 1) as i from {_LISTS}), c as (select user_id, e, count(*) as n, min(i) as first from p group by 1, 2),
    q as (select user_id, arg_min(e, (-n, first)) as most, arg_min(e, (n, first)) as least, list(e order by first) as distinct_types from c group by user_id),
    w as (select user_id, min(i) filter (where e <> k[1]) as stop, len(any_value(k)) as n from p group by user_id)
    select q.user_id, most, least, distinct_types, cast(coalesce(stop - 1, n) as bigint) as leading_same from q join w using (user_id)"""
)
def enum_frequency(t: Tables) -> DataFrame:
    c = F.col("k")
    return _lists(t).select("user_id", E.most_frequent(c).alias("most"), E.least_frequent(c).alias("least"), E.distinct(c).alias("distinct_types"), F.size(E.take_while(c, lambda x: x == F.get(c, F.lit(0)))).cast("long").alias("leading_same"))


@query(
    f"""select user_id, list_filter(k, lambda x: x in ('view', 'click')) as common, list_filter(k, lambda x: x not in ('view', 'click')) as other, list_concat(k, ['end']) as joined, len(k) as n_folded from {_LISTS}"""
)
def enum_sets(t: Tables) -> DataFrame:
    c, two = F.col("k"), F.array(F.lit("view"), F.lit("click"))
    return _lists(t).select("user_id", E.intersect(c, two).alias("common"), E.except_(c, two).alias("other"), E.union(c, F.array(F.lit("end"))).alias("joined"), E.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + 1).alias("n_folded"))


@query(
    f"""select user_id, len(list_distinct(k)) as groups, len(list_filter(k, lambda x: x = 'view')) as views from {_LISTS}"""
)
def enum_group_by(t: Tables) -> DataFrame:
    g = E.group_by(F.col("k"), lambda x: x)
    return _lists(t).select("user_id", g.alias("g")).select("user_id", F.size("g").cast("long").alias("groups"), F.coalesce(F.size(X.map_at(F.col("g"), "view")), F.lit(0)).cast("long").alias("views"))


@query("select event_id, case when value > 10 then sqrt(value) end as root from events")
def udf_safe(t: Tables) -> DataFrame:
    """A Python function whose exceptions give null."""

    def root(x: float) -> float:
        if x <= 10:
            raise ValueError("too small")
        return math.sqrt(x)

    return t.events.select("event_id", U.function(root, "double")(_v()).alias("root"))
