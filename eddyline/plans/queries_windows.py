"""Queries over data windows, aggregation, analytic functions and output policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eddyline.operators import aggregate as A
from eddyline.operators import output as O
from eddyline.operators import retain as R
from eddyline.plans.queries import Tables, query

HOUR = 3600 * R.SECOND
USER = ["user_id"]


def r(c, n: int = 4):
    return F.round(c, n)


# ---- data windows ------------------------------------------------------------------------------------------


@query(
    """select event_id, user_id, round(sum(value) over w, 4) as sum_value, count(*) over w as n
    from events where value > 100
    window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)"""
)
def window_length_sum(t: Tables) -> DataFrame:
    out = A.running(t.log.where("value > 100"), R.Length(10), USER, sum_value=F.sum("value"), n=F.count("*"))
    return out.select("event_id", "user_id", r("sum_value").alias("sum_value"), "n")


@query(
    """select event_id, user_id, round(avg(value) over w, 4) as avg_value, round(max(value) over w, 4) as max_value
    from events window w as (partition by user_id order by ts range between interval 3599999999 microseconds preceding and current row)"""
)
def window_time_avg(t: Tables) -> DataFrame:
    out = A.running(t.log, R.Time(HOUR), USER, avg_value=F.avg("value"), max_value=F.max("value"))
    return out.select("event_id", "user_id", r("avg_value").alias("avg_value"), r("max_value").alias("max_value"))


@query(
    """select event_id, count(*) over w as n, round(min(value) over w, 4) as min_value
    from events window w as (partition by event_type order by ts range between interval 599999999 microseconds preceding and current row)"""
)
def window_ext_timed(t: Tables) -> DataFrame:
    log = t.log.withColumn("ext", F.col("_ts"))
    out = A.running_spread(log, "ext", 600 * R.SECOND, ["event_type"], n=F.count("*"), min_value=F.min("value"))
    return out.select("event_id", "n", r("min_value").alias("min_value"))


@query(
    """select event_id, user_id, count(*) over w as n, round(sum(value) over w, 4) as total
    from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)"""
)
def window_keepall(t: Tables) -> DataFrame:
    out = A.running(t.log, R.KeepAll(), USER, n=F.count("*"), total=F.sum("value"))
    return out.select("event_id", "user_id", "n", r("total").alias("total"))


@query(
    """with n as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 5 as b from events)
    select user_id, cast(b as bigint) as batch, count(*) as n, round(sum(value), 4) as total, max(event_id) as last_event
    from n group by user_id, b having count(*) = 5"""
)
def window_length_batch(t: Tables) -> DataFrame:
    live = R.LengthBatch(5).lifetimes(t.log, USER)
    return live.groupBy("user_id", F.col("_batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"), F.max("event_id").alias("last_event"))


@query(
    """with b as (select *, cast(floor(epoch_us(ts) / 3600000000) as bigint) as bucket from events)
    select user_id, (bucket + 1) * 3600000000 as flush_us, count(*) as n, round(sum(value), 4) as total from b group by user_id, bucket"""
)
def window_time_batch_reference(t: Tables) -> DataFrame:
    live = R.TimeBatch(HOUR, reference=0).lifetimes(t.log, USER)
    return live.groupBy("user_id", F.col("_in.ts").alias("flush_us")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query(
    """with recursive e as (select user_id, value, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (
      select user_id, i, us, value, us + 3600000000 as due from e where i = 1
      union all
      select e.user_id, e.i, e.us, e.value, case when e.us >= s.due + 3600000000 then e.us + 3600000000 when e.us >= s.due then s.due + 3600000000 else s.due end
      from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, due as flush_us, count(*) as n, round(sum(value), 4) as total from s group by 1, 2"""
)
def window_time_batch(t: Tables) -> DataFrame:
    """Anchored at the first arrival, anew after a silent flush."""
    live = R.TimeBatch(HOUR).lifetimes(t.log.select("_ts", "_seq", "user_id", "value"), USER)
    return live.groupBy("user_id", F.col("_in.ts").alias("flush_us")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query(
    """with b as (select *, cast(floor((epoch_us(ts) - first) / 1800000000) as bigint) as batch
      from (select *, min(epoch_us(ts)) over (partition by event_type) as first from events)),
    g as (select event_type, batch, count(*) as n, round(sum(value), 4) as total from b group by 1, 2)
    select event_type, batch, n, total from (select *, max(batch) over (partition by event_type) as last from g) where batch < last"""
)
def window_ext_timed_batch(t: Tables) -> DataFrame:
    live = R.ExternallyTimedBatch("_ts", 1800 * R.SECOND).lifetimes(t.log, ["event_type"])
    return live.groupBy("event_type", F.col("_batch").cast("long").alias("batch")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query(
    """with g as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 3600000000 then 1 else 0 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
    select user_id, cast(session as bigint) as session, count(*) as n, max(epoch_us(ts)) + 3600000000 as expires_us, round(sum(value), 4) as total
    from s group by user_id, session"""
)
def window_time_accum(t: Tables) -> DataFrame:
    live = R.TimeAccum(HOUR).lifetimes(t.log, USER)
    return live.groupBy("user_id", F.col("_session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.max("_out.ts").alias("expires_us"), r(F.sum("value")).alias("total"))


@query("select user_id, min(event_id) as event_id from events group by user_id")
def window_first_unique(t: Tables) -> DataFrame:
    return R.snapshot(R.FirstUnique(("user_id",)).lifetimes(t.log)).select("user_id", "event_id")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def window_unique(t: Tables) -> DataFrame:
    return R.snapshot(R.Unique(("user_id",)).lifetimes(t.log)).select("user_id", "event_id", "value")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k <= 3")
def window_first_length(t: Tables) -> DataFrame:
    return R.snapshot(R.First(3).lifetimes(t.log, USER)).select("user_id", "event_id")


@query("select event_id, value from events where epoch_us(ts) < (select min(epoch_us(ts)) + 86400000000 from events)")
def window_first_time(t: Tables) -> DataFrame:
    start = t.log.agg(F.min("_ts")).first()[0] or 0
    return R.snapshot(R.FirstTime(24 * HOUR, start).lifetimes(t.log)).select("event_id", "value")


@query("select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc, ts desc) as k from events) where k <= 4")
def window_sort(t: Tables) -> DataFrame:
    return R.Sort(4, ("-value",)).retained(t.log, ["event_type"]).select("event_type", "event_id", "value")


@query(
    """with recursive e as (select event_type, user_id, event_id, value, row_number() over (partition by event_type order by ts, event_id) as i from events),
    s as (
      select event_type, i, [{'k': -value, 'i': -i, 'u': user_id, 'e': event_id, 'v': value}] as held from e where i = 1
      union all
      select e.event_type, e.i, list_sort(list_append(list_filter(s.held, lambda x: x.u <> e.user_id), {'k': -e.value, 'i': -e.i, 'u': e.user_id, 'e': e.event_id, 'v': e.value}))[1:3]
      from s join e on e.event_type = s.event_type and e.i = s.i + 1),
    l as (select event_type, unnest(held) as x from (select *, row_number() over (partition by event_type order by i desc) as last from s) where last = 1)
    select event_type, x.u as user_id, x.e as event_id, x.v as value from l"""
)
def window_rank(t: Tables) -> DataFrame:
    """Top 3 by value of the latest events by user; what is evicted does not come back."""
    log = t.log.select("_ts", "_seq", "event_type", "user_id", "event_id", "value")
    return R.Rank(3, ("user_id",), ("-value",)).retained(log, ["event_type"]).select("event_type", "user_id", "event_id", "value")


@query(
    """select event_id, lead_id as evicted_by from (select event_id, lead(event_id, 5) over (partition by user_id order by ts, event_id) as lead_id from events)"""
)
def window_expression(t: Tables) -> DataFrame:
    live = R.Expression(R.CountBelow(6)).lifetimes(t.log, USER)
    return live.select("event_id", F.col("_out.seq").alias("evicted_by"))


@query(
    """with n as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 4 as b from events)
    select user_id, max(event_id) as flushed_by, count(*) as n from n group by user_id, b having count(*) = 4"""
)
def window_expression_batch(t: Tables) -> DataFrame:
    live = R.ExpressionBatch(R.CountFrom(4)).lifetimes(t.log, USER)
    return live.groupBy("user_id", F.col("_in.seq").alias("flushed_by")).agg(F.count("*").alias("n"))


@query(
    """with recursive e as (select user_id, value, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (
      select user_id, i, us, value, 1 as batch, us + 3600000000 as due, 1 as held from e where i = 1
      union all
      select user_id, i, us, value, batch + fresh, case when fresh = 0 then due when filled then case when us >= due then us + 3600000000 else due end when us >= due + 3600000000 then us + 3600000000 else due + 3600000000 end,
        case when fresh = 1 then 1 else held + 1 end
      from (select e.user_id, e.i, e.us, e.value, s.batch, s.held, s.held = 4 as filled, case when s.held = 4 then s.us + 3600000000 else s.due end as due,
          case when s.held = 4 or e.us >= s.due then 1 else 0 end as fresh
        from s join e on e.user_id = s.user_id and e.i = s.i + 1))
    select user_id, case when count(*) = 4 then max(us) else max(due) end as flush_us, count(*) as n, round(sum(value), 4) as total from s group by user_id, batch"""
)
def window_time_length_batch(t: Tables) -> DataFrame:
    """Flush after 4 events or an hour."""
    live = R.TimeLengthBatch(HOUR, 4).lifetimes(t.log.select("_ts", "_seq", "user_id", "value"), USER)
    return live.groupBy("user_id", "_in").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total")).select("user_id", F.col("_in.ts").alias("flush_us"), "n", "total")


@query(
    """select event_id, epoch_us(ts) as in_us, greatest(epoch_us(ts), epoch_us(ts) - 600000000 + 300000000 + (event_id % 3) * 600000000) as out_us
    from events"""
)
def window_time_order(t: Tables) -> DataFrame:
    """An event's own timestamp lies up to 20 minutes off; late ones enter and leave at once."""
    log = t.log.withColumn("stamp", F.col("_ts") - 600 * R.SECOND + (F.col("event_id") % 3) * 600 * R.SECOND)
    live = R.TimeOrder("stamp", 300 * R.SECOND).lifetimes(log)
    return live.select("event_id", F.col("_in.ts").alias("in_us"), F.col("_out.ts").alias("out_us"))


@query(
    """with e as (select *, epoch_us(ts) + cast(value * 1000000 as bigint) as expiry from events),
    m as (select max(epoch_us(ts)) as last from events)
    select event_id, user_id from e, m where expiry > last or expiry is null"""
)
def window_time_to_live(t: Tables) -> DataFrame:
    log = t.log.withColumn("expiry", F.col("_ts") + F.round(F.col("value") * 1000000).cast("long"))
    return R.snapshot_at_end(R.TimeToLive("expiry").lifetimes(log)).select("event_id", "user_id")


@query(
    """with e as (select event_id, user_id, value, epoch_us(ts) as us, lead(event_id, 3) over (partition by user_id order by ts, event_id) as out_by from events)
    select user_id, '+' as op, event_id, event_id as at_event from e
    union all select user_id, '-', event_id, out_by from e where out_by is not null"""
)
def window_irstream(t: Tables) -> DataFrame:
    log = R.changes(R.Length(3).lifetimes(t.log, USER))
    return log.select("user_id", F.col("_op").alias("op"), "event_id", F.col("_at.seq").alias("at_event"))


@query(
    """with e as (select *, lead(epoch_us(ts), 20) over (partition by user_id order by ts, event_id) as by_length, epoch_us(ts) + 3600000000 as by_time from events),
    m as (select max(epoch_us(ts)) as last from events)
    select event_id, (by_length is null or by_length > last) or by_time > last as in_union,
      (by_length is null or by_length > last) and by_time > last as in_both
    from e, m where (by_length is null or by_length > last) or by_time > last"""
)
def window_union_intersect(t: Tables) -> DataFrame:
    either = R.snapshot_at_end(R.UnionOf(R.Length(20), R.Time(HOUR)).lifetimes(t.log, USER)).select("event_id")
    both = R.snapshot_at_end(R.IntersectOf(R.Length(20), R.Time(HOUR)).lifetimes(t.log, USER)).select("event_id", F.lit(True).alias("in_both"))
    return either.join(both, "event_id", "left").select("event_id", F.lit(True).alias("in_union"), F.coalesce("in_both", F.lit(False)).alias("in_both"))


@query(
    """select event_id, round(avg(value) over w, 4) as avg_value
    from events window w as (partition by user_id, event_type order by ts, event_id rows between 2 preceding and current row)"""
)
def window_group(t: Tables) -> DataFrame:
    out = A.running(t.log, R.Group(("user_id", "event_type"), R.Length(3)), (), avg_value=F.avg("value"))
    return out.select("event_id", r("avg_value").alias("avg_value"))


@query(
    """with c as (
      select user_id, epoch_us(ts) as us, event_id as seq, 1 as d, value as v from events
      union all select user_id, epoch_us(ts) + 3600000000, -1, -1, -value from events)
    select user_id, us as at_us, seq as at_seq, cast(sum(d) over w as bigint) as n_retained, round(sum(v) over w, 4) + 0.0 as total
    from c window w as (partition by user_id order by us, seq range between unbounded preceding and current row)"""
)
def window_running_totals(t: Tables) -> DataFrame:
    """Sum and count of a time window after every arrival and every expiry."""
    out = R.running_totals(R.Time(HOUR).lifetimes(t.log, USER), USER, total="value")
    return out.select("user_id", F.col("_at.ts").alias("at_us"), F.col("_at.seq").alias("at_seq"), "n_retained", (r("total") + 0.0).alias("total"))


@query(
    """with x as (select event_id, user_id, count(*) over (partition by user_id order by ts, event_id) as n from events)
    select user_id, '+' as op, event_id, n from x union all
    select user_id, '-', event_id, lag(n) over (partition by user_id order by event_id) from x"""
)
def window_old_aggregates(t: Tables) -> DataFrame:
    """New and old rows of a grouped count; the old row is the group's row before."""
    out = A.running(t.log, R.KeepAll(), USER, n=F.count("*"))
    return A.with_old(out, ["n"], USER).select("user_id", F.col("_op").alias("op"), "event_id", "n")


# ---- aggregation -------------------------------------------------------------------------------------------


@query(
    """select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 4) as total, round(avg(value), 4) as mean,
      round(min(value), 4) as low, round(max(value), 4) as high, round(median(value), 4) as mid, round(stddev_samp(value), 4) as sd
    from events group by event_type"""
)
def aggregate_basic(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), A.count_distinct("user_id").alias("users"), r(F.sum(v)).alias("total"), r(F.avg(v)).alias("mean"), r(F.min(v)).alias("low"), r(F.max(v)).alias("high"), r(A.median(v)).alias("mid"), r(A.stddev(v)).alias("sd"))


@query("select user_id, round(avg(abs(value - m)), 4) as avedev from (select *, avg(value) over (partition by user_id) as m from events) group by user_id")
def aggregate_avedev(t: Tables) -> DataFrame:
    mean = t.events.withColumn("m", F.avg("value").over(Window.partitionBy("user_id")))
    return mean.groupBy("user_id").agg(r(F.avg(F.abs(F.col("value") - F.col("m")))).alias("avedev"))


@query(
    """select event_id, round(list_avg(list_transform(l, lambda x: abs(x - list_avg(l)))), 6) as avedev, round(list_median(l), 4) as mid, len(list_distinct(types)) as n_types
    from (select event_id, list(value) over w as l, list(event_type) over w as types from events
      window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row))"""
)
def aggregate_frame_rewrites(t: Tables) -> DataFrame:
    """Mean deviation, median and distinct count over a frame."""
    w = R.Length(5).frame(USER)
    return t.log.select("event_id", r(A.avedev("value", w), 6).alias("avedev"), r(A.median("value").over(w)).alias("mid"), A.count_distinct("event_type", w).alias("n_types"))


@query(
    """select l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 2) as wavg,
      count(*) filter (where l_discount > 0.05) as discounted, round(sum(l_extendedprice) filter (where l_tax > 0.04), 2) as taxed
    from lineitem group by 1, 2"""
)
def aggregate_filtered_weighted(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.groupBy("l_returnflag", "l_linestatus").agg(r(A.weighted_avg("l_extendedprice", "l_quantity"), 2).alias("wavg"), A.count_if(F.col("l_discount") > 0.05).alias("discounted"), r(F.sum(A.filtered("l_extendedprice", F.col("l_tax") > 0.04)), 2).alias("taxed"))


@query(
    """select event_id, first_value(value) over w as first_v, last_value(value) over w as last_v, lag(value, 1) over p as nth1
    from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and current row), p as (partition by user_id order by ts, event_id)"""
)
def aggregate_first_last_nth(t: Tables) -> DataFrame:
    w = R.Length(3).frame(USER)
    return t.log.select("event_id", F.first("value").over(w).alias("first_v"), F.last("value").over(w).alias("last_v"), A.nth("value", 1, w).alias("nth1"))


@query(
    """select event_id, first_value(value) over w as first_ever, max(value) over w as max_ever, min(value) over w as min_ever, count(*) over w as count_ever
    from events window w as (partition by event_type order by ts, event_id rows unbounded preceding)"""
)
def aggregate_ever(t: Tables) -> DataFrame:
    """Of the five types all events so far, each type spread over hours."""
    out = A.running_unkeyed(t.log, by=["event_type"], first_ever=("first", "value"), max_ever=("max", "value"), min_ever=("min", "value"), count_ever=("count", F.lit(1)))
    return out.select("event_id", "first_ever", "max_ever", "min_ever", "count_ever")


@query(
    """select event_type, arg_max(event_id, value) as top_event, arg_min(event_id, value) as low_event from
    (select event_type, event_id, value, row_number() over (partition by event_type, value order by ts, event_id) as k from events) where k = 1 group by event_type"""
)
def aggregate_max_by(t: Tables) -> DataFrame:
    return t.log.groupBy("event_type").agg(A.max_by("event_id", "value").alias("top_event"), A.min_by("event_id", "value").alias("low_event"))


@query("select user_id, string_agg(event_id::varchar, ',' order by value, event_id) as ids from events group by user_id")
def aggregate_sorted(t: Tables) -> DataFrame:
    return t.log.groupBy("user_id").agg(F.array_join(A.sorted_values(F.col("event_id").cast("string"), "value"), ",").alias("ids"))


@query(
    """select user_id, min(value) as first_key, max(value) as last_key, max(value) filter (where value < 50) as below, min(value) filter (where value > 50) as above, count(*) as n
    from events group by user_id"""
)
def aggregate_sorted_access(t: Tables) -> DataFrame:
    a = A.SortedAccess("value", "event_id")
    made = t.log.groupBy("user_id").agg(a.entries.alias("e"))
    a.entries = F.col("e")
    return made.select("user_id", a.first_key().alias("first_key"), a.last_key().alias("last_key"), a.lower_key(F.lit(50.0)).alias("below"), a.higher_key(F.lit(50.0)).alias("above"), a.count_events().cast("long").alias("n"))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 3599999999 microseconds preceding and current row) / 3600.0 as per_second from events")
def aggregate_rate(t: Tables) -> DataFrame:
    return t.log.select("event_id", A.rate(HOUR, USER).alias("per_second"))


@query(
    """select event_id, case when p is not null then round(3 * 1000.0 / nullif(ms - p, 0), 6) end as rate, k > 3 as leaving
    from (select event_id, epoch_ms(ts) as ms, lag(epoch_ms(ts), 3) over w as p, row_number() over w as k from events window w as (partition by user_id order by ts, event_id))"""
)
def aggregate_rate_by_timestamp(t: Tables) -> DataFrame:
    log = t.log.withColumn("ms", F.floor(F.col("_ts") / 1000))
    return log.select("event_id", r(A.rate_by_timestamp("ms", 3, by=USER), 6).alias("rate"), A.leaving(3, USER).alias("leaving"))


@query(
    """select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as y_intercept,
      round(corr(l_extendedprice, l_quantity), 6) as corr, round(var_samp(l_quantity), 4) as variance, round(stddev_pop(l_quantity), 4) as stddevpa, count(l_quantity) as datapoints
    from lineitem group by 1"""
)
def aggregate_linest(t: Tables) -> DataFrame:
    fit, one = A.linest("l_extendedprice", "l_quantity"), A.univariate("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(r(fit["slope"]).alias("slope"), r(fit["y_intercept"], 2).alias("y_intercept"), r(F.corr("l_extendedprice", "l_quantity"), 6).alias("corr"), r(one["variance"]).alias("variance"), r(one["stddevpa"]).alias("stddevpa"), one["datapoints"].alias("datapoints"))


@query("select l_returnflag, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) as exact_total from lineitem group by 1")
def aggregate_exact(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("exact_total"))


@query("select user_id, round(sum(distinct value), 4) as total, count(distinct event_type) as types from events group by user_id")
def aggregate_distinct(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(r(A.sum_distinct("value")).alias("total"), A.count_distinct("event_type").alias("types"))


@query("select event_id, round(sum(value) over (partition by event_type), 4) as by_type, round(sum(value) over (partition by user_id), 4) as by_user, count(*) over () as n from events")
def aggregate_local_group(t: Tables) -> DataFrame:
    total = t.events.agg(F.count("*").alias("n"))
    rows = t.events.select("event_id", r(A.local_group(F.sum("value"), "event_type")).alias("by_type"), r(A.local_group(F.sum("value"), "user_id")).alias("by_user"))
    return rows.crossJoin(F.broadcast(total))  # one row


_GROUPS = "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, cast(grouping(l_returnflag) as bigint) as g, cast(grouping_id(l_returnflag, l_linestatus) as bigint) as gid from lineitem group by "


def _grouped(df) -> DataFrame:
    return df.agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 2).alias("qty"), F.grouping("l_returnflag").cast("long").alias("g"), F.grouping_id("l_returnflag", "l_linestatus").cast("long").alias("gid"))


@query(_GROUPS + "rollup (l_returnflag, l_linestatus)")
def group_rollup(t: Tables) -> DataFrame:
    return _grouped(t.lineitem.rollup("l_returnflag", "l_linestatus"))


@query(_GROUPS + "cube (l_returnflag, l_linestatus)")
def group_cube(t: Tables) -> DataFrame:
    return _grouped(t.lineitem.cube("l_returnflag", "l_linestatus"))


@query(_GROUPS + "grouping sets ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def group_sets(t: Tables) -> DataFrame:
    return _grouped(t.lineitem.groupingSets([["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], "l_returnflag", "l_linestatus"))


@query("select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id having count(*) > 60 and sum(value) > 1000")
def group_having(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("s")).where("n > 60 and s > 1000").select("user_id", "n", r("s").alias("total"))


# ---- previous and prior ------------------------------------------------------------------------------------


@query(
    """select event_id, lag(value, 2) over p as prior2, case when row_number() over p > 1 then lag(value, 1) over p end as prev1, first_value(value) over w as tail0, count(*) over w as prevcount,
      list_reverse(list(event_id) over w) as prevwindow
    from events window p as (partition by user_id order by ts, event_id), w as (partition by user_id order by ts, event_id rows between 2 preceding and current row)"""
)
def analytic_prev_prior(t: Tables) -> DataFrame:
    p, w = R.ordered(USER), R.Length(3).frame(USER)
    return t.log.select("event_id", F.lag("value", 2).over(p).alias("prior2"), F.lag("value", 1).over(p).alias("prev1"), A.nth_from_oldest("value", 0, w).alias("tail0"), F.count("*").over(w).alias("prevcount"), F.reverse(A.window_values("event_id", w)).alias("prevwindow"))


# ---- output policies ---------------------------------------------------------------------------------------

_BATCHES = "with b as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 6 as batch from events), k as (select *, count(*) over (partition by user_id, batch) as size, row_number() over (partition by user_id, batch order by ts, event_id) as f, row_number() over (partition by user_id, batch order by ts desc, event_id desc) as l from b) select user_id, cast(batch as bigint) as batch, event_id from k where size = 6"


def _batch(t: Tables) -> DataFrame:
    return O.every_events(t.log, 6, USER)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.col("_batch").cast("long").alias("batch"), "event_id")


@query(_BATCHES)
def output_every(t: Tables) -> DataFrame:
    return _shown(_batch(t))


@query(_BATCHES + " and f = 1")
def output_first(t: Tables) -> DataFrame:
    return _shown(O.first_of_batch(_batch(t), USER))


@query(_BATCHES + " and l = 1")
def output_last(t: Tables) -> DataFrame:
    return _shown(O.last_of_batch(_batch(t), USER))


@query(
    """with b as (select *, cast(floor(epoch_us(ts) / 21600000000) as bigint) as batch from events),
    l as (select event_type, batch, max(event_id) as event_id from b group by 1, 2),
    k as (select generate_series as batch from generate_series((select min(batch) from b), (select max(batch) from b))),
    g as (select event_type, k.batch, max(l.event_id) as event_id from l, k where l.batch <= k.batch group by 1, 2)
    select event_type, batch, event_id from g"""
)
def output_all(t: Tables) -> DataFrame:
    """At every tick of six hours the last row of each group seen so far."""
    out = O.all_groups(O.every_time(t.log, 6 * HOUR, F.lit(0)), ["event_type"])
    return out.select("event_type", F.col("_batch").cast("long").alias("batch"), "event_id")


@query(
    """with m as (select (min(epoch_us(ts)) // 21600000000) * 21600000000 as a, max(epoch_us(ts)) as z from events),
    k as (select unnest(generate_series(a + 21600000000, z, 21600000000)) as tick from m)
    select tick, count(*) as n, round(sum(value), 4) as total from k join events on epoch_us(ts) <= tick and epoch_us(ts) + 3600000000 > tick group by tick"""
)
def output_snapshot(t: Tables) -> DataFrame:
    """What an hour's window holds at ticks of six hours."""
    a, z = t.log.agg(F.min("_ts"), F.max("_ts")).first()
    if a is None:
        a = z = 0
    return O.snapshot_at(R.Time(HOUR).lifetimes(t.log), a // (6 * HOUR) * 6 * HOUR, z, 6 * HOUR).groupBy("tick").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query("select event_id from (select event_id, row_number() over (partition by user_id order by ts, event_id) as k from events) where k > 20")
def output_after(t: Tables) -> DataFrame:
    return O.after_events(t.log, 20, USER).select("event_id")


@query(
    """with b as (select *, cast(floor(epoch_us(ts) / 86400000000) as bigint) as day from events)
    select day, event_id, value from (select *, row_number() over (partition by day order by value desc, event_id) as k from b) where k between 3 and 7"""
)
def output_order_limit(t: Tables) -> DataFrame:
    """The third to seventh row of each day's batch by value."""
    batches = O.every_time(t.log, 24 * HOUR, F.lit(0))
    out = O.limit_batch(batches, [F.desc("value"), F.col("event_id")], 5, 2)
    return out.select(F.col("_batch").cast("long").alias("day"), "event_id", "value")


@query("select distinct cast(floor(epoch_us(ts) / 86400000000) as bigint) as day, event_type from events")
def output_distinct(t: Tables) -> DataFrame:
    return O.distinct_batch(O.every_time(t.log, 24 * HOUR, F.lit(0)), ["event_type"]).select(F.col("_batch").cast("long").alias("day"), "event_type")


@query(
    """with n as (select *, (row_number() over (partition by user_id order by ts, event_id) - 1) // 3 as b from events)
    select user_id, cast(b as bigint) as batch, event_id from (select *, count(*) over (partition by user_id, b) as size from n) where size = 3"""
)
def output_when(t: Tables) -> DataFrame:
    out = O.when(t.log, O.InsertsFrom(3), USER)
    return out.select("user_id", F.col("_batch").alias("batch"), "event_id")


@query("select user_id, event_id, n from (select user_id, event_id, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def output_terminated(t: Tables) -> DataFrame:
    """The last running count of each user's partition, when the log ends."""
    out = O.at_termination(A.running(t.log, R.KeepAll(), USER, n=F.count("*")), USER)
    return out.select("user_id", "event_id", "n")


@query(
    """select e.event_id, (select min(x.event_id) from events x where x.event_type = e.event_type and x.ts >= e.ts + interval 1 month) as evicted_by from events e"""
)
def window_ext_timed_calendar(t: Tables) -> DataFrame:
    """Sliding over a calendar month by the event's own time."""
    live = R.ExternallyTimedCalendar("_ts", months=1).lifetimes(t.log.select("_ts", "_seq", "event_type", "event_id"), ["event_type"])
    return live.select("event_id", F.col("_out.seq").alias("evicted_by"))


@query("select event_id, epoch_us(ts + interval 1 month) as leaves_us from events")
def window_time_calendar(t: Tables) -> DataFrame:
    return R.TimeCalendar(months=1).lifetimes(t.log).select("event_id", F.col("_out.ts").alias("leaves_us"))


@query(
    """with g as (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 1 day then 1 else 0 end as fresh from events),
    s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
    select user_id, cast(session as bigint) as session, count(*) as n, epoch_us(max(ts) + interval 1 day) as expires_us from s group by user_id, session"""
)
def window_time_accum_calendar(t: Tables) -> DataFrame:
    live = R.TimeAccumCalendar(days=1).lifetimes(t.log, USER)
    return live.groupBy("user_id", F.col("_session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.max("_out.ts").alias("expires_us"))


@query("select event_id, epoch_us(ts + interval 1 month) as out_us from events")
def window_time_order_calendar(t: Tables) -> DataFrame:
    live = R.TimeOrderCalendar("_ts", months=1).lifetimes(t.log)
    return live.select("event_id", F.col("_out.ts").alias("out_us"))


@query(
    """with recursive e as (select user_id, value, ts, row_number() over (partition by user_id order by ts, event_id) as i from events),
    s as (
      select user_id, i, value, ts as anchor, 1 as k from e where i = 1
      union all
      select e.user_id, e.i, e.value, case when e.ts >= s.anchor + to_months(s.k + 1) then e.ts else s.anchor end,
        case when e.ts >= s.anchor + to_months(s.k + 1) then 1 when e.ts >= s.anchor + to_months(s.k) then s.k + 1 else s.k end
      from s join e on e.user_id = s.user_id and e.i = s.i + 1)
    select user_id, epoch_us(anchor + to_months(k)) as flush_us, count(*) as n, round(sum(value), 4) as total from s group by user_id, anchor, k"""
)
def window_time_batch_calendar(t: Tables) -> DataFrame:
    """Batches of a month from a user's first event."""
    live = R.TimeBatchCalendar(1).lifetimes(t.log.select("_ts", "_seq", "user_id", "value"), USER)
    return live.groupBy("user_id", F.col("_in.ts").alias("flush_us")).agg(F.count("*").alias("n"), r(F.sum("value")).alias("total"))


@query(
    """select event_id, count(*) over w as n, round(sum(value) over w, 4) as total, max(value) over w as top, min(value) over w as low
    from events window w as (order by ts, event_id rows unbounded preceding)"""
)
def aggregate_unkeyed(t: Tables) -> DataFrame:
    """Running aggregates of the whole stream, spread over hours."""
    out = A.running_unkeyed(t.log, n=("count", F.lit(1)), total=("sum", "value"), top=("max", "value"), low=("min", "value"))
    return out.select("event_id", "n", r("total").alias("total"), "top", "low")
