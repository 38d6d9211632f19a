"""Queries on telemetry and epoch series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks, pairs, series, stats
from .inputs import EPOCH, TELE, epochs, telemetry
from .pixel_queries import rounded

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def q(c: str, p: float) -> str:
    return f"round(quantile_cont({c}, {p}), 8)"


ZONE = EPOCH + ", zs as (select zone, i, any_value(t) as t, quantile_cont(disp, .5) as y from ep group by 1, 2)"


def _zone(spark, d):
    return epochs(spark, d).groupBy("zone", "i").agg(F.first("t").alias("t"), F.percentile("disp", F.lit(0.5)).alias("y"))


@query("zone_series", f"with {EPOCH} select zone, i, count(disp) as n, {q('disp', .5)} as median, round((quantile_cont(disp, .75) - quantile_cont(disp, .25)) / 2, 8) as half_iqr from ep group by 1, 2")
def _(spark, d):
    return rounded(series.zone_series(epochs(spark, d), ["zone", "i"], "disp"), 8)


LIN = """count(*) as n, round(regr_slope(y, t), 7) as rate, round(regr_intercept(y, t), 7) as intercept, round(sqrt(greatest(0, regr_syy(y, t) - pow(regr_sxy(y, t), 2) / regr_sxx(y, t)) / count(*)), 7) as rms,
 round(sqrt(greatest(0, regr_syy(y, t) - pow(regr_sxy(y, t), 2) / regr_sxx(y, t)) / (count(*) - 2) / regr_sxx(y, t)), 7) as rate_sigma"""


@query("pixel_rates", f"with {EPOCH}, s as (select pixel, t, disp as y from ep) select pixel, {LIN} from s group by 1")
def _(spark, d):
    return rounded(series.linear_rate(epochs(spark, d), ["pixel"], "t", "disp"), 7)


@query("zone_rates", f"with {ZONE} select zone, {LIN} from zs group by 1")
def _(spark, d):
    return rounded(series.linear_rate(_zone(spark, d), ["zone"]), 7)


@query("weighted_rates", f"""with {ZONE}, s as (select zone, t, y, case when i % 5 > 0 then 1 + i % 5 end as sg from zs), m as (select zone, count(*) as n, count(sg) as v, quantile_cont(sg, .5) as md from s group by 1),
 w as (select zone, n, t, y, case when v < greatest(10, n / 2) then 1.0 else 1 / pow(coalesce(sg, md), 2) end as w from s join m using (zone)), c as (select zone, sum(w * t) / sum(w) as tm, sum(w * y) / sum(w) as ym from w group by 1)
select zone, any_value(n) as n, round(sum(w * (t - tm) * (y - ym)) / sum(w * pow(t - tm, 2)), 7) as rate, round(1 / sqrt(sum(w * pow(t - tm, 2))), 7) as rate_sigma from w join c using (zone) group by 1""")
def _(spark, d):
    z = _zone(spark, d).withColumn("sigma", F.expr("cast(case when i % 5 > 0 then 1 + i % 5 else 0 end as double)"))
    return rounded(series.weighted_rate(z, ["zone"]), 7)


@query("seasonal_fit")
def _(spark, d):
    return rounded(series.seasonal_fit(epochs(spark, d), ["pixel"], "t", "disp"), 6)


@query("step_fit", f"""with {ZONE}, k as (select unnest(range(4, 60)) as k), s as (select zone, k, t, y, (i >= k)::int::double as h from zs cross join k),
 c as (select zone, k, t - avg(t) over w as t, y - avg(y) over w as y, h - avg(h) over w as h from s window w as (partition by zone, k)),
 g as (select zone, k, count(*) as n, sum(t * t) as tt, sum(t * y) as ty, sum(y * y) as yy, sum(h * h) as hh, sum(h * t) as ht, sum(h * y) as hy from c group by 1, 2),
 f as (select zone, k, n, (hy - ht * ty / tt) / (hh - ht * ht / tt) as step, yy - ty * ty / tt - pow(hy - ht * ty / tt, 2) / (hh - ht * ht / tt) as rss, yy - ty * ty / tt as rss0 from g)
select zone, n, arg_min(k, rss) as index, round(arg_min(step, rss), 6) as step, round(sqrt(min(rss) / n), 6) as rms, round(sqrt(any_value(rss0) / n), 6) as rms_linear from f group by 1, 2""")
def _(spark, d):
    return rounded(series.step_fit(_zone(spark, d), ["zone"]).drop("at"), 6)


@query("oscillation", f"""with {ZONE}, f as (select zone, regr_slope(y, t) as r, regr_intercept(y, t) as c from zs group by 1), x as (select zone, y - r * t - c as e from zs join f using (zone)) select zone, round(quantile_cont(e, .975) - quantile_cont(e, .025), 7) as amplitude from x group by 1""")
def _(spark, d):
    return rounded(series.oscillation(_zone(spark, d), ["zone"]), 7)


@query("group_structure", f"""with {ZONE}, f as (select zone, regr_slope(y, t) as r, regr_intercept(y, t) as c from zs group by 1), x as (select zone, t, y - r * t - c as e from zs join f using (zone)),
 p as (select a.zone as a, b.zone as b, corr(a.e, b.e) as r from x a join x b on a.t = b.t and a.zone < b.zone group by 1, 2), g as (select quantile_cont(r, .5) filter (a % 2 = b % 2) as within, quantile_cont(r, .5) filter (a % 2 <> b % 2) as between_ from p)
select round(within, 7) as within, round(between_, 7) as "between", case when between_ > .5 then 'common_mode' when within - between_ >= .3 and between_ < 0 then 'survives' else 'unclear' end as verdict from g""")
def _(spark, d):
    z = _zone(spark, d).withColumn("g", F.col("zone") % 2)
    return rounded(series.group_structure(z, "zone", "g", "t", "y"), 7)


@query("trend_table", f"""with {ZONE}, o as (select *, row_number() over (partition by zone order by t) <= count(*) over (partition by zone) // 2 as early from zs),
 p as (select zone, t, y, 'full' as part from o union all select zone, t, y, case when early then 'first' else 'second' end from o),
 s as (select a.zone, a.part, quantile_cont((b.y - a.y) / (b.t - a.t), .5) as slope from p a join p b on a.zone = b.zone and a.part = b.part and a.t < b.t group by 1, 2), n as (select zone, count(*) as n from zs group by 1)
select zone, any_value(n.n) as n, round(max(slope) filter (part = 'full'), 7) as full, round(max(slope) filter (part = 'first'), 7) as first, round(max(slope) filter (part = 'second'), 7) as second from s join n using (zone) group by 1""")
def _(spark, d):
    return rounded(series.trend_table(_zone(spark, d), ["zone"], per=1.0), 7)


@query("theil_sen", f"""with {ZONE}, s as (select a.zone, quantile_cont((b.y - a.y) / (b.t - a.t), .5) as slope from zs a join zs b on a.zone = b.zone and a.t < b.t group by 1), m as (select zone, count(*) as n, quantile_cont(t, .5) as tm, quantile_cont(y, .5) as ym from zs group by 1)
select zone, n, round(slope, 7) as slope, round(ym - slope * tm, 7) as intercept from m join s using (zone)""")
def _(spark, d):
    return rounded(series.theil_sen(_zone(spark, d), ["zone"]), 7)


@query("split_half_rates", f"""with {ZONE}, h as (select *, case when row_number() over (partition by zone order by t) <= count(*) over (partition by zone) // 2 then 1 else 2 end as half from zs)
select zone, round(regr_slope(y, t), 7) as rate, round(regr_slope(case when half = 1 then y end, t), 7) as first, round(regr_slope(case when half = 2 then y end, t), 7) as second, abs(regr_slope(case when half = 1 then y end, t) - regr_slope(case when half = 2 then y end, t)) > .25 * abs(regr_slope(y, t)) as differs from h group by 1""")
def _(spark, d):
    return rounded(series.split_half_rates(_zone(spark, d), ["zone"]), 7)


@query("cumulative", f"with {EPOCH} select pixel, round(arg_max(disp, i) - arg_min(disp, i), 8) as cumulative from ep group by 1")
def _(spark, d):
    return rounded(series.cumulative(epochs(spark, d), ["pixel"], "i", "disp"), 8)


@query("largest_steps", f"""with {ZONE}, s as (select zone, i, y - lag(y) over (partition by zone order by i) as step from zs), r as (select *, row_number() over (partition by zone order by abs(step) desc, i) as rank from s where step is not null) select zone, i, round(step, 8) as step, rank from r where rank <= 3""")
def _(spark, d):
    return rounded(series.largest_steps(_zone(spark, d), ["zone"], "i", "y"), 8)


@query("rolling_median", f"""with {ZONE} select zone, i, case when count(y) over w >= 12 then round(quantile_cont(y, .5) over w, 8) end as rolling from zs window w as (partition by zone order by i rows between 25 preceding and 25 following)""")
def _(spark, d):
    return rounded(series.rolling_median(_zone(spark, d), ["zone"], "i", "y").select("zone", "i", "rolling"), 8)


@query("persistent_support", f"with {EPOCH} select pixel, round(count(case when disp > -1 then 1 end) / 64, 8) as support from ep group by 1")
def _(spark, d):
    e = epochs(spark, d).withColumn("v", F.expr("case when disp > -1 then disp end"))
    return rounded(stats.support(e, ["pixel"], "v", 64), 8)


@query("epoch_change", f"with {EPOCH}, s as (select pixel, max(disp) filter (i = 0) as a, max(disp) filter (i = 63) as b from ep group by 1) select pixel, round(b - a, 8) as change, round(100 * (b - a) / nullif(a, 0), 5) as pct_change from s")
def _(spark, d):
    e = epochs(spark, d).groupBy("pixel").agg(F.max(F.expr("case when i = 0 then disp end")).alias("a"), F.max(F.expr("case when i = 63 then disp end")).alias("b"))
    return stats.epoch_change(e, "a", "b").select("pixel", F.round("change", 8).alias("change"), F.round("pct_change", 5).alias("pct_change"))


@query("zone_spearman", f"""with {EPOCH}, s as (select zone, pixel, avg(disp) as a, max(disp) as b from ep group by 1, 2), k as (select *, rank() over (partition by zone order by a) + (count(*) over (partition by zone, a) - 1) / 2 as ra, rank() over (partition by zone order by b) + (count(*) over (partition by zone, b) - 1) / 2 as rb from s)
select zone, count(*) as n, round(corr(ra, rb), 7) as spearman, round(corr(a, b), 7) as pearson from k group by 1""")
def _(spark, d):
    s = epochs(spark, d).groupBy("zone", "pixel").agg(F.avg("disp").alias("a"), F.max("disp").alias("b"))
    return rounded(stats.spearman(s, ["zone"], "a", "b"), 7)


@query("epoch_bootstrap")
def _(spark, d):
    z = _zone(spark, d).withColumn("n", F.lit(64))
    return rounded(stats.epoch_bootstrap(z.select("zone", "t", "y", "i", "n"), ["zone"], 1000), 7)


@query("block_permutation")
def _(spark, d):
    z = _zone(spark, d)
    other = z.select("i", ((F.col("zone") + 9) % 10).alias("zone"), F.col("y").alias("b"))
    p = z.join(other, ["zone", "i"]).select("zone", "i", F.col("y").alias("a"), "b")
    return rounded(stats.block_permutation(p, ["zone"], 8), 7)


@query("daily_series", f"with {TELE} select producer, station, cast(ts as date) as date, count(value) as n, {q('value', .5)} as median from tele where value is not null group by 1, 2, 3 having count(value) >= 2")
def _(spark, d):
    return rounded(series.daily_series(telemetry(spark, d), ["producer", "station"]), 8)


DAILY = TELE + ", dl as (select station, station % 5 as zone, cast(ts as date) as date, count(value) as n, quantile_cont(value, .5) as median from tele where value is not null group by 1, 2, 3 having count(value) >= 2), an as (select *, median - quantile_cont(median, .5) over (partition by station) as anomaly from dl)"


def _anomalies(spark, d):
    daily = series.daily_series(telemetry(spark, d).withColumn("zone", F.col("station") % 5), ["station", "zone"])
    return series.anomaly(daily, ["station"])


@query("station_anomalies", f"with {DAILY} select station, date, round(anomaly, 8) as anomaly from an")
def _(spark, d):
    return rounded(_anomalies(spark, d).select("station", "date", "anomaly"), 8)


COMP = "select {k}, date, count(*) as n, round(quantile_cont(anomaly, .5), 8) as composite, any_value(stations) as stations from {t} join (select {k}, count(distinct station) as stations from {t} group by {k}) s using ({k}) group by {k}, date having count(*) >= greatest(.05 * any_value(stations), 2)"


@query("zone_composite", f"with {DAILY}, st as (select zone, count(distinct station) as stations from an group by 1) select zone, date, count(*) as n, round(quantile_cont(anomaly, .5), 8) as composite, any_value(stations) as stations from an join st using (zone) group by 1, 2 having count(*) >= greatest(.5 * any_value(stations), 2)")
def _(spark, d):
    return rounded(series.composite(_anomalies(spark, d), ["zone"], "station"), 8)


@query("leave_one_out_composite", f"""with {DAILY}, few as (select * from an), o as (select distinct zone, station as left_out from few), r as (select few.*, left_out from few join o using (zone) where station <> left_out), st as (select zone, left_out, count(distinct station) as stations from r group by 1, 2)
select zone, left_out, date, count(*) as n, round(quantile_cont(anomaly, .5), 8) as composite, any_value(stations) as stations from r join st using (zone, left_out) group by 1, 2, 3 having count(*) >= greatest(.5 * any_value(stations), 2)""")
def _(spark, d):
    return rounded(series.loo_composite(_anomalies(spark, d), ["zone"], "station"), 8)


FLAGS = """fl as (select station, producer, value, ts, value - lag(value) over w as dv, (ts = lag(ts) over w)::int as rp from tele window w as (partition by station, producer order by ts, value)),
 sf as (select station, producer, count(*) as n, avg((value = 0)::int) as zf, avg(coalesce((dv = 0)::int, 0)) as cf, cast(coalesce(sum((abs(dv) > 10)::int), 0) as bigint) as jumps, cast(coalesce(sum(rp), 0) as bigint) as repeated_times from fl group by 1, 2)"""


@query("sensor_flags", f"with {TELE}, {FLAGS} select station, producer, n, round(zf, 8) as zero_fraction, round(cf, 8) as constant_fraction, jumps, repeated_times from sf")
def _(spark, d):
    return rounded(series.sensor_flags(telemetry(spark, d), ["station", "producer"]), 8)


@query("interval_audit", f"""with {TELE}, g as (select station, ts, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by station order by ts)) / 3.6e9 as gap from tele)
select station, count(*) as n, round(min(gap), 7) as gap_min, round(quantile_cont(gap, .5), 7) as gap_median, round(quantile_cont(gap, .99), 7) as gap_p99, round(max(gap), 7) as gap_max, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 7) as hours,
 round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 / nullif(quantile_cont(gap, .5), 0) + 1), 7) as observed_ratio from g group by 1""")
def _(spark, d):
    return rounded(series.interval_audit(telemetry(spark, d), ["station"]), 7)


QC = {"constant_max": 0.5, "zero_max": 0.5, "min_days": 5, "max_gap_days": 8}


@query("station_qc", f"""with {TELE}, t2 as (select * from tele), fl as (select station, value, value - lag(value) over w as dv from tele window w as (partition by station order by ts, value)), sf as (select station, count(*) as n, avg((value = 0)::int) as zf, avg(coalesce((dv = 0)::int, 0)) as cf from fl group by 1),
 dd as (select distinct station, cast(ts as date) as date from tele where value is not null), gg as (select station, date, date - lag(date) over (partition by station order by date) as g from dd), sp as (select station, count(*) as days, coalesce(max(g), 0) as mg from gg group by 1)
select station, case when cf > .5 or zf > .5 then 'dead' when coalesce(days, 0) < 5 then 'insufficient' when mg > 8 then 'gaps' else 'pass' end as qc from sf left join sp using (station)""")
def _(spark, d):
    return series.station_qc(telemetry(spark, d), ["station"], QC).select("station", "qc")


@query("temporal_profile", f"""with {TELE}, dd as (select distinct producer, station % 20 as s, cast(ts as date) as date from tele), g as (select *, date - lag(date) over (partition by producer, s order by date) as gap from dd)
select producer, s, count(*) as n, min(date) as first_date, max(date) as last_date, quantile_cont(gap, .5) as revisit_median, cast(max(gap) as int) as gap_max, cast(sum(coalesce((gap > 36)::int, 0)) as bigint) as gaps_over_36 from g group by 1, 2""")
def _(spark, d):
    dates = telemetry(spark, d).select("producer", (F.col("station") % 20).alias("s"), F.to_date("ts").alias("date")).distinct()
    return series.temporal_profile(dates, ["producer", "s"])


@query("lag_window_match", f"""with {TELE}, s as (select producer as series_id, cast(ts as date) as date, avg(value) as value from tele group by 1, 2), e as (select distinct date as epoch from s where day(date) % 6 = 0), l as (select unnest([0, 6, 12]) as lag),
 m as (select series_id, epoch, lag, value from e cross join l join s on s.date between cast(epoch - cast(lag as int) - 3 as date) and cast(epoch - cast(lag as int) + 3 as date))
select series_id, epoch, lag, count(value) as n, case when count(value) >= 4 then round(quantile_cont(value, .5), 8) end as median from m group by 1, 2, 3""")
def _(spark, d):
    s = telemetry(spark, d).groupBy(F.col("producer").alias("series_id"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    e = s.where("day(date) % 6 = 0").select(F.col("date").alias("epoch")).distinct()
    return rounded(pairs.lag_window_match(s, e, [0, 6, 12]), 8)


@query("seasonal_cycle", """with m as (select o_orderpriority as p, month(o_orderdate) as month, avg(o_totalprice) as mean from orders group by 1, 2) select p, round(max(mean) - min(mean), 5) as amplitude, arg_max(month, (mean, -month)) as peak_month from m group by 1""")
def _(spark, d):
    from .inputs import table

    o = table(spark, d, "orders").withColumn("p", F.col("o_orderpriority"))
    return rounded(stats.seasonal_cycle(o, ["p"], F.month("o_orderdate"), "o_totalprice"), 5).withColumn("peak_month", F.col("peak_month").cast("long"))


@query("monthly_lags", """with a as (select o_orderpriority as p, cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as value from orders group by 1, 2), b as (select cast(date_trunc('month', l_shipdate) as date) as month, avg(l_extendedprice) as vb from lineitem group by 1), l as (select unnest([0, 1, 2, 3]) as lag),
 s as (select lag, cast(month + to_months(cast(lag as int)) as date) as month, vb from b cross join l) select p, lag, count(*) as n, round(corr(value, vb), 7) as r from a join s using (month) group by 1, 2 having count(*) >= 13""")
def _(spark, d):
    from .inputs import table

    a = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.to_date(F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))).alias("month")).agg(F.avg("o_totalprice").alias("value"))
    b = table(spark, d, "lineitem").groupBy(F.to_date(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("month")).agg(F.avg("l_extendedprice").alias("value"))
    return rounded(series.monthly_lags(a, b, ["p"]), 7)


@query("bh_fdr", f"""with {TELE}, p as (select producer, station, case when count(*) > 2 then round(min(abs(value)) / 100, 8) end as p from tele group by 1, 2), r as (select *, coalesce(p, 1.0) as pp, row_number() over (partition by producer order by coalesce(p, 1.0), station) as rank, count(*) over (partition by producer) as m from p),
 k as (select *, max(case when pp <= .2 * rank / m then rank end) over (partition by producer) as last from r) select producer, station, p, rank, m, rank <= coalesce(last, 0) as rejected from k""")
def _(spark, d):
    p = telemetry(spark, d).groupBy("producer", "station").agg(F.when(F.count("*") > 2, F.round(F.min(F.abs("value")) / 100, 8)).alias("p"))
    return stats.bh_fdr(p.select("producer", "station", "p"), ["producer"], "p", 0.2)


@query("decimal_years", """select o_orderkey, round(year(o_orderdate) + (month(o_orderdate) - 1) / 12 + (day(o_orderdate) - 1) / 365.25, 8) as a, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25, 8) as b from orders""")
def _(spark, d):
    from .inputs import table

    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(pairs.decimal_year(F.col("o_orderdate"), "A"), 8).alias("a"), F.round(pairs.decimal_year(F.col("o_orderdate"), "B"), 8).alias("b"))


@query("rank_percentile", f"with {ZONE} select zone, i, row_number() over w as rank, round(100.0 * row_number() over w / count(*) over (partition by zone), 8) as rank_pct from zs window w as (partition by zone order by y, i)")
def _(spark, d):
    return rounded(stats.rank_pct(_zone(spark, d), ["zone"], ["y", "i"]).select("zone", "i", "rank", "rank_pct"), 8)


@query("temporal_form")
def _(spark, d):
    z = _zone(spark, d)
    fits = series.linear_rate(z, ["zone"]).select("zone", "rate", F.col("rms").alias("rms_linear"))
    fits = fits.join(series.seasonal_fit(z, ["zone"]).select("zone", "annual", F.col("rms").alias("rms_seasonal")), "zone")
    fits = fits.join(series.step_fit(z, ["zone"]).select("zone", "step", F.col("rms").alias("rms_step")), "zone")
    return rounded(masks.temporal_form(fits), 6)
