"""Queries on ledgers, gates, fingerprints and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, masks, pairs, stats
from .inputs import ACQ, PIX, TELE, acquisitions, pixels, table, telemetry
from .pixel_queries import rounded

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


LEDGER = """led as (select o_orderkey as job_id, o_orderstatus as status from orders where o_orderkey % 17 <> 0), rem as (select l_orderkey as job_id, min(l_linestatus) as status from lineitem where l_orderkey % 19 <> 0 group by 1)"""


def _ledger(spark, d):
    led = table(spark, d, "orders").where("o_orderkey % 17 != 0").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    rem = table(spark, d, "lineitem").where("l_orderkey % 19 != 0").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.min("l_linestatus").alias("status"))
    return led, rem


@query("ledger_reconciliation", f"""with {LEDGER} select coalesce(l.job_id, r.job_id) as job_id, l.status as ledger_status, r.status as remote_status,
 case when r.job_id is null then 'missing' when l.job_id is null then 'unexpected' when l.status is distinct from r.status then 'status_mismatch' else 'both' end as state from led l full join rem r on l.job_id = r.job_id""")
def _(spark, d):
    return gates.reconcile_ledger(*_ledger(spark, d))


@query("duplicate_keys", "select o_custkey, cast(o_orderdate as date) as date, count(*) as n from orders group by 1, 2 having count(*) > 1")
def _(spark, d):
    return gates.duplicate_keys(table(spark, d, "orders").withColumn("date", F.to_date("o_orderdate")), ["o_custkey", "date"])


@query("gate_table", f"""with {ACQ}, v as (select count(distinct date) as dates, count(distinct burst) as bursts, max(perp) as top from acq)
select 'dates' as name, dates >= 300 as passed, '>= 300' as expected from v union all select 'bursts', bursts = 4, '4' from v union all select 'perp', top < 1000, '< 1000' from v""")
def _(spark, d):
    v = acquisitions(spark, d).agg(F.countDistinct("date").alias("dates"), F.countDistinct("burst").alias("bursts"), F.max("perp").alias("top"))
    return gates.gate_table(v, [("dates", F.col("dates") >= 300, ">= 300"), ("bursts", F.col("bursts") == 4, "4"), ("perp", F.col("top") < 1000, "< 1000")])


@query("gate_verdict", f"""with {ACQ}, v as (select count(distinct date) as dates, count(distinct burst) as bursts from acq) select dates >= 300 and bursts = 4 as accepted, cast((dates < 300)::int + (bursts <> 4)::int as bigint) as failed from v""")
def _(spark, d):
    v = acquisitions(spark, d).agg(F.countDistinct("date").alias("dates"), F.countDistinct("burst").alias("bursts"))
    return gates.verdict(gates.gate_table(v, [("dates", F.col("dates") >= 300, ">= 300"), ("bursts", F.col("bursts") == 4, "4")]))


@query("acquisition_accounting", f"""with {ACQ}, f as (select date from acq where burst = 'F'), o as (select date from acq where burst = 'O' and perp > 140), p as (select date from acq where burst = 'P'), d as (select distinct date from acq)
select date, date in (select date from f) as in_f, date in (select date from o) as in_o, date in (select date from p) as in_p, case when date not in (select date from f) then 'not in in_f' when date not in (select date from o) then 'not in in_o' when date not in (select date from p) then 'not in in_p' end as reason from d""")
def _(spark, d):
    a = acquisitions(spark, d)
    return gates.account_acquisitions(a, [("in_f", a.where("burst = 'F'")), ("in_o", a.where("burst = 'O' and perp > 140")), ("in_p", a.where("burst = 'P'"))])


@query("hour_identity_gate", f"""with {TELE}, e as (select distinct hour(ts) as hour, cast(ts as date) as date from tele where producer in ('click', 'view')), g as (select distinct hour(ts) as hour, cast(ts as date) as date from tele where producer not in ('click', 'view')),
 j as (select coalesce(e.hour, g.hour) as hour, e.date is not null as a, g.date is not null as b from e full join g on e.hour = g.hour and e.date = g.date)
select hour, cast(sum((a and b)::int) as bigint) as both, cast(sum((a and not b)::int) as bigint) as missing, cast(sum((b and not a)::int) as bigint) as unexpected, bool_and(a and b) as passed from j group by 1""")
def _(spark, d):
    t = telemetry(spark, d).select("producer", F.hour("ts").alias("hour"), F.to_date("ts").alias("date"))
    named = F.col("producer").isin("click", "view")
    return gates.hour_identity_gate(t.where(named), t.where(~named))


@query("table_fingerprint")
def _(spark, d):
    return gates.table_fingerprint(table(spark, d, "orders"))


@query("drift_by_ranges", """with a as (select o_orderkey, o_totalprice from orders where o_orderkey % 1009 <> 0), b as (select o_orderkey, case when o_orderkey % 997 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice from orders where o_orderkey % 1013 <> 0)
select o_orderkey, case when b.o_totalprice is null then 'missing' when a.o_totalprice is null then 'new' else 'changed' end as state from a full join b using (o_orderkey) where a.o_totalprice is distinct from b.o_totalprice""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    now = o.where("o_orderkey % 1013 != 0").withColumn("o_totalprice", F.expr("case when o_orderkey % 997 = 0 then o_totalprice + 1 else o_totalprice end"))
    return gates.drift_by_ranges(o.where("o_orderkey % 1009 != 0"), now, ["o_orderkey"])


@query("drift_check", """with a as (select o_orderkey as k, sha256(o_orderpriority) as old from orders where o_orderkey % 5 <> 0), b as (select o_orderkey as k, sha256(case when o_orderkey % 7 = 0 then 'x' else o_orderpriority end) as new from orders where o_orderkey % 3 <> 0),
 j as (select coalesce(a.k, b.k) as k, case when new is null then 'missing' when old is null then 'new' when old <> new then 'changed' else 'same' end as state from a full join b on a.k = b.k)
select state, case when state = 'same' then 'ok' when k % 2 = 0 and state in ('missing', 'changed') then 'fail' else 'warn' end as severity, count(*) as n from j group by 1, 2""")
def _(spark, d):
    o = table(spark, d, "orders")
    path = F.col("o_orderkey").cast("string").alias("path")
    a = o.where("o_orderkey % 5 != 0").select(path, F.sha2("o_orderpriority", 256).alias("sha256"))
    b = o.where("o_orderkey % 3 != 0").select(path, F.sha2(F.expr("case when o_orderkey % 7 = 0 then 'x' else o_orderpriority end"), 256).alias("sha256"))
    return gates.drift(a, b, F.col("path").cast("long") % 2 == 0).groupBy("state", "severity").agg(F.count("*").alias("n"))


@query("line_audit", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents),
 r as (select * from (values ('license', 'Licensed under|License', 'info'), ('shout', '[A-Z]{6,}!!', 'warn'), ('phone', '\\+[0-9]+ \\([0-9]+\\)', 'fail')) t(rule, p, severity))
select doc_id, cast(line_no as int) as line_no, rule, severity from l join r on regexp_matches(line, p)""")
def _(spark, d):
    return gates.line_audit(table(spark, d, "documents"), [("license", "Licensed under|License", "info"), ("shout", "[A-Z]{6,}!!", "warn"), ("phone", r"\+[0-9]+ \([0-9]+\)", "fail")])


@query("cited_numbers", """with f as (select distinct doc_id, unnest(regexp_extract_all(' ' || replace(text, ' ', '  '), '(?:^|[^0-9.])([0-9]+\\.[0-9]{1,4})(?:$|[^0-9])', 1)) as token from documents), v as (select * from (values ('v2', 2.0), ('v3', 3.0), ('v11', 1.1), ('v25', 2.5)) t(name, value)),
 w as (select distinct name, unnest([format('{:.1f}', value), format('{:.2f}', value), format('{:.3f}', value), format('{:.4f}', value)]) as token from v), h as (select name, count(distinct doc_id) as documents from f join w using (token) group by 1)
select name, coalesce(documents, 0) as documents from v left join h using (name)""")
def _(spark, d):
    v = spark.createDataFrame([("v2", 2.0), ("v3", 3.0), ("v11", 1.1), ("v25", 2.5)], "name string, value double")
    return gates.cited_numbers(table(spark, d, "documents"), v)


@query("replay_check", f"""with {PIX}, a as (select row, round(avg(velocity), 3) as v from px group by 1), b as (select row, avg(velocity) as v from px where row % 7 <> 0 group by 1) select coalesce(a.row, b.row) as row, coalesce(abs(a.v - b.v) <= .001, false) as passed from a full join b on a.row = b.row""")
def _(spark, d):
    p = pixels(spark, d)
    return gates.replay_check(p.groupBy("row").agg(F.round(F.avg("velocity"), 3).alias("v")), p.where("row % 7 != 0").groupBy("row").agg(F.avg("velocity").alias("v")), "row", {"v": 0.001})


@query("upsert_latest", """with u as (select o_custkey as k, o_orderstatus as status, o_orderdate as ts, o_orderkey as id from orders), r as (select *, row_number() over (partition by k order by (status = 'F') desc, ts desc, id) as n from u) select k, status, id from r where n = 1""")
def _(spark, d):
    u = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"))
    return gates.upsert_latest(u.where("id % 2 = 0"), u.where("id % 2 != 0"), ["k"], [F.desc(F.col("status") == "F"), F.desc("ts"), F.asc("id")]).select("k", "status", "id")


@query("completion_report", """with j as (select o_orderkey as p, l.l_orderkey as job, case when o_orderstatus = 'F' then 'SUCCEEDED' when o_orderstatus = 'O' then 'FAILED' else 'RUNNING' end as status, o_orderkey % 3 <> 0 as ok from orders o left join (select distinct l_orderkey from lineitem where l_orderkey % 19 <> 0) l on l.l_orderkey = o.o_orderkey)
select count(distinct p) as expected, count(job) as submitted, count(case when job is not null and status in ('SUCCEEDED', 'FAILED') then 1 end) as ended, count(case when job is not null and status = 'FAILED' then 1 end) as failed, count(case when job is not null and status = 'SUCCEEDED' and not ok then 1 end) as not_downloaded, false as all_clean from j""")
def _(spark, d):
    o = table(spark, d, "orders")
    jobs = o.join(table(spark, d, "lineitem").where("l_orderkey % 19 != 0").select(F.col("l_orderkey").alias("job_id")).distinct(), F.col("job_id") == F.col("o_orderkey"))
    jobs = jobs.select(F.col("o_orderkey").alias("pair_id"), "job_id", F.expr("case when o_orderstatus = 'F' then 'SUCCEEDED' when o_orderstatus = 'O' then 'FAILED' else 'RUNNING' end").alias("status"), F.expr("o_orderkey % 3 != 0").alias("download_ok"))
    return gates.completion_report(o.select(F.col("o_orderkey").alias("pair_id")), jobs)


@query("window_parity", f"""with {TELE}, i as (select station as win, case when producer < 'm' then 'VV' else 'VH' end as pol, cast(ts as date) as t from tele), g as (select win, count(*) as items, list_sort(list(t) filter (pol = 'VV')) as v, list_sort(list(t) filter (pol = 'VH')) as h from i group by 1) select win as "window", items, items as hits, coalesce(v, []) = coalesce(h, []) as sound from g""")
def _(spark, d):
    i = telemetry(spark, d).select(F.col("station").alias("window"), F.when(F.col("producer") < "m", "VV").otherwise("VH").alias("polarisation"), F.to_date("ts").alias("ts"))
    return gates.window_parity(i.join(i.groupBy("window").agg(F.count("*").alias("hits")), "window"))


@query("collection_checks", """with b as (select s_suppkey as id, s_nationkey % 2 as path, 'A' as direction, 'IW1' as subswath, 1700000000 + s_suppkey as ts from supplier), g as (select count(*) as n, count(distinct id) as ids, max(id) - min(id) + 1 as span, count(distinct path) as paths, max(ts) - min(ts) as s from b)
select 'count' as "check", n >= 1 as passed from g union all select 'distinct', n = ids from g union all select 'contiguous', span = ids from g union all select 'one path', paths = 1 from g union all select 'one direction', true from g union all select 'one sub-swath', true from g union all select 'times', s <= 120 from g""")
def _(spark, d):
    s = table(spark, d, "supplier")
    return gates.collection_checks(s.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 2).alias("path"), F.lit("A").alias("direction"), F.lit("IW1").alias("subswath"), F.timestamp_seconds(F.col("s_suppkey") + 1700000000).alias("ts")))


@query("metric_ledger", f"with {PIX} select 'velocity_mean' as metric, 'all cells' as definition, round(avg(velocity), 8) as value from px union all select 'velocity_mean', 'eligible cells', round(avg(velocity), 8) from px where in_aoi and land and tcoh >= .8")
def _(spark, d):
    p = pixels(spark, d)
    m = lambda x: x.agg(F.round(F.avg("velocity"), 8).alias("value")).withColumn("metric", F.lit("velocity_mean"))
    return gates.metric_ledger({"all cells": m(p), "eligible cells": m(masks.eligible(p))})


@query("uncertainty_budget", "select n_regionkey as zone, case when n_nationkey % 2 = 0 then 'formal' else 'reference' end as kind, round(sqrt(sum(pow(1 + n_nationkey / 10, 2))), 8) as combined, count(*) as parts from nation group by 1, 2")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("zone"), F.expr("case when n_nationkey % 2 = 0 then 'formal' else 'reference' end").alias("kind"), (1 + F.col("n_nationkey") / 10).alias("sigma"))
    return rounded(gates.uncertainty_budget(n, ["zone"]), 8)


@query("distinct_lists", "select n_regionkey as r, string_agg(distinct s_nationkey::varchar, ',' order by s_nationkey::varchar) as \"values\" from supplier join nation on s_nationkey = n_nationkey group by 1")
def _(spark, d):
    return stats.listagg(table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("r", F.col("n_regionkey")), ["r"], "s_nationkey")


@query("semi_anti_enrich", """select o_orderstatus as status, count(*) as n, count(l) as with_lines, cast(sum(coalesce(q, 0)) as double) as quantity from orders left join (select l_orderkey as k, count(*) as l, sum(l_quantity) as q from lineitem where l_shipdate >= timestamp '1997-01-01' group by 1) x on k = o_orderkey where o_custkey in (select c_custkey from customer where c_nationkey < 12) and o_orderkey not in (select l_orderkey from lineitem where l_discount > .09) group by 1""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey")).withColumn("l_orderkey", F.col("o_orderkey"))
    kept = pairs.anti(pairs.semi(o, table(spark, d, "customer").where("c_nationkey < 12"), ["c_custkey"]), li.where("l_discount > 0.09"), ["l_orderkey"])
    lines = li.where("l_shipdate >= timestamp '1997-01-01'").groupBy("l_orderkey").agg(F.count("*").alias("l"), F.sum("l_quantity").alias("q"))
    return pairs.enrich(kept, lines, ["l_orderkey"]).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count("l").alias("with_lines"), F.sum(F.coalesce("q", F.lit(0.0))).alias("quantity"))


GRID = """grid as (select row_number() over (order by c, v) as scenario_id, c, v from (values (.7), (.75), (.8), (.82), (.84), (.85), (.9)) as a(c), (values (1.0), (2.0)) as b(v))"""


@query("evidence_grades", f"""with {PIX}, {GRID}, z as (select row // 10 as zone, quantile_cont(velocity, .5) * 5 as median, avg(velocity) * 5 as series_rate, quantile_cont(tcoh, .5) as c from px group by 1),
 s as (select zone, count(*) as survived from (select row // 10 as zone, scenario_id, count(*) as n from px join grid on tcoh >= grid.c and abs(velocity) >= grid.v group by 1, 2) where n >= 20 group by 1)
select zone, coalesce(survived, 0) as survived, case when survived >= 12 and c >= .85 and abs(median) >= 10 and abs(abs(median) - abs(series_rate)) / abs(median) <= .2 then 'A' when survived >= 9 and abs(median) >= 10 then 'B' else 'C' end as grade,
 case when coalesce(survived, 0) / 14 >= .8 then 'robust' when coalesce(survived, 0) / 14 >= .5 then 'moderate' else 'mask_dependent' end as outcome from z left join s using (zone)""")
def _(spark, d):
    px = pixels(spark, d).withColumn("zone", F.expr("row div 10"))
    grid = spark.createDataFrame([(k, c, v) for k, (c, v) in enumerate((c, v) for c in (0.7, 0.75, 0.8, 0.82, 0.84, 0.85, 0.9) for v in (1.0, 2.0))], "scenario_id int, coherence_min double, threshold double")
    survived = pairs.scenarios(px, grid).groupBy("zone", "scenario_id").agg(F.count("*").alias("n")).where("n >= 20").groupBy("zone").agg(F.count("*").alias("survived"))
    z = px.groupBy("zone").agg((F.percentile("velocity", F.lit(0.5)) * 5).alias("median"), (F.avg("velocity") * 5).alias("series_rate"), F.percentile("tcoh", F.lit(0.5)).alias("coherence_median"))
    z = z.join(survived, "zone", "left").na.fill(0, ["survived"])
    return masks.evidence_grade(z).select("zone", "survived", "grade", masks.persistence_outcome(F.col("survived") / 14).alias("outcome"))


@query("promotion_rule", f"""with {TELE}, m as (select producer as branch, 'mean' as metric, avg(value) as value, 'low' as better from tele group by 1 union all select producer, 'spread', stddev_pop(value), 'low' from tele group by 1 union all select producer, 'n', count(*), 'high' from tele group by 1), b as (select metric, value as base from m where branch = (select min(branch) from m))
select branch, cast(sum((case when better = 'low' then value < base else value > base end)::int) as bigint) as improved, count(*) as metrics, sum((case when better = 'low' then value < base else value > base end)::int) >= 2 as promoted from m join b using (metric) where branch <> (select min(branch) from m) group by 1""")
def _(spark, d):
    t = telemetry(spark, d)
    agg = t.groupBy(F.col("producer").alias("branch")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.count("*").cast("double").alias("n"))
    m = agg.unpivot("branch", ["mean", "spread", "n"], "metric", "value").withColumn("better", F.when(F.col("metric") == "n", "high").otherwise("low"))
    return masks.promotion_rule(m, t.agg(F.min("producer")).first()[0], 2)
