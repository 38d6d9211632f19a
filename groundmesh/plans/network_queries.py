"""Queries on acquisitions, pairs and pair networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, pairs
from .inputs import ACQ, CAND, COMMON, NET, acquisitions, common_pairs, network, table

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("presence_matrix", f"""with {ACQ}, m as (select date, max(case when burst = 'F' then 1 else 0 end) as "F", max(case when burst = 'O' then 1 else 0 end) as "O", max(case when burst = 'P' then 1 else 0 end) as "P" from acq group by 1)
select date, "F", "O", "P", "F" + "O" + "P" as burst_count, "F" + "O" + "P" = 3 as complete, concat_ws(',', case when "F" = 0 then 'F' end, case when "O" = 0 then 'O' end, case when "P" = 0 then 'P' end) as missing_bursts from m""")
def _(spark, d):
    return pairs.presence_matrix(acquisitions(spark, d), ["F", "O", "P"])


@query("accept_acquisitions", f"""with {ACQ}, m as (select date, count(*) as n, list(burst) as b from acq group by 1)
select date, cast(n as int) as burst_count, n = 3 as accepted, case when n < 3 then 'missing ' || concat_ws(',', case when not list_contains(b, 'F') then 'F' end, case when not list_contains(b, 'O') then 'O' end, case when not list_contains(b, 'P') then 'P' end) end as reason from m""")
def _(spark, d):
    return pairs.accept_acquisitions(pairs.presence_matrix(acquisitions(spark, d), ["F", "O", "P"]))


@query("candidate_pairs", f"with {CAND} select burst, ref, sec, days, round(dperp, 6) as dperp from cand")
def _(spark, d):
    return pairs.candidate_pairs(acquisitions(spark, d)).withColumn("dperp", F.round("dperp", 6))


@query("identity_intersection", f"with {COMMON} select ref, sec, days, round(max_perp, 6) as max_perp from common")
def _(spark, d):
    return common_pairs(spark, d).withColumn("max_perp", F.round("max_perp", 6))


@query("attach_scenes", f"""with {CAND}, s as (select burst, date, burst || '_' || strftime(date, '%Y%m%d') as scene from acq)
select c.burst, ref, sec, days, round(dperp, 6) as dperp, a.scene as ref_scene, b.scene as sec_scene from cand c join s a on a.burst = c.burst and a.date = ref join s b on b.burst = c.burst and b.date = sec""")
def _(spark, d):
    acq = acquisitions(spark, d)
    scenes = acq.select("burst", "date", F.concat_ws("_", "burst", F.date_format("date", "yyyyMMdd")).alias("scene"))
    return pairs.attach_scenes(pairs.candidate_pairs(acq), scenes).select("burst", "ref", "sec", "days", F.round("dperp", 6).alias("dperp"), "ref_scene", "sec_scene")


@query("pair_payloads", f"""with {CAND} select ref, sec, string_agg(burst || ':' || burst || '_' || strftime(ref, '%Y%m%d'), ';' order by burst) as scenes, any_value(days) as days, round(min(dperp), 6) as perp_min, round(max(dperp), 6) as perp_max,
 round(max(abs(dperp)), 6) as perp_max_abs, round(quantile_cont(dperp, 0.5), 6) as perp_median, case when count(*) <> 3 then 'burst count' else '' end as violations from cand group by 1, 2""")
def _(spark, d):
    acq = acquisitions(spark, d)
    scenes = acq.select("burst", "date", F.concat_ws("_", "burst", F.date_format("date", "yyyyMMdd")).alias("scene"))
    p = pairs.pair_payloads(pairs.attach_scenes(pairs.candidate_pairs(acq), scenes), 3)
    listed = F.array_join(F.transform("bursts", lambda b: F.concat(b["burst"], F.lit(":"), b["ref_scene"])), ";")
    return p.select("ref", "sec", listed.alias("scenes"), "days", *[F.round(c, 6).alias(c) for c in ("perp_min", "perp_max", "perp_max_abs", "perp_median")], F.array_join("violations", ",").alias("violations"))


@query("acquisition_gaps", f"with {ACQ} select burst, date, lag(date) over w as previous_date, cast(date - lag(date) over w as int) as gap_days from acq window w as (partition by burst order by date)")
def _(spark, d):
    return pairs.gap_days(acquisitions(spark, d), ["burst"]).select("burst", "date", "previous_date", "gap_days")


@query("pilot_picks", f"""with {COMMON}, c as (select ref, sec, days, round(max_perp, 6) as max_perp from common),
 p1 as (select 1 as pick, 'lowest baseline, short' as rationale, * from c where days = 7 order by max_perp, ref, sec limit 1),
 o2 as (select *, row_number() over (order by max_perp, ref, sec) - 1 as i, count(*) over () as n from c where days = 14), p2 as (select 2, 'median baseline, middle', ref, sec, days, max_perp from o2 where i = n // 2),
 o3 as (select *, row_number() over (order by max_perp, ref, sec) - 1 as i, count(*) over () as n from c where days = 35), p3 as (select 3, 'p90 baseline, long', ref, sec, days, max_perp from o3 where i = 9 * (n - 1) // 10),
 u3 as (select * from p1 union all select * from p2 union all select * from p3),
 p4 as (select 4, 'monsoon', * from c where month(ref) between 6 and 9 and month(sec) between 6 and 9 and (ref, sec) not in (select (ref, sec) from u3) order by max_perp, ref, sec limit 1), u4 as (select * from u3 union all select * from p4),
 p5 as (select 5, 'dry season', * from c where month(ref) in (11, 12, 1, 2, 3) and month(sec) in (11, 12, 1, 2, 3) and (ref, sec) not in (select (ref, sec) from u4) order by max_perp, ref, sec limit 1), u5 as (select * from u4 union all select * from p5),
 p6 as (select 6, 'late period', * from c where sec >= date '1998-01-01' and (ref, sec) not in (select (ref, sec) from u5) order by max_perp, ref, sec limit 1), u6 as (select * from u5 union all select * from p6)
select pick, rationale, ref, sec, days, max_perp, true as water_mask from u6 union all select 7, 'control without water mask', ref, sec, days, max_perp, false from u6 where pick = (select min(pick) from u6)""")
def _(spark, d):
    p = common_pairs(spark, d).withColumn("max_perp", F.round("max_perp", 6))
    return pairs.pilot_picks(p, "1998-01-01", 7, 14, 35)


@query("season_of_pair", f"""with {COMMON} select case when month(ref) between 6 and 9 and month(sec) between 6 and 9 then 'monsoon' when month(ref) in (11, 12, 1, 2) and month(sec) in (11, 12, 1, 2) then 'dry' else 'mixed' end as season, count(*) as n from common group by 1""")
def _(spark, d):
    return pairs.season_of_pair(common_pairs(spark, d)).groupBy("season").agg(F.count("*").alias("n"))


@query("degrees", f"""with {NET}, x as (select network_id, src as node from edges union all select network_id, dst from edges) select network_id, node, count(*) as degree from x group by 1, 2""")
def _(spark, d):
    return graph.degrees(*network(spark, d))


@query("degree_distribution", f"""with {NET}, x as (select network_id, src as node from edges union all select network_id, dst from edges), g as (select network_id, node, count(*) as degree from x group by 1, 2) select network_id, degree, count(*) as nodes from g group by 1, 2""")
def _(spark, d):
    return graph.degrees(*network(spark, d)).groupBy("network_id", "degree").agg(F.count("*").alias("nodes"))


def _thin(spark, d):
    """A sparse network: only some short pairs in odd months, so it falls apart into chains."""
    nodes, edges = network(spark, d)
    return nodes, edges.where("month(src) % 2 = 1 and month(dst) % 2 = 1 and (days = 7 or (days = 14 and month(src) % 3 = 0))")


THIN = NET + ", thin as (select * from edges where month(src) % 2 = 1 and month(dst) % 2 = 1 and (days = 7 or (days = 14 and month(src) % 3 = 0)))"
REACH = """both_ as (select network_id, src as a, dst as b from {e} union select network_id, dst, src from {e}),
 r as (select network_id, node as a, node as b from nodes union select r.network_id, r.a, x.b from r join both_ x on x.network_id = r.network_id and x.a = r.b)"""


@query("isolates", f"with {THIN} select n.network_id, n.node from nodes n where not exists (select 1 from thin t where t.network_id = n.network_id and (t.src = n.node or t.dst = n.node))")
def _(spark, d):
    return graph.isolates(*_thin(spark, d))


@query("connected_components", f"with recursive {THIN}, {REACH.format(e='thin')} select network_id, a as node, min(b) as component from r group by 1, 2")
def _(spark, d):
    return graph.connected_components(*_thin(spark, d))


BRIDGE = f"""with recursive {THIN}, cuts as (select network_id, src as x, dst as y from thin), n2 as (select c.network_id, c.x, c.y, n.node from cuts c join nodes n using (network_id)),
 e2 as (select c.network_id, c.x, c.y, t.src as a, t.dst as b from cuts c join thin t using (network_id) where not (t.src = c.x and t.dst = c.y) union all select c.network_id, c.x, c.y, t.dst, t.src from cuts c join thin t using (network_id) where not (t.src = c.x and t.dst = c.y)),
 reach as (select network_id, x, y, x as b from cuts union select r.network_id, r.x, r.y, e.b from reach r join e2 e on e.network_id = r.network_id and e.x = r.x and e.y = r.y and e.a = r.b)
select network_id, x as src, y as dst from cuts c where not exists (select 1 from reach r where r.network_id = c.network_id and r.x = c.x and r.y = c.y and r.b = c.y)"""


@query("bridges", BRIDGE)
def _(spark, d):
    return graph.bridges(*_thin(spark, d))


@query("cut_vertices", f"""with recursive {THIN}, two as (select network_id, src as a, dst as b from thin union select network_id, dst, src from thin),
 first as (select network_id, a as c, min(b) as s, count(*) as k from two group by 1, 2),
 reach as (select network_id, c, s as b from first where k > 1 union select r.network_id, r.c, t.b from reach r join two t on t.network_id = r.network_id and t.a = r.b and t.b <> r.c)
select distinct f.network_id, f.c as node from first f join two t on t.network_id = f.network_id and t.a = f.c where f.k > 1 and not exists (select 1 from reach r where r.network_id = f.network_id and r.c = f.c and r.b = t.b)""")
def _(spark, d):
    return graph.cut_vertices(*_thin(spark, d))


AUDIT = f"""with recursive {NET}, two as (select network_id, src as a, dst as b from edges union select network_id, dst, src from edges),
 deg as (select network_id, a as node, count(*) as degree from two group by 1, 2),
 dg as (select network_id, count(*) as nodes, min(degree) as degree_min, avg(degree) as degree_mean, quantile_cont(degree, .5) as degree_median, max(degree) as degree_max from deg group by 1),
 ed as (select network_id, count(*) as edges from edges group by 1), r as (select network_id, node as a, node as b from nodes union select r.network_id, r.a, t.b from r join two t on t.network_id = r.network_id and t.a = r.b),
 cm as (select network_id, count(distinct c) as components from (select network_id, a, min(b) as c from r group by 1, 2) group by 1),
 br as (select network_id, src as x, dst as y, src as b from edges union select k.network_id, k.x, k.y, t.b from br k join two t on t.network_id = k.network_id and t.a = k.b and not (t.a = k.x and t.b = k.y) and not (t.a = k.y and t.b = k.x)),
 nb as (select network_id, count(*) as bridges from edges e where not exists (select 1 from br k where k.network_id = e.network_id and k.x = e.src and k.y = e.dst and k.b = e.dst) group by 1),
 cv as (select network_id, a as c, min(b) as b from two group by 1, 2 union select v.network_id, v.c, t.b from cv v join two t on t.network_id = v.network_id and t.a = v.b and t.b <> v.c),
 nc as (select network_id, count(distinct a) as cut_vertices from two t where not exists (select 1 from cv v where v.network_id = t.network_id and v.c = t.a and v.b = t.b) group by 1),
 gp as (select network_id, max(g) as max_gap from (select network_id, node - lag(node) over (partition by network_id order by node) as g from nodes) group by 1)
select network_id, nodes, degree_min, round(degree_mean, 6) as degree_mean, round(degree_median, 6) as degree_median, degree_max, 0 as isolates, edges, components, coalesce(bridges, 0) as bridges, coalesce(cut_vertices, 0) as cut_vertices, cast(max_gap as int) as max_gap,
 components = 1 and coalesce(bridges, 0) = 0 and coalesce(cut_vertices, 0) = 0 and degree_min >= 3 and max_gap <= 48 as accepted
from dg join ed using (network_id) join cm using (network_id) left join nb using (network_id) left join nc using (network_id) join gp using (network_id)"""


@query("audit_network", AUDIT)
def _(spark, d):
    out = graph.audit_network(*network(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("compare_networks", f"""with {THIN}, g as (select n.network_id, n.node, (select count(*) from edges e where e.network_id = n.network_id and (e.src = n.node or e.dst = n.node)) as full_degree, (select count(*) from thin e where e.network_id = n.network_id and (e.src = n.node or e.dst = n.node)) as curated_degree from nodes n)
select *, full_degree - curated_degree as loss, full_degree > 0 and curated_degree = 0 as newly_isolated from g""")
def _(spark, d):
    nodes, full = network(spark, d)
    return graph.compare_networks(nodes, full, _thin(spark, d)[1])


@query("k_core_prune")
def _(spark, d):
    nodes, edges = network(spark, d)
    return graph.k_core_prune(nodes, edges.where("days <= 21"), 3)


@query("repair_network")
def _(spark, d):
    nodes, full = network(spark, d)
    kept = full.where("days <= 14 and month(src) != 6")
    dropped = full.join(kept.select("network_id", "src", "dst"), ["network_id", "src", "dst"], "left_anti").where("days <= 28 and month(src) in (5, 6, 7)")
    return graph.repair_network(nodes, kept, dropped.withColumn("score", -F.col("max_perp")))


@query("connect_and_debridge")
def _(spark, d):
    nodes, thin = _thin(spark, d)
    return graph.connect_and_debridge(nodes, thin, network(spark, d, max_days=120)[1].select("network_id", "src", "dst", "days"))


@query("edge_influence", f"""with {NET}, q as (select *, round(1 - max_perp / 250, 6) as quality, row_number() over (partition by network_id order by round(1 - max_perp / 250, 6), src, dst) as rank, count(*) over (partition by network_id) as n from edges)
select network_id, src, dst, quality, rank, round(100 * rank / n, 6) as pct, quality < 0.3 as weak from q where days > 28""")
def _(spark, d):
    _, edges = network(spark, d)
    e = edges.select("network_id", "src", "dst", F.round(1 - F.col("max_perp") / 250, 6).alias("quality"), (F.col("days") > 28).alias("flagged"))
    return graph.edge_influence(e).withColumn("pct", F.round("pct", 6))


@query("nearest_join", f"""with {ACQ}, a as (select date from acq where burst = 'P'), b as (select cast(date + cast(2 * (day(date) % 2) as int) as date) as date from acq where burst = 'F' and day(date) % 3 = 0),
 m as (select a.date, b.date as match, abs(a.date - b.date) as gap, row_number() over (partition by a.date order by abs(a.date - b.date), b.date) as r from a join b on abs(a.date - b.date) <= 6)
select a.date, match, cast(gap as int) as gap from a left join m on m.date = a.date and r = 1""")
def _(spark, d):
    acq = acquisitions(spark, d)
    b = acq.where("burst = 'F' and day(date) % 3 = 0").select(F.expr("date_add(date, 2 * (day(date) % 2))").alias("date"))
    return pairs.nearest_join(acq.where("burst = 'P'").select("date"), b, 6)


@query("burst_date_reconciliation", f"""with {ACQ}, a as (select date from acq where burst = 'F'), b as (select date from acq where burst = 'P')
select coalesce(a.date, b.date) as date, case when b.date is null then 'missing' when a.date is null then 'unexpected' else 'both' end as state from a full join b on a.date = b.date""")
def _(spark, d):
    acq = acquisitions(spark, d)
    return pairs.set_diff(acq.where("burst = 'F'").select("date"), acq.where("burst = 'P'").select("date"), ["date"])


@query("validate_baselines", """with b as (select date '1995-01-01' as reference, cast(o_orderdate as date) as date, cast(cast(o_orderdate as date) - date '1995-01-01' as int) + case when o_orderkey % 11 = 0 then 1 else 0 end as temporal_days, case when o_orderkey % 13 <> 0 then o_totalprice end as perp, o_orderkey % 7 <> 0 as sv from orders)
select coalesce(r, 'accepted') as outcome, count(*) as n from (select case when not sv then 'no state vectors' when perp is null then 'no baseline' when temporal_days <> date - reference then 'rebased' end as r from b) group by 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01")) + F.expr("case when o_orderkey % 11 = 0 then 1 else 0 end")
    base = o.select(F.to_date(F.lit("1995-01-01")).alias("reference"), F.to_date("o_orderdate").alias("date"), days.alias("temporal_days"), F.expr("case when o_orderkey % 13 != 0 then o_totalprice end").alias("perp"), F.expr("o_orderkey % 7 != 0").alias("has_state_vectors"))
    return pairs.validate_baselines(base).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query("job_credit_cost", """with j as (select o_orderpriority as scenario, case when o_orderkey % 2 = 0 then '20x4' else '10x2' end as looks, 1 + o_orderkey % 7 as n from orders)
select scenario, count(*) as jobs, cast(sum(case when looks = '20x4' then case when n <= 3 then 1 else 5 end else case when n <= 3 then 2 else 10 end end) as bigint) as credits from j group by 1""")
def _(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("scenario"), F.expr("case when o_orderkey % 2 = 0 then '20x4' else '10x2' end").alias("looks"), F.expr("1 + o_orderkey % 7").alias("n_bursts"))
    costs = spark.createDataFrame([("20x4", 3, 1), ("20x4", 9, 5), ("10x2", 3, 2), ("10x2", 9, 10)], "looks string, max_bursts int, cost int")
    return pairs.job_credit_cost(jobs, costs)
