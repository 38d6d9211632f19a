"""Queries on comparison, placement, oscillation, sampling and document audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, stats
from .inputs import EPOCH, NET, PIX, TELE, epochs, network, pix_sql, pixels, side, table, telemetry
from .pixel_queries import LABEL, _labels, rounded
from .temporal_queries import ZONE, _zone

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def q(c: str, p: float, digits: int = 7) -> str:
    return f"round(quantile_cont({c}, {p}), {digits})"


def _as_sql(c: str, digits: int):
    """A double rounded as the SQL's round: the binary product, halves away from zero; F.round takes the shortest decimal form."""
    p = F.abs(F.col(c) * 10.0**digits)
    near = F.floor(p) + (p - F.floor(p) >= 0.5).cast("int")
    return (F.signum(c) * F.when(p < 2.0**52, near).otherwise(p) / 10.0**digits).alias(c)


@query("zone_comparison", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, z as (select row // 20 * 100 + col // 20 as zone, row, col, case when velocity_std > 0.03 then velocity end as a, velocity_std as a_std, tcoh as a_tcoh from pa),
 o as (select row, col, case when velocity_std > 0.03 then velocity end as b, velocity_std as b_std, tcoh as b_tcoh, case when velocity > 5 then row // 15 * 100 + col // 15 end as label from pb),
 j as (select z.*, b, b_std, b_tcoh, label, a is not null and b is not null as ok from z left join o using (row, col)),
 g as (select zone, count(*) as cells, count(*) filter (ok) as n, count(label) as labelled, avg(row) as r, avg(col) as c, {", ".join(f"quantile_cont({x}, {p}) filter (ok) as {x}{n}" for x in ("a", "b") for n, p in (("m", .5), ("l", .25), ("h", .75)))}, {", ".join(f"quantile_cont({x}, .5) filter (ok) as {x}_" for x in ("a_std", "b_std", "a_tcoh", "b_tcoh"))} from j group by 1),
 s as (select zone, label, count(*) as k, row_number() over (partition by zone order by count(*) desc, label) as i from j where label is not null group by 1, 2), nb as (select label, count(*) as nb, avg(row) as r2, avg(col) as c2 from o where label is not null group by 1),
 t as (select g.*, k, label, nb, r2, c2 from g left join (select * from s where i = 1) using (zone) left join nb using (label))
select cast(zone as bigint) as zone, n as n_common, round(n / cells, 7) as valid_fraction, round(am, 7) as a_median, round(bm, 7) as b_median, round(al, 7) as a_p25, round(ah, 7) as a_p75, round(bl, 7) as b_p25, round(bh, 7) as b_p75, round(a_std_, 7) as a_std, round(b_std_, 7) as b_std,
 round(a_tcoh_, 7) as a_tcoh, round(b_tcoh_, 7) as b_tcoh, am * bm > 0 as sign_agreement, round(abs(bm) / greatest(1e-9, abs(am)), 5) as magnitude_ratio, round(labelled / cells, 7) as overlap_fraction, round(coalesce(k / (cells + nb - k), 0), 7) as iou,
 round(sqrt(pow(r2 - r, 2) + pow(c2 - c, 2)) * 0.04::double, 7) as centroid_offset_km, coalesce(label % 2 = 0, false) as detected, abs(bm) < 2 * b_std_ as b_includes_zero from t where n >= 5""")
def _(spark, d):
    v = lambda n: F.expr(f"case when velocity_std > 0.03 then velocity end as {n}")
    a = pixels(spark, d, "l_returnflag = 'A'").select(F.expr("cast(row div 20 * 100 + col div 20 as bigint) as zone"), "row", "col", v("a"), F.col("velocity_std").alias("a_std"), F.col("tcoh").alias("a_tcoh"))
    b = pixels(spark, d, "l_returnflag = 'N'").select("row", "col", v("b"), F.col("velocity_std").alias("b_std"), F.col("tcoh").alias("b_tcoh"), F.expr("cast(case when velocity > 5 then row div 15 * 100 + col div 15 end as bigint) as label"))
    kept = b.where("label % 2 = 0").select("label").distinct()
    out = reports.zone_comparison(a, b, kept).where("n_common >= 5")
    return rounded(out.withColumn("magnitude_ratio", F.round("magnitude_ratio", 5)), 7)


@query("zone_placement", LABEL + """ select cast(label as bigint) as label, round(500000 + (avg(col) + 0.5) * 40, 5) as x, round(3000000 - (avg(row) + 0.5) * 40, 5) as y, round(sqrt(pow(avg(row) - 50, 2) + pow(avg(col) - 50, 2)) * 40 / 1000, 7) as reference_km,
 round(avg(30 + col / 10.0::double), 7) as incidence, round(quantile_cont(velocity, .5) / cos(radians(avg(30 + col / 10.0::double))), 7) as vertical from z group by 1""")
def _(spark, d):
    px = _labels(spark, d).withColumn("incidence", 30 + F.col("col") / 10)
    out = reports.zone_placement(px, ["label"], 500000.0, 3000000.0, 40.0, (50.0, 50.0))
    return out.select("label", *[_as_sql(c, 5 if c in "xy" else 7) for c in ("x", "y", "reference_km", "incidence", "vertical")])


@query("oscillation_links", f"""with {ZONE}, c as (select zone, i, t - avg(t) over w as u, y - avg(y) over w as v from zs window w as (partition by zone)), s as (select zone, count(*) as n, sum(u * u) as s2, sum(u * u * u) as s3, sum(u * u * u * u) as s4, sum(u * v) as uv, sum(u * u * v) as uuv from c group by 1),
 f as (select zone, i, k as ord, v - uv / s2 * u - case when k = 2 then (uuv - s3 / s2 * uv) / (s4 - s2 * s2 / n - s3 * s3 / s2) * (u * u - s2 / n - s3 / s2 * u) else 0 end as residual from c join s using (zone), (select unnest([1, 2]) as k)),
 a as (select ord, zone, quantile_cont(residual, .975) - quantile_cont(residual, .025) as amplitude from f group by 1, 2), r as (select f.ord, f.zone, corr(f.residual, b.residual) as r from f join f b on b.ord = f.ord and b.i = f.i and b.zone = (select min(zone) from zs) group by 1, 2)
select a.ord as "order", a.zone, round(a.amplitude, 7) as amplitude, round(a.amplitude / b.amplitude, 6) as ratio_to_control, round(r.r, 6) as r_control from a join a b on b.ord = a.ord and b.zone = (select min(zone) from zs) join r on r.ord = a.ord and r.zone = a.zone""")
def _(spark, d):
    z = _zone(spark, d)
    out = reports.oscillation_links(z, "zone", "t", "y", z.agg(F.min("zone")).first()[0])
    return out.select("order", "zone", F.round("amplitude", 7).alias("amplitude"), F.round("ratio_to_control", 6).alias("ratio_to_control"), F.round("r_control", 6).alias("r_control"))


@query("sampling_registry", f"""with {TELE}, g as (select station, ts, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by station order by ts)) / 3.6e9::double as gap from tele), p as (select station, ts, case when gap > 0 then gap end as gap from g),
 m as (select station, h, row_number() over (partition by station order by count(*) desc, h) as i from (select station, cast(round(gap) as bigint) as h from p where gap is not null) group by 1, 2),
 a as (select station, count(*) as n, count(*) filter (ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20') as n_study, quantile_cont(gap, .5) as med, min(gap) as lo, quantile_cont(gap, .99) as p99, max(gap) as hi, count(distinct date_trunc('month', ts)) as months, (max(epoch_us(ts)) - min(epoch_us(ts))) / 3.6e9::double as hours from p group by 1)
select a.station, n, n_study, round(med, 6) as gap_median, round(lo, 6) as gap_min, round(p99, 6) as gap_p99, round(hi, 6) as gap_max, h as gap_mode, months, round(100.0 * n_study / greatest(1.0, coalesce(hours / nullif(med, 0), 1.0)), 5) as coverage from a left join m on m.station = a.station and m.i = 1""")
def _(spark, d):
    out = reports.sampling_registry(telemetry(spark, d), ["station"], "2024-01-05", "2024-01-20")
    return rounded(out.withColumn("coverage", F.round("coverage", 5)), 6)


@query("monthly_counts", "select o_orderpriority as priority, strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by 1, 2")
def _(spark, d):
    return reports.monthly_counts(table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("date")), ["priority"])


PACKS = {"license": [("named", "licensed under", "info"), ("released", "released +under", "info")], "style": [("shout", "[A-Z]{3,}!!", "warn"), ("phone", r"\+[0-9]+ \([0-9]+\)", "fail")]}


@query("pack_audit", """with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents), r as (select * from (values """ + ", ".join(f"('{p}', '{n}', '(?i){x}', '{s}')" for p, rs in PACKS.items() for n, x, s in rs) + """) t(pack, rule, p, severity))
select doc_id, cast(line_no as int) as line_no, pack, rule, severity, substr(trim(line), 1, 190) as text from l join r on regexp_matches(line, p)""")
def _(spark, d):
    return reports.pack_audit(table(spark, d, "documents"), PACKS)


@query("untraced_quantities", """with f as (select doc_id, unnest(regexp_extract_all(text, '([0-9][0-9,]*\\.[0-9]{1,2})\\s*[A-Za-z]', 1)) as quantity from documents), v as (select distinct s_acctbal as value from supplier), k as (select printf('%.1f', value::double) as t from v union select printf('%.2f', value::double) from v union select printf('%.3f', value::double) from v)
select quantity, count(distinct doc_id) as documents from f where replace(quantity, ',', '') not in (select t from k) and replace(quantity, ',', '') not in ('2.0', '3.0') group by 1""")
def _(spark, d):
    values = table(spark, d, "supplier").select(F.col("s_acctbal").alias("value")).distinct()
    return reports.untraced_quantities(table(spark, d, "documents"), values, "[A-Za-z]", ["2.0", "3.0"])


@query("ledger_summary", """select 'duplicate_name' as kind, cast(o_custkey as varchar) as value, count(*) as n from orders group by 2 having count(*) > 1 union all select 'cost', cast(cast(floor(o_totalprice / 50000) as bigint) as varchar), count(*) from orders group by 2""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 50000).alias("cost"))
    return reports.ledger_summary(o, "o_custkey", "cost")


@query("unconnected_nodes", f"""with {NET}, thin as (select * from edges where month(src) < 9), alone as (select * from nodes n where not exists (select 1 from thin t where t.network_id = n.network_id and (t.src = n.node or t.dst = n.node))),
 d as (select a.network_id, a.node, abs(o.node - a.node) as days, o.node as other, row_number() over (partition by a.network_id, a.node order by abs(o.node - a.node), o.node) as k from alone a join nodes o on o.network_id = a.network_id and o.node <> a.node)
select network_id, node, string_agg(days || ':' || strftime(other, '%Y-%m-%d'), ';' order by k) as nearest, case when min(days) > 120 then 'no date within 120 days' else 'no common pair' end as reason from d where k <= 3 group by 1, 2""")
def _(spark, d):
    nodes, edges = network(spark, d)
    out = reports.unconnected_nodes(nodes, edges.where("month(src) < 9"))
    told = F.array_join(F.transform("nearest", lambda x: F.concat(x["days"].cast("string"), F.lit(":"), F.date_format(x["node"], "yyyy-MM-dd"))), ";")
    return out.select("network_id", "node", told.alias("nearest"), "reason")


@query("smallest_improvements", f"with {PIX}, r as (select land, row, col, velocity, row_number() over (partition by land order by abs(velocity) desc, row, col) as k from px) select land, row, col, round(velocity, 9) as velocity from r where k <= 5")
def _(spark, d):
    p = pixels(spark, d).withColumn("size", F.abs("velocity"))
    return rounded(reports.smallest(p, ["land"], "size", ["row", "col"], 5, largest=True).select("land", "row", "col", "velocity"))


@query("class_shares", f"with {PIX} select row // 25 as zone, {', '.join(f'round(avg((cast(floor(abs(velocity) / 5) as bigint) = {k})::int), 9) as share_{k}' for k in (0, 1, 2))} from px group by 1")
def _(spark, d):
    p = pixels(spark, d).select(F.expr("row div 25").alias("zone"), F.floor(F.abs("velocity") / 5).alias("class"))
    return rounded(stats.class_fraction(p, ["zone"], "class", [0, 1, 2]))


@query("collection_rules", """with b as (select s_nationkey % 5 as c, s_suppkey % 13 as id, 9 as path, case when s_suppkey % 17 = 0 and s_nationkey % 5 = 1 then 'A' else 'D' end as direction, 'VV' as polarization, 'IW' || (1 + (s_nationkey % 5 = 2)::int * (s_suppkey % 2)) as subswath,
 1700000000 + s_suppkey % 13 * (20 - 5 * (s_nationkey % 5)) as ts, 76.5 + s_suppkey % 13 * 0.1 as lon_min, 77.4 + s_suppkey % 13 * (0.1 + 0.003 * (s_nationkey % 5)) as lon_max from supplier where s_suppkey % 13 < 9),
 a as (select c, count(*) as k, count(distinct id) as ids, min(id) as lo, max(id) as hi, count(distinct direction) as nd, string_agg(distinct direction, ',' order by direction) as td, count(distinct subswath) as ns, string_agg(distinct subswath, ',' order by subswath) as ts_, max(ts) - min(ts) as spread, min(lon_min) as west, max(lon_max) as east, max(lon_max - lon_min) - min(lon_max - lon_min) as jog from b group by 1)
select cast(c as bigint) as c, check_ as "check", passed, detail from (
 select c, 'burst_count_1_to_15' as check_, k between 1 and 15 as passed, 'K=' || k as detail from a union all select c, 'contiguous_gap_free', ids = k and hi - lo + 1 = k, lo || '..' || hi from a union all select c, 'single_relative_orbit', true, '9' from a
 union all select c, 'single_flight_direction', nd = 1, td from a union all select c, 'single_polarization', true, 'VV' from a union all select c, 'single_or_adjacent_subswath', ns = 1, ts_ from a union all select c, 'acquisition_within_2_minutes', spread <= 120, spread || ' s' from a
 union all select c, 'no_antimeridian_crossing', true, printf('%.3f', west::double) || '..' || printf('%.3f', east::double) from a union all select c, 'aoi_fully_contained', c <> 3, case when c <> 3 then '1.000000' else '0.750000' end from a union all select c, 'no_lateral_jog', k < 2 or jog < 0.02, printf('%.5f', jog::double) from a)""")
def _(spark, d):
    b = table(spark, d, "supplier").where("s_suppkey % 13 < 9").selectExpr(
        "s_nationkey % 5 as c", "s_suppkey % 13 as id", "9 as path", "case when s_suppkey % 17 = 0 and s_nationkey % 5 = 1 then 'A' else 'D' end as direction", "'VV' as polarization",
        "concat('IW', 1 + cast(s_nationkey % 5 = 2 as int) * (s_suppkey % 2)) as subswath", "timestamp_seconds(1700000000 + s_suppkey % 13 * (20 - 5 * (s_nationkey % 5))) as ts",
        "76.5D + s_suppkey % 13 * 0.1D as lon_min", "77.4D + s_suppkey % 13 * (0.1D + 0.003D * (s_nationkey % 5)) as lon_max",
    )
    covered = b.select("c").distinct().withColumn("covered", F.when(F.col("c") != 3, 1.0).otherwise(0.75))
    return reports.collection_rules(b, ["c"], covered)


@query("contradiction_drill_down", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, {pix_sql('pc', "l_returnflag = 'R'")}, {EPOCH}, j as (select a.row // 10 as zone, a.row, a.col, a.velocity as a, b.velocity as b, c.velocity as b0 from pa a left join pb b using (row, col) left join pc c using (row, col)),
 k as (select *, unnest(case when col between 30 and 60 then ['all', 'core'] when col between 20 and 70 then ['all', 'boundary'] else ['all'] end) as name from j),
 e as (select zone, i, quantile_cont(disp, .5) as y from ep group by 1, 2), s as (select zone, i, y - lag(y) over (partition by zone order by i) as step from e), r as (select *, row_number() over (partition by zone order by abs(step) desc, i) as r from s where step is not null)
select cast(zone as bigint) as zone, 'facet' as part, name, count(*) as n, round(quantile_cont(a, .5), 7) as a, round(quantile_cont(b, .5), 7) as b from k where a is not null and b is not null group by 1, 3 having count(*) >= 6
union all select zone, 'branch', name, count(*), round(quantile_cont(b0, .5), 7), round(quantile_cont(b, .5), 7) from k where b0 is not null and b is not null group by 1, 3 having count(*) >= 6
union all select zone, 'step', 'largest', i, round(step, 7), r from r where r <= 3""")
def _(spark, d):
    v = lambda flag, n: pixels(spark, d, f"l_returnflag = '{flag}'").select("row", "col", F.col("velocity").alias(n))
    px = v("A", "a").join(v("N", "b"), ["row", "col"], "left").join(v("R", "b0"), ["row", "col"], "left").withColumn("zone", F.expr("cast(row div 10 as bigint)"))
    cuts = {"all": F.lit(True), "core": F.col("col").between(30, 60), "boundary": F.col("col").between(20, 70) & ~F.col("col").between(30, 60)}
    e = epochs(spark, d).select(F.col("zone").cast("long").alias("zone"), "i", F.col("disp").alias("value"))
    return rounded(reports.contradiction_drill_down(px, ["zone"], cuts, e), 7)


@query("branch_energy")
def _(spark, d):
    n = side(spark, d)
    px = None
    for flag in "AN":
        one = pixels(spark, d, f"l_returnflag = '{flag}'").withColumn("branch", F.lit(flag))
        px = one if px is None else px.unionByName(one)
    return rounded(reports.branch_energy(px, ["A", "N"], "velocity", n, n), 7)


@query("full_agreement", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, j as (select a.land, a.row, a.col, a.velocity as a, b.velocity as b from pa a join pb b using (row, col)),
 k as (select *, rank() over (partition by land order by a) + (count(*) over (partition by land, a) - 1) / 2 as ra, rank() over (partition by land order by b) + (count(*) over (partition by land, b) - 1) / 2 as rb from j),
 m as (select land, quantile_cont(b - a, .5) as o, quantile_cont(a, .5) as ma, quantile_cont(b, .5) as mb from j group by 1), s as (select land, 1.4826 * quantile_cont(abs(b - a - o), .5) as r, 1.4826 * quantile_cont(abs(a - ma), .5) as sa, 1.4826 * quantile_cont(abs(b - mb), .5) as sb from j join m using (land) group by 1),
 c as (select land, count(*) as n, corr(ra, rb) as spearman, corr(a, b) as ab, corr(a, row) as ar, corr(a, col) as ac, corr(b, row) as br, corr(b, col) as bc, corr(row, col) as rc from k group by 1),
 p as (select *, (ab - ar * br) / sqrt((1 - ar * ar) * (1 - br * br)) as pab, (ac - ar * rc) / sqrt((1 - ar * ar) * (1 - rc * rc)) as pac, (bc - br * rc) / sqrt((1 - br * br) * (1 - rc * rc)) as pbc from c)
select land, n, round(spearman, 6) as spearman, round(ab, 6) as pearson, round(o, 6) as "offset", round(r, 6) as robust_rms, round((pab - pac * pbc) / sqrt((1 - pac * pac) * (1 - pbc * pbc)), 6) as plane_pearson, round(sa, 6) as scatter_a, round(sb, 6) as scatter_b from p join m using (land) join s using (land) where n >= 200""")
def _(spark, d):
    a = pixels(spark, d, "l_returnflag = 'A'").select("row", "col", "land", F.col("velocity").alias("a"))
    b = pixels(spark, d, "l_returnflag = 'N'").select("row", "col", F.col("velocity").alias("b"))
    return rounded(reports.full_agreement(a.join(b, ["row", "col"]), ["land"], "a", "b", 200), 6)
