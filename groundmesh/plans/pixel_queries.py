"""Queries on pixel layers, pair pixels and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import masks, pairs, stats, tiled, zones
from .inputs import PAIRPX, PIX, SIDE, pair_pixels, pix_sql, pixels, side

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df, digits: int = 9):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def q(c: str, p: float) -> str:
    return f"round(quantile_cont({c}, {p}), 9)"


ELIG = "in_aoi and land and velocity is not null and tcoh >= 0.8"
TIER = "case when land and tcoh >= 0.9 then 1 when land and tcoh >= 0.8 then 2 when land and tcoh >= 0.7 then 3 when land then 4 else 0 end"


@query("eligible_pixels", f"with {PIX} select row, col, velocity, tcoh from px where {ELIG}")
def _(spark, d):
    return masks.eligible(pixels(spark, d)).select("row", "col", "velocity", "tcoh")


@query("inverted_pixels", f"with {PIX} select count(*) as n, sum(case when velocity_std > 0 then 1 else 0 end) as inverted from px")
def _(spark, d):
    p = pixels(spark, d).withColumn("k", F.lit(1))
    good = masks.inverted(p).select("row", "col", F.lit(1).alias("ok"))
    return p.join(good, ["row", "col"], "left").agg(F.count("*").alias("n"), F.sum(F.coalesce("ok", F.lit(0))).alias("inverted"))


@query("quality_tiers", f"with {PIX} select {TIER} as tier, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 9) as pct from px group by 1")
def _(spark, d):
    t = pixels(spark, d).groupBy(masks.quality_tier(F.col("tcoh"), F.col("land")).alias("tier")).agg(F.count("*").alias("n"))
    total = t.agg(F.sum("n").alias("all"))
    return t.crossJoin(F.broadcast(total)).select("tier", "n", F.round(100 * F.col("n") / F.col("all"), 9).alias("pct"))


@query("published_layer", f"with {PIX} select row, col, case when {ELIG} then round(velocity * 1000, 7) else -9999.0 end as value from px")
def _(spark, d):
    m = F.col("in_aoi") & F.col("land") & (F.col("tcoh") >= 0.8)
    return masks.publish_layer(pixels(spark, d), m, "velocity", 1000.0).select("row", "col", F.round("value", 7).alias("value"))


@query("describe_by_tier", f"""with {PIX} select {TIER} as tier, count(velocity) as n, min(velocity) as min, {", ".join(f"{q('velocity', p)} as p{round(p * 100):02d}" for p in stats.QUANTILES)}, max(velocity) as max, round(avg(velocity), 9) as mean, round(stddev_pop(velocity), 9) as std from px group by 1""")
def _(spark, d):
    return rounded(stats.describe(pixels(spark, d).withColumn("tier", masks.quality_tier(F.col("tcoh"), F.col("land"))), ["tier"], "velocity"))


@query("coherence_fractions", f"with {PIX} select land, round(avg(case when tcoh > 0.8 then 1.0 else 0.0 end), 9) as above_0, round(avg(case when tcoh > 0.85 then 1.0 else 0.0 end), 9) as above_1, round(avg(case when tcoh > 0.9 then 1.0 else 0.0 end), 9) as above_2 from px group by 1")
def _(spark, d):
    return rounded(stats.fractions(pixels(spark, d), ["land"], "tcoh", [0.8, 0.85, 0.9]))


@query("aoi_accounting", f"with {PIX} select count(*) as cells, sum(in_aoi::int) as aoi, sum((in_aoi and velocity_std > 0)::int) as finite, sum((in_aoi and land)::int) as land, sum((in_aoi and not land)::int) as water, round(sum((in_aoi and land)::int) / sum(in_aoi::int), 9) as land_fraction from px")
def _(spark, d):
    return rounded(zones.aoi_counts(pixels(spark, d)))


PAIRQC = f"""with {PAIRPX}, n as (select count(*) as aoi from (select distinct row, col from pp)), c as (select pair_id, cc, count(*) as k from pp group by 1, 2),
 m as (select pair_id, max(k) as biggest, count(*) as n_cc from c group by 1)
select pp.pair_id, count(unw) as valid, round(count(unw) / any_value(aoi), 9) as valid_fraction, {q('coh', .5)} as coh_median, {q('coh', .25)} as coh_p25, round(avg(coh), 9) as coh_mean, any_value(n_cc) as components, round(any_value(biggest) / any_value(aoi), 9) as largest_share from pp join m using (pair_id), n group by 1"""


@query("pair_qc", PAIRQC)
def _(spark, d):
    p = pair_pixels(spark, d)
    return rounded(zones.pair_qc(p, p.select("row", "col").distinct().count()))


@query("robust_scale", f"""with {PIX}, m as (select land, quantile_cont(velocity, 0.5) as median from px group by 1) select land, round(any_value(m.median), 9) as median, round(quantile_cont(abs(velocity - m.median), 0.5), 9) as mad, round(1.4826 * quantile_cont(abs(velocity - m.median), 0.5), 9) as scale from px join m using (land) group by land""")
def _(spark, d):
    return rounded(stats.robust_scale(pixels(spark, d), ["land"], "velocity"))


OUT = f"""with {PAIRPX}, x as (select pair_id, split_part(pair_id, '_', 1) as class, median(coh) as coh_m, avg(cc) as cc_m from pp group by 1),
 a as (select class, quantile_cont(coh_m, .5) as cm, quantile_cont(cc_m, .5) as nm from x group by 1),
 s as (select class, any_value(cm) as cm, any_value(nm) as nm, quantile_cont(abs(coh_m - cm), .5) as cd, quantile_cont(abs(cc_m - nm), .5) as nd, stddev_samp(coh_m) as cs, stddev_samp(cc_m) as ns from x join a using (class) group by 1),
 z as (select x.*, (coh_m - cm) / case when cd > 0 then 1.4826 * cd when cs > 0 then cs else 1e-9 end as zc, (cc_m - nm) / case when nd > 0 then 1.4826 * nd when ns > 0 then ns else 1e-9 end as zn from x join s using (class))
select pair_id, class, round(coh_m, 9) as coh_m, round(cc_m, 9) as cc_m, concat_ws('; ', case when zc < -2 then 'coh_m low' end, case when zn > 2 then 'cc_m high' end) as reasons, cast((zc < -2)::int + (zn > 2)::int as int) as n_reasons from z"""


@query("flag_outliers", OUT)
def _(spark, d):
    x = pair_pixels(spark, d).groupBy("pair_id").agg(F.percentile("coh", F.lit(0.5)).alias("coh_m"), F.avg("cc").alias("cc_m")).withColumn("class", F.split_part("pair_id", F.lit("_"), F.lit(1)))
    return rounded(stats.flag_outliers(x, ["class"], {"coh_m": "low", "cc_m": "high"}, 2.0))


@query("stratify_coherence", f"with {PIX} select land, cast(floor(round(tcoh * 1000) / 50) as bigint) as stratum, count(velocity) as n, {q('velocity', .5)} as median, round(avg(velocity), 9) as mean from px group by 1, 2 having count(velocity) >= 20")
def _(spark, d):
    return rounded(stats.stratify(pixels(spark, d), ["land"], F.floor(F.round(F.col("tcoh") * 1000) / 50), "velocity", 20))


@query("quintiles", f"""with {PIX}, e as (select land, quantile_cont(tcoh, [0.2, 0.4, 0.6, 0.8]) as e from px group by 1) select land, len(list_filter(e, lambda x: x <= tcoh)) as bin, count(*) as n, {q('velocity', .5)} as median from px join e using (land) group by 1, 2""")
def _(spark, d):
    return rounded(stats.quintiles(pixels(spark, d), ["land"], "tcoh", "velocity"))


@query("progressive_quality", f"with {PIX}, t as (select unnest([0.75, 0.8, 0.85, 0.9]) as threshold) select land, cast(threshold as double) as threshold, count(*) as n, {q('velocity', .5)} as median from px join t on tcoh >= threshold group by 1, 2")
def _(spark, d):
    return rounded(stats.progressive(pixels(spark, d), ["land"], "tcoh", "velocity", [0.75, 0.8, 0.85, 0.9]))


@query("block_stats", f"with {PIX} select row // 20 as block_row, col // 20 as block_col, count(velocity) as n, {q('velocity', .5)} as median, {q('tcoh', .5)} as coherence from px group by 1, 2 having count(velocity) >= 200")
def _(spark, d):
    return rounded(stats.block_stats(pixels(spark, d), 20, 200, "velocity"))


@query("class_counts", f"with {PIX} select cast(floor(velocity / 10) as bigint) as class, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 9) as pct from px group by 1")
def _(spark, d):
    return rounded(zones.class_counts(pixels(spark, d), F.floor(F.col("velocity") / 10)))


@query("scenario_pixels", f"""with {PIX}, g as (select * from (values ('s1', 0.8, 10.0), ('s2', 0.85, 15.0), ('s3', 0.9, 5.0)) t(scenario_id, coherence_min, threshold)) select scenario_id, count(*) as n, {q('velocity', .5)} as median from px join g on tcoh >= coherence_min and abs(velocity) >= threshold group by 1""")
def _(spark, d):
    grid = spark.createDataFrame([("s1", 0.8, 10.0), ("s2", 0.85, 15.0), ("s3", 0.9, 5.0)], "scenario_id string, coherence_min double, threshold double")
    return rounded(pairs.scenarios(pixels(spark, d), grid).groupBy("scenario_id").agg(F.count("*").alias("n"), F.percentile("velocity", F.lit(0.5)).alias("median")))


HOT = f"hot as (select row, col, velocity, tcoh from px where {ELIG} and abs(velocity) >= 12)"
LABEL = f"""with recursive {PIX}, {HOT}, k3 as (select unnest([-1, 0, 1]) as k), near as (select a.row * 1000 + a.col as a, b.row * 1000 + b.col as b from hot a cross join k3 i cross join k3 j join hot b on b.row = a.row + i.k and b.col = a.col + j.k),
 r as (select row * 1000 + col as a, row * 1000 + col as b from hot union select r.a, n.b from r join near n on n.a = r.b),
 lab as (select a, min(b) as label from r group by 1), big as (select label from lab group by 1 having count(*) >= 3), z as (select row, col, velocity, tcoh, label from hot join lab on a = row * 1000 + col join big using (label))"""


def _labels(spark, d):
    px = masks.eligible(pixels(spark, d)).where("abs(velocity) >= 12")
    return zones.label_components(px, 3, tile=32)  # many tiles at every size


@query("label_components", LABEL + " select row, col, cast(label as bigint) as label from z")
def _(spark, d):
    return _labels(spark, d).select("row", "col", "label")


SCEN = [("primary", 0.8, 10.0, 0.0048), ("strict", 0.88, 10.0, 0.0048), ("relaxed", 0.7, 10.0, 0.0048), ("no_coh_cut", 0.0, 10.0, 0.0048), ("low", 0.8, 7.5, 0.0048), ("high", 0.8, 12.5, 0.0048), ("large", 0.8, 10.0, 0.0128), ("both", 0.88, 12.5, 0.0048)]
SCEN_SQL = f"""with recursive {PIX}, g as (select * from (values {", ".join(f"('{n}', {c}, {t}, {round(a / 0.0016)})" for n, c, t, a in SCEN)}) t(scenario_id, c, t, least)),
 hot as (select scenario_id, least, row, col, velocity from px join g on tcoh >= c and abs(velocity) >= t where in_aoi and land), k3 as (select unnest([-1, 0, 1]) as k),
 near as (select a.scenario_id, a.row * 1000 + a.col as a, b.row * 1000 + b.col as b from hot a cross join k3 i cross join k3 j join hot b on b.scenario_id = a.scenario_id and b.row = a.row + i.k and b.col = a.col + j.k),
 r as (select scenario_id, row * 1000 + col as a, row * 1000 + col as b from hot union select r.scenario_id, r.a, n.b from r join near n on n.scenario_id = r.scenario_id and n.a = r.b),
 lab as (select scenario_id, a, min(b) as label from r group by 1, 2), s as (select scenario_id, label, count(*) as cells from lab group by 1, 2),
 z as (select h.scenario_id, row, col, velocity, l.label, cells, cells >= least as kept from hot h join lab l on l.scenario_id = h.scenario_id and l.a = row * 1000 + col join s on s.scenario_id = l.scenario_id and s.label = l.label)"""


def _scenarios(spark, d):
    px = pixels(spark, d).where("in_aoi and land").select("row", "col", "velocity", "tcoh")
    return zones.label_scenarios(px, SCEN, tile=min(zones.TILE, max(16, side(spark, d) // 8)))  # many tiles at every size


@query("label_scenarios", SCEN_SQL + " select scenario_id, row, col, cast(label as bigint) as label, cells, kept from z")
def _(spark, d):
    return _scenarios(spark, d).select("scenario_id", "row", "col", "label", "cells", "kept")


@query("mask_persistence", SCEN_SQL + f""", p as (select label as zone, row, col from z where scenario_id = 'primary' and kept), n as (select zone, count(*) as n from p group by 1),
 o as (select zone, scenario_id, label, count(*) as k, any_value(cells) as cells, any_value(kept) as kept from p join z using (row, col) group by 1, 2, 3), w as (select *, row_number() over (partition by zone, scenario_id order by k desc, label) as r from o),
 m as (select scenario_id, label, quantile_cont(velocity, .5) as med from z group by 1, 2)
select cast(zone as bigint) as zone, g.scenario_id, round(coalesce(k / n, 0), 9) as overlap_fraction, round(case when kept then cells * 0.0016::double else 0 end, 9) as component_area_km2, round(case when kept then med end, 9) as component_median, coalesce(kept, false) and coalesce(k / n, 0) >= 0.5 as persists
from n cross join g left join (select * from w where r = 1) b using (zone, scenario_id) left join m on m.scenario_id = b.scenario_id and m.label = b.label""")
def _(spark, d):
    x = _scenarios(spark, d)
    return rounded(zones.zone_persistence(x.where("scenario_id = 'primary' and kept"), x, SCEN))


@query("persistence_outcome", SCEN_SQL + f""", p as (select label as zone, row, col from z where scenario_id = 'primary' and kept), n as (select zone, count(*) as n from p group by 1),
 o as (select zone, scenario_id, label, count(*) as k, any_value(kept) as kept from p join z using (row, col) group by 1, 2, 3), w as (select *, row_number() over (partition by zone, scenario_id order by k desc, label) as r from o),
 c as (select zone, count(*) filter (kept and k >= 0.5 * n) as survived from w join n using (zone) where r = 1 group by 1)
select cast(zone as bigint) as zone, survived, case when survived / {len(SCEN)} >= 0.8 then 'robust' when survived / {len(SCEN)} >= 0.5 then 'moderate' else 'mask_dependent' end as outcome from c""")
def _(spark, d):
    x = _scenarios(spark, d)
    found = zones.zone_persistence(x.where("scenario_id = 'primary' and kept"), x, SCEN).groupBy("zone").agg(F.count_if("persists").alias("survived"))
    return found.select("zone", "survived", masks.persistence_outcome(F.col("survived") / len(SCEN)).alias("outcome"))


@query("zone_stats", LABEL + f""" select cast(label as bigint) as label, count(*) as n, round(count(*) * 0.0016::double, 9) as area_km2, round(avg(row), 9) as row_mean, round(avg(col), 9) as col_mean, min(row) as row_min, max(row) as row_max, min(col) as col_min, max(col) as col_max,
 {q('velocity', .5)} as median, round(avg(velocity), 9) as mean, round(stddev_pop(velocity), 9) as std, {q('velocity', .05)} as p05, {q('velocity', .95)} as p95, arg_max(velocity, (abs(velocity), velocity)) as peak, min(tcoh) as coherence_min, {q('tcoh', .5)} as coherence_median from z group by 1""")
def _(spark, d):
    return rounded(stats.zone_stats(_labels(spark, d), ["label"]))


@query("rank_zones", LABEL + """, s as (select label, round(abs(quantile_cont(velocity, .5)) * sqrt(count(*) * 0.0016::double), 9) as significance from z group by 1)
select cast(label as bigint) as label, significance, 'H' || lpad(cast(row_number() over (order by significance desc, label) as varchar), 3, '0') as zone_id from s""")
def _(spark, d):
    z = stats.zone_stats(_labels(spark, d), ["label"])
    ranked = stats.rank_zones(z.withColumn("median", F.round(F.abs("median") * F.sqrt("area_km2"), 9)).withColumn("area_km2", F.lit(1.0)), "label")
    return ranked.select("label", "significance", "zone_id")


@query("background_stats", LABEL + f", bg as (select px.* from px anti join z on z.row = px.row and z.col = px.col where in_aoi) select count(*) as n, {q('velocity', .5)} as median, {q('tcoh', .5)} as coherence from bg")
def _(spark, d):
    bg = pairs.anti(pixels(spark, d).where("in_aoi"), _labels(spark, d), ["row", "col"])
    return rounded(bg.agg(F.count("*").alias("n"), F.percentile("velocity", F.lit(0.5)).alias("median"), F.percentile("tcoh", F.lit(0.5)).alias("coherence")))


@query("zone_outline", LABEL + """, o as (select * from (values (-1, 0, 'n'), (1, 0, 's'), (0, -1, 'w'), (0, 1, 'e')) t(dr, dc, side)) select cast(z.label as bigint) as label, z.row, z.col, side from z cross join o where not exists (select 1 from z y where y.label = z.label and y.row = z.row + dr and y.col = z.col + dc)""")
def _(spark, d):
    return zones.outline(_labels(spark, d))


@query("dilated_ring", LABEL + """, k as (select unnest(range(-2, 3)) as k), g as (select distinct label, row + a.k as row, col + b.k as col from z, k a, k b) select cast(label as bigint) as label, row, col from g anti join z on z.label = g.label and z.row = g.row and z.col = g.col""")
def _(spark, d):
    return zones.ring(_labels(spark, d), 2)


@query("zone_overlap", f"""with recursive {PIX}, ha as (select row, col, row // 25 * 10 + col // 25 as label from px where velocity > 0), hb as (select row, col, row // 20 * 10 + col // 20 as label from px where tcoh > 0.85),
 i as (select a.label as a, b.label as b, count(*) as n from ha a join hb b using (row, col) group by 1, 2), sa as (select label, count(*) as na from ha group by 1), sb as (select label, count(*) as nb from hb group by 1),
 r as (select a, b, n, na, nb, row_number() over (partition by a order by n desc, b) as k from i join sa on sa.label = a join sb on sb.label = b)
select cast(a as bigint) as a, cast(b as bigint) as b, n, round(n / na, 9) as overlap, round(n / (na + nb - n), 9) as iou from r where k = 1""")
def _(spark, d):
    p = pixels(spark, d)
    a = p.where("velocity > 0").select("row", "col", F.expr("cast(row div 25 * 10 + col div 25 as bigint)").alias("label"))
    b = p.where("tcoh > 0.85").select("row", "col", F.expr("cast(row div 20 * 10 + col div 20 as bigint)").alias("label"))
    return rounded(zones.zone_overlap(a, b))


@query("copy_comparison", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")} select count(*) as n, round(max(abs(a.velocity - b.velocity)), 4) as max_abs, round(avg((a.velocity is distinct from b.velocity)::int), 9) as differing from pa a join pb b using (row, col)""")
def _(spark, d):
    both = zones.compare_copies(pixels(spark, d, "l_returnflag = 'A'"), pixels(spark, d, "l_returnflag = 'N'"), "velocity")
    return rounded(both.withColumn("max_abs", F.round("max_abs", 4)))


@query("stack_agreement", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, j as (select a.land, a.velocity as a, b.velocity as b from pa a join pb b using (row, col)),
 k as (select *, rank() over (partition by land order by a) + (count(*) over (partition by land, a) - 1) / 2 as ra, rank() over (partition by land order by b) + (count(*) over (partition by land, b) - 1) / 2 as rb from j),
 o as (select land, quantile_cont(b - a, .5) as offset_ from j group by 1), v as (select land, 1.4826 * quantile_cont(abs(b - a - offset_), .5) as r from j join o using (land) group by 1)
select k.land, count(*) as n, round(corr(ra, rb), 9) as spearman, round(corr(a, b), 9) as pearson, round(any_value(o.offset_), 4) as "offset", round(any_value(v.r), 4) as robust_rms from k join o using (land) join v using (land) group by 1 having count(*) >= 200""")
def _(spark, d):
    a = pixels(spark, d, "l_returnflag = 'A'").select("row", "col", "land", F.col("velocity").alias("a"))
    b = pixels(spark, d, "l_returnflag = 'N'").select("row", "col", F.col("velocity").alias("b"))
    out = rounded(stats.agreement(a.join(b, ["row", "col"]), ["land"], "a", "b", 200))
    return out.withColumn("offset", F.round("offset", 4)).withColumn("robust_rms", F.round("robust_rms", 4))


@query("matched_contrast", f"""with {PIX}, c as (select floor(round(tcoh * 100) / 2)::bigint as band, velocity, row < 30 as inside from px), g as (select band, count(*) filter (inside) as n_in, count(*) filter (not inside) as n_out, quantile_cont(velocity, .5) filter (inside) as mi, quantile_cont(velocity, .5) filter (not inside) as mo from c group by 1)
select band, n_in, n_out, round(mi, 9) as median_in, round(mo, 9) as median_out, round(mi - mo, 9) as contrast from g where n_in >= 20 and n_out >= 20""")
def _(spark, d):
    p = pixels(spark, d).withColumn("g", F.lit(1))
    return rounded(stats.matched_contrast(p, ["g"], F.col("row") < 30, F.floor(F.round(F.col("tcoh") * 100) / 2), "velocity").drop("g"))


@query("specificity", f"""with {PIX}, c as (select land, velocity, tcoh > 0.88 as i from px), g as (select land, quantile_cont(velocity, .5) filter (i) as a, quantile_cont(velocity, .5) filter (not i) as b, quantile_cont(velocity, .05) filter (not i) as lo, quantile_cont(velocity, .95) filter (not i) as hi from c group by 1)
select land, round(a, 9) as inside, round(b, 9) as outside, round((a - b) / nullif(hi - lo, 0), 9) as separation from g""")
def _(spark, d):
    return rounded(stats.specificity(pixels(spark, d), ["land"], F.col("tcoh") > 0.88, "velocity"))


@query("weighted_zone_mean", f"with {PIX}, z as (select row // 20 as z, quantile_cont(velocity, .5) as m, count(*) as w from px group by 1) select round(sum(m * w) / sum(w), 9) as weighted_mean from z")
def _(spark, d):
    z = pixels(spark, d).groupBy(F.expr("row div 20").alias("z")).agg(F.percentile("velocity", F.lit(0.5)).alias("m"), F.count("*").alias("w"))
    return rounded(stats.weighted_mean(z, [], "m", "w"))


@query("edge_band", f"with {PIX} select case when least(row, {SIDE} - 1 - row, col, {SIDE} - 1 - col) < 5 then 'edge' else 'interior' end as band, count(*) as n, round(avg((velocity_std > 0)::int), 9) as valid, {q('velocity', .5)} as median from px group by 1")
def _(spark, d):
    return rounded(zones.edge_artifact(pixels(spark, d), side(spark, d), side(spark, d), 5))


@query("box_highpass", f"""with {PIX}, m as (select row, col, velocity from px), k as (select unnest([-1, 0, 1]) as k), md as (select quantile_cont(velocity, .5) as md from px),
 g as (select r.r as row, c.c as col from (select unnest(range(0, {SIDE})) as r) r, (select unnest(range(0, {SIDE})) as c) c), f as (select g.row, g.col, coalesce(velocity, md) as v from g left join m using (row, col), md),
 b as (select f.row, f.col, any_value(f.v) as v, avg(h.v) as box from f cross join k a cross join k b join f h on h.row = least({SIDE} - 1, greatest(0, f.row + a.k)) and h.col = least({SIDE} - 1, greatest(0, f.col + b.k)) group by 1, 2),
 hp as (select m.velocity - b.box as hp from m join b using (row, col)), c as (select quantile_cont(hp, .5) as c from hp) select count(*) as n, round(1.4826 * quantile_cont(abs(hp - c), .5), 4) as sigma from hp, c""")
def _(spark, d):
    return tiled.highpass_box(pixels(spark, d).select("row", "col", "velocity"), "velocity", side(spark, d), side(spark, d), tile=48).withColumn("sigma", F.round("sigma", 4))
