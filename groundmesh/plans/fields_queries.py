"""Queries on fields over pixels: residuals, references, seams, smoothing, inversion, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, geo, masks, pairs, series, tiled
from .inputs import EPOCH, NET, PAIRPX, PIX, SIDE, SUPP, epochs, network, pair_pixels, pix_sql, pixels, side, stations, table, telemetry
from .pixel_queries import rounded
from .spatial_queries import AOI, INSIDE

QUERIES, ORACLE = {}, {}
K = fields.WAVELENGTH_M / (4 * 3.141592653589793)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def q(c: str, p: float) -> str:
    return f"round(quantile_cont({c}, {p}), 8)"


CUBE = EPOCH + f""", ex as (select pixel // 25 as row, pixel % 25 as col, zone, i as date, disp as disp_m from ep), pr as (select unnest(range(0, 63)) as ref, unnest(range(1, 64)) as sec union all select unnest(range(0, 62)), unnest(range(2, 64))),
 pc as (select cast(a.row as int) as row, cast(a.col as int) as col, ref || '_' || sec as pair_id, ref, sec, (b.disp_m - a.disp_m) / {-K!r} + case when (a.row + ref) % 5 = 0 then 0.5 else 0.1 * (a.col % 3) end as unw, b.disp_m - a.disp_m as ddisp from pr join ex a on a.date = ref join ex b on b.date = sec and b.row = a.row and b.col = a.col),
 rs as (select row, col, pair_id, unw - ddisp / {-K!r} as residual from pc)"""


def _cube(spark, d):
    """Epoch cells, and pair cells (a step of one or two epochs) with a known error on their phase."""
    e = epochs(spark, d).select(F.expr("cast(pixel div 25 as int)").alias("row"), F.expr("cast(pixel % 25 as int)").alias("col"), "zone", F.col("i").alias("date"), F.col("disp").alias("disp_m"))
    p = spark.range(64).select(F.col("id").cast("int").alias("ref"), F.explode(F.array(F.lit(1), F.lit(2))).alias("s")).select("ref", (F.col("ref") + F.col("s")).alias("sec")).where("sec < 64")
    cells = e.select("row", "col").distinct().crossJoin(F.broadcast(p)).withColumn("pair_id", F.concat_ws("_", "ref", "sec"))
    m = pairs.pair_model(cells, e)
    error = F.when((F.col("row") + F.col("ref")) % 5 == 0, 0.5).otherwise(0.1 * (F.col("col") % 3))
    return e, m.withColumn("unw", F.col("ddisp") / -K + error)


@query("pair_residuals", f"with {CUBE} select pair_id, count(residual) as n, round(sqrt(avg(residual * residual)), 8) as rms, {q('residual', .5)} as median, round(avg((abs(residual) > 1)::int), 8) as above_1rad from rs group by 1")
def _(spark, d):
    e, p = _cube(spark, d)
    return rounded(fields.residual_table(fields.pair_residuals(p.drop("ref_disp", "sec_disp", "ddisp"), e)), 8)


@query("pixel_scatter", f"with {CUBE}, s as (select row, col, stddev_pop(residual) as s from rs group by 1, 2) select count(s) as pixels, {q('s', .5)} as scatter from s")
def _(spark, d):
    e, p = _cube(spark, d)
    return rounded(fields.pixel_scatter(fields.pair_residuals(p.drop("ref_disp", "sec_disp", "ddisp"), e)), 8)


@query("topography_correlation", f"""with {CUBE}, m as (select row, col, avg(residual) as m from rs group by 1, 2), h as (select *, row * 3 + col % 7 as height from m), k as (select *, rank() over (order by m) + (count(*) over (partition by m) - 1) / 2 as ra, rank() over (order by height) + (count(*) over (partition by height) - 1) / 2 as rb from (select round(m, 9) as m, height from h))
select count(*) as n, round(corr(ra, rb), 6) as spearman, round(corr(m, height), 6) as pearson from k""")
def _(spark, d):
    from ..operators import stats

    e, p = _cube(spark, d)
    m = fields.pair_residuals(p.drop("ref_disp", "sec_disp", "ddisp"), e).groupBy("row", "col").agg(F.round(F.avg("residual"), 9).alias("m")).withColumn("height", F.expr("cast(row * 3 + col % 7 as double)")).withColumn("g", F.lit(1))
    return rounded(stats.spearman(m, ["g"], "m", "height").drop("g"), 6)


@query("control_series", f"""with {CUBE}, st as (select row, col from ex group by 1, 2 having stddev_pop(disp_m) < 0.125) select date, count(disp_m) as n, {q('disp_m', .5)} as median from ex semi join st on st.row = ex.row and st.col = ex.col group by 1""")
def _(spark, d):
    e, _p = _cube(spark, d)
    stable = e.groupBy("row", "col").agg(F.stddev_pop("disp_m").alias("s")).where("s < 0.125")
    return rounded(fields.control_series(e, stable, "disp_m"), 8)


@query("spaced_references")
def _(spark, d):
    c = pixels(spark, d).where("in_aoi and land").select("row", "col", (F.col("tcoh") - F.abs("velocity") / 1000).alias("score"))
    return fields.spaced_greedy(c, 25.0, 5)


@query("reference_sensitivity", f"""with {PIX}, z as (select row // 20 as zone, quantile_cont(velocity, .5) as median from px group by 1), r as (select col // 25 as reference, avg(velocity) as value from px where tcoh > .9 group by 1)
select zone, round(max(median - value) - min(median - value), 8) as spread, round(stddev_samp(median - value), 8) as sd from z cross join r group by 1""")
def _(spark, d):
    p = pixels(spark, d)
    z = p.groupBy(F.expr("row div 20").alias("zone")).agg(F.percentile("velocity", F.lit(0.5)).alias("median"))
    r = p.where("tcoh > 0.9").groupBy(F.expr("col div 25").alias("reference")).agg(F.avg("velocity").alias("value"))
    return rounded(fields.reference_sensitivity(z, r), 8)


@query("edge_distance", f"""with {PIX}, c as (select row, col from px where tcoh >= .9 and land), v as (select row, col from px where tcoh < .76 or not land), n as (select c.row, c.col, min(sqrt(pow(c.row - v.row, 2) + pow(c.col - v.col, 2))) as d from c join v on abs(c.row - v.row) <= 10 and abs(c.col - v.col) <= 10 group by 1, 2)
select c.row, c.col, case when d <= 10 then round(d, 8) end as distance from c left join n on n.row = c.row and n.col = c.col""")
def _(spark, d):
    p = pixels(spark, d)
    return rounded(fields.edge_distance(p.where("tcoh >= 0.9 and land").select("row", "col"), p.where("tcoh < 0.76 or not land").select("row", "col"), 10), 8)


@query("seam_check", f"""with {PIX}, v as (select row, velocity + case when row in (40, 61) then 30 else 0 end as v from px), r as (select row, quantile_cont(v, .5) as m from v group by 1), w as (select row, m, m - case when count(m) over x >= 12 then quantile_cont(m, .5) over x end as d from r window x as (order by row rows between 25 preceding and 25 following)),
 c as (select quantile_cont(d, .5) as c, min(row) as lo, max(row) as hi from w), s as (select greatest(1.4826 * quantile_cont(abs(d - c), .5), 1e-9) as s from w, c) select row, round(m, 7) as m, round(d, 7) as d, round((d - c) / s, 6) as z from w, c, s where abs((d - c) / s) > 6 and abs(d) > .05 and row between lo + 30 and hi - 30""")
def _(spark, d):
    p = pixels(spark, d).withColumn("v", F.col("velocity") + F.when(F.col("row").isin(40, 61), 30).otherwise(0))
    out = fields.seam_check(p, "v")
    return out.select("row", F.round("m", 7).alias("m"), F.round("d", 7).alias("d"), F.round("z", 6).alias("z"))


@query("zone_containment", f"with {PIX} select row // 20 as zone, count(*) as n, round(avg((velocity_std > 0)::int), 8) as valid, avg((velocity_std > 0)::int) > .99 as contained from px group by 1")
def _(spark, d):
    return rounded(fields.containment(pixels(spark, d).withColumn("zone", F.expr("row div 20")), F.col("velocity_std") > 0), 8)


@query("point_cells", f"with {SUPP} select id, cast(round((29.0 - lat) / 0.01 - .5) as int) as row, cast(round((lon - 76.5) / 0.01 - .5) as int) as col, cast(round((29.0 - lat) / 0.01 - .5) as int) between 0 and 89 and cast(round((lon - 76.5) / 0.01 - .5) as int) between 0 and 79 as in_grid from (select id, round(lat, 5) + 0.0003 as lat, round(lon, 5) + 0.0003 as lon from supp)")
def _(spark, d):
    p = stations(spark, d, "supplier").select("id", (F.round("lon", 5) + 0.0003).alias("x"), (F.round("lat", 5) + 0.0003).alias("y"))
    return fields.point_to_cell(p, 76.5, 29.0, 0.01, 90, 80).select("id", "row", "col", "in_grid")


@query("coverage", f"with {PIX}, {INSIDE} select count(*) as cells, round(avg((i.row is not null)::int), 8) as covered from px left join ins i on i.row = px.row and i.col = px.col")
def _(spark, d):
    p = pixels(spark, d).withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)
    inside = geo.in_polygon(p, geo.polygon_edges(spark, {"aoi": [AOI]}), ["row", "col"])
    return rounded(fields.coverage(p.select("row", "col"), inside, ["row", "col"]), 8)


@query("gauss_highpass", f"""with {PIX}, n as (select {SIDE} as n), md as (select quantile_cont(velocity, .5) as md from px), w as (select k, exp(-k * k / 18.0::double) as w from (select unnest(range(-12, 13)) as k)),
 g as (select r.r as row, c.c as col from (select unnest(range(0, {SIDE})) as r) r, (select unnest(range(0, {SIDE})) as c) c), f as (select g.row, g.col, coalesce(velocity, md) as v from g left join px using (row, col), md),
 a as (select f.row, f.col, sum(w * o.v) / sum(w) as s from f cross join n cross join w join f o on o.col = f.col and o.row = case when f.row + k < 0 then -1 - f.row - k when f.row + k >= n then 2 * n - 1 - f.row - k else f.row + k end group by 1, 2),
 b as (select f.row, f.col, sum(w * o.s) / sum(w) as s from a f cross join n cross join w join a o on o.row = f.row and o.col = case when f.col + k < 0 then -1 - f.col - k when f.col + k >= n then 2 * n - 1 - f.col - k else f.col + k end group by 1, 2),
 d as (select velocity - s as d from px join b using (row, col)), m as (select quantile_cont(d, .5) as m from d) select count(*) as n, round(1.4826 * quantile_cont(abs(d - m), .5), 6) as sigma from d, m""")
def _(spark, d):
    n = side(spark, d)
    return rounded(tiled.highpass_gauss(pixels(spark, d), "velocity", n, n, tile=48), 6)


@query("network_inversion")
def _(spark, d):
    e, p = _cube(spark, d)
    steps = [(a, a + s) for a in range(64) for s in (1, 2) if a + s < 64]
    index = spark.createDataFrame([(f"{a}_{b}", i) for i, (a, b) in enumerate(steps)], "pair_id string, pair int")
    cells = p.withColumn("unw", F.col("ddisp") / -K).withColumn("coh", F.expr("0.35 + 0.05 * ((3 * row + 7 * col + cast(split(pair_id, '_')[1] as int)) % 12)")).join(index, "pair_id")
    x = fields.invert_network(cells.select("row", "col", "pair", "unw", "coh"), steps, [i * 12 / 365.25 for i in range(64)], 8)
    return x.select("row", "col", F.round("rate", 7).alias("rate"), F.round("coherence", 7).alias("coherence"), F.round(F.element_at("disp", -1), 7).alias("last"))


ORACLE["network_inversion"] = f"""with {EPOCH} select cast(pixel // 25 as int) as row, cast(pixel % 25 as int) as col, round(regr_slope(disp, t), 7) as rate, 1.0::double as coherence, round(arg_max(disp, i) - arg_min(disp, i), 7) as last from ep group by 1, 2"""


@query("branch_comparison", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, j as (select b.velocity_std - a.velocity_std as d from pa a join pb b using (row, col))
select count(*) as n, {q('d', .5)} as median, round(sqrt(avg(d * d)), 8) as rms, round(max(abs(d)), 8) as largest, cast(sum((d < 0)::int) as bigint) as improved, cast(sum((d > 0)::int) as bigint) as worsened from j""")
def _(spark, d):
    return rounded(fields.branch_comparison(pixels(spark, d, "l_returnflag = 'A'"), pixels(spark, d, "l_returnflag = 'N'"), ["row", "col"], "velocity_std"), 8)


@query("region_comparison", f"with {PIX} select case when land then 'land' else 'water' end as region, count(*) as n, round(avg((not (tcoh >= .8))::int), 8) as masked_out, {q('velocity', .5)} as median_all, round(quantile_cont(velocity, .5) filter (tcoh >= .8), 8) as median_kept from px group by 1")
def _(spark, d):
    return rounded(fields.region_comparison(pixels(spark, d), F.when(F.col("land"), "land").otherwise("water"), F.col("tcoh") >= 0.8, "velocity"), 8)


@query("mask_variants", f"with {PIX} select row // 20 as zone, " + ", ".join(f"count(velocity) filter ({m}) as {k}_n, round(quantile_cont(velocity, .5) filter ({m}), 8) as {k}_median" for k, m in (("all", "true"), ("land", "land"), ("c80", "tcoh >= .8"), ("c90", "tcoh >= .9"), ("std", "velocity_std > .04"))) + " from px group by 1")
def _(spark, d):
    v = {"all": F.lit(True), "land": F.col("land"), "c80": F.col("tcoh") >= 0.8, "c90": F.col("tcoh") >= 0.9, "std": F.col("velocity_std") > 0.04}
    return rounded(fields.mask_variants(pixels(spark, d).withColumn("zone", F.expr("row div 20")), "zone", "velocity", v), 8)


@query("volume_projection", """with b as (select l_returnflag as config, l_orderkey as pair_id, max(l_extendedprice) as bytes from lineitem where l_linestatus = 'F' group by 1, 2), p as (select l_returnflag as config, count(distinct l_orderkey) as n from lineitem group by 1)
select config, count(*) as copies, round(avg(bytes), 4) as mean_bytes, any_value(n) as n, round(avg(bytes) * any_value(n), 1) as projected from b join p using (config) group by 1""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("config", F.col("l_returnflag"))
    inv = li.select("config", F.col("l_orderkey").alias("pair_id"), (F.col("l_linestatus") == "F").alias("ok"), F.col("l_extendedprice").alias("bytes"))
    out = fields.project_volume(inv, li.groupBy("config").agg(F.countDistinct("l_orderkey").alias("n")))
    return out.select("config", "copies", F.round("mean_bytes", 4).alias("mean_bytes"), "n", F.round("projected", 1).alias("projected"))


@query("unconnectable_nodes", f"with {NET}, thin as (select * from edges where month(src) < 9), al as (select n.* from nodes n where not exists (select 1 from thin t where t.network_id = n.network_id and (t.src = n.node or t.dst = n.node))) select a.network_id, a.node, cast(min(abs(a.node - b.node)) as int) as nearest_days from al a join nodes b on a.network_id = b.network_id and a.node <> b.node group by 1, 2")
def _(spark, d):
    nodes, edges = network(spark, d)
    return fields.unconnectable(nodes, edges.where("month(src) < 9"))


@query("pixel_bootstrap")
def _(spark, d):
    from pyspark.sql import Window

    e = epochs(spark, d).groupBy("pixel", "zone").agg(F.avg("disp").alias("disp"))
    z = e.withColumn("i", F.row_number().over(Window.partitionBy("zone").orderBy("pixel")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("zone")))
    return rounded(fields.pixel_bootstrap(z, "disp"), 8)


@query("random_reference_spread")
def _(spark, d):
    return rounded(fields.random_reference_spread(pixels(spark, d), "velocity"), 8)


@query("lag_correlation")
def _(spark, d):
    s = telemetry(spark, d).groupBy(F.col("producer").alias("series_id"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    e = s.select(F.col("date").alias("epoch")).distinct()
    m = pairs.lag_window_match(s, e, [0, 3])
    z = e.withColumn("zone", F.lit("z")).withColumn("t", F.unix_date("epoch").cast("double")).join(s.where("series_id = 'click'").select(F.col("date").alias("epoch"), F.col("value").alias("y")), "epoch")
    return rounded(series.lag_correlation(m, z, 10), 7)


@query("reproduction_verdicts", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, z as (select a.row // 10 as zone, quantile_cont(a.velocity, .5) as expected, quantile_cont(b.velocity, .5) as observed, avg(b.tcoh) >= .85 as quality_ok from pa a join pb b using (row, col) group by 1)
select zone, round(abs(observed - expected) / .8, 7) as gap_sigma, case when abs(observed - expected) / .8 <= 2 then 'CONSISTENT' when quality_ok then 'NOT_REPRODUCED' else 'NOT_RESOLVED' end as verdict from z""")
def _(spark, d):
    a = pixels(spark, d, "l_returnflag = 'A'").select("row", "col", F.col("velocity").alias("va"))
    b = pixels(spark, d, "l_returnflag = 'N'").select("row", "col", F.col("velocity").alias("vb"), "tcoh")
    z = a.join(b, ["row", "col"]).groupBy(F.expr("row div 10").alias("zone")).agg(F.percentile("va", F.lit(0.5)).alias("expected"), F.percentile("vb", F.lit(0.5)).alias("observed"), (F.avg("tcoh") >= 0.85).alias("quality_ok")).withColumn("sigma", F.lit(0.8))
    return masks.reproduction_verdict(z).select("zone", F.round("gap_sigma", 7).alias("gap_sigma"), "verdict")
