"""Queries that compare branches, views, producers and zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, masks
from .inputs import PIX, SIDE, TELE, pix_sql, pixels, side, table, telemetry
from .pixel_queries import rounded

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _where(c: str) -> str:
    return f"28 + {c} % 1000 / 1000.0 as lat, 76.5 + {c} % 997 / 997.0 as lon"


HAV = "2 * 6371.0088 * asin(sqrt(pow(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin(radians(y.lon - x.lon) / 2), 2)))"


@query("colocated_rates", f"""with {TELE}, o as (select station, cast(ts as date) as date, quantile_cont(value, .5) as y from tele where value is not null group by 1, 2), s as (select station as id, {_where('station')} from (select distinct station from o)),
 p as (select x.id as a, y.id as b, {HAV} as km from s x join s y on x.id < y.id), m as (select a, b, (u.date - date '2024-01-01') / 365.25 as t, u.y as ya, v.y as yb from p join o u on u.station = a join o v on v.station = b and v.date = u.date where km <= 2),
 r as (select a, b, count(*) as common, regr_slope(ya, t) as rate_a, regr_slope(yb, t) as rate_b, regr_slope(ya - yb, t) as relative_rate, sqrt(8 / regr_sxx(ya, t)) as sigma from m group by 1, 2 having count(*) >= 10)
select a, b, common, round(round(rate_a, 9), 6) as rate_a, round(round(rate_b, 9), 6) as rate_b, round(round(rate_a - rate_b, 9), 6) as difference, round(round(relative_rate, 9), 6) as relative_rate, round(round(sigma, 9), 6) as sigma from r""")
def _(spark, d):
    o = telemetry(spark, d).where("value is not null").groupBy("station", F.to_date("ts").alias("date")).agg(F.percentile("value", F.lit(0.5)).alias("y"))
    o = o.withColumn("t", F.datediff("date", F.lit("2024-01-01")) / 365.25).withColumn("sigma", F.lit(2.0))
    s = o.select(F.col("station").alias("id")).distinct().select("id", (28 + F.col("id") % 1000 / 1000).alias("lat"), (76.5 + F.col("id") % 997 / 997).alias("lon"))
    out = rounded(compare.colocated_rates(s, o, least=10).drop("km"), 9)  # halves at the seventh place agree first
    whole = lambda c: F.signum(c) * F.floor(F.abs(F.col(c) * 1e6) + 0.5) / 1e6  # noqa: E731  rounds the binary product, as the SQL does
    return out.select(*[whole(c).alias(c) if t == "double" else c for c, t in out.dtypes])


BRANCHES = f"{pix_sql('pa', chr(39) + 'A' + chr(39) + ' = l_returnflag')}, {pix_sql('pn', chr(39) + 'N' + chr(39) + ' = l_returnflag')}, {pix_sql('pr', chr(39) + 'R' + chr(39) + ' = l_returnflag')}"


def _branches(spark, d):
    cut = lambda f: pixels(spark, d, f"l_returnflag = '{f}'").withColumn("residue", F.col("height") / 10)
    px = cut("N").withColumn("branch", F.lit("N")).unionByName(cut("R").withColumn("branch", F.lit("R")))
    return px, cut("A").withColumn("stable", F.expr("(row + col) % 5 = 0"))


def _partial(xy: str, xz: str, yz: str) -> str:
    return f"(({xy}) - ({xz}) * ({yz})) / sqrt((1 - ({xz}) * ({xz})) * (1 - ({yz}) * ({yz})))"


PLANE = _partial(_partial("ab", "ar", "br"), _partial("ac", "ar", "rc"), _partial("bc", "br", "rc"))


@query("branch_metrics", f"""with {BRANCHES}, px as (select 'N' as branch, *, height / 10 as residue from pn union all select 'R', *, height / 10 from pr), i as (select * from px where velocity_std > 0),
 own as (select branch, count(*) as inverted, quantile_cont(tcoh, .25) as tc_p25, quantile_cont(tcoh, .5) as tc_p50, quantile_cont(tcoh, .75) as tc_p75, sum((tcoh >= .5)::int)::bigint as tc_ge_50, sum((tcoh >= .6)::int)::bigint as tc_ge_60, sum((tcoh >= .7)::int)::bigint as tc_ge_70,
  quantile_cont(velocity_std, .5) as median_std, sqrt(avg(residue * residue)) as residual_rms, quantile_cont(velocity, .5) as mid from i group by 1),
 sc as (select branch, 1.4826 * quantile_cont(abs(velocity - mid), .5) as robust_scatter from i join own using (branch) group by 1),
 both_ as (select branch, row, col, i.velocity as v, pa.velocity as base, (row + col) % 5 = 0 as stable from i join pa using (row, col)),
 k as (select *, rank() over (partition by branch order by v) + (count(*) over (partition by branch, v) - 1) / 2 as rv, rank() over (partition by branch order by base) + (count(*) over (partition by branch, base) - 1) / 2 as rb from both_),
 cr as (select branch, count(*) as common, corr(base, v) as pearson, corr(rb, rv) as spearman, stddev_pop(v) as common_scatter, stddev_pop(case when stable then v end) as stable_scatter,
  corr(base, v) as ab, corr(base, row) as ar, corr(base, col) as ac, corr(v, row) as br, corr(v, col) as bc, corr(row, col) as rc from k group by 1)
select branch, inverted, tc_ge_50, tc_ge_60, tc_ge_70, common, {', '.join(f'round({c}, 6) as {c}' for c in ('tc_p25', 'tc_p50', 'tc_p75', 'median_std', 'residual_rms', 'robust_scatter', 'pearson', 'spearman', 'common_scatter', 'stable_scatter'))}, round({PLANE}, 6) as plane_pearson
 from own join sc using (branch) join cr using (branch)""")
def _(spark, d):
    return rounded(compare.branch_metrics(*_branches(spark, d)), 6)


BLOCKS = f"""{PIX}, bl as (select cast(row // 5 as int) as row, cast(col // 5 as int) as col, avg((velocity_std > 0 and land)::int) as support, 1000.0 * least(min(row), min(col), {SIDE} - 1 - max(row), {SIDE} - 1 - max(col)) as edge_m, quantile_cont(velocity_std, .5) as std, quantile_cont(velocity, .5) as velocity, quantile_cont(tcoh, .5) as coherence from px group by 1, 2)"""


def _blocks(spark, d):
    return pixels(spark, d).groupBy(F.expr("cast(row div 5 as int)").alias("r"), F.expr("cast(col div 5 as int)").alias("c")).agg(
        F.avg(F.expr("cast(velocity_std > 0 and land as double)")).alias("support"), (1000.0 * F.least(F.min("row"), F.min("col"), side(spark, d) - 1 - F.max("row"), side(spark, d) - 1 - F.max("col"))).alias("edge_m"),
        *[F.percentile(c, F.lit(0.5)).alias(n) for c, n in (("velocity_std", "std"), ("velocity", "velocity"), ("tcoh", "coherence"))],
    ).withColumnsRenamed({"r": "row", "c": "col"})


@query("reference_gates", f"""with {BLOCKS}, g as (select *, (select quantile_cont(std, .25) from bl) as std_limit from bl), h as (select *, support >= .9 and edge_m >= 2000 and std <= std_limit as hard_ok, abs(velocity) <= 2 as velocity_ok from g), x as (select *, not (select bool_or(hard_ok and velocity_ok) from h) as relaxed from h)
select row, col, round(std, 6) as std, hard_ok, velocity_ok, relaxed, round(case when hard_ok and relaxed then -abs(velocity) when hard_ok and velocity_ok then coherence end, 6) as score from x""")
def _(spark, d):
    return rounded(compare.reference_gates(_blocks(spark, d), support=0.9), 6).select("row", "col", "std", "hard_ok", "velocity_ok", "relaxed", "score")


@query("select_references")
def _(spark, d):
    return rounded(compare.select_references(_blocks(spark, d), distance=4.0, support=0.9), 6)


VIEWS = f"{pix_sql('pa', chr(39) + 'A' + chr(39) + ' = l_returnflag')}, {pix_sql('pb', chr(39) + 'N' + chr(39) + ' = l_returnflag')}, v as (select row, col, row // 10 as zone, row % 10 as inner_, pa.velocity as a, pb.velocity as b, pb.tcoh as tb, pa.tcoh as ta from pa join pb using (row, col))"


def _views(spark, d):
    a = pixels(spark, d, "l_returnflag = 'A'").select("row", "col", F.col("velocity").alias("a"), F.col("tcoh").alias("ta"))
    b = pixels(spark, d, "l_returnflag = 'N'").select("row", "col", F.col("velocity").alias("b"), F.col("tcoh").alias("tb"))
    return a.join(b, ["row", "col"]).withColumn("zone", F.expr("row div 10")).withColumn("inner", F.col("row") % 10)


CUTS = {"all": "true", "b_tcoh>=0.5": "tb >= 0.5", "b_tcoh>=0.7": "tb >= 0.7", "b_tcoh>=0.8": "tb >= 0.8", "b_tcoh>=0.9": "tb >= 0.9", "core": "{i} between 2 and 7", "boundary": "{i} not between 2 and 7", "ring": "{i} in (0, 9)"}
LOOKS = ((-0.62, -0.11, 0.77), (0.58, -0.12, 0.80))


@query("contradiction_facets", f"""with {VIEWS}, f as ({' union all '.join(f"select zone, '{n}' as facet, a, b from v where {c.format(i='inner_')}" for n, c in CUTS.items())})
select zone, facet, count(*) as n, round(quantile_cont(a, .5), 6) as a, round(quantile_cont(b, .5), 6) as b from f group by 1, 2 having count(*) >= 6""")
def _(spark, d):
    cuts = {n: F.expr(c.format(i="`inner`")) for n, c in CUTS.items()}
    return rounded(compare.facets(_views(spark, d), ["zone"], "a", "b", cuts), 6)


@query("implied_components", f"""with {VIEWS}, z as (select zone, quantile_cont(a, .5) as a, quantile_cont(b, .5) as b from v group by 1), n as (select unnest([-10.0, -5.0, 0.0, 5.0, 10.0])::double as north),
 e as (select zone, north, a + .11 * north as p, b + .12 * north as q, .77 * .58 + .62 * .80 as det from z, n) select zone, north, round((.58 * p + .62 * q) / det, 6) as vertical, round((.77 * q - .80 * p) / det, 6) as east from e""")
def _(spark, d):
    z = _views(spark, d).groupBy("zone").agg(F.percentile("a", F.lit(0.5)).alias("a"), F.percentile("b", F.lit(0.5)).alias("b"))
    return rounded(compare.implied_components(z, ["zone"], *LOOKS), 6)


CROSS = f"""{VIEWS}, z as (select zone, quantile_cont(a, .5) as a, quantile_cont(b, .5) as b, quantile_cont(ta, .5) as ca, quantile_cont(tb, .5) as cb, count(*) as n_both, stddev_samp(a) / sqrt(count(*)) as sa, stddev_samp(b) / sqrt(count(*)) as sb, avg((tb >= .8)::int) as coverage, avg((abs(b) >= 10)::int) >= .2 as detected from v group by 1)"""


def _cross(spark, d):
    return _views(spark, d).groupBy("zone").agg(
        *[F.percentile(c, F.lit(0.5)).alias(n) for c, n in (("a", "a"), ("b", "b"), ("ta", "coherence_a"), ("tb", "coherence_b"))], F.count("*").alias("n_both"),
        *[(F.stddev_samp(c) / F.sqrt(F.count("*"))).alias(f"sigma_{c}") for c in ("a", "b")],
        F.avg((F.col("tb") >= 0.8).cast("double")).alias("coverage"), (F.avg((F.abs("b") >= 10).cast("double")) >= 0.2).alias("detected"),
    )


@query("cross_geometry_class", f"""with {CROSS}, s as (select *, sign(a) = sign(b) as same, abs(b) / greatest(abs(a), 1e-9) >= .5 as large from z)
select zone, case when b is null or coverage < .5 or cb < .5 then 'NOT_RESOLVED' when same and detected and large then 'INDEPENDENTLY_SUPPORTED' when same and (detected or large) then 'PARTIALLY_SUPPORTED' when not same then 'CONTRADICTED' else 'NOT_RESOLVED' end as cross_class from s""")
def _(spark, d):
    return masks.cross_class(_cross(spark, d)).select("zone", "cross_class")


@query("decomposition_eligibility", f"""with {CROSS}, k as (select *, (.58 * a + .62 * b) / (.77 * .58 + .62 * .80) as vertical, sqrt(pow(.58 * sa, 2) + pow(.62 * sb, 2)) / (.77 * .58 + .62 * .80) as sigma, abs(b) / nullif(abs(a), 0) as ratio from z)
select zone, case when n_both < 5 then 'few common cells' else concat_ws('; ', case when sign(a) <> sign(b) then 'sign disagreement' end, case when ratio is null or ratio not between .5 and 2 then 'magnitude ratio outside 0.5-2.0' end, case when ca < .8 then 'coherence of a under 0.8' end,
 case when cb < .8 then 'coherence of b under 0.8' end, case when coalesce(abs(vertical) <= 2 * sigma, true) then 'vertical within 2 sigma' end) end as reasons from k""")
def _(spark, d):
    (ea, _, ua), (eb, _, ub) = LOOKS
    z = _cross(spark, d).withColumn("vertical", (eb * F.col("a") - ea * F.col("b")) / (ua * eb - ea * ub))
    z = z.withColumn("vertical_sigma", F.sqrt(F.pow(eb * F.col("sigma_a"), 2) + F.pow(ea * F.col("sigma_b"), 2)) / abs(ua * eb - ea * ub))
    return masks.decomp_eligibility(z).select("zone", "reasons")


@query("connected_contrast", f"""with {PIX} select row // 10 as zone, count(*) as inverted, sum(((row * col) % 3 <> 0)::int)::bigint as inside, round(avg(((row * col) % 3 <> 0)::int), 6) as fraction_inside, round(quantile_cont(case when (row * col) % 3 <> 0 then abs(velocity) end, .5), 6) as inside_abs_velocity,
 round(quantile_cont(case when (row * col) % 3 = 0 then abs(velocity) end, .5), 6) as outside_abs_velocity, round(quantile_cont(case when (row * col) % 3 <> 0 then tcoh end, .5), 6) as inside_tcoh, round(quantile_cont(case when (row * col) % 3 = 0 then tcoh end, .5), 6) as outside_tcoh from px where velocity_std > 0 group by 1""")
def _(spark, d):
    px = pixels(spark, d).withColumn("zone", F.expr("row div 10")).withColumn("connected", F.expr("(row * col) % 3 != 0"))
    return rounded(compare.connected_contrast(px, ["zone"]), 6)


@query("correction_coverage", """with e as (select distinct cast(o_orderdate as date) as date from orders), f as (select cast(l_shipdate as date) as date, max(cast(l_extendedprice / 10 as bigint)) as bytes from lineitem where l_orderkey % 5 <> 0 group by 1),
 c as (select cast(l_shipdate as date) as date, avg((l_tax > 0)::int) as finite from lineitem where l_suppkey % 2 = 0 group by 1) select e.date, bytes, round(finite, 6) as finite, case when bytes is null then 'no file' when bytes < 5000 then 'small file' when finite is null then 'no delays' when finite < .9 then 'incomplete area' else 'ok' end as state
 from e left join f on f.date = e.date left join c on c.date = e.date""")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    files = li.where("l_orderkey % 5 != 0").select("date", F.rint(F.col("l_extendedprice") / 10).cast("long").alias("bytes"))  # halves to even, as the SQL's cast
    delays = li.select("date", (F.col("l_suppkey") % 2 == 0).alias("in_aoi"), F.when(F.col("l_tax") > 0, F.col("l_tax").cast("double")).alias("value"))
    return rounded(compare.correction_coverage(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")), files, delays, 5000, 0.9), 6)


@query("rebasing_effect", f"""with {BRANCHES}, b as (select 'N' as branch, * from pn union all select 'R', * from pr), x as (select branch, b.velocity - pa.velocity as d from b join pa using (row, col))
select branch, count(*) as n, round(quantile_cont(d, .5), 6) as published_median, round(sqrt(avg(d * d)), 6) as published_rms, round(quantile_cont(d + 1.5, .5), 6) as aligned_median, round(sqrt(avg((d + 1.5) * (d + 1.5))), 6) as aligned_rms from x group by 1""")
def _(spark, d):
    px, base = _branches(spark, d)
    named = px.select("branch", "row", "col", F.col("velocity").alias("value"))
    return rounded(compare.rebasing_effect(base.select("row", "col", F.col("velocity").alias("value")), named, ["row", "col"], ["branch"], 1.5), 6)


@query("zone_profile", f"""with {PIX}, g as (select row, col, l_returnflag as property, l_linenumber as depth, avg(l_quantity) as value from (select *, cast(l_partkey % {SIDE} as int) as row, cast((l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % {SIDE} as int) as col from lineitem) group by all)
select px.row // 10 as zone, property, depth, count(*) as n, round(quantile_cont(value, .5) / 10, 6) as median from px join g using (row, col) where in_aoi group by 1, 2, 3""")
def _(spark, d):
    cells = table(spark, d, "lineitem").select(F.expr(f"cast(l_partkey % {side(spark, d)} as int)").alias("row"), F.expr(f"cast((l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % {side(spark, d)} as int)").alias("col"), F.col("l_returnflag").alias("property"), F.col("l_linenumber").alias("depth"), "l_quantity")
    grids = cells.groupBy("row", "col", "property", "depth").agg(F.avg("l_quantity").alias("value"))
    return rounded(compare.zone_profile(pixels(spark, d).where("in_aoi").withColumn("zone", F.expr("row div 10")), grids), 6)


@query("cross_producer_duplication", f"""with a as (select c_custkey // 2 as station, min((c_custkey % 1000, c_custkey % 997)) as p from customer group by 1), b as (select s_suppkey as station, (s_suppkey * 2 % 1000, s_suppkey * 2 % 997) as p from supplier)
select (select count(*) from a) as stations_a, (select count(*) from b) as stations_b, (select count(*) from a where station in (select station from b)) as shared_names, (select count(distinct p) from a where p in (select p from b)) as shared_coordinates""")
def _(spark, d):
    at = lambda k: (F.col(k) % 1000 / 1000, F.col(k) % 997)
    a = table(spark, d, "customer").select(F.expr("c_custkey div 2").alias("station"), at("c_custkey")[0].alias("lat"), at("c_custkey")[1].alias("lon"))
    b = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") * 2).select(F.col("s_suppkey").alias("station"), at("k")[0].alias("lat"), at("k")[1].alias("lon"))
    return compare.cross_producer_duplication(a, b)


@query("aoi_window", f"""with s as (select {_where('s_suppkey')} from supplier), b as (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from s)
select greatest(0, cast(floor((29.2 - y1) / .01) as int) - 1) as row0, least(150, cast(ceil((29.2 - y0) / .01) as int) + 1) as row1, greatest(0, cast(floor((x0 - 76.3) / .01) as int) - 1) as col0, least(160, cast(ceil((x1 - 76.3) / .01) as int) + 1) as col1 from b""")
def _(spark, d):
    k = F.col("s_suppkey")
    return compare.aoi_window(table(spark, d, "supplier").select((76.5 + k % 997 / 997).alias("x"), (28 + k % 1000 / 1000).alias("y")), 76.3, 29.2, 0.01, 150, 160)
