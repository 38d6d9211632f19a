"""Queries on coordinates, polygons, resampling and two viewing geometries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, geo, masks, near
from .inputs import CUST, PIX, SIDE, SUPP, pix_sql, pixels, side, stations, table
from .pixel_queries import rounded

QUERIES, ORACLE = {}, {}
AOI = [(20.5, 10.5), (80.5, 15.5), (90.5, 50.5), (70.5, 85.5), (30.5, 80.5), (10.5, 40.5)]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def hav(a: str, b: str) -> str:
    return f"2 * 6371.0088 * asin(sqrt(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2)))"


EDGES = "edges as (select * from (values " + ", ".join(f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for a, b in zip(AOI, AOI[1:] + AOI[:1], strict=True)) + ") t(x1, y1, x2, y2))"


@query("station_distances", f"with {SUPP}, {CUST} select s.id as id, round({hav('s', 'c')}, 6) as km, round(sqrt(pow((c.lon - s.lon) * 111.320 * cos(radians((s.lat + c.lat) / 2)), 2) + pow((c.lat - s.lat) * 110.574, 2)), 6) as flat_km from supp s join cust c on c.id = s.id * 3")
def _(spark, d):
    s = stations(spark, d, "supplier")
    c = stations(spark, d, "customer").select(F.col("id").alias("cid"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    x = (F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
    return s.join(c, F.col("cid") == F.col("id") * 3).select("id", F.round(geo.haversine_km(*x), 6).alias("km"), F.round(geo.equirect_km(*x), 6).alias("flat_km"))


@query("nearest_stations", f"""with {SUPP}, {CUST}, z as (select * from supp), d as (select z.id, c.id as station, {hav('z', 'c')} as km from z cross join cust c), r as (select *, row_number() over (partition by id order by round(km, 9), station) as rank from d)
select id, station, round(km, 6) as km, rank from r where rank <= 3""")
def _(spark, d):
    return near.nearest_stations(stations(spark, d, "supplier"), stations(spark, d, "customer"), 3).withColumn("km", F.round("km", 6))


@query("colocated_stations", f"with {CUST} select a.id as a, b.id as b, round({hav('a', 'b')}, 6) as km from cust a join cust b on a.id < b.id and {hav('a', 'b')} <= 2.0")
def _(spark, d):
    return geo.colocated(stations(spark, d, "customer"), 2.0).withColumn("km", F.round("km", 6))


@query("distance_bands", f"""with {SUPP}, {CUST}, z as (select * from supp ), d as (select z.id, {hav('z', 'c')} as km from z cross join cust c)
select id, sum((km >= 0 and km <= 1)::int) as upto_1, sum((km > 1 and km <= 2)::int) as upto_2, sum((km > 2 and km <= 5)::int) as upto_5, sum((km > 5 and km <= 10)::int) as upto_10, sum((km > 10 and km <= 20)::int) as upto_20 from d group by 1""")
def _(spark, d):
    return near.station_bands(stations(spark, d, "supplier"), stations(spark, d, "customer"))


INSIDE = f"{EDGES}, ins as (select px.row, px.col from px join edges on ((y1 > row + 0.5) <> (y2 > row + 0.5)) and col + 0.5 < (x2 - x1) * (row + 0.5 - y1) / (y2 - y1) + x1 group by 1, 2 having count(*) % 2 = 1)"


def _centres(spark, d):
    return pixels(spark, d).withColumn("x", F.col("col") + 0.5).withColumn("y", F.col("row") + 0.5)


@query("pixels_in_polygon", f"with {PIX}, {INSIDE} select row, col from ins")
def _(spark, d):
    return geo.in_polygon(_centres(spark, d), geo.polygon_edges(spark, {"aoi": [AOI]}), ["row", "col"]).select("row", "col")


DIST = f"""{INSIDE}, dd as (select px.row, px.col, min(sqrt(pow(col + 0.5 - x1 - u * (x2 - x1), 2) + pow(row + 0.5 - y1 - u * (y2 - y1), 2))) as outline from
 (select px.row, px.col, x1, y1, x2, y2, greatest(0.0, least(1.0, ((col + 0.5 - x1) * (x2 - x1) + (row + 0.5 - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as u from px cross join edges) px group by 1, 2)"""


@query("polygon_distance", f"with {PIX}, {DIST} select dd.row, dd.col, i.row is not null as inside, round(case when i.row is not null then 0.0 else outline end, 6) as distance from dd left join ins i on i.row = dd.row and i.col = dd.col")
def _(spark, d):
    out = near.dist_to_polygon(_centres(spark, d), geo.polygon_edges(spark, {"aoi": [AOI]}), ["row", "col"])
    return out.select("row", "col", "inside", F.round("distance", 6).alias("distance"))


@query("zone_variants", f"with {PIX}, {DIST}, s as (select case when i.row is not null then -outline else outline end as s from dd left join ins i on i.row = dd.row and i.col = dd.col) select sum((s <= -3)::int) as core, sum((s <= 4)::int) as buffered from s")
def _(spark, d):
    dist = near.dist_to_polygon(_centres(spark, d), geo.polygon_edges(spark, {"aoi": [AOI]}), ["row", "col"])
    core = geo.zone_variant(dist, core=3.0).agg(F.count("*").alias("core"))
    return core.crossJoin(geo.zone_variant(dist, buffer=4.0).agg(F.count("*").alias("buffered")))


@query("correspondence", f"with {PIX}, {DIST} select case when (dd.row + dd.col) % 3 = 0 then 'none' when i.row is not null or outline <= 2 then 'direct' when outline <= 5 then 'near' else 'none' end as class, count(*) as n from dd left join ins i on i.row = dd.row and i.col = dd.col group by 1")
def _(spark, d):
    dist = near.dist_to_polygon(_centres(spark, d), geo.polygon_edges(spark, {"aoi": [AOI]}), ["row", "col"])
    return dist.groupBy(masks.correspondence(F.col("distance"), F.col("inside"), (F.col("row") + F.col("col")) % 3 != 0).alias("class")).agg(F.count("*").alias("n"))


#: Three squares beside the area, in cells.
SQUARES = {"a": [[(10, 10), (30, 10), (30, 30), (10, 30)]], "b": [[(60, 55), (80, 55), (80, 90), (60, 90)]], "c": [[(25, 25), (40, 25), (40, 35), (25, 35)]]}
SQUARE_SQL = "sq as (select * from (values " + ", ".join(f"('{k}', {x1}.0, {y1}.0, {x2}.0, {y2}.0)" for k, (r,) in SQUARES.items() for (x1, y1), (x2, y2) in zip(r, [*r[1:], r[0]])) + ") t(poly_id, x1, y1, x2, y2))"


@query("best_match", f"""with {PIX}, {SQUARE_SQL}, e as (select row, col, poly_id, x1, y1, x2, y2, col + 0.5::double as x, row + 0.5::double as y from px cross join sq),
 g as (select row, col, poly_id, min(sqrt(pow(x - x1 - u * (x2 - x1), 2) + pow(y - y1 - u * (y2 - y1), 2))) as outline, sum(case when (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1 as inside from
  (select *, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) as u from e) group by 1, 2, 3),
 r as (select *, case when inside then 0.0 else outline end as distance, row_number() over (partition by row, col order by case when inside then 0.0 else outline end, poly_id) as k from g)
select row, col, poly_id, round(distance, 6) as distance, inside from r where k = 1""")
def _(spark, d):
    dist = near.dist_to_polygon(_centres(spark, d), geo.polygon_edges(spark, SQUARES), ["row", "col"])
    return near.best_match(dist, ["row", "col"]).withColumn("distance", F.round("distance", 6))


@query("utm_round_trip", f"with {SUPP} select id, round(lat, 6) as lat, round(lon, 6) as lon from supp")
def _(spark, d):
    s = stations(spark, d, "supplier")
    east, north = geo.to_utm(F.col("lat"), F.col("lon"), 43)
    lat, lon = geo.to_lonlat(F.col("e"), F.col("n"), 43)
    return s.select("id", east.alias("e"), north.alias("n")).select("id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("bilinear_resample", f"""with {pix_sql('pb', "l_returnflag = 'N'")}, g as (select r.r as row, c.c as col, r.r * 0.9::double + 0.25::double as fr, c.c * 0.9::double + 0.5::double as fc from (select unnest(range(0, {SIDE})) as r) r, (select unnest(range(0, {SIDE})) as c) c),
 k as (select row, col, cast(floor(fr) as int) + i as br, cast(floor(fc) as int) + j as bc, (case when i = 1 then fr - floor(fr) else 1 - (fr - floor(fr)) end) * (case when j = 1 then fc - floor(fc) else 1 - (fc - floor(fc)) end) as w from g, (select unnest([0, 1]) as i) i, (select unnest([0, 1]) as j) j)
select k.row, k.col, round(sum(w * velocity) / sum(w), 9) as value, round(sum(w), 9) as weight from k join pb on pb.row = br and pb.col = bc where w > 0 group by 1, 2""")
def _(spark, d):
    b, n = pixels(spark, d, "l_returnflag = 'N'"), side(spark, d)
    grid = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("row"), F.expr(f"cast(id % {n} as int)").alias("col"))
    grid = grid.withColumn("r", F.col("row") * 0.9 + 0.25).withColumn("c", F.col("col") * 0.9 + 0.5)
    return rounded(geo.resample(b, grid, "velocity"), 9)


FEET = """i as (select s_suppkey % 3 as path, s_suppkey // 3 as id from supplier where s_suppkey % 11 <> 0), f as (select path, id, unnest(range(4 * id - path % 3, 4 * id + 7 + (path + id) % 4)) as cell from i), a as (select unnest(range(40, 66)) as cell)"""


@query("smallest_covering_run", f"""with {FEET}, r as (select x.path, x.id as first, y.id as last from i x join i y on y.path = x.path and y.id between x.id and x.id + 14
  where (select count(*) from i z where z.path = x.path and z.id between x.id and y.id) = y.id - x.id + 1),
 c as (select r.path, first, last, count(distinct f.cell) as u, count(distinct f.cell) filter (f.cell between 40 and 65) as n from r join f on f.path = r.path and f.id between first and last group by 1, 2, 3)
select path, first, last, cast(last - first + 1 as int) as k, round(u / 26, 9) as ratio from c where n = 26 order by last - first, u, path, first limit 1""")
def _(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 11 != 0").select((F.col("s_suppkey") % 3).alias("path"), F.expr("s_suppkey div 3").alias("id"))
    feet = s.withColumn("cell", F.explode(F.expr("sequence(4 * id - path % 3, 4 * id + 6 + (path + id) % 4)")))
    return rounded(geo.smallest_covering_run(feet, spark.range(40, 66).withColumnRenamed("id", "cell")), 9)


@query("contiguous_runs", "with i as (select s_nationkey as path, s_suppkey % 40 as id from supplier group by 1, 2), n as (select path, id, id - row_number() over (partition by path order by id) as isl from i) select a.path, a.id as first, b.id as last, b.id - a.id + 1 as k from n a join n b on a.path = b.path and a.isl = b.isl and b.id >= a.id and b.id - a.id < 15")
def _(spark, d):
    ids = table(spark, d, "supplier").select(F.col("s_nationkey").alias("path"), (F.col("s_suppkey") % 40).alias("id")).distinct()
    return geo.contiguous_runs(ids)


TWO = f"""{pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, j as (select a.row, a.col, a.velocity as d_a, b.velocity as d_b, cos(radians(34.0)) as up_a, sin(radians(34.0)) * cos(radians(-12.0)) as east_a, cos(radians(39.0)) as up_b, sin(radians(39.0)) * cos(radians(-168.0)) as east_b,
 -sin(radians(34.0)) * sin(radians(-12.0)) as north_a, -sin(radians(39.0)) * sin(radians(-168.0)) as north_b, 1.0 as sigma_a, 1.5 as sigma_b from pa a join pb b using (row, col))"""


def _two(spark, d):
    a = pixels(spark, d, "l_returnflag = 'A'").select("row", "col", F.col("velocity").alias("d_a"))
    b = pixels(spark, d, "l_returnflag = 'N'").select("row", "col", F.col("velocity").alias("d_b"))
    ua, ea, na = geo.los_vector(F.lit(34.0), F.lit(-12.0))
    ub, eb, nb = geo.los_vector(F.lit(39.0), F.lit(-168.0))
    return a.join(b, ["row", "col"]).withColumns({"up_a": ua, "east_a": ea, "north_a": na, "up_b": ub, "east_b": eb, "north_b": nb, "sigma_a": F.lit(1.0), "sigma_b": F.lit(1.5)})


@query("decomposition", f"""with {TWO}, k as (select *, up_a * east_b - east_a * up_b as det, up_a * up_a + east_a * east_a + up_b * up_b + east_b * east_b as s from j)
select row, col, round((east_b * d_a - east_a * d_b) / det, 6) as up, round((up_a * d_b - up_b * d_a) / det, 6) as east, round(sqrt(east_b * east_b * 1.0 + east_a * east_a * 2.25) / abs(det), 6) as up_sigma, round(sqrt(s) / abs(det), 6) as amplification,
 round(sqrt((s + sqrt(s * s - 4 * det * det)) / (s - sqrt(s * s - 4 * det * det))), 6) as condition from k""")
def _(spark, d):
    return rounded(geo.decompose(_two(spark, d)).select("row", "col", "up", "east", "up_sigma", "amplification", "condition"), 6)


@query("north_sweep", f"""with {TWO}, n as (select unnest([-5.0, -2.0, 0.0, 2.0, 5.0]) as north), k as (select *, up_a * east_b - east_a * up_b as det from j, n)
select cast(north as double) as north, round(avg((east_b * (d_a - north * north_a) - east_a * (d_b - north * north_b)) / det), 6) as up, round(avg((up_a * (d_b - north * north_b) - up_b * (d_a - north * north_a)) / det), 6) as east from k group by 1""")
def _(spark, d):
    return rounded(geo.north_sweep(_two(spark, d), [-5.0, -2.0, 0.0, 2.0, 5.0]).groupBy("north").agg(F.avg("up").alias("up"), F.avg("east").alias("east")), 6)


@query("common_domain", f"""with {pix_sql('pa', "l_returnflag = 'A'")}, {pix_sql('pb', "l_returnflag = 'N'")}, v as (select a.row // 20 as zone, b.row is not null as both_ from (select * from pa where velocity_std > 0) a left join (select * from pb where velocity_std > 0) b using (row, col))
select zone, count(*) as cells, sum(both_::int) as common, round(avg(both_::int), 6) as coverage from v group by 1""")
def _(spark, d):
    a = masks.inverted(pixels(spark, d, "l_returnflag = 'A'")).select("row", "col")
    b = masks.inverted(pixels(spark, d, "l_returnflag = 'N'")).select("row", "col", F.lit(1).alias("k"))
    j = a.join(b, ["row", "col"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    return rounded(j.groupBy(F.expr("row div 20").alias("zone")).agg(F.count("*").alias("cells"), F.sum("k").alias("common"), F.avg("k").alias("coverage")), 6)


@query("common_control", f"""with {TWO}, t as (select j.*, a.tcoh as ca, b.tcoh as cb from j join pa a using (row, col) join pb b using (row, col)), e as (select quantile_cont(ca, .75) as ea, quantile_cont(cb, .75) as eb from t)
select count(*) as n, round(quantile_cont(d_a, .5), 6) as ref_a, round(quantile_cont(d_b, .5), 6) as ref_b from t, e where ca >= ea and cb >= eb and abs(d_a) <= 10 and abs(d_b) <= 10""")
def _(spark, d):
    t = _two(spark, d).join(pixels(spark, d, "l_returnflag = 'A'").select("row", "col", F.col("tcoh").alias("ca")), ["row", "col"]).join(pixels(spark, d, "l_returnflag = 'N'").select("row", "col", F.col("tcoh").alias("cb")), ["row", "col"])
    return rounded(compare.common_control(t, 10.0), 6)
