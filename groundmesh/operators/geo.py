"""Coordinates, distances, polygons and resampling as column expressions and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    r = F.radians
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def equirect_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx = (lon2 - lon1) * 111.320 * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * 110.574
    return F.sqrt(dx * dx + dy * dy)


def to_utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (north hemisphere, WGS 84) by the Krueger series to third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * big * east, 0.9996 * big * north


def to_lonlat(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Latitude and longitude in degrees; the inverse of to_utm."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi0, eta0 = north / (0.9996 * big), (east - 500000) / (0.9996 * big)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, c in enumerate(delta, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return F.degrees(phi), (6 * zone - 183) + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))


def polygon_edges(spark, rings: dict[str, list[list[tuple[float, float]]]]) -> DataFrame:
    """poly_id, x1, y1, x2, y2 for rings given as corner lists; the first is the shell, others are holes."""
    rows = [(p, *a, *b) for p, parts in rings.items() for ring in parts for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "poly_id string, x1 double, y1 double, x2 double, y2 double")


def in_polygon(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, poly_id of points (x, y) inside a polygon, by the parity of edges that a ray to the right crosses.

    Points and edges meet in an equi-join on bands of y, as many as a quarter of the edges and 256 at least, so a point
    meets the few edges of its band. Points above or below all edges meet none.
    """
    x, y = F.col("x"), F.col("y")
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    size = edges.agg(F.min(lo).alias("_lo"), F.greatest(F.max(hi) - F.min(lo), F.lit(1e-300)).alias("_span"), F.greatest(F.lit(256), F.count("*") / 4).cast("long").alias("_bands"))
    band = lambda v: F.floor((v - F.col("_lo")) / F.col("_span") * F.col("_bands"))
    cut = edges.crossJoin(F.broadcast(size)).select("poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(band(lo), band(hi))).alias("_band"))
    placed = points.select(*key, "x", "y").crossJoin(F.broadcast(size)).select(*key, "x", "y", band(y).alias("_band"))
    hits = placed.join(cut, "_band").where(((F.col("y1") > y) != (F.col("y2") > y)) & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")))
    return hits.groupBy(*key, "poly_id").agg(F.count("*").alias("_n")).where(F.col("_n") % 2 == 1).select(*key, "poly_id")


def zone_variant(distances: DataFrame, core: float = 0.0, buffer: float = 0.0) -> DataFrame:
    """Points of a zone's core (at least ``core`` from its outline, inside) or of the zone with a buffer."""
    return distances.where(F.col("signed") <= (-core if core else buffer))


def colocated(stations: DataFrame, cap_km: float, carried: list[str] = ()) -> DataFrame:
    """Pairs of stations within the cap, met through cells as wide as the cap (and their neighbours), not all pairs.

    The columns ``carried`` of both come along, with 1 (of a) and 2 (of b) behind their names.

    A cell is cap_km / 100 degrees high and, as degrees of longitude shrink with latitude, wide enough for the cap at the
    highest latitude of the data; columns go round the earth, so pairs across the date line meet. Near the poles one
    column has all.
    """
    deg = cap_km / 100.0
    half = math.sin(min(cap_km / EARTH_KM / 2, math.pi / 2))
    top = F.cos(F.radians(F.max(F.abs("lat"))))
    wide = F.when(F.lit(half) < top, F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(half) / top)))).otherwise(360.0)
    around = F.greatest(F.lit(1), F.floor(360 / (wide * 1.000001)).cast("int"))
    size = stations.agg(around.alias("around"))
    cells = stations.crossJoin(F.broadcast(size)).withColumn("_j", F.floor(F.pmod(F.col("lon").cast("double"), F.lit(360.0)) * F.col("around") / 360))
    a = cells.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.floor(F.col("lat") / deg).alias("i"), F.pmod("_j", "around").alias("j"), "around", *[F.col(c).alias(f"{c}1") for c in carried])
    rows = F.explode(F.array(*[F.lit(x) for x in (-1, 0, 1)])).alias("x")
    columns = F.explode(F.array_distinct(F.array(*[F.pmod(F.col("j") + y, F.col("around")) for y in (-1, 0, 1)]))).alias("j")
    also = lambda k: [F.col(f"{c}1").alias(f"{c}{k}") for c in carried]
    b = a.select("a", "lat1", "lon1", "i", rows, "j", "around", *also(1)).select(F.col("a").alias("b"), F.col("lat1").alias("lat2"), F.col("lon1").alias("lon2"), (F.col("i") + F.col("x")).alias("i"), columns, *also(2))
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["i", "j"]).where("a < b").select("a", "b", km.alias("km"), *[f"{c}{k}" for c in carried for k in (1, 2)]).where(F.col("km") <= cap_km)


def distance_bands(near: DataFrame, by: list[str], edges: tuple[float, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """Stations in each distance band of each zone: up to the first edge, between edges."""
    lo = (0.0, *edges[:-1])
    return near.groupBy(*by).agg(*[F.sum(((F.col("km") > a if i else F.col("km") >= a) & (F.col("km") <= b)).cast("int")).alias(f"upto_{b:g}") for i, (a, b) in enumerate(zip(lo, edges, strict=True))])


def resample(px_b: DataFrame, grid_a: DataFrame, col: str) -> DataFrame:
    """Bilinear values of stack b at the cells of grid a.

    grid_a: row, col and the fractional place (r, c) of the cell in b. Each cell looks up its four neighbours in one
    equi-join; missing ones give their weight to the others.
    """
    r0, c0 = F.floor("r"), F.floor("c")
    wr, wc = F.col("r") - r0, F.col("c") - c0
    corner = lambda i, j: F.struct((r0 + i).cast("int").alias("br"), (c0 + j).cast("int").alias("bc"), ((wr if i else 1 - wr) * (wc if j else 1 - wc)).alias("w"))
    four = grid_a.select("row", "col", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("k")).select("row", "col", "k.*").where("w > 0")
    b = px_b.where(F.col(col).isNotNull()).select(F.col("row").alias("br"), F.col("col").alias("bc"), F.col(col).alias("v"))
    return four.join(b, ["br", "bc"]).groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("value"), F.sum("w").alias("weight"))


def common_grid(products: DataFrame) -> DataFrame:
    """The overlap of all products (left, bottom, right, top, step, crs) snapped to whole cells of the first."""
    agg = products.agg(F.max("left").alias("left"), F.max("bottom").alias("bottom"), F.min("right").alias("right"), F.min("top").alias("top"), F.first("step").alias("step"), F.countDistinct("crs").alias("crs_count"))
    return agg.withColumn("width", F.round((F.col("right") - F.col("left")) / F.col("step")).cast("int")).withColumn("height", F.round((F.col("top") - F.col("bottom")) / F.col("step")).cast("int")).withColumn("usable", (F.col("crs_count") == 1) & (F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom")))


def contiguous_runs(ids: DataFrame, most: int = 15) -> DataFrame:
    """All gap-free runs of at most ``most`` ids: first, last, k. Ids (bursts of a path) meet inside an island only."""
    island = ids.withColumn("island", F.col("id") - F.row_number().over(Window.partitionBy("path").orderBy("id")))
    ends = island.select("path", "island", F.col("id").alias("last"))
    return island.select("path", "island", F.col("id").alias("first")).join(ends, ["path", "island"]).where(f"last >= first and last - first < {most}").select("path", "first", "last", (F.col("last") - F.col("first") + 1).alias("k"))


def los_vector(incidence: Column, heading: Column) -> tuple[Column, Column, Column]:
    """Up, east and north parts of the line of sight; angles in degrees."""
    i, h = F.radians(incidence), F.radians(heading)
    return F.cos(i), F.sin(i) * F.cos(h), -F.sin(i) * F.sin(h)


def decompose(z: DataFrame) -> DataFrame:
    """Up and east rates from two views (d_a, d_b, their unit parts up_a, east_a, ... and sigmas), with deviations.

    The 2 x 2 system is solved in closed form; amplification is the root of the trace of the inverse's square,
    condition the ratio of singular values. A singular pair of views gives nulls.
    """
    a, b, c, d = (F.col(x) for x in ("up_a", "east_a", "up_b", "east_b"))
    det = F.nullif(a * d - b * c, F.lit(0.0))
    s = a * a + b * b + c * c + d * d
    root = F.sqrt(F.greatest(F.lit(0.0), s * s - 4 * det * det))
    va, vb = F.col("sigma_a") * F.col("sigma_a"), F.col("sigma_b") * F.col("sigma_b")
    return z.withColumns({
        "up": (d * F.col("d_a") - b * F.col("d_b")) / det, "east": (a * F.col("d_b") - c * F.col("d_a")) / det,
        "up_sigma": F.sqrt(d * d * va + b * b * vb) / F.abs(det), "east_sigma": F.sqrt(c * c * va + a * a * vb) / F.abs(det),
        "amplification": F.sqrt(s) / F.abs(det), "condition": F.sqrt((s + root) / F.nullif(s - root, F.lit(0.0))),
    })


def north_sweep(z: DataFrame, values: list[float]) -> DataFrame:
    """Decompositions with an assumed north rate taken out of both views (north_a, north_b), for each value."""
    swept = z.withColumn("north", F.explode(F.array(*map(F.lit, values))))
    swept = swept.withColumn("d_a", F.col("d_a") - F.col("north") * F.col("north_a")).withColumn("d_b", F.col("d_b") - F.col("north") * F.col("north_b"))
    return decompose(swept)


def smallest_covering_run(footprints: DataFrame, area: DataFrame, most: int = 15) -> DataFrame:
    """The gap-free run of at most ``most`` footprints of a path that covers all of the area's cells: path, first, last, k, ratio.

    footprints: path, id, cell (also cells outside the area); area: cell. The fewest footprints win, then the least union
    (ratio: cells of the union to those of the area), then path and first. For each cell of the area, the next footprint that
    covers it is known from each start; the farthest of these ends the shortest run from there, which must reach every cell
    and stay in the gap-free island. No row if no run covers the area; an empty area has none.
    """
    cells = area.select("cell").where("cell is not null").distinct()
    f = footprints.select("path", "id", "cell").where("id is not null").distinct()
    ids = f.select("path", "id").distinct()
    by = Window.partitionBy("path").orderBy("id")
    ids = ids.withColumn("island", F.col("id") - F.row_number().over(by))
    ends = ids.groupBy("path", "island").agg(F.min("id").alias("lo"))
    hit = f.join(cells, "cell").join(ids, ["path", "id"])
    before = F.lag("id").over(Window.partitionBy("path", "island", "cell").orderBy("id"))
    hit = hit.join(ends, ["path", "island"]).withColumn("from", F.greatest(F.coalesce(before + 1, F.col("lo")), F.col("id") - most + 1))
    reach = hit.select("path", "cell", F.col("id").alias("last"), F.explode(F.sequence("from", "id")).alias("first"))
    runs = reach.groupBy("path", "first").agg(F.max("last").alias("last"), F.count("*").alias("n"))
    total = cells.agg(F.count("*").alias("cells"))
    runs = runs.join(total, F.col("n") == F.col("cells")).withColumn("k", (F.col("last") - F.col("first") + 1).cast("int")).where(F.col("k") <= most)
    tied = runs.join(runs.agg(F.min("k").alias("k")), "k")
    steps = tied.select("path", "first", "last", "k", "cells", F.explode(F.sequence("first", "last")).alias("id"))
    union = steps.join(f, ["path", "id"]).groupBy("path", "first", "last", "k", "cells").agg(F.count_distinct("cell").alias("u"))
    return union.select("path", "first", "last", "k", (F.col("u") / F.col("cells")).alias("ratio")).orderBy("ratio", "path", "first").limit(1)
