"""Nearest neighbours by ring search: cells of a grid are widened until the distance found is proved the least.

What is searched lies in cells; a search looks into its own cell and those around it, in one equi-join. What is found no
farther than a cell is wide is proved, for anything nearer would lie in these cells; the rest looks again in cells twice as
wide. So rounds grow with the logarithm of the extent, and no search meets all there is unless it lies that far off.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geo import EARTH_KM, haversine_km, in_polygon
from .lineage import Saved


def _on_sphere(lat: str, lon: str) -> list[Column]:
    """Coordinates on the unit sphere: cells of them know no date line and no poles."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def _cell(axes: list[Column], size: Column | float) -> list[Column]:
    return [F.floor(x / size).alias(n) for x, n in zip(axes, ("_i", "_j", "_k"))]


def _around(df: DataFrame, axes: list[str]) -> DataFrame:
    """Each row once for each cell that touches its own, its own included."""
    for n in axes:
        df = df.withColumn(n, F.explode(F.array(*[F.col(n) + k for k in (-1, 0, 1)])))
    return df


def nearest_stations(zones: DataFrame, stations: DataFrame, k: int, first_km: float | None = None) -> DataFrame:
    """id, station, km, rank: the k nearest stations of each zone (id, lat, lon on both sides); ties to the lesser id.

    Distances are equal if they agree in 9 decimals of a kilometre. ``first_km`` is the width of the first cells; unset, it is
    what would hold about k stations if they were spread evenly over their extent. Zones and stations without a place are left
    out; with fewer stations than k, all are given.
    """
    store = Saved(zones.sparkSession)
    z = zones.where("lat is not null and lon is not null").select("id", "lat", "lon", *[a.alias(n) for a, n in zip(_on_sphere("lat", "lon"), "xyw")])
    s = stations.where("lat is not null and lon is not null").select(F.col("id").alias("station"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), *[a.alias(f"s{n}") for a, n in zip(_on_sphere("lat", "lon"), "xyw")])
    s = store.keep(s)
    if first_km is None:
        n, *box = s.agg(F.count("*"), *[F.max(f"s{a}") - F.min(f"s{a}") for a in "xyw"]).first()
        wide = sorted(b or 0.0 for b in box)
        first_km = max(1e-3, EARTH_KM * math.sqrt(max(wide[1] * wide[2], 1e-12) * k / max(n, 1)))
    size, left, out = min(2.0, first_km / EARTH_KM), store.keep(z), None
    by = Window.partitionBy("id").orderBy(F.round("km", 9), "station")
    while True:
        last = size >= 2.0
        asked = _around(left.select("id", "lat", "lon", *_cell([F.col(a) for a in "xyw"], size)), ["_i", "_j", "_k"])
        met = asked.join(s.select("station", "slat", "slon", *_cell([F.col(f"s{a}") for a in "xyw"], size)), ["_i", "_j", "_k"])
        km = haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
        best = met.select("id", "station", km.alias("km")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        # A chord as long as a cell is wide spans this arc; a little less is taken as proved.
        proved = EARTH_KM * 2 * math.asin(min(1.0, size / 2)) * (1 - 1e-9)
        best = store.keep(best.withColumn("sure", F.lit(last) | ((F.count("*").over(Window.partitionBy("id")) == k) & (F.max("km").over(Window.partitionBy("id")) <= proved))))
        done = best.where("sure").drop("sure")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = store.keep(left.join(done.select("id").distinct(), "id", "left_anti"))
        if left.isEmpty():
            return out
        size *= 2


def within_km(zones: DataFrame, stations: DataFrame, cap_km: float) -> DataFrame:
    """id, station, km of all stations within the cap of a zone (id, lat, lon on both sides), met through cells as wide as it."""
    size = max(1e-9, 2 * math.sin(min(math.pi / 2, cap_km / EARTH_KM / 2)) * (1 + 1e-9))
    z = _around(zones.select("id", "lat", "lon", *_cell(_on_sphere("lat", "lon"), size)), ["_i", "_j", "_k"])
    s = stations.select(F.col("id").alias("station"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), *_cell(_on_sphere("lat", "lon"), size))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon"))
    return z.join(s, ["_i", "_j", "_k"]).select("id", "station", km.alias("km")).where(F.col("km") <= cap_km)


#: Zones and places of a group that are counted together, strips of latitude to the widest band, points tested in one step.
ZONES = 4096
PLACES = 500_000
STRIPS = 128
TESTED = 2_000_000


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of all places of the ranges first, first + 1, ..., of n places each."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def counts_within(zones: tuple[np.ndarray, np.ndarray], places: tuple[np.ndarray, np.ndarray, np.ndarray], edges: tuple[float, ...]) -> np.ndarray:
    """How many stations lie within each edge (km) of each zone. zones: lat, lon; places: lat, lon, stations there.

    Places lie in strips of latitude, by longitude in each. In a strip, what lies within a bound for the part of it that is
    farthest is counted by two searches; what lies between this and the bound for the nearest part is measured. So a zone
    meets the strips and the places near its circles, not all places inside.
    """
    turned = lambda x: np.radians(np.mod(x - zones[1][0] + 180, 360) - 180)
    z_lat, z_lon, p_lat, p_lon = np.radians(zones[0]), turned(zones[1]), np.radians(places[0]), turned(places[1])
    low, high, wide = p_lat.min(), max(edges) / EARTH_KM / STRIPS, 16.0
    strip = np.floor((p_lat - low) / high).astype(np.int64)
    order = np.lexsort((p_lon, strip))
    p_lat, p_lon, many = p_lat[order], p_lon[order], places[2][order].astype(np.float64)
    key, before = strip[order] * wide + p_lon, np.concatenate([[0.0], np.cumsum(many)])
    out = np.zeros((len(z_lat), len(edges)))
    for e, km in enumerate(edges):
        arc = km / EARTH_KM
        most = math.sin(min(arc, math.pi) / 2) ** 2
        first = np.clip(np.floor((z_lat - arc - 1e-9 - low) / high), 0, strip.max() + 1).astype(np.int64)
        last = np.clip(np.floor((z_lat + arc + 1e-9 - low) / high), -1, strip.max()).astype(np.int64)
        for at in range(0, len(z_lat), 1024):
            one = slice(at, at + 1024)
            z, s = _ranges(first[one], np.maximum(last[one] - first[one] + 1, 0))
            z = z + at
            lo, hi = low + s * high - 1e-12, low + (s + 1) * high + 1e-12
            least = np.maximum(0, np.maximum(lo - z_lat[z], z_lat[z] - hi))
            far = np.maximum(np.abs(lo - z_lat[z]), np.abs(hi - z_lat[z]))
            cos_lo, cos_hi = np.maximum(np.cos(lo), 0), np.maximum(np.cos(hi), 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                outer = np.nan_to_num((most - np.sin(least / 2) ** 2) / (np.cos(z_lat[z]) * np.minimum(cos_lo, cos_hi)), nan=1.0)
                inner = np.nan_to_num((most - np.sin(far / 2) ** 2) / (np.cos(z_lat[z]) * np.where((lo < 0) & (hi > 0), 1.0, np.maximum(cos_lo, cos_hi))), nan=-1.0)
            # 1e-9 (6 mm) on the safe side: what the rounding of a bound could misplace is measured.
            reach = 2 * np.arcsin(np.sqrt(np.clip(outer, 0, 1))) + 1e-9
            sure = 2 * np.arcsin(np.sqrt(np.clip(inner, 0, 1))) - 1e-9
            round_ = (z_lon[z] - reach < -math.pi) | (z_lon[z] + reach > math.pi)
            reach, middle = np.where(round_, 4.0, reach), np.where(round_, 0.0, z_lon[z])
            a, d = np.searchsorted(key, s * wide + middle - reach, "left"), np.searchsorted(key, s * wide + middle + reach, "right")
            b, c = np.searchsorted(key, s * wide + middle - sure, "left"), np.searchsorted(key, s * wide + middle + sure, "right")
            none = round_ | (sure <= 0)
            b, c = np.where(none, d, b), np.where(none, d, c)
            out[:, e] += np.bincount(z, before[c] - before[b], len(z_lat))
            z, start, n = np.concatenate([z, z]), np.concatenate([a, c]), np.concatenate([b - a, d - c])
            step = np.cumsum(n) // TESTED
            for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(step)) + 1):
                of, p = _ranges(start[cut], n[cut])
                x = z[cut][of]
                h = np.sin((p_lat[p] - z_lat[x]) / 2) ** 2 + np.cos(z_lat[x]) * np.cos(p_lat[p]) * np.sin((p_lon[p] - z_lon[x]) / 2) ** 2
                out[:, e] += np.bincount(x, many[p] * (2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1))) <= km), len(z_lat))
    return np.rint(out).astype(np.int64)


def station_bands(zones: DataFrame, stations: DataFrame, edges: tuple[float, ...] = (1, 2, 5, 10, 20)) -> DataFrame:
    """Each zone's stations in each distance band: up to the first edge, between edges; zones without any count 0.

    Places go once, with how many stations they have, to the cells (as wide as the last edge) around theirs that have zones;
    counts_within counts there. Zones and places of full cells are dealt to groups of bounded size, whose counts add up.
    """
    names, cell = [f"upto_{b:g}" for b in edges], ["_i", "_j", "_k"]
    edges = tuple(map(float, edges))
    size = max(1e-9, 2 * math.sin(min(math.pi / 2, max(edges) / EARTH_KM / 2)) * (1 + 1e-9))
    parts = lambda most: F.ceil(F.count("*") / most).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = "lat is not null and lon is not null and not isnan(lat) and not isnan(lon)"
    z = zones.where("id is not null").where(place).select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    z = z.select("*", *_cell(_on_sphere("lat", "lon"), size))
    p = stations.where(place).groupBy(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).agg(F.count("*").alias("n"))
    p = _around(p.select("*", *_cell(_on_sphere("lat", "lon"), size)), cell).join(z.groupBy(*cell).agg(parts(ZONES).alias("_zs")), cell)
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    full = p.groupBy(*cell).agg(parts(PLACES).alias("_ps"), F.first("_zs").alias("_zs"))
    z = z.join(full, cell).select("id", "lat", "lon", *cell, dealt("_zs", "id", "lat", "lon").alias("_a"), each("_ps").alias("_b"))
    p = p.join(full.select(*cell, "_ps"), cell).select("lat", "lon", "n", *cell, each("_zs").alias("_a"), dealt("_ps", "lat", "lon").alias("_b"))

    def run(key, a, b):
        n = counts_within((a["lat"].to_numpy(), a["lon"].to_numpy()), (b["lat"].to_numpy(), b["lon"].to_numpy(), b["n"].to_numpy()), edges) if len(a) and len(b) else np.zeros((len(a), len(edges)), np.int64)
        n = np.diff(n, axis=1, prepend=0)
        return pd.DataFrame({"id": a["id"], **{x: n[:, k] for k, x in enumerate(names)}})

    group = [*cell, "_a", "_b"]
    found = z.groupBy(*group).cogroup(p.groupBy(*group)).applyInPandas(run, f"id {dict(zones.dtypes)['id']}, " + ", ".join(f"`{x}` long" for x in names))
    counts = found.groupBy("id").agg(*[F.sum(f"`{x}`").alias(x) for x in names])
    return zones.select("id").join(counts, "id", "left").select("id", *[F.coalesce(f"`{x}`", F.lit(0)).alias(x) for x in names])


def dist_to_polygon(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """key, poly_id, inside, outline, distance and signed distance (negative inside) of each point (x, y) to each polygon.

    edges: poly_id, x1, y1, x2, y2. The nearest edge is found by ring search: an edge lies in the cells that its pieces
    touch, none longer than a cell is wide, so it is in few more cells than it crosses. Points without a place are left out.
    """
    store = Saved(points.sparkSession)
    e = store.keep(edges.select("poly_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]))
    p = points.where("x is not null and y is not null").select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = e.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("p.*")
    lo_x, lo_y, hi_x, hi_y = ends.unionByName(p.select("x", "y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    span = max((hi_x or 0) - (lo_x or 0), (hi_y or 0) - (lo_y or 0), 1e-300)
    n = e.count()
    size = span / max(8, min(4096, int(math.sqrt(n))))
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))))
    # Of an edge that is a point, u is null; greatest and least pass over nulls and give 0 and 1, both its place.
    d = F.sqrt(F.pow(F.col("x") - F.col("x1") - u * dx, 2) + F.pow(F.col("y") - F.col("y1") - u * dy, 2))
    left = store.keep(p.join(e.select("poly_id").distinct(), how="cross") if n else p.withColumn("poly_id", F.lit("")).limit(0))
    out = None
    while True:
        last = size >= span
        at = lambda c, lo: F.floor((F.col(c) - F.lit(lo or 0.0)) / size)  # noqa: B023,E731
        m = F.greatest(F.lit(1), F.ceil(length / size)).cast("int")
        pieces = e.withColumn("m", m).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        for c, (a, b) in {"px": ("x1", "x2"), "py": ("y1", "y2")}.items():
            for k in (0, 1):
                pieces = pieces.withColumn(f"{c}{k}", F.col(a) + (F.col(b) - F.col(a)) * (F.col("t") + k) / F.col("m"))
        span_of = lambda c, lo: F.sequence(F.least(at(f"{c}0", lo), at(f"{c}1", lo)), F.greatest(at(f"{c}0", lo), at(f"{c}1", lo)))  # noqa: B023,E731
        cells = pieces.withColumn("_i", F.explode(span_of("px", lo_x))).withColumn("_j", F.explode(span_of("py", lo_y))).select("poly_id", "x1", "y1", "x2", "y2", "_i", "_j").distinct()
        asked = _around(left.withColumn("_i", at("x", lo_x)).withColumn("_j", at("y", lo_y)), ["_i", "_j"])
        met = asked.join(cells, ["poly_id", "_i", "_j"]).groupBy(*key, "poly_id", "x", "y").agg(F.min(d).alias("outline"))
        met = store.keep(met if last else met.where(F.col("outline") <= size * (1 - 1e-9)))
        out = met if out is None else out.unionByName(met)
        if last:
            break
        left = store.keep(left.join(met.select(*key, "poly_id"), [*key, "poly_id"], "left_anti"))
        if left.isEmpty():
            break
        size *= 2
    inside = in_polygon(p, e, key).withColumn("inside", F.lit(True))
    out = out.join(inside, [*key, "poly_id"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return out.select(*key, "poly_id", "outline", "inside", F.when(F.col("inside"), 0.0).otherwise(F.col("outline")).alias("distance"), F.when(F.col("inside"), -F.col("outline")).otherwise(F.col("outline")).alias("signed"))


def best_match(distances: DataFrame, key: list[str]) -> DataFrame:
    """Each key's nearest polygon: key, poly_id, distance, inside; ties to the lesser poly_id."""
    best = distances.groupBy(*key).agg(F.min(F.struct("distance", "poly_id", "inside")).alias("_b"))
    return best.select(*key, "_b.poly_id", "_b.distance", "_b.inside")
