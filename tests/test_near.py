"""Ring searches against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmesh.operators import geo, near


def km(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def test_nearest_stations_anywhere(spark):
    r = random.Random(2)
    where = lambda k: [(r.uniform(-90, 90), r.uniform(-180, 180)), (89.9 - r.random(), r.uniform(-180, 180)), (r.uniform(-1, 1), r.choice([-179.99, 179.99])), (28 + r.random() / 50, 76.5)][k % 4]
    s = [(k, *where(k)) for k in range(120)] + [(200, 28.0, 76.5), (201, 28.0, 76.5), (202, None, 3.0)]
    z = [(k, *where(k)) for k in range(40)] + [(50, 28.0, 76.5), (51, -90.0, 0.0), (52, 1.0, None)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")
    placed = [x for x in s if x[1] is not None]
    for first in (None, 1.0, 50_000.0):
        got = {}
        for x in near.nearest_stations(frame(z), frame(s), 3, first).collect():
            got.setdefault(x["id"], {})[x["rank"]] = x["station"]
        want = {i: dict(enumerate([y[0] for y in sorted(placed, key=lambda y: (round(km((a, b), y[1:]), 9), y[0]))[:3]], 1)) for i, a, b in z if b is not None}
        assert got == want
    got = {(x["id"], x["station"]) for x in near.within_km(frame(z), frame(s), 300.0).collect()}
    assert got == {(i, y[0]) for i, a, b in z if b is not None for y in placed if km((a, b), y[1:]) <= 300}
    few = near.nearest_stations(frame(z[:3]), frame(s[:2]), 3).collect()
    assert len(few) == 6 and near.nearest_stations(frame(z[:3]), frame([(1, None, None)]), 3).collect() == []


def segment(x, y, e):
    (x1, y1), (x2, y2) = e
    n = (x2 - x1) ** 2 + (y2 - y1) ** 2
    u = 0.0 if n == 0 else max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n))
    return math.hypot(x - x1 - u * (x2 - x1), y - y1 - u * (y2 - y1))


def test_distance_to_polygons(spark):
    r = random.Random(4)
    star = lambda cx, cy, n, big: [(cx + (big if k % 2 else big / 3) * math.cos(2 * math.pi * k / n), cy + (big if k % 2 else big / 3) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    rings = {"star": [star(0, 0, 60, 10)], "long": [[(-500.0, 3.0), (500.0, 3.0), (500.0, 3.5), (-500.0, 3.5)]], "hole": [star(40, 40, 8, 9), star(40, 40, 8, 2)], "point": [[(7.0, 7.0), (7.0, 7.0), (7.0, 7.0)]]}
    pts = [(k, r.uniform(-60, 60), r.uniform(-60, 60)) for k in range(80)] + [(100, 0.0, 0.0), (101, 40.0, 40.0), (102, 9000.0, -9000.0), (103, None, 1.0), (104, 7.0, 7.0)]
    got = near.dist_to_polygon(spark.createDataFrame(pts, "id long, x double, y double"), geo.polygon_edges(spark, rings), ["id"])
    rows = {(x["id"], x["poly_id"]): x for x in got.collect()}
    assert len(rows) == 84 * 4
    for i, x, y in pts:
        if x is None:
            continue
        for name, parts in rings.items():
            edges = [e for ring in parts for e in zip(ring, [*ring[1:], ring[0]])]
            inside = sum(((a[1] > y) != (b[1] > y)) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in edges) % 2 == 1
            d = min(segment(x, y, e) for e in edges)
            g = rows[i, name]
            assert math.isclose(g["outline"], d, rel_tol=1e-9, abs_tol=1e-9) and g["inside"] == inside and math.isclose(g["signed"], -d if inside else d, rel_tol=1e-9, abs_tol=1e-9)
    best = {x["id"]: x["poly_id"] for x in near.best_match(got, ["id"]).collect()}
    assert best[101] == "hole" and best[104] == "point"
    assert near.dist_to_polygon(spark.createDataFrame(pts, "id long, x double, y double"), geo.polygon_edges(spark, rings).limit(0), ["id"]).collect() == []


@pytest.mark.parametrize("limits", [(4096, 500_000), (7, 11)])
def test_counts_of_bands_match_brute_force(spark, monkeypatch, limits):
    for n, v in zip(("ZONES", "PLACES"), limits, strict=True):
        monkeypatch.setattr(near, n, v)
    r = np.random.default_rng(5)
    edges = (1, 2.5, 5, 10, 20)
    for lat, lon in ((28.0, 76.0), (0.0, 180.0), (89.95, 0.0), (-89.99, 10.0)):
        wide = 0.6 / max(np.cos(np.radians(lat)), 0.002)
        spots = [(float(max(-90, min(90, lat + y))), float((lon + x + 180) % 360 - 180)) for y, x in zip(r.uniform(-0.3, 0.3, 150), r.uniform(-wide, wide, 150), strict=True)]
        z, s = [(k, *x) for k, x in enumerate(spots[:40])] + [(40, None, 1.0), (41, -lat, lon)], [(k, *x) for k, x in enumerate(spots + spots[:30] + spots[:5])] + [(999, None, None)]
        frame = lambda rows: spark.createDataFrame(rows, "id long, lat double, lon double")
        got = {x["id"]: tuple(x)[1:] for x in near.station_bands(frame(z), frame(s), edges).collect()}
        met = geo.distance_bands(frame(z).crossJoin(frame(s).select(F.col("lat").alias("y"), F.col("lon").alias("x"))).select("id", geo.haversine_km(*map(F.col, ("lat", "lon", "y", "x"))).alias("km")), ["id"], edges)
        want = {x["id"]: tuple(v or 0 for v in tuple(x)[1:]) for x in met.collect()}
        assert got == want and sum(map(sum, want.values())) > 500


def test_bands_meet_the_places_near_their_circles_only(monkeypatch):
    """Of 200,000 places within the last edge, few are measured one by one."""
    r, seen, plain = np.random.default_rng(1), [], near._ranges
    monkeypatch.setattr(near, "_ranges", lambda a, n: seen.append(int(n.sum())) or plain(a, n))
    places = (28 + r.uniform(0, 0.2, 200_000), 76 + r.uniform(0, 0.2, 200_000), np.ones(200_000, np.int64))
    monkeypatch.setattr(near, "TESTED", 50)
    (got,) = near.counts_within((np.array([28.1]), np.array([76.1])), places, (1.0, 2.0, 5.0, 10.0, 20.0))
    assert sum(seen) < 60_000
    assert got.tolist() == [sum(km((28.1, 76.1), x) <= e for x in zip(*places[:2], strict=True)) for e in (1, 2, 5, 10, 20)]
