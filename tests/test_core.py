"""Known answers for the network, zone, series and gate operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmesh import sources, streaming
from groundmesh.operators import gates, geo, graph, masks, near, pairs, series, stats, tiled, zones


@pytest.fixture(scope="module")
def net(spark):
    e = [("a", 1, 2), ("a", 2, 3), ("a", 1, 3), ("a", 3, 4), ("a", 4, 5), ("b", 1, 2)]
    edges = spark.createDataFrame(e, "network_id string, src int, dst int")
    nodes = spark.createDataFrame([("a", i) for i in range(1, 7)] + [("b", 1), ("b", 2)], "network_id string, node int")
    return nodes, edges


def test_graph(net):
    nodes, edges = net
    comp = {(r[0], r[1]): r[2] for r in graph.connected_components(nodes, edges).collect()}
    assert comp[("a", 5)] == 1 and comp[("a", 6)] == 6 and comp[("b", 2)] == 1
    assert sorted(tuple(r) for r in graph.bridges(nodes, edges).collect()) == [("a", 3, 4), ("a", 4, 5), ("b", 1, 2)]
    assert sorted(tuple(r) for r in graph.cut_vertices(nodes, edges).collect()) == [("a", 3), ("a", 4)]
    assert [tuple(r) for r in graph.isolates(nodes, edges).collect()] == [("a", 6)]
    assert sorted(tuple(r) for r in graph.k_core_prune(nodes, edges, 2).collect()) == [("a", 1), ("a", 2), ("a", 3)]


def test_repair_mends_bridges_and_gives_the_verdict(spark):
    day = lambda i: f"2020-01-{i:02d}"
    four = lambda k: [(k + a, k + b) for a in range(4) for b in range(a + 1, 4)]
    e = [("a", x, y) for x, y in [*four(1), *four(5), (4, 5)]] + [("b", x, y) for x, y in [(1, 2), (2, 3), (1, 3)]]
    frame = lambda rows: spark.createDataFrame([(n, day(x), day(y), 1.0) for n, x, y in rows], "network_id string, src string, dst string, score double").selectExpr("network_id", "date(src) as src", "date(dst) as dst", "score")
    kept = frame(e)
    nodes = kept.select("network_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    got = graph.repair_network(nodes, kept, frame([("a", 1, 5), ("a", 4, 6), ("a", 3, 6)])).collect()
    assert sorted((r["network_id"], str(r["src"]), str(r["dst"]), r["round"], r["accepted"]) for r in got) == [("a", day(3), day(6), 1, True), ("b", "None", "None", 0, False)]


def test_candidate_pairs_match_brute_force(spark):
    rng = np.random.default_rng(1)
    days = sorted(rng.choice(400, 60, replace=False).tolist())
    acq = spark.createDataFrame([("x", d, float(rng.normal(0, 200))) for d in days], "burst string, d int, perp double").withColumn("date", F.date_add(F.lit("2020-01-01"), F.col("d")))
    rows = acq.collect()
    got = {(str(r["ref"]), str(r["sec"])) for r in pairs.candidate_pairs(acq).collect()}
    want = {(str(a["date"]), str(b["date"])) for a in rows for b in rows if a["date"] < b["date"] and (b["date"] - a["date"]).days <= 36 and abs(b["perp"] - a["perp"]) <= 250}
    assert got == want


def test_labels_join_across_tile_corners(spark):
    cells = [(127, 127), (128, 128), (128, 129), (10, 10), (10, 11), (300, 5)]
    px = spark.createDataFrame(cells, "row int, col int")
    got = {(r["row"], r["col"]): r["label"] for r in zones.label_components(px, 2).collect()}
    assert got[(127, 127)] == got[(128, 129)] == 127127 and got[(10, 11)] == 10010 and (300, 5) not in got


def test_labels_of_wide_grids_do_not_collide(spark):
    px = spark.createDataFrame([(3, 1005), (4, 5), (4, 6), (3, 2900)], "row int, col int")
    got = {(r["row"], r["col"]): r["label"] for r in zones.label_components(px, 1).collect()}
    assert len(set(got.values())) == 3 and got[(4, 5)] == got[(4, 6)]


def test_random_masks_label_alike_in_small_and_large_tiles(spark):
    rng = np.random.default_rng(2)
    px = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((40, 40)) < 0.4), strict=True)], "row int, col int")
    a = sorted(tuple(r) for r in zones.label_components(px, 1, tile=8).select("row", "col", "label").collect())
    b = sorted(tuple(r) for r in zones.label_components(px, 1, tile=64).select("row", "col", "label").collect())
    assert a == b


def test_tiers_and_missing_values(spark):
    df = spark.createDataFrame([(0.95, True), (0.85, True), (0.75, True), (0.5, True), (0.99, False)], "c double, land boolean")
    assert [r[0] for r in df.select(masks.quality_tier(F.col("c"), F.col("land"))).collect()] == [1, 2, 3, 4, 0]
    m = masks.null_missing(spark.createDataFrame([(float("nan"), 0.0, -9999.0), (1.0, 2.0, 3.0)], "a double, b double, c double"), ["a"], ["b"], {"c": -9999.0}).collect()
    assert tuple(m[0]) == (None, None, None) and tuple(m[1]) == (1.0, 2.0, 3.0)


def test_series_fits_recover_their_parts(spark):
    t = np.arange(64) * 12 / 365.25
    rows = [("lin", i, float(x), 3 + 5 * float(x)) for i, x in enumerate(t)]
    rows += [("sea", i, float(x), 2 * float(x) + 4 * math.sin(2 * math.pi * x)) for i, x in enumerate(t)]
    rows += [("stp", i, float(x), 1 * float(x) + (7.0 if i >= 30 else 0.0)) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "s string, i int, t double, y double")
    lin = {r["s"]: r for r in series.linear_rate(df, ["s"]).collect()}
    assert abs(lin["lin"]["rate"] - 5) < 1e-9 and lin["lin"]["rms"] < 1e-6
    sea = {r["s"]: r for r in series.seasonal_fit(df, ["s"]).collect()}
    assert abs(sea["sea"]["annual"] - 4) < 1e-6 and abs(sea["sea"]["rate"] - 2) < 1e-6
    stp = {r["s"]: r for r in series.step_fit(df, ["s"]).collect()}
    assert stp["stp"]["index"] == 30 and abs(stp["stp"]["step"] - 7) < 1e-6 and stp["stp"]["rms"] < 1e-6
    ts = {r["s"]: r for r in series.theil_sen(df, ["s"]).collect()}
    assert abs(ts["lin"]["slope"] - 5) < 1e-9 and abs(ts["lin"]["intercept"] - 3) < 1e-9
    w = series.weighted_rate(df.withColumn("sigma", F.lit(2.0)), ["s"]).where("s = 'lin'").first()
    assert abs(w["rate"] - 5) < 1e-9


def test_constant_field_has_no_highpass_noise(spark):
    px = spark.createDataFrame([(r, c, 4.0) for r in range(10) for c in range(10) if (r + c) % 7], "row int, col int, v double")
    assert tiled.highpass_box(px, "v", 10, 10).first()["sigma"] == pytest.approx(0, abs=1e-12)


def test_contrasts_do_not_depend_on_the_reference(spark):
    px = spark.createDataFrame([(i, float(i % 7), i < 20) for i in range(100)], "i int, v double, inside boolean").withColumn("g", F.lit(1))
    f = lambda d: stats.matched_contrast(d, ["g"], F.col("inside"), F.lit(1), "v").first()["contrast"]
    assert f(px) == pytest.approx(f(px.withColumn("v", F.col("v") + 11.5)))


def test_geometry(spark):
    s = spark.createDataFrame([(28.5, 77.0), (0.0, 75.0), (60.0, 73.2)], "lat double, lon double")
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), 43)
    lat, lon = geo.to_lonlat(F.col("e"), F.col("n"), 43)
    for r in s.withColumn("e", e).withColumn("n", n).select("*", lat.alias("a"), lon.alias("b")).collect():
        assert abs(r["lat"] - r["a"]) < 1e-8 and abs(r["lon"] - r["b"]) < 1e-8
    square = geo.polygon_edges(spark, {"p": [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]]})
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 11.0, 5.0)], "id int, x double, y double")
    assert [r["id"] for r in geo.in_polygon(pts, square, ["id"]).collect()] == [1]
    d = {r["id"]: r["distance"] for r in near.dist_to_polygon(pts, square, ["id"]).collect()}
    assert d == {1: 0.0, 2: 1.0, 3: 1.0}


def test_fdr_and_fingerprint(spark):
    tests = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.001, 0.02, 0.03, None, 0.9])], "fam string, i int, p double")
    assert sorted(r["i"] for r in stats.bh_fdr(tests, ["fam"], "p", 0.05).where("rejected").collect()) == [0, 1, 2]
    df = spark.createDataFrame([(i, str(i)) for i in range(500)], "a int, b string")
    one, two = gates.table_fingerprint(df).first(), gates.table_fingerprint(df.repartition(7)).first()
    assert one == two and one["rows"] == 500
    assert gates.table_fingerprint(df.withColumn("b", F.lit("x"))).first() != one


def test_sources(spark, tmp_path):
    (tmp_path / "s.tenv").write_text("site YYMMMDD yyyy.yyyy ____up(m) sig_u(m)\nABCD 23SEP10 2023.69 0.01 0.002\nABCD 23SEP11 2023.70 bad 0.003\n")
    rows = sources.read_station_series(spark, f"{tmp_path}/s.tenv").orderBy("date").collect()
    assert [(str(r["date"]), r["up_m"]) for r in rows] == [("2023-09-10", 0.01), ("2023-09-11", None)]
    (tmp_path / "t.csv").write_text("Station,Data Acquisition Time,Level\nw1,05-03-2022 06:00,1.5\nw1,bad,x\n")
    t = sources.read_telemetry(spark, f"{tmp_path}/t.csv", "north").collect()
    assert t[0]["value"] == 1.5 and str(t[0]["ts"]) == "2022-03-05 06:00:00" and t[1]["ts"] is None and t[1]["value"] is None
    (tmp_path / "a.json").write_text('{"features":[{"properties":{"id":"z"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]]]}}]}')
    assert sources.read_polygons(spark, f"{tmp_path}/a.json").count() == 4
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    (tmp_path / "k.csv").write_text("k,v\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="repeats"):
        sources.read_table(spark, f"{tmp_path}/k.csv", schema, ["k"])


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "cat.txt").write_text("AAAA 28.0 77.0 1\nBBBB 28.1 437.0\nCCCC x 77\nDDDD 50.0 10.0 5\n")
    cat = {r["station"]: r["lon"] for r in sources.read_catalogue(spark, f"{tmp_path}/cat.txt", 28.0, 77.0, 50.0).collect()}
    assert set(cat) == {"AAAA", "BBBB"} and cat["BBBB"] == pytest.approx(77.0)
    text = spark.createDataFrame([("1 Old Fort 28.61 77.24 12.50 Dug Well",), ("2 Far 10.00 70.00 3.10 tube",), ("no row",), (None,)], "value string")
    assert [tuple(r) for r in sources.extract_station_rows(text, (28, 76, 29, 78)).collect()] == [("Old Fort", 28.61, 77.24, 12.5, "dug")]
    item = '{"GranuleUR":"g1","Platforms":[{"ShortName":"S1"}],"RelatedUrls":[{"URL":"a.xml"},{"URL":"a.tiff"}],"AdditionalAttributes":[{"Name":"PATH","Values":["27"]}]}'
    flat = sources.flatten_catalogue(spark.createDataFrame([(item,), ("{}",)], "json string"), ["PATH", "FRAME"]).collect()
    assert tuple(flat[0]) == ("g1", "S1", "a.tiff", "27", None) and tuple(flat[1]) == (None,) * 5
    px = spark.createDataFrame([(s, r, c, float(r * c)) for s in ("a", "b") for r in range(6) for c in range(6)], "stack string, row int, col int, v double")
    sources.write_table(px, f"{tmp_path}/cube", by=["stack"])
    scan = sources.scan_pixels(spark, f"{tmp_path}/cube", "a", (1, 2), (3, 4), ["v"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == 4 and "PartitionFilters: [isnotnull(stack" in plan and "GreaterThanOrEqual(row,1)" in plan
    with pytest.raises(Exception, match="(?i)exist"):
        sources.write_table(px, f"{tmp_path}/cube")
    for k in (1, 2):
        sources.append_ledger(spark.createDataFrame([(k,)], "job int"), f"{tmp_path}/ledger")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/ledger").collect()) == [1, 2]
    (tmp_path / "grb").mkdir()
    (tmp_path / "grb" / "e_20230910_06.grb").write_bytes(b"x" * 2000)
    (tmp_path / "grb" / "e_20230911_06.grb").write_bytes(b"x")
    assert [(str(r["date"]), r["hour"]) for r in sources.files_to_dates(spark, f"{tmp_path}/grb").collect()] == [("2023-09-10", 6)]
    got = masks.resolve_by_provenance(spark.createDataFrame([("x_b.tif", "run/a"), ("y_a.tif", "run/b")], "name string, source string"), "/a").collect()
    assert [r["name"] for r in got] == ["x_b.tif"]


def test_monthly_climate(spark):
    days = spark.createDataFrame([(f"{y}-{m:02d}-15", 0.001 * (m + y - 2020)) for y in (2020, 2021, 2022) for m in range(1, 13)], "d string, m_per_day double").withColumn("ts", F.to_timestamp("d"))
    months = sources.monthly_series(days, "2020-01-01", "2021-12-31")
    assert months.count() == 24
    first = {r["month_of_year"]: r for r in sources.climatology(months).collect()}
    assert first[1]["n"] == 2 and first[1]["mean_mm"] == pytest.approx(31 * 1.5)
    even = spark.createDataFrame([(f"{y}-{m:02d}-01", float(12 * y + m)) for y in (2020, 2021) for m in range(1, 13)], "d string, mm double").withColumn("month", F.to_date("d"))
    assert sources.yearly_trend(even).first()["mm_per_year"] == pytest.approx(12.0)


def test_polygon_bands_match_brute_force(spark):
    rng = np.random.default_rng(4)
    turn = np.sort(rng.uniform(0, 2 * math.pi, 700))
    far = rng.uniform(3, 10, 700)
    ring = [(float(r * math.cos(a)), float(r * math.sin(a))) for r, a in zip(far, turn, strict=True)]
    hole = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-12, 12, (800, 2)))] + [(800, 0.0, 0.0), (801, 0.0, 50.0)]
    want = set()
    for i, x, y in pts:
        ends = [e for r in (ring, hole) for e in zip(r, r[1:] + r[:1], strict=True)]
        if sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for (a, b), (c, d) in ends) % 2:
            want.add(i)
    points = spark.createDataFrame(pts, "id int, x double, y double")
    assert {r["id"] for r in geo.in_polygon(points, geo.polygon_edges(spark, {"p": [ring, hole]}), ["id"]).collect()} == want
    text = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")"
    wkt = spark.createDataFrame([("p", f"POLYGON ({text(ring)}, {text(hole)})"), ("q", "POINT (1 2)"), ("r", None)], "id string, wkt string")
    assert {r["id"] for r in geo.in_polygon(points, sources.polygons_from_wkt(wkt, "id"), ["id"]).collect()} == want
    assert geo.in_polygon(points, geo.polygon_edges(spark, {}), ["id"]).count() == 0


def test_trend_table(spark):
    df = spark.createDataFrame([("a", float(t), 2.0 * t if t < 10 else 20 + 5.0 * (t - 10)) for t in range(20)] + [("b", 1.0, 1.0)], "k string, t double, y double")
    got = {r["k"]: r for r in series.trend_table(df, ["k"], per=1.0).collect()}
    assert (got["a"]["n"], got["a"]["first"], got["a"]["second"]) == (20, pytest.approx(2), pytest.approx(5)) and got["b"]["full"] is None


def test_sensor_health_stream_counts_in_time_order(spark, tmp_path):
    rows = [[(1, 0, 0.0), (1, 5, 2.0), (2, 1, 1.0)], [(1, 3, 0.0), (1, 30, 2.0)], [(1, 200, 9.0), (2, 201, 1.0)]]
    schema = "station long, ts timestamp, value double"
    for i, part in enumerate(rows):
        frame = spark.createDataFrame([(s, h, v) for s, h, v in part], "station long, h int, value double")
        frame.select("station", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r["station"]] = r

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.sensor_health(stream, "3 days").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert (seen[1]["n"], seen[1]["zero_fraction"], seen[1]["constant_fraction"]) == (4, 0.5, 0.5) and seen[1]["max_gap_days"] == pytest.approx(25 / 24)
    assert (seen[2]["n"], seen[2]["max_gap_days"]) == (1, 0.0)


def test_daily_stream_equals_its_batch_twin(spark, tmp_path):
    obs = spark.createDataFrame([("p", s, f"2024-01-{d:02d} {h:02d}:00:00", float(s + d + h)) for s in (1, 2) for d in range(1, 8) for h in (1, 9, 17)], "producer string, station long, t string, value double").select("producer", "station", F.to_timestamp("t").alias("ts"), "value")
    obs.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = streaming.daily_medians(spark.readStream.schema(obs.schema).parquet(f"{tmp_path}/in"))
    q.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in series.daily_series(obs, ["producer", "station"]).collect()}
    assert got <= want and {r for r in want if str(r[2]) <= "2024-01-05"} <= got


def test_queries_import_without_the_document_operators():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_colocated_stations_match_brute_force_at_any_latitude(spark):
    rng = np.random.default_rng(6)
    # At 60 degrees, across the date line, and where the columns round the pole are few.
    places = [(60, 10.0, 0.2), (28.5, 76.5, 0.1), (-60, 180.0, 0.1)]
    for block in (places, [*places, (89.99, 0.0, 400.0)]):
        rows = [(k * 200 + i, float(lat + rng.uniform(-0.009, 0.009)), float((lon + rng.uniform(-wide, wide) + 180) % 360 - 180)) for k, (lat, lon, wide) in enumerate(block) for i in range(120)]
        got = {(r["a"], r["b"]) for r in geo.colocated(spark.createDataFrame(rows, "id long, lat double, lon double"), 2.0).collect()}
        ids, lat, lon = np.array([r[0] for r in rows]), *(np.radians([r[k] for r in rows]) for k in (1, 2))
        h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
        x, y = np.nonzero((2 * geo.EARTH_KM * np.arcsin(np.sqrt(h)) <= 2.0) & (ids[:, None] < ids))
        assert got == {(int(ids[i]), int(ids[j])) for i, j in zip(x, y, strict=True)}


def test_low_links_match_brute_force():
    import random

    import numpy as np

    def parts(n, ends, gone=None):
        label = list(range(n))
        for u, v in ends:
            if gone not in (u, v):
                old, new = label[u], label[v]
                label = [new if x == old else x for x in label]
        return len({x for k, x in enumerate(label) if k != gone})

    r = random.Random(6)
    for _ in range(200):
        n = r.randint(1, 9)
        ends = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, 12)) if n > 1})
        whole, cut, split = graph.low_links(n, np.array(ends, dtype=np.int64).reshape(-1, 2))
        assert whole == parts(n, ends)
        assert sorted(cut) == [k for k in range(len(ends)) if parts(n, ends[:k] + ends[k + 1 :]) > whole]
        alone = {k for k in range(n) if not any(k in e for e in ends)}
        assert split == {k for k in range(n) if k not in alone and parts(n, ends, k) > whole}


def test_connect_and_debridge(spark):
    import datetime

    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(12 * k)
    nodes = spark.createDataFrame([("a", day(k)) for k in range(5)], "network_id string, node date")
    edges = spark.createDataFrame([("a", day(0), day(1)), ("a", day(1), day(2)), ("a", day(3), day(4))], "network_id string, src date, dst date")
    every = [("a", day(i), day(j), 12 * (j - i)) for i in range(5) for j in range(i + 1, 5)]
    got = graph.connect_and_debridge(nodes, edges, spark.createDataFrame(every, "network_id string, src date, dst date, days int"), base_days=0).orderBy("step").collect()
    assert (got[0]["src"], got[0]["dst"], got[0]["role"]) == (day(2), day(3), "connect_components")
    # One pair from end to end makes the chain a ring: no bridge and no cut vertex is left.
    assert (got[1]["src"], got[1]["dst"], got[1]["role"], got[1]["bridges_left"], got[1]["cut_vertices_left"]) == (day(0), day(4), "remove_bridge", 0, 0) and len(got) == 2


def test_grades_and_forms(spark):
    from groundmesh.operators import masks

    z = spark.createDataFrame([(12, 0.85, -10.0, -11.9), (12, 0.84, -10.0, -10.0), (9, 0.1, 10.0, 99.0), (8, 0.9, 50.0, 50.0), (14, 0.9, 9.9, 9.9)], "survived int, coherence_median double, median double, series_rate double")
    assert [r["grade"] for r in masks.evidence_grade(z).collect()] == ["A", "B", "B", "C", "C"]
    f = spark.createDataFrame([(1.0, 0.79, 3.1, 9.0, 1.0), (1.0, 0.81, 9.0, 3.1, 2.9), (1.0, 1.0, 0.0, 3.1, 10.0), (1.0, 1.0, 0.0, 2.9, 10.0)], "rms_linear double, rms_step double, step double, annual double, rate double")
    assert [r["form"] for r in masks.temporal_form(f).collect()] == ["episodic_offset", "seasonal_dominated", "linear_with_seasonal", "approximately_linear"]
