"""Finishing tables and streams against plain rules."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmesh import streaming
from groundmesh.operators import compare, fields, geo, masks, reports, series


def test_detrend(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(t), float(3 + 2 * t - 0.5 * t * t + r.normal())) for t in range(40)] + [("b", 5.0, 1.0), ("c", 1.0, 2.0), ("c", 3.0, 6.0), ("d", 1.0, None), ("d", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "z string, t double, y double")
    for order in (1, 2):
        got = {(x["z"], x["t"]): x["residual"] for x in reports.detrend(df, ["z"], order=order).collect()}
        t, y = np.array([x[1] for x in rows[:40]]), np.array([x[2] for x in rows[:40]])
        want = y - np.polyval(np.polyfit(t, y, order), t)
        assert [got["a", x] for x in t] == pytest.approx(want.tolist(), abs=1e-8)
        assert got["b", 5.0] == 0 and got["c", 1.0] == pytest.approx(0) and got["d", 1.0] is None


def test_terms_are_found_where_they_stand_alone(spark):
    docs = spark.createDataFrame([(1, "the relative LOS velocity\nthe los velocity here\n"), (2, "It was Ruled Out; 22.6 km"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["line_no"], r["rule"]) for r in reports.pack_audit(docs, {"terms": reports.TERMINOLOGY}).collect())
    assert got == [(1, 2, "relative LOS vs vertical"), (2, 1, "22.6 km2 meaning"), (2, 1, "NO EVIDENCE vs ruled out")]


def test_untraced_quantities(spark):
    docs = spark.createDataFrame([(1, "1,962.4 km2 and 6.66 km² and 7.77 km2"), (2, "7.77 km2, 5.5 m"), (3, None)], "doc_id long, text string")
    values = spark.createDataFrame([(6.66,), (None,)], "value double")
    got = reports.untraced_quantities(docs, values, r"km(?:²|2)", ["1962.4"]).collect()
    assert [tuple(r) for r in got] == [("7.77", 2)]


def test_quantities_are_traced_as_the_sql_writes_them(spark):
    docs = spark.createDataFrame([(1, "7267.6 km2, 7267.7 km2"), (2, "0.2 km2 0.3 km2"), (3, "5.5\x0bkm2 8.5\fkm2")], "doc_id long, text string")
    values = spark.createDataFrame([(7267.65,), (0.25,)], "value double")
    got = reports.untraced_quantities(docs, values, "km2").collect()
    assert sorted(tuple(r) for r in got) == [("0.3", 1), ("7267.7", 1), ("8.5", 1)]


def test_file_sizes_are_rounded_to_even(spark, tmp_path):
    from groundmesh import plans

    day = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(day,)], "o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 2, 104005.0, 0.1, day), (2, 2, 103985.0, 0.0, day)], "l_orderkey long, l_suppkey long, l_extendedprice double, l_tax double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    (got,) = plans.QUERIES["correction_coverage"](spark, str(tmp_path)).collect()
    assert (got["bytes"], got["finite"], got["state"]) == (10400, 0.5, "incomplete area")


def test_colocated_rates_shuffle_no_rows_of_pairs(spark):
    r, day = random.Random(4), datetime.date(2024, 1, 1)
    some = lambda x, p: x if r.random() < p else None
    places = [(k, 28 + r.uniform(0, 0.05), 76 + r.uniform(0, 0.05)) for k in range(25)]
    rows = [(k, day + datetime.timedelta(d), d / 365.25, some(r.gauss(0, 9), 0.9), some(r.choice([0.0, 1.0, 2.5]), 0.2 if k % 3 else 1)) for k in range(25) for d in range(40) if r.random() < 0.8]
    rows += [(0, day, 0.0, 5.0, 1.0), (1, None, 0.0, 5.0, 1.0)]  # a day told twice; none
    stations, obs = spark.createDataFrame(places, "id long, lat double, lon double"), spark.createDataFrame(rows, "station long, date date, t double, y double, sigma double")
    out = compare.colocated_rates(stations, obs, 2.0, 25)
    got = {(x["a"], x["b"]): tuple(x)[3:] for x in out.collect()}
    near = [(x["a"], x["b"]) for x in geo.colocated(stations, 2.0).collect()]
    flat = []
    for a, b in near:
        for _, d, t, ya, sa in (x for x in rows if x[0] == a and x[1]):
            for _, _, _, yb, sb in (x for x in rows if x[0] == b and x[1] == d):
                both = None if sa is None or sb is None else float(np.hypot(sa, sb))
                flat += [(a, b, "a", t, ya, sa), (a, b, "b", t, yb, sb), (a, b, "d", t, None if ya is None or yb is None else ya - yb, both)]
    rates = {(x["a"], x["b"], x["of"]): x for x in series.weighted_rate(spark.createDataFrame(flat, "a long, b long, of string, t double, y double, sigma double"), ["a", "b", "of"]).where("n >= 25").collect()}
    assert {k[:2] for k in rates} == set(got) and len(got) > 30 and len(rates) < 3 * len(got)
    for (a, b), x in got.items():
        one = [rates.get((a, b, k)) for k in "abd"]
        want = [max(y["n"] for y in one if y), *[one[k]["rate"] if one[k] else None for k in (0, 1)], one[2]["rate"] if one[2] else None]
        assert [x[0], x[1], x[2], x[4]] == [None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in want]
        sigma = float(np.hypot(one[0]["rate_sigma"], one[1]["rate_sigma"])) if one[0] and one[1] else None
        assert x[5] == (None if sigma is None else pytest.approx(sigma, rel=1e-9))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_pixel_bootstrap_shuffles_no_draws(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(z, i, n, None if i % 9 == 4 else float(r.normal())) for z, n in ((1, 40), (2, 61), (7, 1)) for i in range(n)]
    px = spark.createDataFrame(rows, "zone int, i int, n long, x double").repartition(3)
    draws = px.select("zone", "n", F.col("i").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("rep")).withColumn("i", F.pmod(F.xxhash64("zone", "rep", "k", F.lit(3)), "n"))
    m = draws.join(px.select("zone", "i", "x"), ["zone", "i"]).groupBy("zone", "rep").agg(F.percentile("x", F.lit(0.5)).alias("m"))
    want = {x["zone"]: tuple(x)[1:] for x in m.groupBy("zone").agg(F.percentile("m", F.lit(0.025)), F.percentile("m", F.lit(0.975))).collect()}
    for most in (2_000_000, 50):
        monkeypatch.setattr(fields, "ARRAY_CELLS", most)
        out = fields.pixel_bootstrap(px, "x", 60)
        assert {x["zone"]: tuple(x)[1:] for x in out.collect()} == {k: tuple(map(pytest.approx, v)) for k, v in want.items()}


def test_reference_choice(spark):
    r = random.Random(3)
    rows = [(i, j, r.choice([0.9, 0.96, 1.0]), 1000.0 * r.randint(0, 5), r.random(), r.uniform(-4, 4), r.random(), r.choice([0.0, 0.0, 0.1, None])) for i in range(9) for j in range(9)]
    schema = "row int, col int, support double, edge_m double, std double, velocity double, coherence double, water double"
    limit = np.percentile([x[4] for x in rows], 25)
    hard = [x for x in rows if x[2] >= 0.95 and x[3] >= 2000 and x[4] <= limit and x[7] == 0]
    for most_v in (2.0, 0.0):  # the second leaves nothing, so the gate is relaxed
        pool = sorted((x for x in hard if abs(x[5]) <= most_v), key=lambda x: -x[6]) or sorted(hard, key=lambda x: abs(x[5]))
        want = []
        for x in pool:
            if len(want) < 3 and all(np.hypot(x[0] - a, x[1] - b) >= 2.5 for a, b in want):
                want.append((x[0], x[1]))
        got = compare.select_references(spark.createDataFrame(rows, schema), distance=2.5, most=3, most_v=most_v).collect()
        assert [(g["row"], g["col"]) for g in sorted(got, key=lambda g: -g["score"])] == want and all(g["relaxed"] == (most_v == 0) for g in got)


def test_provenance_and_placement(spark):
    p = spark.createDataFrame([("a_era5.h5", "raw.h5"), ("b.h5", "run_era5.h5"), ("c.h5", None)], "file string, source string")
    assert [r["file"] for r in masks.resolve_by_provenance(p, "era5.h5").collect()] == ["b.h5"]
    px = spark.createDataFrame([(1, 0, 0, 2.0, 60.0), (1, 0, 2, 4.0, 60.0)], "z int, row int, col int, velocity double, incidence double")
    got = reports.zone_placement(px, ["z"], 100.0, 500.0, 10.0, (0.0, 4.0)).first()
    assert tuple(got) == (1, 115.0, 495.0, 0.03, 60.0, pytest.approx(6.0))


def test_mean_incidence_does_not_hang_on_order(spark):
    r = random.Random(5)
    zones = {z: [30 + r.randrange(1000) / 10 for _ in range(200)] for z in range(20)}
    zones |= {20: [-3.3, 0.1, 0.2, 3e-9], 21: [2e6, 0.5], 22: [float("nan"), 1.0], 23: [float("inf"), 1.0], 24: [None], 25: [0.7, None, 0.1, 0.1]}
    px = spark.createDataFrame([(z, 0, 0, 2.0, x) for z, xs in zones.items() for x in xs], "z int, row int, col int, velocity double, incidence double")
    told = {z: [x for x in xs if x is not None] for z, xs in zones.items()}
    want = {z: math.fsum(xs) / len(xs) if xs else None for z, xs in told.items() if z != 22}
    for parts in (1, 3, 7):
        got = {x["z"]: x["incidence"] for x in reports.zone_placement(px.repartition(parts), ["z"], 0.0, 0.0, 1.0, (0.0, 0.0)).collect()}
        assert math.isnan(got.pop(22)) and got == want


def test_placement_is_rounded_as_the_sql_rounds(spark, tmp_path):
    from groundmesh import plans

    cells = [(row, col) for row in range(6, 95) for col in range(5, 14) if (row + col) % 17][:640]
    spark.createDataFrame([(col, row, 0, 0, 1.0, 65000.0, 0.0, 0.0) for row, col in cells], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    (got,) = plans.QUERIES["zone_placement"](spark, str(tmp_path)).collect()
    assert math.fsum(30 + col / 10 for _, col in cells) / 640 == 30.900468749999998  # times 1e7 it ends in .5
    assert got["label"] == 6005 and got["incidence"] == 30.9004688


def test_nearest_of_unconnected(spark):
    day = lambda k: datetime.date(2020, 1, 1) + datetime.timedelta(k)
    nodes = spark.createDataFrame([("n", day(k)) for k in (0, 5, 9, 300, 2000)], "network_id string, node date")
    edges = spark.createDataFrame([("n", day(0), day(5))], "network_id string, src date, dst date")
    got = {r["node"]: ([(x["days"], x["node"]) for x in r["nearest"]], r["reason"]) for r in reports.unconnected_nodes(nodes, edges).collect()}
    assert got[day(9)] == ([(4, day(5)), (9, day(0)), (291, day(300))], "no common pair") and got[day(2000)][1] == "no date within 120 days" and len(got) == 3


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    return q


def test_two_streams_meet_and_late_readings_are_left_out(spark, tmp_path):
    stamp = lambda day, hour=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=hour)
    write = lambda rows, schema, where, k: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{where}/{k}")
    schema, eschema = "station long, ts timestamp, value double", "epoch timestamp"
    batches = [([(1, stamp(d, 6), float(d)) for d in range(0, 12)], [(stamp(5),)]), ([(1, stamp(d, 6), float(d)) for d in range(12, 30)] + [(1, stamp(2, 1), 1000.0)], [(stamp(20),)]), ([(1, stamp(3, 1), 999.0), (1, stamp(60), 0.0)], [(stamp(60),)])]
    for where, s in (("o", schema), ("e", eschema)):
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{where}/none")
    read = lambda where, s: spark.readStream.schema(s).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{where}")
    q = _run(streaming.epoch_match_streams(read("o", schema), read("e", eschema)), "matches")
    w = _run(streaming.sliding_medians(read("o", schema)), "slides")
    try:
        for k, (obs, epochs) in enumerate(batches):
            write(obs, schema, "o", k)
            write(epochs, eschema, "e", k)
            q.processAllAvailable()
            w.processAllAvailable()
    finally:
        q.stop()
        w.stop()
    got = {str(r["epoch"]): (r["n"], r["median"]) for r in spark.table("matches").collect()}
    # Readings of days 2 .. 8 and 17 .. 23; both stragglers come after the watermark has passed them.
    assert got["2024-01-06"] == (7, 5.0) and got["2024-01-21"] == (7, 20.0)
    slides = {str(r["start"]): r["median"] for r in spark.table("slides").collect()}
    assert slides["2024-01-01 00:00:00"] == 3.0 and slides["2024-01-11 00:00:00"] == 13.0


def test_upserts_survive_a_lost_and_repeated_batch(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "job_id long, status string, ts long")
    run = streaming.upsert_sink(f"{tmp_path}/jobs", ["job_id"])
    run(frame([(1, "new", 1), (2, "new", 1)]), 0)
    run(frame([(1, "done", 5)]), 2)  # batch 1 was empty and never came
    again = streaming.upsert_sink(f"{tmp_path}/jobs", ["job_id"])
    again(frame([(1, "done", 5)]), 2)
    again(frame([(2, "old", 0), (3, "new", 7)]), 3)
    got = sorted((r["job_id"], r["status"]) for r in spark.read.parquet(again.last).collect())
    assert got == [(1, "done"), (2, "new"), (3, "new")]
