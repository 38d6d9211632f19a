"""Slopes, picks, permutations, covering runs and fingerprint trees against their plain rules."""

import itertools
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundmesh.operators import fields, gates, geo, pairs, series, stats


def plain_slope(t, y):
    s = [(y[j] - y[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[i] < t[j]]
    return float(np.median(s)) if s else None


@pytest.mark.parametrize("few", [1_000_000, 40, 3])
def test_median_slope(few):
    r = np.random.default_rng(few)
    for k in range(60):
        n = int(r.integers(0, 60))
        t = r.integers(0, 12, n).astype(float) if k % 3 == 0 else r.random(n) * 10
        y = r.integers(0, 4, n).astype(float) if k % 4 == 0 else r.normal(0, 3, n) + 2 * t if k % 4 < 3 else np.where(r.random(n) < 0.5, 100.0, 0.0) + t
        want, got = plain_slope(t, y), series.median_slope(t, y, few)
        assert (got is None and want is None) or got == pytest.approx(want, rel=1e-9, abs=1e-9), (k, n)


def test_a_long_series():
    r = np.random.default_rng(3)
    t = np.sort(r.random(200_000)) * 1000
    y = 0.37 * t + r.standard_t(2, 200_000)
    began = time.time()
    slope = series.median_slope(t, y)
    assert slope == pytest.approx(0.37, abs=1e-4) and time.time() - began < 120
    under = series._inversions(np.argsort(np.lexsort((t, y - np.nextafter(slope, 9) * t))))
    assert abs(under - 200_000 * 199_999 // 4) <= 200_000 * 199_999 * 1e-9 + 2  # as many slopes below as above


def test_inversions_and_swapped():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 33, 64):
        p = r.sample(range(n), n)
        want = {(a, b) for a, b in itertools.combinations(range(n), 2) if p[a] > p[b]}
        assert series._inversions(np.array(p, dtype=np.int64)) == len(want)
        i, j = series._swapped(np.arange(n), np.argsort(np.array(p, dtype=np.int64)))
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


def test_picks_are_never_used_twice(spark):
    d = lambda s: pd.Timestamp(s).date()
    rows = [(d("2024-07-01"), d("2024-07-13"), 12, 1.0), (d("2024-07-02"), d("2024-07-14"), 12, 2.0), (d("2025-02-01"), d("2025-02-25"), 24, 3.0), (d("2025-01-03"), d("2025-01-27"), 24, 4.0), (d("2025-03-01"), d("2025-03-20"), 19, 5.0)]
    got = {r["pick"]: (r["ref"], r["water_mask"]) for r in pairs.pilot_picks(spark.createDataFrame(rows, "ref date, sec date, days int, max_perp double")).collect()}
    # 1 takes the least of the monsoon, so 4 takes the next; 2 takes place 2 div 2; no pair of 36 days; 5 and 6 in turn.
    assert got == {1: (rows[0][0], True), 2: (rows[3][0], True), 4: (rows[1][0], True), 5: (rows[2][0], True), 6: (rows[4][0], True), 7: (rows[0][0], False)}
    assert pairs.pilot_picks(spark.createDataFrame([], "ref date, sec date, days int, max_perp double")).collect() == []


def test_permuted_blocks_of_days(spark):
    r = random.Random(2)
    days = sorted(r.sample(range(100), 24))
    rows = [("x", k, r.gauss(0, 1) + k / 30, r.gauss(0, 1) + k / 40) for k in days]
    got = stats.block_permutation(spark.createDataFrame(rows, "s string, i int, a double, b double"), ["s"], reps=4000, block_days=20, least=10).first()
    rank = lambda v: pd.Series(v).rank().to_numpy()
    a, b = rank([x[2] for x in rows]), rank([x[3] for x in rows])
    number = [(k - days[0]) // 20 for k in days]
    blocks = [[i for i, m in enumerate(number) if m == k] for k in sorted(set(number))]
    rho = np.corrcoef(a, b)[0, 1]
    all_ = [abs(np.corrcoef(a[[i for k in o for i in blocks[k]]], b)[0, 1]) >= abs(rho) - 1e-12 for o in itertools.permutations(range(len(blocks)))]
    assert got["spearman"] == pytest.approx(rho) and abs(got["p"] - np.mean(all_)) < 4 * math.sqrt(0.25 / 4000) and len(blocks) == 5
    turned = stats.block_permutation(spark.createDataFrame(rows, "s string, i int, a double, b double"), ["s"], reps=500, block_days=20, circular=True, least=10).first()
    assert turned["reps"] == 500 and 0 < turned["p"] <= 1


def test_smallest_covering_run(spark):
    r = random.Random(5)
    for _ in range(4):
        feet = {(p, i): set(range(s := r.randint(0, 30), s + r.randint(1, 14))) for p in range(3) for i in r.sample(range(12), 9)}
        area = set(range(12, 24))
        best = None
        for (p, i), _ in feet.items():
            for k in range(1, 7):
                run = [feet.get((p, i + j)) for j in range(k)]
                if None not in run and area <= (u := set().union(*run)):
                    best = min(best or (99,), (k, len(u) / len(area), p, i))
        rows = [(p, i, c) for (p, i), cs in feet.items() for c in cs]
        got = geo.smallest_covering_run(spark.createDataFrame(rows, "path int, id int, cell int"), spark.createDataFrame([(c,) for c in area], "cell int"), 6).collect()
        assert [(x["k"], x["ratio"], x["path"], x["first"]) for x in got] == ([best] if best else [])


def test_fingerprint_tree(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7 % 11).alias("v"))
    tree = gates.fingerprint_tree(df, ["id"], 2)
    root = tree.where("level = 0").first()
    again = gates.table_fingerprint(df.repartition(5).orderBy(F.desc("id"))).first()
    assert (root["rows"], root["fingerprint"]) == (again["rows"], again["fingerprint"]) and tree.where("level = 2").count() == 256
    now = df.where("id != 17").withColumn("v", F.when(F.col("id") == 99, -1).otherwise(F.col("v"))).unionByName(spark.range(5000, 5001).select("id", F.lit(0).cast("long").alias("v")))
    other = gates.fingerprint_tree(now, ["id"], 2)
    assert 1 <= gates.differing_ranges(tree, other, 2).count() <= 3
    assert {tuple(r) for r in gates.drift_by_ranges(df, now, ["id"], 2, tree).collect()} == {(17, "missing"), (99, "changed"), (5000, "new")}
    assert gates.differing_ranges(tree, gates.fingerprint_tree(df.repartition(7), ["id"], 2), 2).count() == 0
    one, two = (gates.table_fingerprint(spark.createDataFrame(x, "a int")).first()["fingerprint"] for x in ([(1,), (2,)], [(1,), (1,)]))
    assert one != two and gates.table_fingerprint(df.limit(0)).first()["rows"] == 0


def test_inversion_weighs_pairs_that_disagree(spark):
    """Noisy pairs of varied coherence, some missing, against weighted least squares of each pixel; one pixel lacks a date."""
    r = np.random.default_rng(4)
    pairs, dates = [(0, 1), (1, 2), (0, 2), (2, 3), (1, 3), (3, 4), (2, 4), (0, 4)], [0.0, 0.1, 0.25, 0.3, 0.6]
    design = np.array([[(b == i) - (a == i) for i in range(1, 5)] for a, b in pairs], float)
    rows, want = [], {}
    for row in range(3):
        for col in range(5):
            phase, coh = r.normal(0, 3, len(pairs)), r.choice([0.0, 0.2, 0.5, 0.9, 1.0], len(pairs))
            keep = r.random(len(pairs)) > 0.15
            if (row, col) == (2, 2):
                keep = np.array([4 not in p for p in pairs])  # the last date has no pair
            rows += [(row, col, k, float(phase[k]) if keep[k] else None, float(coh[k]) if coh[k] else None) for k in range(len(pairs))]
            c = np.clip(coh, 0.05, 0.98)
            w = np.sqrt(c * c / (1 - c * c))[keep]
            x, _, rank, _ = np.linalg.lstsq(design[keep] * w[:, None], phase[keep] * w, rcond=None)
            if rank == 4:
                disp = np.concatenate([[0.0], x * -fields.WAVELENGTH_M / (4 * np.pi)])
                want[row, col] = disp, np.polyfit(dates, disp, 1)[0], abs(np.exp(1j * (phase[keep] - design[keep] @ x)).mean())
    px = spark.createDataFrame(rows, "row int, col int, pair int, unw double, coh double")
    got = {(x["row"], x["col"]): x for x in fields.invert_network(px, pairs, dates, 2).collect()}
    assert got.keys() == want.keys() and (2, 2) not in got
    for k, (disp, rate, coherence) in want.items():
        assert np.allclose(got[k]["disp"], disp, atol=1e-9) and abs(got[k]["rate"] - rate) < 1e-8 and abs(got[k]["coherence"] - coherence) < 1e-8
