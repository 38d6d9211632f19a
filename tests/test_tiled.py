"""Exact quantiles and tiled filters against numpy on the whole."""

import math
import random

import numpy as np
import pytest

from groundmesh.operators import compare, quantiles, tiled

SHARES = [0.0, 0.013, 0.25, 0.5, 0.975, 1.0]


@pytest.mark.parametrize("bins, few", [(4096, 10_000), (3, 2), (2, 0)])
def test_exact_quantiles(spark, bins, few):
    r = random.Random(5)
    cases = {
        "plain": [r.gauss(0, 1) for _ in range(400)], "ties": [float(r.randint(0, 3)) for _ in range(301)], "one": [2.5], "equal": [7.0] * 50,
        "wide": [0.1, 0.2, 0.3, 1.7e308, -1.7e308, 5e-324, 0.0, 1e-300], "two": [1.0, 2.0],
    }
    for name, values in cases.items():
        rows = [(v,) for v in values] + [(None,), (math.nan,)]
        got = quantiles.exact_quantiles(spark.createDataFrame(rows, "x double").repartition(3), "x", SHARES if name != "wide" else [0.0, 0.5, 1.0], bins, few)
        want = np.quantile(values, SHARES).tolist() if name != "wide" else [-1.7e308, float(np.median(values)), 1.7e308]
        assert got == pytest.approx(want, rel=1e-12, abs=1e-300), name
    assert quantiles.exact_quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
    assert quantiles.exact_scale(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "x double"), "x") == (2.0, 1.4826)


@pytest.mark.parametrize("edges, mode", [("reflect", "symmetric"), ("nearest", "edge")])
def test_filters_at_tile_corners(spark, edges, mode):
    r = np.random.default_rng(1)
    for rows, cols, weights in ((37, 23, tiled.gauss(3.0)), (9, 5, tiled.gauss(2.0)), (20, 20, np.full(3, 1 / 3))):
        grid = r.normal(0, 5, (rows, cols))
        gone = r.random((rows, cols)) < 0.1
        grid[gone] = np.nan
        cells = [(i, j, float(grid[i, j]) if not gone[i, j] else None) for i in range(rows) for j in range(cols)]
        got = {(x["row"], x["col"]): x["smooth"] for x in tiled.smooth(spark.createDataFrame(cells, "row int, col int, v double"), "v", weights, rows, cols, edges, tile=8).collect()}
        full = np.where(gone, np.nanmedian(grid), grid)
        reach = len(weights) // 2
        padded = np.pad(full, reach, mode=mode)
        down = sum(w * padded[k : k + rows] for k, w in enumerate(weights))
        want = sum(w * down[:, k : k + cols] for k, w in enumerate(weights))
        assert set(got) == {(i, j) for i in range(rows) for j in range(cols) if not gone[i, j]}
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in got)


def test_common_control(spark):
    rows = [(0.1 * k, 0.1 * (9 - k), float(k), -float(k)) for k in range(10)] + [(0.95, 0.95, 1.0, 2.0), (0.99, 0.99, 2.0, -4.0), (0.99, 0.99, 3.0, 3.5), (None, 0.99, 0.0, 0.0)]
    got = compare.common_control(spark.createDataFrame(rows, "ca double, cb double, d_a double, d_b double")).first()
    assert tuple(got) == (1, 1.0, 2.0)
    assert tuple(compare.common_control(spark.createDataFrame([], "ca double, cb double, d_a double, d_b double")).first()) == (0, None, None)
