"""Labels of nested masks on many tiles against one plain search for each mask."""

import random

import numpy as np
from pyspark.sql import functions as F

from groundmesh.operators import zones


def plain_labels(cells, span):
    left, out = set(cells), {}
    for start in sorted(cells):
        if start not in left:
            continue
        left.discard(start)
        todo, mine = [start], []
        while todo:
            r, c = todo.pop()
            mine.append((r, c))
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if (r + a, c + b) in left:
                        left.discard((r + a, c + b))
                        todo.append((r + a, c + b))
        out |= {x: start[0] * span + start[1] for x in mine}
    return out


def test_nested_labels_equal_one_labelling_each(spark):
    r = random.Random(7)
    rows = [(i, j, r.gauss(0, 9), r.choice([None, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95])) for i in range(40) for j in range(40) if r.random() < 0.9]
    px = spark.createDataFrame([(*x, "clash") for x in rows], "row int, col int, velocity double, tcoh double, _level string").repartition(5)
    scenarios = [(n, c, t, 0.0064 if a < 1 else 0.02) for n, c, t, a in zones.SCENARIOS]
    got = zones.label_scenarios(px, scenarios, tile=8).collect()
    for name, c, t, area in scenarios:
        want = plain_labels({(i, j) for i, j, v, k in rows if k is not None and k >= c and abs(v) >= t}, 1000)
        mine = {(x["row"], x["col"]): x for x in got if x["scenario_id"] == name}
        assert {k: x["label"] for k, x in mine.items()} == want
        size = {}
        for label in want.values():
            size[label] = size.get(label, 0) + 1
        assert all(x["cells"] == size[x["label"]] and x["kept"] == (x["cells"] >= round(area / 0.0016)) for x in mine.values())
    assert len(zones._chains({(c, t) for _, c, t, _ in zones.SCENARIOS})) <= 3


def test_labels_beyond_a_thousand_columns_and_repeated_cells(spark):
    rows = [(0, 999), (1, 1000), (1, 1000), (2, 1001), (1, 5), (70_000, 3)]
    got = sorted((r["row"], r["col"], r["label"]) for r in zones.label_components(spark.createDataFrame(rows, "row int, col int"), 1, tile=2).collect())
    span = 1 << 31
    assert got == sorted([(0, 999, 999), (1, 1000, 999), (1, 1000, 999), (2, 1001, 999), (1, 5, span + 5), (70_000, 3, 70_000 * span + 3)])
    assert zones.label_components(spark.createDataFrame([], "row int, col int"), 1).collect() == []


def test_tile_labels():
    r = np.random.default_rng(3)
    for _ in range(20):
        row, col = np.divmod(np.sort(r.choice(400, 250, replace=False)), 20)
        level = r.integers(1, 5, 250)
        for k, found in enumerate(zones.tile_labels(row, col, level), 1):
            want = plain_labels({(a, b) for a, b, x in zip(row.tolist(), col.tolist(), level) if x >= k}, 20)
            assert {(a, b): row[f] * 20 + col[f] for a, b, x, f in zip(row.tolist(), col.tolist(), level, found) if x >= k} == want


def test_persistence(spark):
    px = spark.createDataFrame([(0, c, 20.0 + c, 0.95 if c < 4 else 0.82) for c in range(8)] + [(5, c, -11.0, 0.9) for c in range(4)], "row int, col int, velocity double, tcoh double")
    scenarios = [("primary", 0.8, 10.0, 0.0048), ("strict", 0.9, 10.0, 0.0048), ("large", 0.8, 10.0, 0.01), ("fast", 0.8, 26.0, 0.0)]
    x = zones.label_scenarios(px, scenarios)
    got = {(r["zone"], r["scenario_id"]): tuple(r)[2:] for r in zones.zone_persistence(x.where("scenario_id = 'primary' and kept"), x, scenarios).collect()}
    assert got[0, "primary"] == (1.0, 8 * 0.0016, 23.5, True) and got[0, "strict"] == (0.5, 4 * 0.0016, 21.5, True)
    assert got[0, "fast"] == (0.25, 2 * 0.0016, 26.5, False) and got[5000, "large"] == (1.0, 0.0, None, False) and got[5000, "fast"] == (0.0, 0.0, None, False)


def test_sizes_of_components_come_from_tiles(spark):
    """No step after the tiles groups or joins cells by their component, which one task would gather."""
    px = spark.createDataFrame([(i, j) for i in range(30) for j in range(30) if (i, j) != (5, 5)] + [(40, 40)], "row int, col int")
    out = zones.nested_labels(px, F.lit(1), tile=8)
    assert {(r["label"], r[out.columns[-1]]) for r in out.collect()} == {(0, 899), (40040, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "row#" in line for line in plan.splitlines())
