"""Zones: connected components of pixels, their neighbourhoods, overlaps and accounting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .lineage import free_names, saved
from .quantiles import group_quantiles

TILE = 128


def _hooked(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``parent`` (each entry its set's least member) after the sets of u[k] and v[k] are joined for all k."""
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def tile_labels(row: np.ndarray, col: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """For each level 1, 2, ..., most: each cell's component among the cells of at least that level, by its first cell.

    Cells are in order of (row, col), so the least member is the first. Cells join in falling order of level, each
    neighbourship (diagonal ones too) at the lower of its two levels, so what is joined once stays joined below.
    """
    n, most = len(row), int(level.max(initial=0))
    grid = np.full((int(np.ptp(row)) + 3, int(np.ptp(col)) + 3), -1) if n else np.zeros((3, 3), int)
    i, j = (row - row.min() + 1, col - col.min() + 1) if n else (row, col)
    grid[i, j] = np.arange(n)
    pairs = [(k[k2 >= 0], k2[k2 >= 0]) for k, k2 in ((np.arange(n), grid[i + a, j + b]) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)))]
    u, v = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    at, parent, out = np.minimum(level[u], level[v]), np.arange(n), []
    for k in range(most, 0, -1):
        now = at == k
        parent = _hooked(parent, u[now], v[now])
        out.append(parent.copy())
    return out[::-1]


def nested_labels(px: DataFrame, level: Column, tile: int = TILE) -> DataFrame:
    """The cells of level 1 and more, once for each level k = 1 .. their own, with the label of their component there and,
    as the last column, how many cells it has.

    A component at k is 8-connected cells of level k or more; its label is the least row * span + col (span 1000, or 2**31
    if a column does not fit). One pass labels each tile for all levels, in numpy; cells on tile borders then meet their
    neighbours of other tiles in one equi-join, and the labels they tie form one small graph for all levels, whose
    components finish the labels. Only border cells and labels are shuffled after the tiles. Null levels are left out.
    """
    names = free_names(px, "_level", "_labels", "_cells")
    px = px.withColumn(names[0], level.cast("int")).where(F.col(names[0]) >= 1)
    span = 1000 if px.where("col not between 0 and 999").isEmpty() else 1 << 31

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        cells = pdf[["row", "col"]].drop_duplicates()
        of = (pdf[["row", "col"]].diff().ne(0).any(axis=1)).cumsum().to_numpy() - 1  # repeated cells share a label
        lev = pdf[names[0]].groupby(of).max().to_numpy()
        r, c = cells["row"].to_numpy(np.int64), cells["col"].to_numpy(np.int64)
        ids = r * span + c
        found = [ids[x][of] for x in tile_labels(r, c, lev)]
        own = pdf[names[0]].to_numpy()
        return pdf.assign(**{names[1]: [[x[k] for x in found[: own[k]]] for k in range(len(pdf))]})

    fields = ", ".join(f"`{n}` {t}" for n, t in px.dtypes) + f", {names[1]} array<long>"
    tiled = saved(px.groupBy(F.expr(f"row div {tile}"), F.expr(f"col div {tile}")).applyInPandas(run, fields))
    done = tiled.select(*[c for c in px.columns if c != names[0]], F.posexplode(names[1]).alias("k", "tile_label")).withColumn("k", F.col("k") + 1)
    edge = done.where(f"row % {tile} in (0, {tile - 1}) or col % {tile} in (0, {tile - 1})").select("k", "row", "col", "tile_label").distinct()
    near = edge.select("k", F.explode(F.array(*[F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("p"), F.col("tile_label").alias("other")).select("k", "p.row", "p.col", "other")
    links = near.join(edge, ["k", "row", "col"]).where("tile_label < other").select(F.col("k").alias("network_id"), F.col("tile_label").alias("src"), F.col("other").alias("dst")).distinct()
    links = saved(links)
    nodes = links.select("network_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    merged = connected_components(nodes, links).select(F.col("network_id").alias("k"), F.col("node").alias("tile_label"), "component")
    # Sizes are summed from tiles, so no task gathers the cells of a large component.
    parts = done.groupBy("k", "tile_label").agg(F.count("*").alias("_in_tile")).join(merged, ["k", "tile_label"], "left")
    parts = saved(parts.select("k", "tile_label", F.coalesce("component", "tile_label").alias("label"), "_in_tile"))
    sizes = parts.groupBy("k", "label").agg(F.sum("_in_tile").alias(names[2]))
    return done.join(parts.drop("_in_tile").join(sizes, ["k", "label"]), ["k", "tile_label"]).drop("tile_label")


def label_components(px: DataFrame, least: int = 250, tile: int = TILE) -> DataFrame:
    """Label the 8-connected components of the given cells (see nested_labels); those under ``least`` cells go."""
    out = nested_labels(px, F.lit(1), tile)
    return out.where(F.col(out.columns[-1]) >= least).drop("k", out.columns[-1])


#: scenario_id, least coherence, least size of velocity (mm a year), least area (km2).
SCENARIOS = [
    ("primary", 0.8, 10.0, 0.4), ("strict_coh_0.90", 0.9, 10.0, 0.4), ("relaxed_coh_0.70", 0.7, 10.0, 0.4), ("relaxed_coh_0.60", 0.6, 10.0, 0.4), ("relaxed_coh_0.50", 0.5, 10.0, 0.4),
    ("no_coh_cut", 0.0, 10.0, 0.4), ("threshold_7.5", 0.8, 7.5, 0.4), ("threshold_5", 0.8, 5.0, 0.4), ("threshold_15", 0.8, 15.0, 0.4), ("min_area_1.0", 0.8, 10.0, 1.0),
    ("min_area_2.0", 0.8, 10.0, 2.0), ("min_area_5.0", 0.8, 10.0, 5.0), ("coh_0.70_thr_5", 0.7, 5.0, 0.4), ("coh_0.90_thr_15", 0.9, 15.0, 0.4),
]  # fixed values


def _chains(masks: set[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The masks in chains, each mask of a chain within the one before: few passes serve all."""
    chains: list[list[tuple[float, float]]] = []
    for m in sorted(masks):
        fits = [c for c in chains if c[-1][0] <= m[0] and c[-1][1] <= m[1]]
        if fits:
            max(fits, key=lambda c: c[-1]).append(m)
        else:
            chains.append([m])
    return chains


def label_scenarios(px: DataFrame, scenarios: list[tuple] = SCENARIOS, tile: int = TILE, cell_km2: float = 0.0016) -> DataFrame:
    """The cells of each scenario with scenario_id, label, cells (of their component) and kept (its area is enough).

    Masks that lie within each other form chains; a cell's level in a chain is how many of its masks it passes, so one
    labelling of a chain serves all its scenarios. px: row, col, velocity, tcoh of eligible cells; null values pass no mask.
    """
    out, px = None, saved(px)
    for chain in _chains({(c, t) for _, c, t, _ in scenarios}):
        passed = [F.when((F.col("tcoh") >= c) & (F.abs("velocity") >= t), 1).otherwise(0) for c, t in chain]
        found = nested_labels(px, sum(passed[1:], passed[0]), tile)
        found = found.withColumnRenamed(found.columns[-1], "cells")
        mine = [(chain.index((c, t)) + 1, name, round(area / cell_km2)) for name, c, t, area in scenarios if (c, t) in chain]
        of = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("scenario_id"), F.lit(n).alias("least")) for k, name, n in mine])
        rows = found.withColumn("_s", F.explode(F.filter(of, lambda x: x["k"] == F.col("k"))))
        rows = rows.select(F.col("_s.scenario_id").alias("scenario_id"), *px.columns, "label", "cells", (F.col("cells") >= F.col("_s.least")).alias("kept"))
        out = rows if out is None else out.unionByName(rows)
    return out


def zone_persistence(zones: DataFrame, labelled: DataFrame, scenarios: list[tuple] = SCENARIOS, cell_km2: float = 0.0016) -> DataFrame:
    """zone, scenario_id, overlap_fraction, component_area_km2, component_median, persists for each zone and scenario.

    Of the scenario's components the one with most of the zone's cells counts (ties to the least label), kept or not; the
    zone persists if it has half of them and is kept, which also decides whether area and median are told.
    """
    labelled, mine = saved(labelled.select("scenario_id", "row", "col", "velocity", "label", "cells", "kept")), saved(zones.select(F.col("label").alias("zone"), "row", "col").distinct())
    n = mine.groupBy("zone").agg(F.count("*").alias("n"))
    both = mine.join(labelled.select("scenario_id", "row", "col", "label", "cells", "kept"), ["row", "col"])
    both = both.groupBy("zone", "scenario_id", "label").agg(F.count("*").alias("k"), F.first("cells").alias("cells"), F.first("kept").alias("kept"))
    best = both.groupBy("zone", "scenario_id").agg(F.max(F.struct("k", (-F.col("label")).alias("m"), "cells", "kept")).alias("x")).select("zone", "scenario_id", "x.k", (-F.col("x.m")).alias("label"), "x.cells", "x.kept")
    best = saved(best)
    wanted = labelled.join(best.where("kept").select("scenario_id", "label").distinct(), ["scenario_id", "label"], "left_semi")
    middle = group_quantiles(wanted, ["scenario_id", "label"], {"component_median": (F.col("velocity"), 0.5)})
    every = n.withColumn("scenario_id", F.explode(F.array(*[F.lit(s[0]) for s in scenarios])))
    out = every.join(best, ["zone", "scenario_id"], "left").join(middle, ["scenario_id", "label"], "left")
    share = F.coalesce(F.col("k") / F.col("n"), F.lit(0.0))
    return out.select("zone", "scenario_id", share.alias("overlap_fraction"), F.when(F.col("kept"), F.col("cells") * cell_km2).otherwise(0.0).alias("component_area_km2"), "component_median", (F.coalesce("kept", F.lit(False)) & (share >= 0.5)).alias("persists"))


def aoi_counts(px: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.expr(f"cast({c} as int)"))
    return px.agg(
        F.count("*").alias("cells"), n("in_aoi").alias("aoi"), n("in_aoi and velocity_std > 0").alias("finite"), n("in_aoi and land").alias("land"),
        n("in_aoi and not land").alias("water"), (n("in_aoi and land") / n("in_aoi")).alias("land_fraction"),
    )


def pair_qc(pair_px: DataFrame, aoi: int) -> DataFrame:
    """Quality of each pair: valid cells and their share of all ``aoi`` cells, coherence, components, largest share."""
    parts = pair_px.groupBy("pair_id", "cc").agg(F.count("*").alias("k")).groupBy("pair_id").agg(F.max("k").alias("_k"), F.count("*").alias("components"))
    agg = pair_px.groupBy("pair_id").agg(
        F.count("unw").alias("valid"), (F.count("unw") / aoi).alias("valid_fraction"), F.percentile("coh", F.lit(0.5)).alias("coh_median"),
        F.percentile("coh", F.lit(0.25)).alias("coh_p25"), F.avg("coh").alias("coh_mean"),
    )
    return agg.join(parts, "pair_id").withColumn("largest_share", F.col("_k") / aoi).drop("_k")


def class_counts(px: DataFrame, cls: Column) -> DataFrame:
    n = px.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("class", "n", (100 * F.col("n") / F.col("_all")).alias("pct"))


def outline(labels: DataFrame) -> DataFrame:
    """The cell edges that bound each label, all its pieces and holes: an edge whose other side is not of the label."""
    sides = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(s).alias("side")) for r, c, s in ((-1, 0, "n"), (1, 0, "s"), (0, -1, "w"), (0, 1, "e"))])
    edges = labels.select("label", "row", "col", F.explode(sides).alias("s")).select("label", "row", "col", "s.side", (F.col("row") + F.col("s.r")).alias("r2"), (F.col("col") + F.col("s.c")).alias("c2"))
    cells = labels.select("label", F.col("row").alias("r2"), F.col("col").alias("c2"))
    return edges.join(cells, ["label", "r2", "c2"], "left_anti").select("label", "row", "col", "side")


def ring(labels: DataFrame, k: int = 5) -> DataFrame:
    """Cells within k steps (diagonal ones too) of a label that are not its own."""
    steps = F.sequence(F.lit(-k), F.lit(k))
    tall = labels.select("label", "row", "col", F.explode(steps).alias("k")).select("label", (F.col("row") + F.col("k")).alias("row"), "col").distinct()
    grown = tall.select("label", "row", "col", F.explode(steps).alias("k")).select("label", "row", (F.col("col") + F.col("k")).alias("col")).distinct()
    return grown.join(labels.select("label", "row", "col"), ["label", "row", "col"], "left_anti")


def zone_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each zone of a, the zone of b that shares most cells (ties to the least), overlap fraction and IoU."""
    both = a.select("row", "col", F.col("label").alias("a")).join(b.select("row", "col", F.col("label").alias("b")), ["row", "col"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    na = a.groupBy(F.col("label").alias("a")).agg(F.count("*").alias("na"))
    nb = b.groupBy(F.col("label").alias("b")).agg(F.count("*").alias("nb"))
    best = both.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("m"))).alias("x")).select("a", (-F.col("x.m")).alias("b"), F.col("x.n").alias("n"))
    return best.join(na, "a").join(nb, "b").select("a", "b", "n", (F.col("n") / F.col("na")).alias("overlap"), (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("iou"))


def compare_copies(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    x, y = a.select("row", "col", F.col(col).alias("_a")), b.select("row", "col", F.col(col).alias("_b"))
    return x.join(y, ["row", "col"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs"), F.avg((~F.col("_a").eqNullSafe(F.col("_b"))).cast("double")).alias("differing"))


def edge_artifact(px: DataFrame, rows: int, cols: int, band: int) -> DataFrame:
    near = F.least(F.col("row"), rows - 1 - F.col("row"), F.col("col"), cols - 1 - F.col("col")) < band
    return px.groupBy(F.when(near, "edge").otherwise("interior").alias("band")).agg(F.count("*").alias("n"), F.avg((F.col("velocity_std") > 0).cast("double")).alias("valid"), F.percentile("velocity", F.lit(0.5)).alias("median"))
