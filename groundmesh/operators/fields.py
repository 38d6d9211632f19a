"""Fields over pixels: pair residuals, scatter, references, containment, seams, smoothing, inversion, comparisons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import saved
from .pairs import pair_model
from .quantiles import exact_quantiles

WAVELENGTH_M = 0.055465764662349676


def pair_residuals(pair_px: DataFrame, epoch_px: DataFrame) -> DataFrame:
    """Residual phase of each pair pixel against the displacement series: row, col, pair_id, residual (radians)."""
    m = pair_model(pair_px.where("unw is not null"), epoch_px)
    return m.withColumn("residual", F.col("unw") - F.col("ddisp") / (-WAVELENGTH_M / (4 * math.pi)))


def residual_table(residuals: DataFrame) -> DataFrame:
    r = F.col("residual")
    return residuals.groupBy("pair_id").agg(F.count(r).alias("n"), F.sqrt(F.avg(r * r)).alias("rms"), F.percentile(r, F.lit(0.5)).alias("median"), F.avg((F.abs(r) > 1).cast("double")).alias("above_1rad"))


def pixel_scatter(residuals: DataFrame) -> DataFrame:
    """Median over pixels of the residuals' deviation over pairs."""
    s = saved(residuals.groupBy("row", "col").agg(F.stddev_pop("residual").alias("s")).where("s is not null"))
    return residuals.sparkSession.createDataFrame([(s.count(), exact_quantiles(s, "s", [0.5])[0])], "pixels long, scatter double")


def control_series(epoch_px: DataFrame, stable: DataFrame, value: str) -> DataFrame:
    """Median of the stable cells (row, col) at each date; every stable cell counts, none are sampled."""
    return epoch_px.join(stable.select("row", "col").distinct(), ["row", "col"], "left_semi").groupBy("date").agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"))


def spaced_greedy(cands: DataFrame, distance: float, most: int) -> DataFrame:
    """Candidates (row, col, score) best first, each at least ``distance`` from those taken; at most ``most``.

    A round takes the best and filters the rest by distance; only ``most`` rows ever reach the driver. The candidates
    are computed once and kept on the executors for all rounds.
    """
    taken: list = []
    rest = kept = cands.select("row", "col", "score").persist(StorageLevel.MEMORY_AND_DISK)
    for _ in range(most):
        best = rest.orderBy(F.desc("score"), "row", "col").first()
        if best is None:
            break
        taken.append((len(taken) + 1, best["row"], best["col"], float(best["score"])))
        rest = rest.where(F.sqrt(F.pow(F.col("row") - best["row"], 2) + F.pow(F.col("col") - best["col"], 2)) >= distance)
    kept.unpersist()
    return cands.sparkSession.createDataFrame(taken, "rank int, row int, col int, score double")


def reference_sensitivity(zones: DataFrame, references: DataFrame) -> DataFrame:
    """Each zone's spread over candidate references (reference, value): range and deviation of zone minus reference."""
    d = zones.crossJoin(references).withColumn("shifted", F.col("median") - F.col("value"))
    return d.groupBy("zone").agg((F.max("shifted") - F.min("shifted")).alias("spread"), F.stddev_samp("shifted").alias("sd"))


def edge_distance(cands: DataFrame, invalid: DataFrame, cap: int = 50) -> DataFrame:
    """Distance of each candidate cell to the nearest invalid cell, null beyond ``cap``, met in blocks of that size."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = invalid.select(F.col("row").alias("r2"), F.col("col").alias("c2"), steps.alias("s")).select("r2", "c2", (F.expr(f"r2 div {cap}") + F.col("s.i")).alias("bi"), (F.expr(f"c2 div {cap}") + F.col("s.j")).alias("bj"))
    a = cands.withColumn("bi", F.expr(f"row div {cap}").cast("long")).withColumn("bj", F.expr(f"col div {cap}").cast("long"))
    d = F.sqrt(F.pow(F.col("row") - F.col("r2"), 2) + F.pow(F.col("col") - F.col("c2"), 2))
    near = a.join(b, ["bi", "bj"]).withColumn("d", d).where(F.col("d") <= cap).groupBy("row", "col").agg(F.min("d").alias("distance"))
    return cands.join(near, ["row", "col"], "left")


def seam_check(px: DataFrame, value: str, window: int = 51, z: float = 6.0, effect: float = 0.05, margin: int = 30) -> DataFrame:
    """Rows whose median departs from the rolling median of rows by z robust scales and by ``effect``; borders excluded."""
    rows = px.groupBy("row").agg(F.percentile(value, F.lit(0.5)).alias("m"))
    w = Window.orderBy("row").rowsBetween(-(window // 2), window // 2)  # one value for each row of the grid
    dev = rows.withColumn("d", F.col("m") - F.when(F.count("m").over(w) >= 12, F.percentile("m", F.lit(0.5)).over(w)))
    mid = dev.agg(F.percentile("d", F.lit(0.5)).alias("c"), F.min("row").alias("lo"), F.max("row").alias("hi"))
    mad = dev.crossJoin(F.broadcast(mid)).agg(F.first("c").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.greatest(1.4826 * F.percentile(F.abs(F.col("d") - F.col("c")), F.lit(0.5)), F.lit(1e-9)).alias("s"))
    out = dev.crossJoin(F.broadcast(mad)).withColumn("z", (F.col("d") - F.col("c")) / F.col("s"))
    return out.where((F.abs("z") > z) & (F.abs("d") > effect) & F.col("row").between(F.col("lo") + margin, F.col("hi") - margin)).select("row", "m", "d", "z")


def containment(zone_px: DataFrame, valid: Column, least: float = 0.99) -> DataFrame:
    """Share of each zone's cells that are valid, and whether it exceeds ``least``."""
    return zone_px.groupBy("zone").agg(F.count("*").alias("n"), F.avg(valid.cast("double")).alias("valid")).withColumn("contained", F.col("valid") > least)


def point_to_cell(points: DataFrame, x_first: float, y_first: float, step: float, rows: int, cols: int) -> DataFrame:
    """The grid cell of each point (x, y), cells named by their centre half a step in, and whether it is in the grid."""
    out = points.withColumn("row", F.round((y_first - F.col("y")) / step - 0.5).cast("int")).withColumn("col", F.round((F.col("x") - x_first) / step - 0.5).cast("int"))
    return out.withColumn("in_grid", F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def coverage(cells: DataFrame, inside: DataFrame, key: list[str]) -> DataFrame:
    """Share of the area's cells that any footprint covers; ``inside``: key, poly_id. Exact to one cell."""
    hit = inside.select(*key).distinct().withColumn("_c", F.lit(1.0))
    return cells.join(hit, key, "left").agg(F.count("*").alias("cells"), F.avg(F.coalesce("_c", F.lit(0.0))).alias("covered"))


def invert_network(pair_px: DataFrame, pairs: list[tuple[int, int]], dates: list[float], tile: int = 64) -> DataFrame:
    """Displacement at each date, rate and temporal coherence of every pixel, from its pair phases.

    pair_px: row, col, pair (index into ``pairs``), unw, coh. Pairs index ``dates`` (years). The first date is 0. Pairs
    weigh by coherence squared over (1 - coherence squared). A tile of pixels is one group: the design is small and
    shared, and all pixels of the tile are solved side by side. Pixels with a rank-deficient network are left out.
    """
    n, fields = len(dates), "row int, col int, disp array<double>, rate double, coherence double"
    design = np.zeros((len(pairs), n - 1))
    for i, (a, b) in enumerate(pairs):
        if b:
            design[i, b - 1] += 1
        if a:
            design[i, a - 1] -= 1
    t = np.asarray(dates, dtype=float) - dates[0]
    factor = -WAVELENGTH_M / (4 * math.pi)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, code = np.unique(pdf["row"].to_numpy(np.int64) * (1 << 20) + pdf["col"].to_numpy(np.int64), return_inverse=True)
        phase, weight = np.zeros((len(cells), len(pairs))), np.zeros((len(cells), len(pairs)))
        p, ok = pdf["pair"].to_numpy(np.int64), pdf["unw"].notna().to_numpy()
        c = np.clip(pdf["coh"].fillna(0).to_numpy(float), 0.05, 0.98)
        phase[code[ok], p[ok]] = pdf["unw"].to_numpy(float)[ok]
        weight[code[ok], p[ok]] = (c * c / (1 - c * c))[ok]
        normal = np.einsum("ki,ck,kj->cij", design, weight, design)
        good = np.linalg.matrix_rank(normal, hermitian=True) == n - 1
        if not good.any():
            return pd.DataFrame({"row": [], "col": [], "disp": [], "rate": [], "coherence": []})
        right = np.einsum("ki,ck->ci", design, weight * phase)[good]
        x = np.linalg.solve(normal[good], right[:, :, None])[:, :, 0]
        rest = np.where(weight[good] > 0, np.exp(1j * (phase[good] - x @ design.T)), 0)
        coherence = np.abs(rest.sum(1)) / np.maximum((weight[good] > 0).sum(1), 1)
        disp = np.concatenate([np.zeros((len(x), 1)), x * factor], axis=1)
        tc = t - t.mean()
        rate = (disp - disp.mean(1, keepdims=True)) @ tc / (tc @ tc)
        return pd.DataFrame({"row": cells[good] >> 20, "col": cells[good] & ((1 << 20) - 1), "disp": list(disp), "rate": rate, "coherence": coherence})

    return pair_px.groupBy(F.expr(f"row div {tile}"), F.expr(f"col div {tile}")).applyInPandas(run, fields)


def branch_comparison(a: DataFrame, b: DataFrame, key: list[str], value: str, better: str = "low") -> DataFrame:
    """Difference of two branches cell by cell: median, RMS, largest, and how many improved or worsened from a to b."""
    j = a.select(*key, F.col(value).alias("_a")).join(b.select(*key, F.col(value).alias("_b")), key).withColumn("_d", F.col("_b") - F.col("_a"))
    gain = -F.col("_d") if better == "low" else F.col("_d")
    j = saved(j)
    (median,) = exact_quantiles(j, "_d", [0.5])
    return j.agg(F.count("*").alias("n"), F.lit(median).cast("double").alias("median"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rms"), F.max(F.abs("_d")).alias("largest"), F.sum((gain > 0).cast("int")).alias("improved"), F.sum((gain < 0).cast("int")).alias("worsened"))


def region_comparison(px: DataFrame, region: Column, mask: Column, value: str) -> DataFrame:
    """Masked against unmasked figures of each region: cells, share masked out, both medians."""
    return px.groupBy(region.alias("region")).agg(F.count("*").alias("n"), F.avg((~mask).cast("double")).alias("masked_out"), F.percentile(value, F.lit(0.5)).alias("median_all"), F.percentile(F.when(mask, F.col(value)), F.lit(0.5)).alias("median_kept"))


def mask_variants(px: DataFrame, zone: str, value: str, variants: dict[str, Column]) -> DataFrame:
    """n and median of each zone under each named mask, in one pass."""
    aggs = [f(v).alias(f"{k}_{n}") for k, m in variants.items() for n, f, v in (("n", F.count, F.when(m, F.col(value))), ("median", lambda c: F.percentile(c, F.lit(0.5)), F.when(m, F.col(value))))]
    return px.groupBy(zone).agg(*aggs)


def project_volume(inventory: DataFrame, planned: DataFrame) -> DataFrame:
    """Bytes to come for each configuration: its mean size over the best copy of each pair, times the planned number.

    inventory: config, pair_id, ok, bytes; planned: config, n.
    """
    best = inventory.where("ok").groupBy("config", "pair_id").agg(F.max("bytes").alias("bytes"))
    return best.groupBy("config").agg(F.count("*").alias("copies"), F.avg("bytes").alias("mean_bytes")).join(planned, "config").withColumn("projected", F.col("mean_bytes") * F.col("n"))


def unconnectable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (dates) without an edge, with the days to their nearest other node. Networks are small."""
    alone = nodes.join(edges.select("network_id", F.explode(F.array("src", "dst")).alias("node")).distinct(), ["network_id", "node"], "left_anti")
    other = nodes.select("network_id", F.col("node").alias("o"))
    gap = F.abs(F.datediff("node", "o"))
    return alone.join(other, "network_id").where("node != o").groupBy("network_id", "node").agg(F.min(gap).alias("nearest_days"))


#: Cells of a zone whose values go as one array, and replicates that such an array serves in one place.
ARRAY_CELLS = 2_000_000
ARRAY_REPS = 25


def pixel_bootstrap(zone_px: DataFrame, value: str, reps: int = 500, seed: int = 3) -> DataFrame:
    """Interval of each zone's median over resampled cells; a draw is a hash of zone, replicate and place.

    zone_px: zone, i (0 .. n-1), n and the value. A zone's values go as one array to where its replicates are drawn, so no
    draw is shuffled; in zones of over ARRAY_CELLS cells, draws meet their values in a join.
    """
    px = zone_px.where("zone is not null").select("zone", "i", "n", F.col(value).cast("double").alias("v"))
    drawn = lambda k: F.pmod(F.xxhash64("zone", "rep", k, F.lit(seed)), F.col("n"))
    kind, last = dict(px.dtypes)["i"], (reps - 1) // ARRAY_REPS
    rep = F.explode(F.sequence(F.col("part") * ARRAY_REPS, F.least(F.col("part") * ARRAY_REPS + ARRAY_REPS, F.lit(reps)) - 1)).alias("rep")
    dealt = px.where(F.col("n") <= ARRAY_CELLS).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    # A fixed number of parts: the arrays are small, the draws made of them are not.
    arrays = dealt.repartition(128, "zone", "part").groupBy("zone", "part").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "v"))).getField("v").alias("vs")).select("zone", "n", "vs", rep)
    picked = F.transform(F.sequence(F.lit(0).cast(kind), (F.col("n") - 1).cast(kind)), lambda k: F.get("vs", drawn(k).cast("int")))
    few = arrays.select("zone", "rep", F.array_sort(F.array_compact(picked)).alias("x")).withColumn("m", F.size("x"))
    few = few.select("zone", "rep", (0.5 * F.get("x", F.floor((F.col("m") - 1) / 2).cast("int")) + 0.5 * F.get("x", F.ceil((F.col("m") - 1) / 2).cast("int"))).alias("m"))
    many = px.where(F.col("n") > ARRAY_CELLS)
    draws = many.select("zone", "n", F.col("i").alias("k")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("i", drawn("k"))
    wide = draws.join(many.select("zone", "i", "v"), ["zone", "i"]).groupBy("zone", "rep").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    return few.unionByName(wide).groupBy("zone").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def random_reference_spread(px: DataFrame, value: str, draws: int = 200, half: int = 25, seed: int = 5) -> DataFrame:
    """p97.5 minus p2.5 of the median in windows around cells picked by hash.

    A window meets the cells of the blocks it touches, four at most, as blocks are as wide as windows.
    """
    wide = 2 * half + 1
    picks = px.select(F.col("row").alias("r"), F.col("col").alias("c"), F.xxhash64("row", "col", F.lit(seed)).alias("h")).orderBy("h", "row", "col").limit(draws)
    for n, at in (("_i", "r"), ("_j", "c")):
        picks = picks.withColumn(n, F.explode(F.array_distinct(F.array(*[F.floor((F.col(at) + k) / wide) for k in (-half, half)]))))
    near = (F.abs(F.col("row") - F.col("r")) <= half) & (F.abs(F.col("col") - F.col("c")) <= half)
    blocks = px.withColumn("_i", F.floor(F.col("row") / wide)).withColumn("_j", F.floor(F.col("col") / wide))
    m = blocks.join(picks, ["_i", "_j"]).where(near).groupBy("r", "c").agg(F.percentile(value, F.lit(0.5)).alias("m"))
    return m.agg(F.count("*").alias("windows"), (F.percentile("m", F.lit(0.975)) - F.percentile("m", F.lit(0.025))).alias("spread"))
