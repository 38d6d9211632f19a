"""Comparisons of branches, views, producers and zones that tie several operators together."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fields, geo, stats
from .lineage import saved
from .quantiles import exact_quantiles, group_quantiles


def _median(c: Column) -> Column:
    return F.percentile(c, F.lit(0.5))


def _pair_rates(n: int, pair: np.ndarray, t: np.ndarray, y: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, rate, its deviation) of each of n series, as series.weighted_rate has them. pair: the series of each row."""
    fine = ~(np.isnan(t) | np.isnan(y))
    pair, t, y, sigma = pair[fine], t[fine], y[fine], np.where(sigma[fine] > 0, sigma[fine], np.nan)
    total = lambda v: np.bincount(pair, v, n)
    rows, told = np.bincount(pair, minlength=n), np.bincount(pair[~np.isnan(sigma)], minlength=n)
    if np.isnan(sigma).any():
        middle = pd.Series(sigma).groupby(pair).median().reindex(range(n)).to_numpy()
        sigma = np.where(np.isnan(sigma), middle[pair], sigma)
    w = np.where((told < np.maximum(10.0, rows / 2))[pair], 1.0, 1 / sigma**2)
    with np.errstate(divide="ignore", invalid="ignore"):
        sw = total(w)
        dt, dy = t - (total(w * t) / sw)[pair], y - (total(w * y) / sw)[pair]
        sxx = total(w * dt * dt)
        sxx = np.where(sxx == 0, np.nan, sxx)
        return rows, total(w * dt * dy) / sxx, 1 / np.sqrt(sxx)


def colocated_rates(stations: DataFrame, obs: DataFrame, cap_km: float = 2.0, least: int = 30) -> DataFrame:
    """Rates of both stations of each pair within ``cap_km``, on the dates that both have, and of their difference.

    stations: id, lat, lon. obs: station, date, t (years), y, sigma. Pairs with fewer than ``least`` common dates are left
    out. Windows agree, as rates over different spans do not compare. A station's series, a row for each of its dates, goes
    as one to the cells around it, and pairs are fitted where they meet: no row of a pair is shuffled.
    """
    fields_ = ("t", "y", "sigma")
    rows = obs.where("station is not null and date is not null").select("station", F.unix_date(F.to_date("date")).cast("double").alias("date"), *[F.col(c).cast("double").alias(c) for c in fields_])
    one = F.array_sort(F.collect_list(F.struct("date", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in fields_])))
    whole = rows.groupBy("station").agg(one.alias("_s")).select("station", *[F.col("_s").getField(c).alias(c) for c in ("date", *fields_)])
    placed = stations.join(whole, stations["id"] == whole["station"]).drop("station")
    near = geo.colocated(placed, cap_km, ["date", *fields_])
    id_type = dict(stations.dtypes)["id"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, of, flat = part.num_rows, {}, {}
                for side in "12":
                    dates = part.column(f"date{side}")
                    of[side] = np.repeat(np.arange(n), dates.value_lengths().to_numpy())
                    for c in ("date", *fields_):
                        flat[c + side] = part.column(c + side).flatten().to_numpy(zero_copy_only=False)
                wide = 1 << 24  # days of the years 1 to 9999 are fewer
                key = {s: of[s] * wide + flat[f"date{s}"].astype(np.int64) + (wide >> 1) for s in "12"}
                lo, hi = (np.searchsorted(key["2"], key["1"], x) for x in ("left", "right"))
                first = np.repeat(np.arange(len(lo)), hi - lo)
                second = np.arange(len(first)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[first]
                pair, t = of["1"][first], flat["t1"][first]
                ya, yb, sa, sb = flat["y1"][first], flat["y2"][second], flat["sigma1"][first], flat["sigma2"][second]
                got = [_pair_rates(n, pair, t, y, s) for y, s in ((ya, sa), (yb, sb), (ya - yb, np.sqrt(sa * sa + sb * sb)))]
                enough = [g[0] >= least for g in got]
                common = np.max([np.where(e, g[0], -1) for g, e in zip(got, enough, strict=True)], axis=0)
                told = lambda v, e: pa.array(v, pa.float64(), mask=~e | np.isnan(v))
                out = [part.column("a"), part.column("b"), part.column("km"), pa.array(common, pa.int64()), *[told(got[k][1], enough[k]) for k in (0, 1, 2)], *[told(got[k][2], enough[k]) for k in (0, 1)]]
                yield pa.RecordBatch.from_arrays(out, ["a", "b", "km", "common", "rate_a", "rate_b", "relative_rate", "sa", "sb"]).filter(pa.array(common >= 0))

    out = near.mapInArrow(run, f"a {id_type}, b {id_type}, km double, common long, rate_a double, rate_b double, relative_rate double, sa double, sb double")
    return out.select("a", "b", "km", "common", "rate_a", "rate_b", (F.col("rate_a") - F.col("rate_b")).alias("difference"), "relative_rate", F.sqrt(F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")).alias("sigma"))


def plane_detrended(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, plane_pearson: the correlation of a and b once a plane in row and col is taken off both.

    It is the partial correlation given row and col, so six correlations of one aggregation give it.
    """
    pairs = [("ab", a, b), ("ar", a, "row"), ("ac", a, "col"), ("br", b, "row"), ("bc", b, "col"), ("rc", "row", "col")]
    r = df.groupBy(*by).agg(*[F.corr(x, y).alias(n) for n, x, y in pairs])
    part = lambda xy, xz, yz: (xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz))
    c = F.col
    ab, ac, bc = part(c("ab"), c("ar"), c("br")), part(c("ac"), c("ar"), c("rc")), part(c("bc"), c("br"), c("rc"))
    return r.select(*by, part(ab, ac, bc).alias("plane_pearson"))


def branch_metrics(px: DataFrame, base: DataFrame) -> DataFrame:
    """A row of metrics for each branch, as the promotion rule takes them.

    px: branch, row, col, velocity, velocity_std, tcoh, residue; base: row, col, velocity, stable. Cells that no inversion
    reached (velocity_std 0) count nowhere.
    """
    inv = saved(px.where("velocity_std > 0").select("branch", "row", "col", "velocity", "velocity_std", "tcoh", "residue"))
    plain = inv.groupBy("branch").agg(F.count("*").alias("inverted"), *[F.sum((F.col("tcoh") >= t).cast("long")).alias(f"tc_ge_{int(t * 100)}") for t in (0.5, 0.6, 0.7)], F.sqrt(F.avg(F.col("residue") * F.col("residue"))).alias("residual_rms"))
    asked = {f"tc_p{int(q * 100)}": (F.col("tcoh"), q) for q in (0.25, 0.5, 0.75)} | {"median_std": (F.col("velocity_std"), 0.5), "mid": (F.col("velocity"), 0.5)}
    own = plain.join(group_quantiles(inv, ["branch"], asked), "branch")
    own = own.select("branch", "inverted", "tc_p25", "tc_p50", "tc_p75", "tc_ge_50", "tc_ge_60", "tc_ge_70", "median_std", "residual_rms", "mid")
    scatter = group_quantiles(inv.join(own.select("branch", "mid"), "branch"), ["branch"], {"_mad": (F.abs(F.col("velocity") - F.col("mid")), 0.5)})
    scatter = scatter.select("branch", (1.4826 * F.col("_mad")).alias("robust_scatter"))
    both = saved(inv.join(base.select("row", "col", F.col("velocity").alias("base"), "stable"), ["row", "col"]))
    cross = both.groupBy("branch").agg(F.count("*").alias("common"), F.corr("base", "velocity").alias("pearson"), F.stddev_pop("velocity").alias("common_scatter"), F.stddev_pop(F.when(F.col("stable"), F.col("velocity"))).alias("stable_scatter"))
    rank = stats.spearman(both, ["branch"], "base", "velocity").select("branch", "spearman")
    out = own.drop("mid").join(scatter, "branch").join(cross, "branch", "left").join(rank, "branch", "left")
    return out.join(plane_detrended(both, ["branch"], "base", "velocity"), "branch", "left")


def reference_gates(blocks: DataFrame, support: float = 0.95, edge_m: float = 2000.0, most_v: float = 2.0) -> DataFrame:
    """Candidate blocks with their gates: support, edge, the lowest quarter of deviations (hard), and a small velocity.

    blocks: row, col, support, edge_m, std, velocity, coherence, and water, the share of water, of which no block with any is
    good (without this column, none has any). relaxed: no block passes the velocity gate with the others.
    score ranks the pool: coherence, or, if relaxed, the least velocity; it is null outside the pool.
    """
    (limit,) = exact_quantiles(blocks, "std", [0.25])
    hard = (F.col("support") >= support) & (F.col("edge_m") >= edge_m) & (F.col("std") <= F.col("std_limit"))
    if "water" in blocks.columns:
        hard = hard & (F.coalesce("water", F.lit(1.0)) == 0)
    gated = blocks.withColumn("std_limit", F.lit(limit).cast("double")).withColumn("hard_ok", hard).withColumn("velocity_ok", F.abs("velocity") <= most_v)
    free = gated.agg(F.coalesce(F.bool_or(F.col("hard_ok") & F.col("velocity_ok")), F.lit(False)).alias("free"))
    gated = gated.crossJoin(free).withColumn("relaxed", ~F.col("free")).drop("free")
    score = F.when(F.col("hard_ok") & F.col("relaxed"), -F.abs("velocity")).when(F.col("hard_ok") & F.col("velocity_ok"), F.col("coherence"))
    return gated.withColumn("score", score)


def select_references(blocks: DataFrame, distance: float = 200.0, most: int = 8, **gates) -> DataFrame:
    """At most ``most`` reference blocks, best first, each ``distance`` cells from the others, and whether a gate was relaxed."""
    gated = reference_gates(blocks, **gates).where("score is not null").persist()
    try:
        taken = fields.spaced_greedy(gated.select("row", "col", "score"), distance, most)
        relaxed = not gated.where("relaxed").isEmpty()
    finally:
        gated.unpersist()
    return taken.withColumn("relaxed", F.lit(relaxed))


def facets(px: DataFrame, by: list[str], a: str, b: str, cuts: dict[str, Column], least: int = 6) -> DataFrame:
    """by, facet, n and the medians of two views over the cells of each cut (all, quality levels, core, boundary, ring)."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cuts.items()]))
    out = px.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b, F.explode(named).alias("facet"))
    return out.groupBy(*by, "facet").agg(F.count("*").alias("n"), _median(F.col(a)).alias("a"), _median(F.col(b)).alias("b")).where(F.col("n") >= least)


def implied_components(z: DataFrame, by: list[str], look_a: tuple, look_b: tuple, north: tuple = (-10.0, -5.0, 0.0, 5.0, 10.0)) -> DataFrame:
    """by, north, vertical, east: what two line-of-sight rates a and b imply together for each assumed northward rate."""
    (ea, na, ua), (eb, nb, ub) = look_a, look_b
    det = ua * eb - ea * ub
    rows = z.select(*by, "a", "b", F.explode(F.array(*map(F.lit, north))).alias("north"))
    p, q = F.col("a") - na * F.col("north"), F.col("b") - nb * F.col("north")
    return rows.select(*by, "north", ((eb * p - ea * q) / det).alias("vertical"), ((ua * q - ub * p) / det).alias("east"))


def connected_contrast(px: DataFrame, by: list[str]) -> DataFrame:
    """Inverted cells inside and outside the connected set: counts, share inside, medians of speed and coherence.

    px: by, velocity, velocity_std, tcoh, connected.
    """
    inside, outside = F.col("connected"), ~F.col("connected")
    pick = lambda c, v: _median(F.when(c, v))
    return px.where("velocity_std > 0").groupBy(*by).agg(
        F.count("*").alias("inverted"), F.sum(inside.cast("long")).alias("inside"), F.avg(inside.cast("double")).alias("fraction_inside"), pick(inside, F.abs("velocity")).alias("inside_abs_velocity"),
        pick(outside, F.abs("velocity")).alias("outside_abs_velocity"), pick(inside, F.col("tcoh")).alias("inside_tcoh"), pick(outside, F.col("tcoh")).alias("outside_tcoh"),
    )


def correction_coverage(expected: DataFrame, files: DataFrame, delays: DataFrame, least_bytes: int = 1024, least_finite: float = 0.999) -> DataFrame:
    """Whether each expected date has a correction: its file, the file's size, and the share of area cells with a value.

    expected: date; files: date, bytes; delays: date, in_aoi, value. Only cells of the area count. state tells the first
    thing missing; the branch is complete if all states are ok.
    """
    f = files.groupBy("date").agg(F.max("bytes").alias("bytes"))
    c = delays.where("in_aoi").groupBy("date").agg(F.avg((F.col("value").isNotNull() & ~F.isnan("value")).cast("double")).alias("finite"))
    out = expected.select("date").distinct().join(f, "date", "left").join(c, "date", "left")
    state = F.when(F.col("bytes").isNull(), "no file").when(F.col("bytes") < least_bytes, "small file").when(F.col("finite").isNull(), "no delays").when(F.col("finite") < least_finite, "incomplete area").otherwise("ok")
    return out.withColumn("state", state)


def rebasing_effect(a: DataFrame, b: DataFrame, key: list[str], by: list[str], offset: float) -> DataFrame:
    """Median and RMS of branch minus base, as published and once the base is shifted by ``offset``. a: key, value; b: by, key, value."""
    d = b.join(a.select(*key, F.col("value").alias("_base")), key).where("value is not null and _base is not null").select(*by, (F.col("value") - F.col("_base")).alias("d"))
    rms = lambda x: F.sqrt(F.avg(x * x))
    x, y = F.col("d"), F.col("d") + offset
    return d.groupBy(*by).agg(F.count("*").alias("n"), _median(x).alias("published_median"), rms(x).alias("published_rms"), _median(y).alias("aligned_median"), rms(y).alias("aligned_rms"))


def zone_profile(zone_px: DataFrame, grids: DataFrame, scale: float = 10.0) -> DataFrame:
    """zone, property, depth, n and median (over ``scale``) of the grid cells of each zone. zone_px: zone, row, col; grids: property, depth, row, col, value."""
    cells = zone_px.select("zone", "row", "col").distinct().join(grids.where("value is not null"), ["row", "col"])
    return cells.groupBy("zone", "property", "depth").agg(F.count("*").alias("n"), (_median(F.col("value")) / scale).alias("median"))


def cross_producer_duplication(a: DataFrame, b: DataFrame, digits: int = 4) -> DataFrame:
    """One row: stations of each producer, shared names, shared rounded coordinates. a, b: station, lat, lon; a name counts once, at its least coordinates."""
    once = lambda x: x.groupBy("station").agg(F.min(F.struct("lat", "lon")).alias("p")).select("station", F.round("p.lat", digits).alias("lat"), F.round("p.lon", digits).alias("lon"))
    a, b = once(a), once(b)
    count = lambda x, n: x.agg(F.count("*").alias(n))
    at = ["lat", "lon"]
    names, places = a.join(b, "station", "left_semi"), a.select(*at).distinct().join(b.select(*at).distinct(), at, "left_semi")
    return count(a, "stations_a").crossJoin(count(b, "stations_b")).crossJoin(count(names, "shared_names")).crossJoin(count(places, "shared_coordinates"))


def aoi_window(corners: DataFrame, x_first: float, y_first: float, step: float, rows: int, cols: int) -> DataFrame:
    """One row: the grid window (row0, row1, col0, col1, ends excluded) around a polygon's corners (x, y), a cell wider, inside the grid."""
    b = corners.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    low = lambda v: F.greatest(F.lit(0), (F.floor(v) - 1).cast("int"))
    high = lambda v, most: F.least(F.lit(most), (F.ceil(v) + 1).cast("int"))
    c = F.col
    return b.select(
        low((y_first - c("y1")) / step).alias("row0"), high((y_first - c("y0")) / step, rows).alias("row1"), low((c("x0") - x_first) / step).alias("col0"), high((c("x1") - x_first) / step, cols).alias("col1"),
    )


def common_control(both: DataFrame, most: float = 3.0, share: float = 0.75) -> DataFrame:
    """n, ref_a, ref_b: the cells stable in two stacks and the median of each stack there, which re-references it.

    both: ca, cb (coherence) and d_a, d_b (rate) of cells that both stacks have. Stable: of the upper part of either
    stack's coherence beyond ``share``, and at most ``most`` in size in both.
    """
    both = saved(both.select("ca", "cb", "d_a", "d_b"))
    a, b = (exact_quantiles(both, c, [share])[0] for c in ("ca", "cb"))
    c = saved(both.where((F.col("ca") >= F.lit(a)) & (F.col("cb") >= F.lit(b)) & (F.abs("d_a") <= most) & (F.abs("d_b") <= most)))
    medians = [exact_quantiles(c, x, [0.5])[0] for x in ("d_a", "d_b")]
    return both.sparkSession.createDataFrame([(c.count(), *medians)], "n long, ref_a double, ref_b double")
