"""Grouped summaries, robust scales, ranks, tests and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import Saved, saved
from .quantiles import average_ranks, group_quantiles, same_groups

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def describe(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """n, min, percentiles (linear), max, mean and population deviation of a column; nulls are skipped."""
    df = saved(df.select(*by, col))
    names = [f"p{round(q * 100):02d}" for q in QUANTILES]
    plain = df.groupBy(*by).agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    found = group_quantiles(df, by, {n: (F.col(col), q) for n, q in zip(names, QUANTILES, strict=True)})
    return same_groups(plain, found, by).select(*by, "n", "min", *names, "max", "mean", "std")


def fractions(df: DataFrame, by: list[str], col: str, thresholds: list[float]) -> DataFrame:
    """Share of non-null values above each threshold, as above_0, above_1, ..."""
    return df.groupBy(*by).agg(*[F.avg((F.col(col) > t).cast("double")).alias(f"above_{i}") for i, t in enumerate(thresholds)])


def robust_scale(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation; if that is 0 the sample deviation, if that too 1e-9."""
    df = saved(df.select(*by, col))
    mid = group_quantiles(df, by, {"median": (F.col(col), 0.5)}).join(df.groupBy(*by).agg(F.stddev_samp(col).alias("_s")), by)
    dev = mid.join(group_quantiles(df.join(mid, by), by, {"mad": (F.abs(F.col(col) - F.col("median")), 0.5)}), by)
    scale = F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("_s") > 0, F.col("_s")).otherwise(1e-9)
    return dev.select(*by, "median", "mad", scale.alias("scale"))


def flag_outliers(df: DataFrame, by: list[str], metrics: dict[str, str], k: float = 3.5) -> DataFrame:
    """Rows with reasons: metrics says of each column which side is bad, ``low`` or ``high``, by k robust scales."""
    out = df
    reasons = []
    for m, side in metrics.items():
        s = robust_scale(df, by, m).select(*by, F.col("median").alias(f"_m_{m}"), F.col("scale").alias(f"_s_{m}"))
        out = out.join(s, by)
        z = (F.col(m) - F.col(f"_m_{m}")) / F.col(f"_s_{m}")
        reasons.append(F.when(z < -k if side == "low" else z > k, F.lit(f"{m} {side}")))
    listed = F.array_compact(F.array(*reasons))
    return out.select(*df.columns, F.array_join(listed, "; ").alias("reasons"), F.size(listed).alias("n_reasons"))


def stratify(df: DataFrame, by: list[str], strata: Column, col: str, least: int) -> DataFrame:
    """n, median and mean of a column in each stratum of ``least`` rows or more."""
    agg = df.withColumn("stratum", strata).groupBy(*by, "stratum").agg(F.count(col).alias("n"), F.percentile(col, F.lit(0.5)).alias("median"), F.avg(col).alias("mean"))
    return agg.where(F.col("n") >= least)


def quintiles(df: DataFrame, by: list[str], key: str, col: str, parts: int = 5) -> DataFrame:
    """Summary of ``col`` in the quantile bins of ``key``; a bin holds its lower edge, the last its upper too."""
    cuts = df.groupBy(*by).agg(F.percentile(key, F.array(*[F.lit(i / parts) for i in range(1, parts)])).alias("_e"))
    bins = df.join(cuts, by).withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col(key))))
    return bins.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.percentile(col, F.lit(0.5)).alias("median"))


def progressive(df: DataFrame, by: list[str], quality: str, col: str, thresholds: list[float]) -> DataFrame:
    """n and median of the rows at or above each threshold; a row counts for each threshold it reaches."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col(quality))
    return df.withColumn("threshold", F.explode(reached)).groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.percentile(col, F.lit(0.5)).alias("median"))


def block_stats(px: DataFrame, size: int, least: int, col: str) -> DataFrame:
    """Blocks of size x size cells with at least so many values: n, median of the column and of coherence."""
    agg = px.groupBy(F.expr(f"row div {size}").alias("block_row"), F.expr(f"col div {size}").alias("block_col"))
    return agg.agg(F.count(col).alias("n"), F.percentile(col, F.lit(0.5)).alias("median"), F.percentile("tcoh", F.lit(0.5)).alias("coherence")).where(F.col("n") >= least)


def zone_stats(px: DataFrame, by: list[str], cell_km2: float = 0.0016) -> DataFrame:
    """Cells, area, centroid, extent, velocity figures, signed peak and coherence of each zone."""
    v = "velocity"
    return px.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count("*") * cell_km2).alias("area_km2"), F.avg("row").alias("row_mean"), F.avg("col").alias("col_mean"),
        F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.95)).alias("p95"),
        F.max(F.struct(F.abs(v).alias("a"), F.col(v).alias("v"))).getField("v").alias("peak"),
        F.min("tcoh").alias("coherence_min"), F.percentile("tcoh", F.lit(0.5)).alias("coherence_median"),
    )


def rank_zones(zones: DataFrame, by: str) -> DataFrame:
    """Significance abs(median) * sqrt(area) and the names H001, H002, ... in its order; zones are few."""
    sig = zones.withColumn("significance", F.abs("median") * F.sqrt("area_km2"))
    rank = F.row_number().over(Window.orderBy(F.desc("significance"), by))
    return sig.withColumn("zone_id", F.concat(F.lit("H"), F.lpad(rank.cast("string"), 3, "0")))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks inside each group; rows with a null on either side are left out.

    Ranks belong to values, which are put in order over all tasks; rows meet them in joins, so no task holds a group.
    """
    store = Saved(df.sparkSession)
    whole = store.keep(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, F.col(a).alias("_a"), F.col(b).alias("_b")))
    ranked = whole
    for c, name in (("_a", "_ra"), ("_b", "_rb")):
        ranked = same_groups(ranked, average_ranks(whole, by, c, name, store), [*by, c])
    out = store.keep(ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("spearman"), F.corr("_a", "_b").alias("pearson")))
    store.drop(*[x for x, _ in list(store.paths.values()) if x is not out])
    return out


def agreement(df: DataFrame, by: list[str], a: str, b: str, least: int = 500) -> DataFrame:
    """Pearson, Spearman, offset and robust RMS after the medians are aligned, of groups with ``least`` pairs."""
    df = saved(df.where(f"`{a}` is not null and `{b}` is not null").select(*by, a, b))
    base = spearman(df, by, a, b).where(F.col("n") >= least)
    mid = group_quantiles(df, by, {"offset": (F.col(b) - F.col(a), 0.5)})
    dev = group_quantiles(df.join(mid, by), by, {"_mad": (F.abs(F.col(b) - F.col(a) - F.col("offset")), 0.5)})
    return base.join(mid, by).join(dev.select(*by, (1.4826 * F.col("_mad")).alias("robust_rms")), by)


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))).alias("weighted_mean"))


def seasonal_cycle(df: DataFrame, by: list[str], month: Column, value: str) -> DataFrame:
    """Range of the monthly means and the month of the largest; ties to the earlier month."""
    monthly = df.groupBy(*by, month.alias("month")).agg(F.avg(value).alias("mean"))
    return monthly.groupBy(*by).agg((F.max("mean") - F.min("mean")).alias("amplitude"), (-F.max(F.struct("mean", (-F.col("month")).alias("m"))).getField("m")).alias("peak_month"))


def class_fraction(df: DataFrame, by: list[str], cls: str, values: list) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg((F.col(cls) == v).cast("double")).alias(f"share_{v}") for v in values])


def distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def listagg(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Distinct values in order, joined by commas. A group's values must be few (platforms, orbits)."""
    return df.groupBy(*by).agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col(col).cast("string")))).alias("values"))


def support(px: DataFrame, by: list[str], value: str, epochs: int) -> DataFrame:
    return px.groupBy(*by).agg((F.count(value) / epochs).alias("support"))


def epoch_change(df: DataFrame, first: str, last: str) -> DataFrame:
    change = F.col(last) - F.col(first)
    return df.withColumn("change", change).withColumn("pct_change", 100 * change / F.nullif(F.col(first), F.lit(0.0)))


def bh_fdr(tests: DataFrame, by: list[str], p: str, q: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg in each family of tests: a null p counts as 1; all ranks up to the last that passes go."""
    w = Window.partitionBy(*by)
    filled = tests.withColumn("_p", F.coalesce(F.col(p), F.lit(1.0)))
    ranked = filled.withColumn("rank", F.row_number().over(w.orderBy("_p", *[c for c in tests.columns if c not in by]))).withColumn("m", F.count("*").over(w))
    last = F.max(F.when(F.col("_p") <= q * F.col("rank") / F.col("m"), F.col("rank"))).over(w)
    return ranked.withColumn("rejected", F.col("rank") <= F.coalesce(last, F.lit(0))).drop("_p")


def rank_pct(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*by)
    out = df.withColumn(name, F.row_number().over(w.orderBy(*order)))
    return out.withColumn(f"{name}_pct", 100 * F.col(name) / F.count("*").over(w))


def specificity(df: DataFrame, by: list[str], inside: Column, value: str) -> DataFrame:
    """Difference of the medians inside and outside, in units of the p05 to p95 range outside."""
    m = lambda c, q: F.percentile(F.when(c, F.col(value)), F.lit(q))
    agg = df.groupBy(*by).agg(m(inside, 0.5).alias("inside"), m(~inside, 0.5).alias("outside"), m(~inside, 0.05).alias("lo"), m(~inside, 0.95).alias("hi"))
    return agg.select(*by, "inside", "outside", ((F.col("inside") - F.col("outside")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).alias("separation"))


def matched_contrast(df: DataFrame, by: list[str], inside: Column, band: Column, value: str, least: int = 20) -> DataFrame:
    """Median inside minus outside in each quality band with ``least`` rows on both sides."""
    agg = df.withColumn("band", band).groupBy(*by, "band").agg(
        F.count(F.when(inside, F.col(value))).alias("n_in"), F.count(F.when(~inside, F.col(value))).alias("n_out"),
        F.percentile(F.when(inside, F.col(value)), F.lit(0.5)).alias("median_in"), F.percentile(F.when(~inside, F.col(value)), F.lit(0.5)).alias("median_out"),
    )
    return agg.where((F.col("n_in") >= least) & (F.col("n_out") >= least)).withColumn("contrast", F.col("median_in") - F.col("median_out"))


def epoch_bootstrap(series: DataFrame, by: list[str], reps: int = 200, seed: int = 1) -> DataFrame:
    """Percentiles of the rate over resampled epochs; draws are hashes, so reruns agree.

    series: by, t (years), y, i (0 .. n-1), n. A replicate with fewer than 3 distinct epochs is left out.
    """
    draws = series.select(*by, "n", F.col("i").alias("k")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    draws = draws.withColumn("i", F.pmod(F.xxhash64(*by, "rep", "k", F.lit(seed)), F.col("n")))
    rates = draws.join(series.select(*by, "i", "t", "y"), [*by, "i"]).groupBy(*by, "rep").agg(F.regr_slope("y", "t").alias("rate"), F.countDistinct("i").alias("distinct")).where("distinct >= 3")
    return rates.groupBy(*by).agg(F.count("*").alias("reps"), F.percentile("rate", F.lit(0.025)).alias("lo"), F.percentile("rate", F.lit(0.5)).alias("mid"), F.percentile("rate", F.lit(0.975)).alias("hi"), F.stddev_samp("rate").alias("se"))


def block_permutation(pairs: DataFrame, by: list[str], block_rows: int = 90, reps: int = 5000, seed: int = 0, chunk: int = 500, block_days: int | None = None, circular: bool = False, least: int = 40) -> DataFrame:
    """Two-sided p of Spearman's rank correlation when blocks of one side's rows are permuted; null under ``least`` rows.

    The rows are cut into max(2, n div block_rows) consecutive blocks, sizes at most one apart; p is the share of
    permutations with a correlation at least as large in size. pairs: by, i (order), a, b. With ``block_days``, i counts
    days and a block holds the rows of so many days from the first on, however many; with ``circular``, blocks are cut from
    a row drawn anew each time, and what lies before it follows the end. Each (test, chunk of replicates) is a group of its own, so replicates spread over
    tasks; a test's rows are one series of bounded length.
    """
    import numpy as np
    import pandas as pd

    fields = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*by).dtypes) + ", n long, rho double, hits long, reps long"

    def run(pdf):
        pdf = pdf.sort_values("i")
        rank = lambda x: pd.Series(x).rank().to_numpy()
        a, b = rank(pdf["a"].to_numpy()), rank(pdf["b"].to_numpy())
        n, first = len(a), int(pdf["chunk"].iloc[0]) * chunk
        if n < least or np.std(a) == 0 or np.std(b) == 0:
            return pd.DataFrame([[*pdf[by].iloc[0], n, None, 0, 0]], columns=[*by, "n", "rho", "hits", "reps"])
        rho, rng, hits = np.corrcoef(a, b)[0, 1], np.random.default_rng([seed, first]), 0
        day = pdf["i"].to_numpy(float)

        def cut(start):
            rows = (np.arange(n) + start) % n
            if block_days is None:
                return np.array_split(rows, max(2, n // block_rows))
            gone = day[rows] - day[start] + np.where(rows < start, day[-1] - day[0] + 1, 0)
            number = np.floor(gone / block_days)
            return np.split(rows, np.flatnonzero(np.diff(number)) + 1)

        blocks = cut(0)
        todo = min(chunk, reps - first)
        for _ in range(todo):
            blocks = cut(int(rng.integers(n))) if circular else blocks
            order = np.concatenate([blocks[k] for k in rng.permutation(len(blocks))])
            hits += abs(np.corrcoef(a[order], b)[0, 1]) >= abs(rho) - 1e-12
        return pd.DataFrame([[*pdf[by].iloc[0], n, rho, hits, todo]], columns=[*by, "n", "rho", "hits", "reps"])

    chunks = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // chunk)))
    parts = pairs.select(*by, "i", "a", "b", chunks.alias("chunk")).groupBy(*by, "chunk").applyInPandas(run, fields)
    total = parts.groupBy(*by).agg(F.first("n").alias("n"), F.first("rho").alias("spearman"), F.sum("hits").alias("hits"), F.sum("reps").alias("reps"))
    return total.withColumn("p", F.when(F.col("reps") > 0, F.col("hits") / F.col("reps")))
