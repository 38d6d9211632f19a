"""Station and zone time series: quality, rates, seasonal and step fits, lags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linear_rate(df: DataFrame, by: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """Least-squares rate, intercept, residual RMS, and the rate's deviation (n - 2 degrees of freedom)."""
    agg = df.where(f"{t} is not null and {y} is not null").groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope(y, t).alias("rate"), F.regr_intercept(y, t).alias("intercept"),
        F.regr_sxx(y, t).alias("sxx"), F.regr_syy(y, t).alias("syy"), F.regr_sxy(y, t).alias("sxy"),
    )
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0)))
    return agg.select(*by, "n", "rate", "intercept", F.sqrt(rss / F.col("n")).alias("rms"), F.when(F.col("n") > 2, F.sqrt(rss / (F.col("n") - 2) / F.col("sxx"))).alias("rate_sigma"))


def weighted_rate(df: DataFrame, by: list[str], t: str = "t", y: str = "y", sigma: str = "sigma") -> DataFrame:
    """Rate weighted by 1/sigma^2 with its formal deviation.

    A sigma of 0 or less is none. With fewer than max(10, n/2) sigmas all weights are 1; otherwise gaps get the
    median sigma.
    """
    whole = df.where(f"{t} is not null and {y} is not null").withColumn("_s", F.when(F.col(sigma) > 0, F.col(sigma)))
    stat = whole.groupBy(*by).agg(F.count("*").alias("n"), F.count("_s").alias("_v"), F.percentile("_s", F.lit(0.5)).alias("_m"))
    w = F.when(F.col("_v") < F.greatest(F.lit(10.0), F.col("n") / 2), 1.0).otherwise(1 / F.pow(F.coalesce("_s", "_m"), 2))
    weighted = whole.join(stat, by).withColumn("w", w)
    mid = weighted.groupBy(*by).agg(F.first("n").alias("n"), F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col(t)) / F.sum("w")).alias("tm"), (F.sum(F.col("w") * F.col(y)) / F.sum("w")).alias("ym"))
    dt, dy = F.col(t) - F.col("tm"), F.col(y) - F.col("ym")
    out = weighted.drop("n").join(mid, by).groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("w") * dt * dt).alias("sxx"), F.sum(F.col("w") * dt * dy).alias("sxy"))
    return out.select(*by, "n", (F.col("sxy") / F.nullif(F.col("sxx"), F.lit(0.0))).alias("rate"), (1 / F.sqrt(F.nullif(F.col("sxx"), F.lit(0.0)))).alias("rate_sigma"))


def seasonal_fit(df: DataFrame, by: list[str], t: str = "t", y: str = "y", sigma: str | None = None) -> DataFrame:
    """Rate, annual and semi-annual amplitudes, RMS, the rate's deviation and reduced chi-square of each series.

    Rows weigh 1 / sigma^2, a sigma being 1e-9 at least; without a sigma column all weigh 1.

    Spark sums the 6 x 6 normal equations of every series in one aggregation; only the small systems, a row for each
    series, are solved in numpy.
    """
    w = 2 * 3.141592653589793
    mid = df.where(f"{t} is not null and {y} is not null").groupBy(*by).agg(F.avg(t).alias("_t0"))
    base = df.where(f"{t} is not null and {y} is not null").join(mid, by)
    terms = [F.lit(1.0), F.col(t) - F.col("_t0"), F.cos(w * F.col(t)), F.sin(w * F.col(t)), F.cos(2 * w * F.col(t)), F.sin(2 * w * F.col(t))]
    weight = F.lit(1.0) if sigma is None else 1 / F.pow(F.greatest(F.col(sigma), F.lit(1e-9)), 2)
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    aggs = [F.sum(w_ * terms[i] * terms[j]).alias(f"{n}a{i}{j}") for n, w_ in (("w", weight), ("u", F.lit(1.0))) for i, j in pairs]
    aggs += [F.sum(w_ * terms[i] * F.col(y)).alias(f"{n}b{i}") for n, w_ in (("w", weight), ("u", F.lit(1.0))) for i in range(6)]
    sums = base.groupBy(*by).agg(F.count("*").alias("n"), F.sum(weight * F.col(y) * F.col(y)).alias("wyy"), F.sum(F.col(y) * F.col(y)).alias("uyy"), *aggs)

    def square(values) -> np.ndarray:
        m = np.zeros((6, 6))
        m[np.triu_indices(6)] = values
        return m + np.triu(m, 1).T

    @F.pandas_udf("struct<rate double, annual double, semiannual double, rms double, rate_sigma double, chi2 double>")
    def solve(wa: pd.Series, wb: pd.Series, wyy: pd.Series, ua: pd.Series, ub: pd.Series, uyy: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, q, a1, b1, q1, k in zip(wa, wb, wyy, ua, ub, uyy, n, strict=True):
            m = square(a)
            if k < 7 or np.linalg.matrix_rank(m) < 6:
                out.append((None,) * 6)
                continue
            cov = np.linalg.inv(m)
            x = cov @ np.array(b)
            rest = max(0.0, q1 - 2 * x @ np.array(b1) + x @ square(a1) @ x)  # residuals count alike in the RMS
            out.append((x[1], float(np.hypot(x[2], x[3])), float(np.hypot(x[4], x[5])), float(np.sqrt(rest / k)), float(np.sqrt(cov[1, 1])), max(0.0, q - x @ np.array(b)) / max(1, k - 6)))
        return pd.DataFrame(out, columns=["rate", "annual", "semiannual", "rms", "rate_sigma", "chi2"], dtype=float)

    cols = [F.array(*[F.col(f"{n}{c}") for c in cs]) for n in "wu" for cs in ([f"a{i}{j}" for i, j in pairs], [f"b{i}" for i in range(6)])]
    solved = solve(cols[0], cols[1], F.col("wyy"), cols[2], cols[3], F.col("uyy"), F.col("n"))
    return sums.select(*by, "n", solved.alias("f")).select(*by, "n", "f.*")


def step_fit(df: DataFrame, by: list[str], t: str = "t", y: str = "y", margin: int = 4) -> DataFrame:
    """Rate plus the one step that leaves the least residual; steps lie ``margin`` rows or more from either end.

    With a step at index k the model is y = a + r t + s [i >= k]. Residuals of y and of the step on (1, t) follow from
    running sums, so each candidate costs one row, not a pass over its series.
    """
    w = Window.partitionBy(*by).orderBy(t)
    rows = df.where(f"{t} is not null and {y} is not null").withColumn("i", F.row_number().over(w) - 1)
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("n", F.count("*").over(whole)).withColumn("_t", F.col(t) - F.avg(t).over(whole)).withColumn("_y", F.col(y) - F.avg(y).over(whole))
    rows = rows.withColumn("sxx", F.sum(F.col("_t") * F.col("_t")).over(whole)).withColumn("sxy", F.sum(F.col("_t") * F.col("_y")).over(whole)).withColumn("syy", F.sum(F.col("_y") * F.col("_y")).over(whole))
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("h", (F.col("n") - F.col("i")).cast("double")).withColumn("ht", F.sum("_t").over(ahead)).withColumn("hy", F.sum("_y").over(ahead))
    # The step, centred and freed of the trend: its own square, and its product with y freed of the trend.
    hh = F.col("h") - F.col("h") * F.col("h") / F.col("n") - F.col("ht") * F.col("ht") / F.col("sxx")
    hy = F.col("hy") - F.col("ht") * F.col("sxy") / F.col("sxx")
    rss0 = F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")
    cand = rows.where((F.col("i") >= margin) & (F.col("i") < F.col("n") - margin)).withColumn("step", hy / hh).withColumn("rss", F.greatest(F.lit(0.0), rss0 - hy * hy / hh)).withColumn("rss0", rss0)
    best = cand.groupBy(*by).agg(F.min(F.struct("rss", "i", F.col(t).alias("at"), "step", "n", "rss0")).alias("b"))
    return best.select(*by, F.col("b.n").alias("n"), F.col("b.i").alias("index"), F.col("b.at").alias("at"), F.col("b.step").alias("step"), F.sqrt(F.col("b.rss") / F.col("b.n")).alias("rms"), F.sqrt(F.greatest(F.lit(0.0), F.col("b.rss0")) / F.col("b.n")).alias("rms_linear"))


def detrend(df: DataFrame, by: list[str], t: str = "t", y: str = "y") -> DataFrame:
    fit = df.groupBy(*by).agg(F.regr_slope(y, t).alias("_r"), F.regr_intercept(y, t).alias("_c"))
    return df.join(fit, by).withColumn("residual", F.col(y) - F.col("_r") * F.col(t) - F.col("_c")).drop("_r", "_c")


def oscillation(df: DataFrame, by: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """p97.5 minus p2.5 of the detrended series."""
    return detrend(df, by, t, y).groupBy(*by).agg((F.percentile("residual", F.lit(0.975)) - F.percentile("residual", F.lit(0.025))).alias("amplitude"))


def group_structure(df: DataFrame, series: str, group: str, t: str, y: str) -> DataFrame:
    """Median correlation of detrended series inside and between groups, and what it says.

    Series pairs meet on their epochs; a pair is one row afterwards. The number of series (zones) is small.
    """
    flat = detrend(df, [series], t, y).select(F.col(series).alias("s"), F.col(group).alias("g"), F.col(t).alias("t"), "residual")
    other = flat.select(F.col("s").alias("s2"), F.col("g").alias("g2"), "t", F.col("residual").alias("r2"))
    pairs = flat.join(other, "t").where("s < s2").groupBy("s", "s2").agg(F.corr("residual", "r2").alias("r"), F.first(F.col("g") == F.col("g2")).alias("within"))
    agg = pairs.agg(F.percentile(F.when(F.col("within"), F.col("r")), F.lit(0.5)).alias("within"), F.percentile(F.when(~F.col("within"), F.col("r")), F.lit(0.5)).alias("between"))
    verdict = F.when(F.col("between") > 0.5, "common_mode").when((F.col("within") - F.col("between") >= 0.3) & (F.col("between") < 0), "survives").otherwise("unclear")
    return agg.withColumn("verdict", verdict)


def _inversions(rank: np.ndarray) -> int:
    """Pairs of places of which the later has the lower rank; ranks are 0 .. n-1."""
    n, total, wide = len(rank), 0, 1
    while wide < n:
        block = np.arange(n) // (2 * wide)
        order = np.argsort(block * n + rank, kind="stable")
        left = (order // wide) % 2 == 0
        before = np.cumsum(left) - left
        starts = np.searchsorted(block, np.arange(block[-1] + 1))
        in_block = block[order]
        lefts = np.bincount(block, weights=(np.arange(n) // wide % 2 == 0), minlength=block[-1] + 1).astype(np.int64)
        total += int((lefts[in_block] - (before - before[starts][in_block]))[~left].sum())
        wide *= 2
    return total


def _swapped(first: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members whose order differs between two orders, given as places of members."""
    n, wide, a, b = len(first), 1, [], []
    rank = np.empty(n, np.int64)
    rank[then] = np.arange(n)
    at = first.copy()
    while wide < n:
        block = np.arange(n) // (2 * wide)
        left = np.arange(n) // wide % 2 == 0
        order = np.argsort(block * n + rank[at], kind="stable")
        here, is_left, in_block = at[order], left[order], block[order]
        upto = np.cumsum(is_left)
        lefts = np.flatnonzero(is_left)
        ends = np.searchsorted(in_block[lefts], in_block, side="right")
        count = np.where(is_left, 0, ends - upto)
        later = np.repeat(np.arange(n), count)
        offset = np.arange(len(later)) - np.repeat(np.cumsum(count) - count, count)
        a.append(here[lefts[upto[later] + offset]])
        b.append(here[later])
        at = here
        wide *= 2
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def median_slope(t: np.ndarray, y: np.ndarray, few: int = 1_000_000) -> float | None:
    """The median of (y2 - y1) / (t2 - t1) over all pairs with t1 < t2; None without any.

    Up to ``few`` slopes are taken one by one. Beyond, slopes under s are as many as the pairs whose order by y - s t is
    against that of t, counted by merging; s is moved until few slopes lie between two such bounds about the median, and
    only these are listed. If more than few agree to 14 digits, their common value is given. The work grows as n log^2 n.
    """
    order = np.lexsort((y, t))
    t, y = t[order], y[order]
    n = len(t)
    times = np.unique(t, return_counts=True)[1] if n else np.zeros(0, np.int64)
    pairs = n * (n - 1) // 2 - int((times * (times - 1) // 2).sum())
    if pairs == 0:
        return None
    low, high = (pairs - 1) // 2, pairs // 2

    def slopes(i, j):
        i, j = np.where(t[i] <= t[j], i, j), np.where(t[i] <= t[j], j, i)
        return (y[j] - y[i]) / (t[j] - t[i])

    if n * (n - 1) // 2 <= few:
        i, j = np.triu_indices(n, 1)
        apart = t[i] < t[j]
        return float(np.median(slopes(i[apart], j[apart])))

    def by_residual(s):
        return np.lexsort((np.arange(n), t, y - s * t))

    def under(s):
        rank = np.empty(n, np.int64)
        rank[by_residual(s)] = np.arange(n)
        return _inversions(rank)

    r = np.random.default_rng(0)
    i, j = r.integers(0, n, 4000), r.integers(0, n, 4000)
    some = np.sort(slopes(i[t[i] != t[j]], j[t[i] != t[j]]))
    lo, hi = (some[len(some) * 45 // 100], some[min(len(some) - 1, len(some) * 55 // 100)]) if len(some) else (-1.0, 1.0)
    step = max(hi - lo, abs(lo) * 1e-9, abs(hi) * 1e-9, 1e-12)
    below, above = under(lo), under(hi)
    while below > low:
        lo, step = lo - step, 2 * step
        below = under(lo)
    while above <= high:
        hi, step = hi + step, 2 * step
        above = under(hi)

    def select(rank, lo, hi, below, above):
        """(slopes between two bounds in order, slopes under them): the slope of this rank is among them."""
        turn = 0
        while above - below > few and hi - lo > 1e-14 * max(abs(lo), abs(hi)):
            # Where the rank would lie if slopes were even between the bounds, a little to either side; halves in turn.
            share = (rank + 0.5 - below) / (above - below) + (0.02, -0.02, 0.0)[turn % 3]
            s = (lo + hi) / 2 if turn % 3 == 2 else lo + (hi - lo) * min(0.98, max(0.02, share))
            turn += 1
            if not lo < s < hi:
                break
            c = under(s)
            if c <= rank:
                lo, below = s, c
            else:
                hi, above = s, c
        if above - below > 8 * few:
            return None, below, (lo + hi) / 2
        return np.sort(slopes(*_swapped(by_residual(lo), by_residual(hi)))), below, None

    def value(found, below, common, rank):
        return common if common is not None else found[rank - below]

    first = select(low, lo, hi, below, above)
    one = value(*first, low)
    if high == low:
        return float(one)
    near = first[0] is not None and high - first[1] < len(first[0])
    other = value(*first, high) if near else value(*select(high, lo, hi, below, above), high)
    return float((one + other) / 2)


def theil_sen(df: DataFrame, by: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """n, slope, intercept: the median of the slopes of all row pairs, and median(y) - slope * median(t).

    A series is a group of its own and must fit a task; its slopes are selected, not listed, when there are many (see
    median_slope). Rows without t or y are left out; a series of one moment has no slope.
    """
    kinds = dict(df.dtypes)

    def run(key, pdf):
        at, v = pdf["_t"].to_numpy(float), pdf["_y"].to_numpy(float)
        slope = median_slope(at, v)
        return pd.DataFrame([[*key, len(at), slope, None if slope is None else float(np.median(v) - slope * np.median(at))]], columns=[*by, "n", "slope", "intercept"])

    rows = df.where(f"{t} is not null and {y} is not null").select(*by, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"))
    return rows.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", n long, slope double, intercept double")


def split_half_rates(df: DataFrame, by: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """Rate of the first n div 2 rows and of the rest, and whether they differ by over a quarter of the whole rate."""
    w = Window.partitionBy(*by)
    half = F.when(F.row_number().over(w.orderBy(t)) <= F.floor(F.count("*").over(w) / 2), 1).otherwise(2)
    rows = df.withColumn("half", half)
    agg = rows.groupBy(*by).agg(F.regr_slope(y, t).alias("rate"), F.regr_slope(F.when(F.col("half") == 1, F.col(y)), F.col(t)).alias("first"), F.regr_slope(F.when(F.col("half") == 2, F.col(y)), F.col(t)).alias("second"))
    return agg.withColumn("differs", F.abs(F.col("first") - F.col("second")) > 0.25 * F.abs("rate"))


def trend_table(df: DataFrame, by: list[str], t: str = "t", y: str = "y", per: float = 365.25) -> DataFrame:
    """Theil-Sen slopes of the whole series, its first n div 2 rows and the rest, times ``per`` (days of t in a year)."""
    w = Window.partitionBy(*by)
    first = F.row_number().over(w.orderBy(t)) <= F.floor(F.count("*").over(w) / 2)
    halves = df.where(f"{t} is not null and {y} is not null").withColumn("_part", F.when(first, "first").otherwise("second"))
    parts = halves.withColumn("_part", F.explode(F.array(F.lit("full"), "_part")))
    slopes = theil_sen(parts, [*by, "_part"], t, y)
    one = lambda p: (F.max(F.when(F.col("_part") == p, F.col("slope"))) * per).alias(p)
    return slopes.groupBy(*by).agg(F.max("n").alias("n"), one("full"), one("first"), one("second"))


def cumulative(df: DataFrame, by: list[str], date: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg((F.max_by(value, date) - F.min_by(value, date)).alias("cumulative"))


def largest_steps(df: DataFrame, by: list[str], t: str, y: str, k: int = 3) -> DataFrame:
    """The k largest absolute changes from one row to the next; ties to the earlier row."""
    w = Window.partitionBy(*by)
    step = df.withColumn("step", F.col(y) - F.lag(y).over(w.orderBy(t))).where("step is not null")
    return step.withColumn("rank", F.row_number().over(w.orderBy(F.desc(F.abs("step")), t))).where(F.col("rank") <= k).select(*by, t, "step", "rank")


def rolling_median(df: DataFrame, by: list[str], order: str, col: str, rows: int = 51, least: int = 12) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows // 2), rows // 2)
    return df.withColumn("rolling", F.when(F.count(col).over(w) >= least, F.percentile(col, F.lit(0.5)).over(w)))


def zone_series(epoch_px: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median and half the interquartile range over each zone's cells at each date."""
    q = lambda p: F.percentile(value, F.lit(p))
    return epoch_px.groupBy(*by).agg(F.count(value).alias("n"), q(0.5).alias("median"), ((q(0.75) - q(0.25)) / 2).alias("half_iqr"))


def daily_series(obs: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Median of each station's day if it has ``least`` values."""
    return obs.where("value is not null").groupBy(*by, F.to_date("ts").alias("date")).agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("median")).where(F.col("n") >= least)


def anomaly(daily: DataFrame, by: list[str], value: str = "median") -> DataFrame:
    return daily.withColumn("anomaly", F.col(value) - F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*by)))


def composite(anomalies: DataFrame, by: list[str], station: str, floor_: int = 2) -> DataFrame:
    """Median anomaly of a zone's stations on dates that half of them, and at least ``floor_``, have."""
    stations = anomalies.groupBy(*by).agg(F.countDistinct(station).alias("stations"))
    daily = anomalies.groupBy(*by, "date").agg(F.count("*").alias("n"), F.percentile("anomaly", F.lit(0.5)).alias("composite"))
    return daily.join(stations, by).where(F.col("n") >= F.greatest(0.5 * F.col("stations"), F.lit(floor_)))


def loo_composite(anomalies: DataFrame, by: list[str], station: str, floor_: int = 2) -> DataFrame:
    """The composite of a zone without each of its stations in turn: by, left_out, date, n, composite, stations.

    anomalies has a row for each station and date at most. Each date is ranked once; the median without a station follows
    from its rank and the three values in the middle, so no copy of a zone is made for each station.
    """
    day = Window.partitionBy(*by, "date")
    ranked = anomalies.withColumn("_r", F.row_number().over(day.orderBy("anomaly", station))).withColumn("_n", F.count("*").over(day))
    lo = F.expr("_n div 2")  # of n - 1 others the middle ones are at n div 2 and (n - 1) div 2 + 1
    at = lambda k: F.max(F.when(F.col("_r") == lo + k, F.col("anomaly"))).alias(f"_v{k}")
    days = ranked.groupBy(*by, "date").agg(F.first("_n").alias("_n"), F.percentile("anomaly", F.lit(0.5)).alias("_whole"), *[at(k) for k in range(3)])
    left = anomalies.select(*by, F.col(station).alias("left_out")).distinct().withColumn("stations", F.count("*").over(Window.partitionBy(*by)) - 1)
    own = ranked.select(*by, "date", F.col(station).alias("left_out"), "_r")
    rows = left.join(days, by).join(own, [*by, "date", "left_out"], "left")
    value = lambda k: F.when(F.col("_r") <= lo + k, F.col(f"_v{k + 1}")).otherwise(F.col(f"_v{k}"))
    upper = F.when(F.col("_n") % 2 == 1, value(1)).otherwise(value(0))
    n = F.when(F.col("_r").isNull(), F.col("_n")).otherwise(F.col("_n") - 1)
    out = rows.select(*by, "left_out", "date", n.alias("n"), F.when(F.col("_r").isNull(), F.col("_whole")).otherwise((value(0) + upper) / 2).alias("composite"), "stations")
    return out.where(F.col("n") >= F.greatest(0.5 * F.col("stations"), F.lit(floor_)))


def sensor_flags(obs: DataFrame, by: list[str], jump: float = 10.0) -> DataFrame:
    """Shares of zeros and of values like the one before (of all rows), jumps, repeated times."""
    w = Window.partitionBy(*by).orderBy("ts", "value")
    d = F.col("value") - F.lag("value").over(w)
    rows = obs.withColumn("_d", d).withColumn("_r", (F.col("ts") == F.lag("ts").over(w)).cast("int"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col("value") == 0).cast("double")).alias("zero_fraction"), F.avg(F.coalesce((F.col("_d") == 0).cast("double"), F.lit(0.0))).alias("constant_fraction"),
        F.coalesce(F.sum((F.abs("_d") > jump).cast("int")), F.lit(0)).alias("jumps"), F.coalesce(F.sum("_r"), F.lit(0)).alias("repeated_times"),
    )


def interval_audit(obs: DataFrame, by: list[str]) -> DataFrame:
    """Gaps between readings in hours, and the share of readings that the median gap would give."""
    w = Window.partitionBy(*by).orderBy("ts")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 3.6e9
    q = lambda p: F.percentile("gap", F.lit(p))
    agg = obs.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("gap", gap).groupBy(*by).agg(
        F.count("*").alias("n"), F.min("gap").alias("gap_min"), q(0.5).alias("gap_median"), q(0.99).alias("gap_p99"), F.max("gap").alias("gap_max"),
        ((F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 3.6e9).alias("hours"),
    )
    return agg.withColumn("observed_ratio", F.col("n") / (F.col("hours") / F.nullif(F.col("gap_median"), F.lit(0.0)) + 1))


def station_qc(obs: DataFrame, by: list[str], rules: dict) -> DataFrame:
    """Class of each station: dead, insufficient, gaps or pass, the first that applies.

    rules: constant_max, zero_max, min_days, max_gap_days.
    """
    flags = sensor_flags(obs, by)
    days = obs.where("value is not null").select(*by, F.to_date("ts").alias("date")).distinct()
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*by).orderBy("date")))
    span = days.withColumn("gap", gap).groupBy(*by).agg(F.count("*").alias("days"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"))
    qc = (
        F.when((F.col("constant_fraction") > rules["constant_max"]) | (F.col("zero_fraction") > rules["zero_max"]), "dead")
        .when(F.coalesce("days", F.lit(0)) < rules["min_days"], "insufficient").when(F.col("max_gap") > rules["max_gap_days"], "gaps").otherwise("pass")
    )
    return flags.join(span, by, "left").withColumn("qc", qc)


def temporal_profile(dates: DataFrame, by: list[str]) -> DataFrame:
    """Span, median revisit, largest gap and gaps over 36 days."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*by).orderBy("date")))
    return dates.withColumn("gap", gap).groupBy(*by).agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.percentile("gap", F.lit(0.5)).alias("revisit_median"),
        F.max("gap").alias("gap_max"), F.coalesce(F.sum((F.col("gap") > 36).cast("int")), F.lit(0)).alias("gaps_over_36"),
    )


def monthly_lags(a: DataFrame, b: DataFrame, by: list[str], lags: int = 3, least: int = 13) -> DataFrame:
    """Correlation of a's month with b's value lag months before; a, b: by, month (date), value."""
    shifted = b.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), F.col("month").alias("_m"), F.col("value").alias("vb"))
    shifted = shifted.select("lag", F.add_months("_m", F.col("lag")).alias("month"), "vb")
    return a.join(shifted, "month").groupBy(*by, "lag").agg(F.count("*").alias("n"), F.corr("value", "vb").alias("r")).where(F.col("n") >= least)


def lag_correlation(matched: DataFrame, zones: DataFrame, least: int = 40) -> DataFrame:
    """Spearman and Pearson of detrended zone and lagged series for each zone, series and lag with enough matches.

    matched: series_id, epoch, lag, median; zones: zone, epoch, t, y.
    """
    from .stats import spearman

    key = ["zone", "series_id", "lag"]
    both = matched.where("median is not null").join(zones, "epoch").select(*key, "t", "y", "median")
    ya, yb = (theil_sen(both, key, "t", c).select(*key, F.col("slope").alias(f"s_{c}"), F.col("intercept").alias(f"c_{c}")) for c in ("y", "median"))
    flat = both.join(ya, key).join(yb, key).select(*key, (F.col("y") - F.col("s_y") * F.col("t") - F.col("c_y")).alias("ry"), (F.col("median") - F.col("s_median") * F.col("t") - F.col("c_median")).alias("rm"))
    return spearman(flat, key, "ry", "rm").where(F.col("n") >= least)
