"""Acquisition pairs and the joins around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_pairs(acq: DataFrame, max_days: int = 36, max_perp: float = 250.0) -> DataFrame:
    """Pairs of dates of one burst, at most ``max_days`` and ``max_perp`` metres apart, reference before secondary.

    acq: burst, date, perp. The range condition becomes an equi-join on day buckets as wide as the range: a later
    date looks in its own bucket and the one before, so each pair is met once and no nested loop is planned.
    """
    day = F.datediff("date", F.lit("1970-01-01"))
    side = acq.select("burst", "date", "perp", F.floor(day / max_days).alias("bucket"))
    early = side.select("burst", "bucket", F.col("date").alias("ref"), F.col("perp").alias("ref_perp"))
    late = side.select("burst", F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"), F.col("date").alias("sec"), F.col("perp").alias("sec_perp"))
    days = F.datediff("sec", "ref")
    out = early.join(late, ["burst", "bucket"]).where((F.col("ref") < F.col("sec")) & (days <= max_days))
    out = out.select("burst", "ref", "sec", days.alias("days"), (F.col("sec_perp") - F.col("ref_perp")).alias("dperp"))
    return out.where(F.abs("dperp") <= max_perp)


def identity_intersection(cands: DataFrame, k: int) -> DataFrame:
    """Pairs that all ``k`` bursts have, with the largest absolute perpendicular difference."""
    agg = cands.groupBy("ref", "sec").agg(F.countDistinct("burst").alias("n"), F.first("days").alias("days"), F.max(F.abs("dperp")).alias("max_perp"))
    return agg.where(F.col("n") == k).select("ref", "sec", "days", "max_perp")


def attach_scenes(pairs: DataFrame, scenes: DataFrame) -> DataFrame:
    """The scene names of both ends of each (burst, ref, sec); scenes: burst, date, scene."""
    ref = scenes.select("burst", F.col("date").alias("ref"), F.col("scene").alias("ref_scene"))
    sec = scenes.select("burst", F.col("date").alias("sec"), F.col("scene").alias("sec_scene"))
    return pairs.join(ref, ["burst", "ref"]).join(sec, ["burst", "sec"])


def pair_payloads(pairs: DataFrame, n_bursts: int, max_days: int = 36) -> DataFrame:
    """One row for each pair: bursts with their scenes in order, spread of the baseline, and rules it breaks.

    pairs: burst, ref, sec, days, dperp, ref_scene, sec_scene.
    """
    agg = pairs.groupBy("ref", "sec").agg(
        F.array_sort(F.collect_list(F.struct("burst", "ref_scene", "sec_scene"))).alias("bursts"),
        F.first("days").alias("days"), F.min("dperp").alias("perp_min"), F.max("dperp").alias("perp_max"),
        F.max(F.abs("dperp")).alias("perp_max_abs"), F.percentile("dperp", F.lit(0.5)).alias("perp_median"),
    )
    rules = F.array(
        F.when(F.size("bursts") != n_bursts, F.lit("burst count")),
        F.when(F.col("ref") >= F.col("sec"), F.lit("date order")),
        F.when(F.col("days") > max_days, F.lit("days")),
        F.when(F.size(F.array_distinct(F.transform("bursts", lambda b: b["burst"]))) != F.size("bursts"), F.lit("repeated burst")),
    )
    return agg.withColumn("violations", F.array_compact(rules))


def validate_baselines(base: DataFrame) -> DataFrame:
    """Accept a baseline only if its days are the true offset from the reference and its state vectors exist.

    base: reference, date, temporal_days, perp, has_state_vectors. Adds accepted and reason.
    """
    reason = (
        F.when(~F.coalesce("has_state_vectors", F.lit(False)), "no state vectors")
        .when(F.col("perp").isNull(), "no baseline")
        .when(F.col("temporal_days") != F.datediff("date", "reference"), "rebased")
    )
    return base.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def nearest_join(a: DataFrame, b: DataFrame, tol_days: int, key: list[str] | None = None) -> DataFrame:
    """Each row of a (…, date) with the nearest date of b within the tolerance; of two as near, the earlier.

    Days of b are spread over the tolerance, so the join is on equal days.
    """
    key = key or []
    spread = b.select(*key, F.col("date").alias("match"), F.explode(F.sequence(F.date_sub("date", tol_days), F.date_add("date", tol_days))).alias("date"))
    gap = F.abs(F.datediff("match", "date"))
    best = spread.groupBy(*key, "date").agg(F.min(F.struct(gap.alias("gap"), "match")).alias("best"))
    return a.join(best, [*key, "date"], "left").withColumn("match", F.col("best.match")).withColumn("gap", F.col("best.gap")).drop("best")


def lag_window_match(series: DataFrame, epochs: DataFrame, lags: list[int], half: int = 3, least: int = 4) -> DataFrame:
    """Median of the daily values in lag days before each epoch, half days either way; null under ``least`` values.

    series: series_id, date, value; epochs: epoch (date).
    """
    wanted = epochs.select("epoch", F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    days = wanted.select("epoch", "lag", F.explode(F.sequence(F.expr(f"date_sub(epoch, lag + {half})"), F.expr(f"date_sub(epoch, lag - {half})"))).alias("date"))
    agg = days.join(series.where("value is not null"), "date").groupBy("series_id", "epoch", "lag").agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"))
    return agg.withColumn("median", F.when(F.col("n") >= least, F.col("median")))


def semi(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def anti(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def enrich(rows: DataFrame, extra: DataFrame, on: list[str], prefix: str = "x_") -> DataFrame:
    """Left join; columns of ``extra`` that rows has too get a prefix, never a silent suffix."""
    clash = set(rows.columns) & set(extra.columns) - set(on)
    named = extra.select(*[F.col(c).alias(prefix + c) if c in clash else F.col(c) for c in extra.columns])
    return rows.join(named, on, "left")


def set_diff(expected: DataFrame, got: DataFrame, on: list[str]) -> DataFrame:
    """Keys of either side with state ``both``, ``missing`` (expected only) or ``unexpected``."""
    a = expected.select(*on).distinct().withColumn("_e", F.lit(True))
    b = got.select(*on).distinct().withColumn("_g", F.lit(True))
    state = F.when(F.col("_g").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("both")
    return a.join(b, on, "full_outer").select(*on, state.alias("state"))


def pair_model(pair_px: DataFrame, epoch_px: DataFrame) -> DataFrame:
    """Displacement change between the two epochs of each pair pixel: two equi-joins on (row, col, date)."""
    ref = epoch_px.select("row", "col", F.col("date").alias("ref"), F.col("disp_m").alias("ref_disp"))
    sec = epoch_px.select("row", "col", F.col("date").alias("sec"), F.col("disp_m").alias("sec_disp"))
    return pair_px.join(ref, ["row", "col", "ref"]).join(sec, ["row", "col", "sec"]).withColumn("ddisp", F.col("sec_disp") - F.col("ref_disp"))


def scenarios(px: DataFrame, grid: DataFrame) -> DataFrame:
    """Pixels that pass each scenario (scenario_id, coherence_min, threshold); the planner sends the grid to all tasks if it is small."""
    return px.join(grid, (px["tcoh"] >= grid["coherence_min"]) & (F.abs(px["velocity"]) >= grid["threshold"]))


def presence_matrix(acq: DataFrame, bursts: list[str]) -> DataFrame:
    """date, one 0/1 column for each burst, burst_count, complete and the missing bursts."""
    wide = acq.groupBy("date").pivot("burst", bursts).agg(F.max(F.lit(1)))
    wide = wide.select("date", *[F.coalesce(F.col(b), F.lit(0)).alias(b) for b in bursts])
    count = sum((F.col(b) for b in bursts[1:]), F.col(bursts[0]))
    missing = F.concat_ws(",", *[F.when(F.col(b) == 0, F.lit(b)) for b in bursts])
    return wide.withColumn("burst_count", count).withColumn("complete", F.col("burst_count") == len(bursts)).withColumn("missing_bursts", missing)


def accept_acquisitions(matrix: DataFrame) -> DataFrame:
    """Complete dates are accepted, all others excluded with a reason."""
    reason = F.when(~F.col("complete"), F.concat(F.lit("missing "), F.col("missing_bursts")))
    return matrix.select("date", "burst_count", F.col("complete").alias("accepted"), reason.alias("reason"))


def gap_days(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Days since the row before, null for the first. Without ``by``, dates must be few (one network)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("date")
    return rows.withColumn("previous_date", F.lag("date").over(w)).withColumn("gap_days", F.datediff("date", "previous_date"))


def pilot_picks(pairs: DataFrame, late: str = "2025-01-01", short: int = 12, middle: int = 24, long: int = 36) -> DataFrame:
    """Seven picks of pairs (ref, sec, days, max_perp) for a pilot, none used twice: pick, rationale, the pair, water_mask.

    1 the least baseline of ``short`` days, 2 the middle one (place n div 2) of ``middle`` days, 3 the one at nine tenths of
    ``long`` days; 4 the least of the monsoon (both ends June to September), 5 of the dry season (November to March), 6 of
    those that end from ``late`` on, each the first that no pick before has; 7 the first pick again without the water mask.
    Ties by dates. A rule without pairs has no row. Of each rule only as many rows as could be taken before are looked at.
    """
    at = [F.asc_nulls_last("max_perp"), "ref", "sec"]
    wet = F.month("ref").between(6, 9) & F.month("sec").between(6, 9)
    dry = F.month("ref").isin(11, 12, 1, 2, 3) & F.month("sec").isin(11, 12, 1, 2, 3)
    rule = [(1, "lowest baseline, short", F.col("days") == short), (2, "median baseline, middle", F.col("days") == middle), (3, "p90 baseline, long", F.col("days") == long), (4, "monsoon", wet), (5, "dry season", dry), (6, "late period", F.col("sec") >= F.lit(late).cast("date"))]
    every = F.filter(F.array(*[F.when(c, F.struct(F.lit(k).alias("pick"), F.lit(n).alias("rationale"))) for k, n, c in rule]), lambda x: x.isNotNull())
    each = pairs.select("ref", "sec", "days", "max_perp").withColumn("r", F.explode(every)).select("r.*", "ref", "sec", "days", "max_perp")
    by = Window.partitionBy("pick")
    placed = each.withColumn("i", F.row_number().over(by.orderBy(*at)) - 1).withColumn("n", F.count("*").over(by))
    want = F.when(F.col("pick") == 2, F.expr("n div 2")).when(F.col("pick") == 3, F.expr("(9 * (n - 1)) div 10")).otherwise(F.lit(0))
    chosen = placed.where((F.col("pick") <= 3) & (F.col("i") == want))
    for k in (4, 5, 6):
        free = placed.where((F.col("pick") == k) & (F.col("i") < k)).join(chosen.select("ref", "sec"), ["ref", "sec"], "left_anti")
        first = free.withColumn("_f", F.min("i").over(by)).where("i = _f").select(*chosen.columns)
        chosen = chosen.unionByName(first)
    out = chosen.select("pick", "rationale", "ref", "sec", "days", "max_perp", F.lit(True).alias("water_mask"))
    first = out.withColumn("_f", F.min("pick").over(Window.partitionBy(F.lit(1)))).where("pick = _f")  # six rows at most
    return out.unionByName(first.select(F.lit(7).alias("pick"), F.lit("control without water mask").alias("rationale"), "ref", "sec", "days", "max_perp", F.lit(False).alias("water_mask")))


def season_of_pair(pairs: DataFrame) -> DataFrame:
    """Both ends in the monsoon (June to September), or both in the dry season (November to February)."""
    wet = F.month("ref").between(6, 9) & F.month("sec").between(6, 9)
    dry = F.month("ref").isin(11, 12, 1, 2) & F.month("sec").isin(11, 12, 1, 2)
    return pairs.withColumn("season", F.when(wet, "monsoon").when(dry, "dry").otherwise("mixed"))


def job_credit_cost(jobs: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of each scenario's jobs; costs: looks, max_bursts, cost — the least step that holds the job's bursts.

    Jobs are counted by scenario, looks and bursts first, so repeated jobs are charged each and few rows meet the costs.
    """
    kinds = jobs.groupBy("scenario", "looks", "n_bursts").agg(F.count("*").alias("jobs"))
    step = kinds.join(costs, "looks").where("n_bursts <= max_bursts").groupBy("scenario", "looks", "n_bursts", "jobs").agg(F.min_by("cost", "max_bursts").alias("cost"))
    return step.groupBy("scenario").agg(F.sum("jobs").alias("jobs"), F.sum(F.col("jobs") * F.col("cost")).alias("credits"))


def decimal_year(date: Column, variant: str = "A") -> Column:
    if variant == "A":
        return F.year(date) + (F.month(date) - 1) / 12 + (F.dayofmonth(date) - 1) / 365.25
    return F.year(date) + (F.dayofyear(date) - 1) / 365.25
