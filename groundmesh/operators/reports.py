"""Tables that finish an analysis: zone comparison and placement, oscillation links, sampling registry, document audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import saved
from .quantiles import group_quantiles


def _median(c) -> Column:
    return F.percentile(c, F.lit(0.5))


def _mean(c: str) -> Column:
    """The mean of a double column from the exact sum, rounded once, so it does not hang on the order in which rows meet.

    Each value goes as two whole numbers: its part above 2^-20 and the rest in units of 2^-73, below which nothing counts. A group
    with a value of 2^20 or more, an infinite one or NaN has the plain mean.
    """
    fits = F.abs(c) < 2.0**20
    scaled = F.when(fits, F.col(c) * 2.0**20)
    top = F.floor(scaled)
    low = F.floor((scaled - top) * 2.0**53)
    whole = lambda x: F.sum(x.cast("decimal(20,0)"))
    total = (whole(top) * F.lit(1 << 53).cast("decimal(16,0)") + whole(low)).cast("double") * 2.0**-73
    return F.when(F.max(F.abs(c)) < 2.0**20, total / F.count(c)).otherwise(F.avg(c))


def zone_comparison(zone_px: DataFrame, other: DataFrame, kept: DataFrame | None = None, cell_km: float = 0.04, least: int = 5) -> DataFrame:
    """Each zone against a second stack: common cells, quartiles and scatter of both, sign, ratio, and its best counterpart.

    zone_px: zone, row, col, a, a_std, a_tcoh of all cells of the zones (a null where the first stack has none); other: row, col,
    b, b_std, b_tcoh, label (null outside the second stack's zones). The counterpart is the label with most of the zone's
    cells, ties to the least; ``kept`` (label) tells which count as detected, all if unset. Zones of fewer than ``least``
    common cells have counts only.
    """
    z = zone_px.select("zone", "row", "col", "a", "a_std", "a_tcoh")
    j = z.join(other.select("row", "col", "b", "b_std", "b_tcoh", "label"), ["row", "col"], "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    c = lambda x: F.when(both, F.col(x))
    q = lambda x, p: F.percentile(c(x), F.lit(p))
    agg = j.groupBy("zone").agg(
        F.count("*").alias("cells"), F.count(F.when(both, 1)).alias("n_common"), F.count("label").alias("labelled"), F.avg("row").alias("_r"), F.avg("col").alias("_c"),
        *[q(x, p).alias(f"{x}_{n}") for x in ("a", "b") for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))], *[q(x, 0.5).alias(x) for x in ("a_std", "b_std", "a_tcoh", "b_tcoh")],
    )
    shared = j.where("label is not null").groupBy("zone", "label").agg(F.count("*").alias("k"))
    best = shared.groupBy("zone").agg(F.max(F.struct("k", (-F.col("label")).alias("m"))).alias("x")).select("zone", "x.k", (-F.col("x.m")).alias("label"))
    size = other.where("label is not null").groupBy("label").agg(F.count("*").alias("nb"), F.avg("row").alias("_r2"), F.avg("col").alias("_c2"))
    best = best.join(size, "label")
    if kept is not None:
        best = best.join(kept.select("label", F.lit(True).alias("_kept")), "label", "left")
    else:
        best = best.withColumn("_kept", F.lit(True))
    t = agg.join(best, "zone", "left")
    enough = F.col("n_common") >= least
    told = lambda e: F.when(enough, e)
    return t.select(
        "zone", "n_common", told(F.col("n_common") / F.col("cells")).alias("valid_fraction"), *[told(F.col(x)).alias(x) for x in ("a_median", "b_median", "a_p25", "a_p75", "b_p25", "b_p75", "a_std", "b_std", "a_tcoh", "b_tcoh")],
        told(F.col("a_median") * F.col("b_median") > 0).alias("sign_agreement"), told(F.abs("b_median") / F.greatest(F.lit(1e-9), F.abs("a_median"))).alias("magnitude_ratio"),
        told(F.col("labelled") / F.col("cells")).alias("overlap_fraction"), told(F.coalesce(F.col("k") / (F.col("cells") + F.col("nb") - F.col("k")), F.lit(0.0))).alias("iou"),
        told(F.hypot(F.col("_r2") - F.col("_r"), F.col("_c2") - F.col("_c")) * cell_km).alias("centroid_offset_km"), told(F.coalesce("_kept", F.lit(False))).alias("detected"),
        told(F.abs("b_median") < 2 * F.col("b_std")).alias("b_includes_zero"),
    )


def zone_placement(px: DataFrame, by: list[str], x_first: float, y_first: float, step: float, reference: tuple[float, float]) -> DataFrame:
    """Centroid (x, y of cell centres), distance from the reference cell in km, and vertical equivalent of each zone.

    px: row, col, velocity, incidence (degrees). The vertical equivalent is the median velocity over the cosine of the mean
    incidence; near 90 degrees the last bit of that mean shows, so it is taken of the exact sum. step is the width of a cell in
    metres; rows run southward.
    """
    r, c = reference
    agg = px.groupBy(*by).agg(F.avg("row").alias("_r"), F.avg("col").alias("_c"), _median("velocity").alias("_v"), _mean("incidence").alias("incidence"))
    return agg.select(
        *by, (x_first + (F.col("_c") + 0.5) * step).alias("x"), (y_first - (F.col("_r") + 0.5) * step).alias("y"),
        (F.hypot(F.col("_r") - r, F.col("_c") - c) * step / 1000).alias("reference_km"), "incidence", (F.col("_v") / F.cos(F.radians("incidence"))).alias("vertical"),
    )


def detrend(df: DataFrame, by: list[str], t: str = "t", y: str = "y", order: int = 1) -> DataFrame:
    """``df`` with residual, what a line (order 1) or a parabola (order 2) leaves of each series.

    Powers are taken about each series' mean time and made orthogonal, so sums stay small; no line is fitted where time does
    not vary, no parabola where two times only are there.
    """
    u, v = F.col(t) - F.col("_t"), F.col(y) - F.col("_y")
    mean = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.avg(t).alias("_t"), F.avg(y).alias("_y"))
    about = df.join(mean, by)
    sums = about.where(v.isNotNull() & u.isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), *[F.sum(F.pow(u, k)).alias(f"_s{k}") for k in (2, 3, 4)], F.sum(u * v).alias("_uv"), F.sum(u * u * v).alias("_uuv"))
    zero = F.lit(0.0)
    slope = F.coalesce(F.col("_uv") / F.nullif("_s2", zero), zero)
    g, m2 = F.coalesce(F.col("_s3") / F.nullif("_s2", zero), zero), F.col("_s2") / F.col("_n")
    rest = F.col("_s4") - m2 * F.col("_s2") - g * F.col("_s3")
    bend = F.when(rest > 1e-12 * F.col("_s4"), (F.col("_uuv") - g * F.col("_uv")) / rest).otherwise(zero)
    left = v - slope * u - (bend * (u * u - m2 - g * u) if order == 2 else zero)
    return about.join(sums, by).withColumn("residual", left).select(*df.columns, "residual")


def oscillation_links(df: DataFrame, zone: str, t: str, y: str, control: str) -> DataFrame:
    """order, zone, amplitude, ratio and r to the control zone, after detrending by a line and by a parabola.

    amplitude: p97.5 - p2.5 of the residual. r: correlation over common times, null where one does not vary. ``control`` names
    the zone that is not expected to move; zones meet it on times, not each other.
    """
    out = None
    for order in (1, 2):
        res = detrend(df, [zone], t, y, order).where("residual is not null").select(zone, t, "residual")
        amp = res.groupBy(zone).agg((F.percentile("residual", F.lit(0.975)) - F.percentile("residual", F.lit(0.025))).alias("amplitude"))
        base = res.where(F.col(zone) == control).select(t, F.col("residual").alias("_c"))
        r = res.join(base, t).groupBy(zone).agg(F.corr("residual", "_c").alias("r_control"))
        of = amp.where(F.col(zone) == control).select(F.col("amplitude").alias("_a"))
        one = amp.join(r, zone, "left").join(of, how="cross").select(F.lit(order).alias("order"), zone, "amplitude", (F.col("amplitude") / F.nullif("_a", F.lit(0.0))).alias("ratio_to_control"), "r_control")
        out = one if out is None else out.unionByName(one)
    return out


def sampling_registry(obs: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """n, n_study, median, least, p99, greatest and modal gap in hours (gaps over 0 only), months, coverage of the study time.

    The mode is of gaps rounded to whole hours, ties to the least. Coverage: readings from start to before end for each that the
    median gap leads to expect over the record, in percent.
    """
    w = Window.partitionBy(*by).orderBy("ts")
    ts = F.unix_micros("ts")
    gaps = obs.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withColumn("gap", (ts - F.lag(ts).over(w)) / 3.6e9).withColumn("gap", F.when(F.col("gap") > 0, F.col("gap")))
    inside = (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))
    q = lambda p: F.percentile("gap", F.lit(p))
    agg = gaps.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(inside).alias("n_study"), q(0.5).alias("gap_median"), F.min("gap").alias("gap_min"), q(0.99).alias("gap_p99"), F.max("gap").alias("gap_max"), F.count_distinct(F.date_trunc("month", "ts")).alias("months"), ((F.max(ts) - F.min(ts)) / 3.6e9).alias("_h"))
    each = gaps.where("gap is not null").groupBy(*by, F.round("gap").cast("long").alias("h")).agg(F.count("*").alias("k"))
    mode = each.groupBy(*by).agg(F.max(F.struct("k", (-F.col("h")).alias("m"))).alias("x")).select(*by, (-F.col("x.m")).alias("gap_mode"))
    expected = F.col("_h") / F.nullif("gap_median", F.lit(0.0))
    return agg.join(mode, by, "left").select(*by, "n", "n_study", "gap_median", "gap_min", "gap_p99", "gap_max", "gap_mode", "months", (100 * F.col("n_study") / F.greatest(F.lit(1.0), expected)).alias("coverage"))


def monthly_counts(dates: DataFrame, by: list[str], date: str = "date") -> DataFrame:
    """by, month, n: the dates of each month that has any."""
    return dates.where(F.col(date).isNotNull()).groupBy(*by, F.date_format(date, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


#: name, pattern (in any case), severity. Fixed values.
TERMINOLOGY = [
    ("relative LOS vs vertical", r"(?<!relative )(?<!mean )LOS velocity", "review"),
    ("supported vs validated", r"independently validated", "review"),
    ("22.6 km2 meaning", r"22\.6\s*km", "review"),
    ("area meaning", r"independently supported at the (hotspot|zone) level", "review"),
    ("NO EVIDENCE vs ruled out", r"ruled out|refuted|excluded as a cause", "review"),
    ("NOT ADEQUATELY TESTED distinct", r"NOT ADEQUATELY TESTED", "review"),
    ("NOT TESTABLE distinct", r"NOT TESTABLE", "review"),
    ("subsidence usage", r"\bsubsidence\b", "review"),
]


def pack_audit(docs: DataFrame, packs: dict[str, list[tuple[str, str, str]]]) -> DataFrame:
    """doc_id, line_no (from 1), pack, rule, severity, text (190 characters) of each line that a pack's rule finds, in any case."""
    from .gates import line_audit

    rules = [(f"{p}\x1f{n}", f"(?i){x}", s) for p, rs in packs.items() for n, x, s in rs]
    hits = line_audit(docs, rules)
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    name = F.split("rule", "\x1f")
    out = hits.join(lines, ["doc_id", "line_no"])
    return out.select("doc_id", (F.col("line_no") + 1).alias("line_no"), name[0].alias("pack"), name[1].alias("rule"), "severity", F.substring(F.trim("line"), 1, 190).alias("text"))


def untraced_quantities(docs: DataFrame, values: DataFrame, unit: str, allowed: list[str] = ()) -> DataFrame:
    """quantity, documents: numbers before ``unit`` (a pattern) that are no known value with 1 to 3 decimals and not allowed.

    docs: doc_id, text; values: value. Thousands may be parted by commas; a number has one or two decimals. Values are
    written as C's printf does, by the exact binary value (7267.65 is 7267.6); format_string rounds what is printed of it.
    """

    @F.pandas_udf("array<string>")
    def written(v: pd.Series) -> pd.Series:
        return v.map(lambda x: [f"{x:.{k}f}" for k in (1, 2, 3)])

    found = F.regexp_extract_all("text", F.lit(rf"([0-9][0-9,]*\.[0-9]{{1,2}})[\t\n\f\r ]*{unit}"), 1)
    said = docs.select("doc_id", F.explode(F.array_distinct(found)).alias("quantity")).withColumn("token", F.replace("quantity", F.lit(",")))
    forms = values.where("value is not null").select(F.col("value").cast("double").alias("value")).distinct().select(F.explode(written("value")).alias("token")).distinct()
    loose = said.join(forms, "token", "left_anti").where(~F.col("token").isin(*allowed) if allowed else F.lit(True))
    return loose.groupBy("quantity").agg(F.count_distinct("doc_id").alias("documents"))


def ledger_summary(ledger: DataFrame, name: str, cost: str) -> DataFrame:
    """kind, value, n: names that stand more than once (duplicate_name) and how many jobs have each cost (cost)."""
    twice = ledger.where(F.col(name).isNotNull()).groupBy(F.col(name).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    costs = ledger.groupBy(F.col(cost).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return twice.select(F.lit("duplicate_name").alias("kind"), "value", "n").unionByName(costs.select(F.lit("cost").alias("kind"), "value", "n"))


def unconnected_nodes(nodes: DataFrame, edges: DataFrame, k: int = 3, most_days: int = 120) -> DataFrame:
    """network_id, node, nearest (the k nearest dates with their days, nearest first, ties to the earlier) and reason.

    The nearest are among the k before and the k after in order, so nodes meet no others. Reason: no date within ``most_days``,
    or no common pair with one.
    """
    w = Window.partitionBy("network_id").orderBy("node")
    around = F.array_compact(F.array(*[f("node", i).over(w) for i in range(1, k + 1) for f in (F.lag, F.lead)]))
    at = nodes.select("network_id", "node").distinct().withColumn("_near", around)
    linked = edges.select("network_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    days = F.array_sort(F.transform("_near", lambda x: F.struct(F.abs(F.datediff(x, F.col("node"))).alias("days"), x.alias("node"))))
    out = at.join(linked, ["network_id", "node"], "left_anti").withColumn("nearest", F.slice(days, 1, k))
    far = F.coalesce(F.get("nearest", F.lit(0))["days"] > most_days, F.lit(True))
    return out.select("network_id", "node", "nearest", F.when(far, f"no date within {most_days} days").otherwise("no common pair").alias("reason"))


def smallest(df: DataFrame, by: list[str], value: str, ties: list[str], k: int, largest: bool = False) -> DataFrame:
    """The k rows of each group (of all, without ``by``) with the least, or largest, value, ties by ``ties``; nulls never."""
    order = [F.desc(value) if largest else F.asc(value), *ties]
    rows = df.where(F.col(value).isNotNull())
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def collection_rules(bursts: DataFrame, by: list[str], covered: DataFrame, most: int = 15, seconds: int = 120, jog: float = 0.02) -> DataFrame:
    """by, check, passed, detail: the rules of each collection of bursts.

    bursts: by, id, path, direction, polarization, subswath, ts, lon_min, lon_max; covered: by, covered, the share of the area
    that the collection covers (missing: none). A collection of one burst has no lateral jog; a null in a rule fails it.
    """
    one = lambda c: F.count_distinct(c)
    told = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    wide = F.col("lon_max") - F.col("lon_min")
    agg = bursts.groupBy(*by).agg(
        F.count("*").alias("k"), one("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"), *[x for c in ("path", "direction", "polarization", "subswath") for x in (one(c).alias(f"n_{c}"), told(c).alias(f"t_{c}"), F.count(c).alias(f"k_{c}"))],
        (F.max(F.unix_seconds("ts")) - F.min(F.unix_seconds("ts"))).alias("spread"), F.min("lon_min").alias("west"), F.max("lon_max").alias("east"), F.max(F.greatest(F.abs("lon_min"), F.abs("lon_max"))).alias("far"), (F.max(wide) - F.min(wide)).alias("jog"),
    ).join(covered.select(*by, "covered"), by, "left")
    num = lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    single = lambda name, c: (name, (F.col(f"n_{c}") == 1) & (F.col(f"k_{c}") == F.col("k")), F.col(f"t_{c}"))
    rules = [
        (f"burst_count_1_to_{most}", F.col("k").between(1, most), F.concat(F.lit("K="), F.col("k").cast("string"))),
        ("contiguous_gap_free", (F.col("ids") == F.col("k")) & (F.col("hi") - F.col("lo") + 1 == F.col("k")), F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string"))),
        single("single_relative_orbit", "path"), single("single_flight_direction", "direction"), single("single_polarization", "polarization"), single("single_or_adjacent_subswath", "subswath"),
        ("acquisition_within_2_minutes", F.col("spread") <= seconds, F.concat(F.col("spread").cast("string"), F.lit(" s"))),
        ("no_antimeridian_crossing", F.col("far") <= 179.0, F.concat_ws("..", num("west", 3), num("east", 3))),
        ("aoi_fully_contained", F.col("covered") >= 1.0, num("covered", 6)),
        ("no_lateral_jog", (F.col("k") < 2) | (F.col("jog") < jog), num("jog", 5)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"), d.alias("detail")) for n, c, d in rules])
    return agg.select(*by, F.inline(rows))


def contradiction_drill_down(px: DataFrame, by: list[str], cuts: dict[str, Column], epochs: DataFrame, steps: int = 3, least: int = 6) -> DataFrame:
    """by, part, name, n, a, b: what a zone that two views disagree on looks like from all sides.

    px: by, a, b (the two views) and b0 (the second view before its corrections), null where a view has none. Part ``facet``: the
    medians of a and b over each cut (core, boundary, ring, ...); part ``branch``: of b0 (as a) and b over the same cells; part
    ``step``: the largest steps of the zone's median series in epochs (by, i, value), n the epoch it ends at, a the step, b its
    rank.
    """
    from .compare import facets

    views = facets(px, by, "a", "b", cuts, least).select(*by, F.lit("facet").alias("part"), F.col("facet").alias("name"), "n", "a", "b")
    branch = facets(px, by, "b0", "b", cuts, least).select(*by, F.lit("branch").alias("part"), F.col("facet").alias("name"), "n", "a", "b")
    line = epochs.where("value is not null").groupBy(*by, "i").agg(_median("value").alias("y"))
    w = Window.partitionBy(*by)
    jumps = line.withColumn("step", F.col("y") - F.lag("y").over(w.orderBy("i"))).where("step is not null")
    jumps = jumps.withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.abs("step")), "i"))).where(F.col("_r") <= steps)
    return views.unionByName(branch).unionByName(jumps.select(*by, F.lit("step").alias("part"), F.lit("largest").alias("name"), F.col("i").cast("long").alias("n"), F.col("step").alias("a"), F.col("_r").cast("double").alias("b")))


def branch_energy(px: DataFrame, branches: list[str], value: str, rows: int, cols: int, sigma: float = 3.0) -> DataFrame:
    """branch, n, energy: what each branch has left after its Gaussian mean, as a robust scale; branches are a short list."""
    from .tiled import highpass_gauss

    out = None
    for b in branches:
        one = highpass_gauss(px.where(F.col("branch") == b), value, rows, cols, sigma).select(F.lit(b).alias("branch"), "n", F.col("sigma").alias("energy"))
        out = one if out is None else out.unionByName(one)
    return out


def full_agreement(px: DataFrame, by: list[str], a: str, b: str, least: int = 500) -> DataFrame:
    """stats.agreement with plane_pearson (once a plane is taken off both) and the robust scatter of either view."""
    from .compare import plane_detrended
    from .stats import agreement

    rows = saved(px.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, "row", "col", a, b))
    mid = group_quantiles(rows, by, {"_a": (F.col(a), 0.5), "_b": (F.col(b), 0.5)})
    scatter = group_quantiles(rows.join(mid, by), by, {"_sa": (F.abs(F.col(a) - F.col("_a")), 0.5), "_sb": (F.abs(F.col(b) - F.col("_b")), 0.5)})
    scatter = scatter.select(*by, (1.4826 * F.col("_sa")).alias("scatter_a"), (1.4826 * F.col("_sb")).alias("scatter_b"))
    return agreement(rows, by, a, b, least).join(plane_detrended(rows, by, a, b), by).join(scatter, by)
