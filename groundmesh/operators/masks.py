"""Pixel masks, tiers and ordered classification rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(px: DataFrame, coh_min: float = 0.8) -> DataFrame:
    """Cells in the area, on land, with a velocity and enough coherence."""
    return px.where(F.col("in_aoi") & F.col("land") & F.col("velocity").isNotNull() & (F.col("tcoh") >= coh_min))


def inverted(px: DataFrame) -> DataFrame:
    """Cells that an inversion reached: a deviation of 0 means it did not."""
    return px.where(F.col("velocity_std") > 0)


def quality_tier(tcoh: Column, land: Column) -> Column:
    """1 (.90 or more), 2 (.80), 3 (.70), 4 (other land), 0; the strictest tier wins, water is always 0."""
    return F.when(land & (tcoh >= 0.9), 1).when(land & (tcoh >= 0.8), 2).when(land & (tcoh >= 0.7), 3).when(land, 4).otherwise(0)


def publish_layer(px: DataFrame, mask: Column, col: str, scale: float, nodata: float = -9999.0) -> DataFrame:
    return px.withColumn("value", F.when(mask & F.col(col).isNotNull(), F.col(col) * scale).otherwise(nodata))


def null_missing(df: DataFrame, nan: list[str] = (), zero: list[str] = (), nodata: dict[str, float] | None = None) -> DataFrame:
    """Map the four encodings of a missing value to null: NaN, zero where it means none, and no-data numbers."""
    fix = {c: F.when(~F.isnan(c), F.col(c)) for c in nan}
    fix |= {c: F.nullif(fix.get(c, F.col(c)), F.lit(0.0)) for c in zero}
    fix |= {c: F.nullif(fix.get(c, F.col(c)), F.lit(v)) for c, v in (nodata or {}).items()}
    return df.withColumns(fix)


def temporal_form(f: DataFrame) -> DataFrame:
    """Label of a zone's series from its fits: rms_linear, rms_step, step, annual, rate (mm and mm a year).

    An offset if the step fit's RMS is under 0.8 of the linear one's and the step over 3 times the linear RMS; else
    seasonal if the rate is under 3 and the annual amplitude over 3; else linear with season if the amplitude exceeds
    0.3 of the rate; else about linear.
    """
    rate = F.abs("rate")
    form = (
        F.when((F.col("rms_step") < 0.8 * F.col("rms_linear")) & (F.abs("step") > 3 * F.col("rms_linear")), "episodic_offset")
        .when((rate < 3) & (F.col("annual") > 3), "seasonal_dominated").when(F.col("annual") > 0.3 * rate, "linear_with_seasonal").otherwise("approximately_linear")
    )
    return f.withColumn("form", form)


def evidence_grade(z: DataFrame) -> DataFrame:
    """A, B or C from survived (of 14 scenarios), coherence_median, median and series_rate (mm a year).

    A: 12 scenarios, coherence .85, a rate of 10 and the two rates within a fifth of it; B: 9 scenarios and a rate of 10.
    """
    size = F.abs("median")
    gap = F.abs(size - F.abs("series_rate")) / F.nullif(size, F.lit(0.0))
    a = (F.col("survived") >= 12) & (F.col("coherence_median") >= 0.85) & (size >= 10) & (gap <= 0.2)
    return z.withColumn("grade", F.when(a, "A").when((F.col("survived") >= 9) & (size >= 10), "B").otherwise("C"))


def persistence_outcome(share: Column) -> Column:
    return F.when(share >= 0.8, "robust").when(share >= 0.5, "moderate").otherwise("mask_dependent")


def reproduction_verdict(z: DataFrame) -> DataFrame:
    """Whether a second geometry reproduces a zone: observed and expected response, sigma, quality_ok."""
    gap = F.abs(F.col("observed") - F.col("expected")) / F.nullif(F.col("sigma"), F.lit(0.0))
    return z.withColumn("gap_sigma", gap).withColumn("verdict", F.when(gap <= 2, "CONSISTENT").when(F.col("quality_ok"), "NOT_REPRODUCED").otherwise("NOT_RESOLVED"))


def cross_class(z: DataFrame) -> DataFrame:
    """Whether a second geometry (b) supports a zone of the first (a): a, b, coverage, coherence_b, detected.

    Not resolved without a value of b, under half coverage or a coherence under .5. Supported: same sign, a component
    detected and half the magnitude; partly: same sign and one of the two; contradicted: the other sign.
    """
    weak = F.col("b").isNull() | (F.col("coverage") < 0.5) | F.coalesce(F.col("coherence_b") < 0.5, F.lit(False))
    same = F.signum("a") == F.signum("b")
    large = F.abs("b") / F.greatest(F.abs("a"), F.lit(1e-9)) >= 0.5
    label = (
        F.when(weak, "NOT_RESOLVED").when(same & F.col("detected") & large, "INDEPENDENTLY_SUPPORTED").when(same & (F.col("detected") | large), "PARTIALLY_SUPPORTED")
        .when(~same, "CONTRADICTED").otherwise("NOT_RESOLVED")
    )
    return z.withColumn("cross_class", label)


def decomp_eligibility(z: DataFrame, least: int = 5) -> DataFrame:
    """Whether two views of a zone justify a decomposition, with all reasons against: n_both, a, b, coherence_a, coherence_b, vertical, vertical_sigma."""
    ratio = F.abs("b") / F.nullif(F.abs("a"), F.lit(0.0))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.signum("a") != F.signum("b"), F.lit(True)), F.lit("sign disagreement")), F.when(~F.coalesce(ratio.between(0.5, 2.0), F.lit(False)), F.lit("magnitude ratio outside 0.5-2.0")),
        F.when(F.coalesce(F.col("coherence_a"), F.lit(0.0)) < 0.8, F.lit("coherence of a under 0.8")), F.when(F.coalesce(F.col("coherence_b"), F.lit(0.0)) < 0.8, F.lit("coherence of b under 0.8")),
        F.when(F.coalesce(F.abs("vertical") <= 2 * F.col("vertical_sigma"), F.lit(True)), F.lit("vertical within 2 sigma")),
    ))
    reasons = F.when(F.col("n_both") < least, F.array(F.lit("few common cells"))).otherwise(reasons)
    return z.withColumn("reasons", F.array_join(reasons, "; ")).withColumn("eligible", F.size(reasons) == 0)


def correspondence(km: Column, inside: Column, same_sign: Column) -> Column:
    """How a reported place corresponds to a zone of the same sign: in it or within 2 km, within 5 km, or not."""
    return F.when(~F.coalesce(same_sign, F.lit(False)), "none").when(inside | (km <= 2), "direct").when(km <= 5, "near").otherwise("none")


def resolve_by_provenance(products: DataFrame, source_suffix: str) -> DataFrame:
    """Products by the source they record, never by their file name."""
    return products.where(F.col("source").endswith(source_suffix))


def promotion_rule(metrics: DataFrame, baseline: str, least: int) -> DataFrame:
    """Branches that improve enough metrics on the baseline branch.

    metrics: branch, metric, value, better (``low`` or ``high``).
    """
    base = metrics.where(F.col("branch") == baseline).select("metric", F.col("value").alias("base"))
    better = F.when(F.col("better") == "low", F.col("value") < F.col("base")).otherwise(F.col("value") > F.col("base"))
    out = metrics.where(F.col("branch") != baseline).join(base, "metric").groupBy("branch").agg(F.sum(better.cast("int")).alias("improved"), F.count("*").alias("metrics"))
    return out.withColumn("promoted", F.col("improved") >= least)
