"""Exact quantiles of a whole column without one task that holds it: by ever narrower histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import Saved


def exact_quantiles(df: DataFrame, value: str | Column, shares: list[float], bins: int = 4096, few: int = 10_000) -> list[float | None]:
    """The quantiles of the values that are neither null nor NaN, between two neighbours linearly, as ``percentile`` gives.

    A first pass counts ``bins`` equal parts of the range; each rank that is asked lies in one part, which is cut again
    from its least to its greatest value until at most ``few`` values are left or all are equal; those few come to the
    driver. Every pass sends at most ``bins`` counts for each rank, whatever the rows. None without values.
    """
    store = Saved(df.sparkSession)
    v = store.keep(df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    ranks = sorted({f(h) for h in places for f in (math.floor, math.ceil)})
    open_, found = {(lo, hi, 0, n): ranks}, {}
    while open_:
        done = {b: rs for b, rs in open_.items() if b[0] == b[1]}
        found |= {r: b[0] for b, rs in done.items() for r in rs}
        open_ = {b: rs for b, rs in open_.items() if b not in done}
        small = [b for b in open_ if b[3] <= few]
        if small:
            inside = F.lit(False)
            for b in small:
                inside = inside | F.col("v").between(b[0], b[1])
            got = sorted(r["v"] for r in v.where(inside).collect())
            for b in small:
                mine = [x for x in got if b[0] <= x <= b[1]]
                found |= {r: mine[r - b[2]] for r in open_.pop(b)}
        if not open_:
            break
        every = sorted(open_)
        part = F.lit(None).cast("struct<b:int,k:int>")
        for i, (a, z, _, _) in enumerate(every):
            # Halves keep the width finite for any two doubles.
            k = F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - a / 2) / (z / 2 - a / 2) * bins)).cast("int")
            part = F.when(F.col("v").between(a, z), F.struct(F.lit(i).alias("b"), k.alias("k"))).otherwise(part)
        counts = v.select("v", part.alias("p")).where("p is not null").groupBy("p").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z")).collect()
        narrower: dict = {}
        for i, b in enumerate(every):
            before = b[2]
            for r in sorted((r for r in counts if r["p"]["b"] == i), key=lambda r: r["p"]["k"]):
                inside_ = [x for x in open_[b] if before <= x < before + r["c"]]
                if inside_:
                    narrower[(r["a"], r["z"], before, r["c"])] = inside_
                before += r["c"]
        open_ = narrower
    store.drop(v)
    out = []
    for h in places:
        a, b = math.floor(h), math.ceil(h)
        out.append(found[a] if a == b or found[a] == found[b] else (b - h) * found[a] + (h - a) * found[b])
    return out


def same_groups(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on columns ``by``, nulls being equal; of b only its other columns are added."""
    names = {c: f"_same_{k}" for k, c in enumerate(by)}
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    b = b.withColumnsRenamed(names)
    return (a.join(b, on, how) if on else a.join(b, F.lit(True), how)).drop(*names.values())


def places(df: DataFrame, by: list[str], value: str, store: Saved, most: int = 250_000) -> DataFrame:
    """by, value, count, before and n for each distinct value of each group: rows that have it, a less one, and any.

    Values are counted, then put in order over tasks of about ``most`` rows, whatever their groups are, so that no task has a
    whole group; what the tasks before one have of a group comes from their sums. Null values are left out, NaN is the greatest.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("count"))
    parts = max(4, min(4096, math.ceil(df.count() / most)))
    placed = store.keep(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part", *by).agg(F.sum("count").alias("_sum"))
    group = Window.partitionBy(*by)
    so_far = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", *by, F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_base"), F.sum("_sum").over(group).alias("n"))
    inside = Window.partitionBy("_part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return same_groups(placed, sums, ["_part", *by]).select(*by, value, "count", (F.col("_base") + F.col("_inside")).alias("before"), "n")


def group_quantiles(df: DataFrame, by: list[str], asked: dict[str, tuple[Column, float]]) -> DataFrame:
    """by and the quantiles asked, name: (value, share), for each group of ``df``, as ``percentile`` gives them.

    No task holds a group: values are put in order over all tasks (see places), and each place asked for is picked there.
    """
    store, exprs = Saved(df.sparkSession), []
    which = {}
    for name, (c, share) in asked.items():
        text = str(c)
        if text not in [t for t, _ in exprs]:
            exprs.append((text, c))
        which[name] = [t for t, _ in exprs].index(text), share
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), c.cast("double").alias("_v")) for i, (_, c) in enumerate(exprs)])).alias("_x")).select(*by, "_x.*")
    rows = store.keep(rows)
    at = places(rows, [*by, "_i"], "_v", store)
    picked, out = [], []
    for k, (i, share) in enumerate(which.values()):
        place = (F.col("n") - 1) * F.lit(float(share))
        for side, f in (("l", F.floor), ("h", F.ceil)):
            here = (F.col("_i") == i) & (F.col("before") <= f(place)) & (f(place) < F.col("before") + F.col("count"))
            picked.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{k}"))
        picked.append(F.max(F.when(F.col("_i") == i, place)).alias(f"_p{k}"))
    found = at.groupBy(*by).agg(*picked)
    for k, name in enumerate(which):
        low, high, p = F.col(f"_l{k}"), F.col(f"_h{k}"), F.col(f"_p{k}")
        out.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name))
    groups = rows.select(*by).distinct() if by else None
    found = found.select(*by, *out)
    done = store.keep(same_groups(groups, found, by, "left") if by else found)
    store.drop(*[x for x, _ in list(store.paths.values()) if x is not done])
    return done


def average_ranks(df: DataFrame, by: list[str], value: str, name: str, store: Saved) -> DataFrame:
    """by, value and the average rank that rows with it have in their group."""
    at = places(df, by, value, store)
    return at.select(*by, value, (F.col("before") + (F.col("count") + 1) / 2).alias(name))


def exact_scale(df: DataFrame, value: str | Column) -> tuple[float | None, float | None]:
    """(median, 1.4826 times the median distance from it)."""
    c = F.col(value) if isinstance(value, str) else value
    (mid,) = exact_quantiles(df, c, [0.5])
    if mid is None:
        return None, None
    (mad,) = exact_quantiles(df, F.abs(c - mid), [0.5])
    return mid, 1.4826 * mad
