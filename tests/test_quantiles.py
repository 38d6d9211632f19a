"""Quantiles and ranks of groups over many tasks against Spark's own, which hold a group in one task."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from groundmesh.operators import stats
from groundmesh.operators.quantiles import group_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    data = [(r.choice([True, True, True, False, None]), r.choice([None, float(r.randint(-3, 3)), r.gauss(0, 5)]), r.choice([float(r.randint(0, 2)), r.gauss(0, 1)])) for _ in range(3000)]
    return spark.createDataFrame([*data, (None, float("nan"), 1.0)], "g boolean, x double, y double").repartition(7)


def table(df):
    return {str(r[0]): tuple(r)[1:] for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == tuple(x if x is None else pytest.approx(x, abs=1e-9, nan_ok=True) for x in v), k


def test_group_quantiles_equal_percentile(rows):
    asked = {f"q{k}": (F.col("x"), p) for k, p in enumerate((0.0, 0.01, 0.25, 0.5, 0.9, 1.0))} | {"d": (F.abs(F.col("y") - F.col("x")), 0.5), "none": (F.when(F.lit(False), F.col("x")), 0.5)}
    close(table(group_quantiles(rows, ["g"], asked)), table(rows.groupBy("g").agg(*[F.percentile(c, F.lit(p)).alias(n) for n, (c, p) in asked.items()])))
    whole = rows.where("not isnan(x)")
    assert group_quantiles(whole, [], {"m": (F.col("x"), 0.37)}).first()["m"] == pytest.approx(whole.agg(F.percentile("x", F.lit(0.37))).first()[0])
    assert group_quantiles(rows.limit(0), ["g"], asked).collect() == []


def test_describe_and_ranks_need_no_group_in_one_task(rows):
    rows = rows.where("x is null or not isnan(x)")
    names = [f"p{round(q * 100):02d}" for q in stats.QUANTILES]
    want = rows.groupBy("g").agg(F.count("x"), F.min("x"), *[F.percentile("x", F.lit(q)).alias(n) for n, q in zip(names, stats.QUANTILES, strict=True)], F.max("x"), F.avg("x"), F.stddev_pop("x"))
    got = stats.describe(rows, ["g"], "x")
    close(table(got), table(want))
    rank = lambda c: F.rank().over(Window.partitionBy("g").orderBy(c)) + (F.count("*").over(Window.partitionBy("g", c)) - 1) / 2
    plain = rows.where("x is not null").withColumn("a", rank("x")).withColumn("b", rank("y")).groupBy("g").agg(F.count("*"), F.corr("a", "b"), F.corr("x", "y"))
    ranked = stats.spearman(rows, ["g"], "x", "y")
    close(table(ranked), table(plain))
    for df in (got, ranked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan and "Window" not in plan
