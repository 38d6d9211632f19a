"""The given tables as domain shapes, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def acquisitions(spark, d) -> DataFrame:
    """burst, date (weeks), perp (metres) from orders."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("burst"), F.to_date(F.date_trunc("week", F.col("o_orderdate").cast("timestamp"))).alias("date"), "o_totalprice")
    return o.groupBy("burst", "date").agg(F.round(F.avg("o_totalprice") / 1000, 3).alias("perp"))


def common_pairs(spark, d) -> DataFrame:
    from ..operators.pairs import candidate_pairs, identity_intersection

    return identity_intersection(candidate_pairs(acquisitions(spark, d)), 3)


def network(spark, d, max_days: int = 36) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a network for each burst, from all its pairs, and of one of the pairs that all bursts have."""
    from ..operators.pairs import candidate_pairs, identity_intersection

    cands = candidate_pairs(acquisitions(spark, d), max_days=max_days)
    p = cands.select(F.col("burst").alias("network_id"), F.col("ref").alias("src"), F.col("sec").alias("dst"), "days", F.abs("dperp").alias("max_perp"))
    common = identity_intersection(cands, 3)
    p = p.unionByName(common.select(F.lit("common").alias("network_id"), F.col("ref").alias("src"), F.col("sec").alias("dst"), "days", "max_perp"))
    nodes = p.select("network_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes, p


def telemetry(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("producer"), F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "value")


def epochs(spark, d) -> DataFrame:
    """pixel, zone, i (epoch), t (years), disp from embeddings."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pixel"), F.col("label").alias("zone"), F.posexplode("embedding").alias("i", "v"))
    return e.select("pixel", "zone", "i", (F.col("i") * 12 / 365.25).alias("t"), F.col("v").cast("double").alias("disp"))


def side(spark, d) -> int:
    """Rows, and columns, of the grid of cells: 100 at least, and some six rows of lineitem a cell."""
    return max(100, int((table(spark, d, "lineitem").count() / 6.0) ** 0.5))


def _row_col(n: int):
    return F.expr(f"cast(l_partkey % {n} as int)"), F.expr(f"cast((l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % {n} as int)")


def pixels(spark, d, where: str = "true") -> DataFrame:
    """One row for each grid cell: velocity, velocity_std, tcoh, from lineitem."""
    n = side(spark, d)
    row, col = _row_col(n)
    x = table(spark, d, "lineitem").where(where).withColumn("row", row).withColumn("col", col)
    x = x.groupBy("row", "col").agg(
        F.round((F.avg("l_extendedprice") - 50000) / 1000, 10).alias("velocity"), F.round(F.avg("l_tax"), 6).alias("velocity_std"),
        F.round(1 - 3 * F.avg("l_discount"), 6).alias("tcoh"), F.round(F.avg("l_quantity"), 4).alias("height"),
    )
    return x.withColumn("in_aoi", F.expr(f"row between 5 and {n - 6} and col between 5 and {n - 6}")).withColumn("land", F.expr("(row + col) % 17 != 0"))


def pair_pixels(spark, d) -> DataFrame:
    """pair_id, row, col, unw, coh, cc from lineitem and orders."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    x = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    row, col = _row_col(side(spark, d))
    return x.select(
        F.concat_ws("_", "o_orderstatus", F.year("o_orderdate")).alias("pair_id"), row.alias("row"), col.alias("col"), F.nullif("l_discount", F.lit(0.0)).alias("unw"),
        (1 - 3 * F.col("l_discount")).alias("coh"), F.col("l_linenumber").alias("cc"),
    )


def stations(spark, d, name: str) -> DataFrame:
    p = name[0]
    k = F.col(f"{p}_{'suppkey' if p == 's' else 'custkey'}")
    return table(spark, d, name).select(k.alias("id"), (28 + k % 1000 / 1000).alias("lat"), (76.5 + k % 997 / 997).alias("lon"))


ACQ = """acq as (select o_orderstatus as burst, cast(date_trunc('week', o_orderdate) as date) as date, round(avg(o_totalprice) / 1000, 3) as perp from orders group by 1, 2)"""
CAND = ACQ + """, cand as (select a.burst, a.date as ref, b.date as sec, cast(b.date - a.date as int) as days, b.perp - a.perp as dperp
  from acq a join acq b on a.burst = b.burst and a.date < b.date and b.date - a.date <= 36 where abs(b.perp - a.perp) <= 250)"""
COMMON = CAND + """, common as (select ref, sec, any_value(days) as days, max(abs(dperp)) as max_perp from cand group by 1, 2 having count(distinct burst) = 3)"""
NET = COMMON + """, edges as (select burst as network_id, ref as src, sec as dst, days, abs(dperp) as max_perp from cand union all select 'common', ref, sec, days, max_perp from common),
 nodes as (select network_id, src as node from edges union select network_id, dst from edges)"""
TELE = """tele as (select event_type as producer, user_id as station, ts, value from events)"""
EPOCH = """ep as (select vec_id as pixel, label as zone, i, i * 12 / 365.25 as t, cast(embedding[i + 1] as double) as disp from (select vec_id, label, embedding, unnest(range(len(embedding))) as i from embeddings))"""


SIDE = "(select greatest(100, cast(floor(sqrt(count(*) / 6.0)) as int)) from lineitem)"


def pix_sql(name: str = "px", where: str = "true") -> str:
    return f"""{name} as (select *, row between 5 and {SIDE} - 6 and col between 5 and {SIDE} - 6 as in_aoi, (row + col) % 17 <> 0 as land from (
  select cast(l_partkey % {SIDE} as int) as row, cast((l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % {SIDE} as int) as col, round((avg(l_extendedprice) - 50000) / 1000, 10) as velocity,
    round(avg(l_tax), 6) as velocity_std, round(1 - 3 * avg(l_discount), 6) as tcoh, round(avg(l_quantity), 4) as height from lineitem where {where} group by 1, 2))"""


PIX = pix_sql()
PAIRPX = f"""pp as (select o_orderstatus || '_' || year(o_orderdate) as pair_id, cast(l_partkey % {SIDE} as int) as row, cast((l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % {SIDE} as int) as col,
  nullif(l_discount, 0) as unw, 1 - 3 * l_discount as coh, l_linenumber as cc from lineitem join orders on l_orderkey = o_orderkey)"""
SUPP = """supp as (select s_suppkey as id, 28 + s_suppkey % 1000 / 1000 as lat, 76.5 + s_suppkey % 997 / 997 as lon from supplier)"""
CUST = """cust as (select c_custkey as id, 28 + c_custkey % 1000 / 1000 as lat, 76.5 + c_custkey % 997 / 997 as lon from customer)"""
