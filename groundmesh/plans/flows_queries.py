"""Queries that run as streams over the events table to its end, and sources over its nested column."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import streaming
from ..operators import gates
from .inputs import TELE, table
from .pixel_queries import rounded

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _folder(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/stream-{uuid.uuid4().hex}"


def events(spark, d) -> DataFrame:
    """The events table as a stream of readings."""
    schema = table(spark, d, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(d)
    return s.select(F.col("event_type").alias("producer"), F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("job_id"))


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into files, and read them."""
    path = _folder(stream.sparkSession)
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_daily_medians", f"""with {TELE}, g as (select producer, station, cast(ts as date) as date, count(value) as n, quantile_cont(value, .5) as median from tele where value is not null group by 1, 2, 3 having count(value) >= 2), e as (select max(ts) - interval 1 day as mark from tele)
select producer, station, date, n, round(median, 8) as median from g, e where date + interval 1 day <= mark""")
def _(spark, d):
    return rounded(to_end(streaming.daily_medians(events(spark, d))), 8)


@query("stream_sensor_health", f"""with {TELE}, e as (select epoch_ms(max(ts)) - 86400000 as mark from tele where value is not null),
 r as (select station, ts, value, lag(value) over w as v0, lag(ts) over w as t0 from tele, e where value is not null and epoch_ms(ts) + 1 < mark window w as (partition by station order by ts, value))
select station, count(*) as n, round(avg((value = 0)::int), 8) as zero_fraction, round(sum(coalesce((value = v0)::int, 0)) / count(*), 8) as constant_fraction, round(coalesce(max(epoch_us(ts) - epoch_us(t0)), 0) / 8.64e10, 8) as max_gap_days from r group by 1""")
def _(spark, d):
    path = _folder(spark)
    s = streaming.sensor_health(events(spark, d))
    run = streaming.upsert_sink(f"{path}/out", ["station"])
    q = s.withColumn("ts", F.col("n")).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.read.parquet(run.last).drop("ts"), 8)


@query("stream_latest_states", f"with {TELE} select producer, count(*) as n, count(distinct station) as stations from tele group by 1")
def _(spark, d):
    s = streaming.latest_states(events(spark, d).withColumn("status", F.col("producer")))
    return to_end(s).groupBy("producer").agg(F.count("*").alias("n"), F.countDistinct("station").alias("stations"))


@query("stream_epoch_matches", f"""with {TELE}, e as (select distinct cast(ts as date) as epoch from tele where day(ts) % 6 = 0), m as (select station, epoch, value from tele join e on cast(ts as date) between cast(epoch - 3 as date) and cast(epoch + 3 as date)),
 k as (select max(cast(epoch + 4 as timestamp) - interval 1 second) - interval 1 day as mark from e where exists (select 1 from tele where cast(ts as date) between cast(epoch - 3 as date) and cast(epoch + 3 as date)))
select station, epoch, count(value) as n, case when count(value) >= 4 then round(quantile_cont(value, .5), 8) end as median from m, k where cast(epoch + 4 as timestamp) <= mark group by 1, 2""")
def _(spark, d):
    epochs = table(spark, d, "events").select(F.to_date("ts").alias("epoch")).where("day(epoch) % 6 = 0").distinct()
    return rounded(to_end(streaming.epoch_matches(events(spark, d), epochs)), 8)


@query("nested_attributes", "select json_extract_string(props, '$.' || k) as value, k as name, count(*) as n from (select props, unnest(json_keys(props)) as k from events) group by 1, 2")
def _(spark, d):
    e = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string, string>")).alias("name", "value"))
    return e.groupBy("name", "value").agg(F.count("*").alias("n"))


@query("stream_batch_twin")
def _(spark, d):
    """Days of the batch form that the daily stream has (both), or still holds behind the watermark (missing)."""
    from ..operators.series import daily_series
    from .inputs import telemetry

    a = rounded(to_end(streaming.daily_medians(events(spark, d))), 8)
    b = rounded(daily_series(telemetry(spark, d), ["producer", "station"]), 8)
    return gates.set_diff(b, a, ["producer", "station", "date"]).groupBy("state").agg(F.count("*").alias("n"))
