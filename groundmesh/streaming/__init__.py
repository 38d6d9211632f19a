"""Streams with the semantics of the batch operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import upsert_latest


def daily_medians(obs: DataFrame, late: str = "1 day", least: int = 2) -> DataFrame:
    """Daily median of each station with ``least`` values or more; a day is given once the watermark has passed it."""
    agg = obs.where("value is not null").withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "producer", "station")
    out = agg.agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("median")).where(F.col("n") >= least)
    return out.select("producer", "station", F.to_date("w.start").alias("date"), "n", "median")


HEALTH = "station long, n long, zero_fraction double, constant_fraction double, max_gap_days double"


def sensor_health(obs: DataFrame, late: str = "1 day") -> DataFrame:
    """Running health of each station: shares of zeros and of repeated values, and the largest gap.

    The state of a station is five numbers and the readings that the watermark (``late`` behind the newest) has not
    passed; a timer wakes the station when it does, and they are counted in the order of time, then value. A row is
    given each time that readings are counted; those that come after the watermark are left out.
    """

    def run(key, frames, state):
        n, zeros, same, value, at, gap, times, values = state.get if state.exists else (0, 0, 0, None, None, 0.0, [], [])
        new = list(frames)
        ts = np.concatenate([np.array(times, dtype=np.int64), *(f["ts"].to_numpy("datetime64[us]").astype(np.int64) for f in new)])
        v = np.concatenate([np.array(values, dtype=float), *(f["value"].to_numpy(float) for f in new)])
        order = np.lexsort((v, ts))
        ts, v = ts[order], v[order]
        ready = int((ts // 1000 + 1 < state.getCurrentWatermarkMs()).sum())
        if ready:
            seen_t, seen_v = ts[:ready], v[:ready]
            if at is not None:
                seen_t, seen_v = np.append(at, seen_t), np.append(value, seen_v)
            n, zeros, same = n + ready, zeros + int((v[:ready] == 0).sum()), same + int((np.diff(seen_v) == 0).sum())
            gap = max(gap, float(np.diff(seen_t).max()) / 8.64e10) if len(seen_t) > 1 else gap
            value, at = float(v[ready - 1]), int(ts[ready - 1])
        state.update((n, zeros, same, value, at, gap, ts[ready:].tolist(), v[ready:].tolist()))
        if ready < len(ts):
            state.setTimeoutTimestamp(max(int(ts[ready]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if ready:
            yield pd.DataFrame([[key[0], n, zeros / n, same / n, gap]], columns=["station", "n", "zero_fraction", "constant_fraction", "max_gap_days"])

    keyed = obs.where("value is not null").select("station", "ts", "value").withWatermark("ts", late).groupBy("station")
    return keyed.applyInPandasWithState(run, HEALTH, "n long, zeros long, same long, value double, at long, gap double, times array<long>, values array<double>", "update", "EventTimeTimeout")


def latest_states(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """An append-only ledger's events without the repeats that arrive inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "status"])


def upsert_sink(path: str, key: list[str]):
    """A foreachBatch function that keeps the latest row of each key in a parquet table, the newest at its ``last``.

    A version is named by its batch, and built from the newest finished version before it, so a batch that is run again
    after a restart gives the same version, whatever was lost; versions before the one built on are deleted.
    """

    def versions(spark) -> list[int]:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [f.getPath() for f in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in done if p.getName()[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        name = lambda k: f"{path}/v{k}"
        before = [k for k in versions(spark) if k < epoch]
        rows = upsert_latest(spark.read.parquet(name(before[-1])), batch, key, [F.desc("ts")]) if before else upsert_latest(batch.limit(0), batch, key, [F.desc("ts")])
        rows.write.mode("overwrite").parquet(name(epoch))
        for k in before[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(name(k))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        run.last = name(epoch)

    return run


def epoch_matches(obs: DataFrame, epochs: DataFrame, half_days: int = 3, least: int = 4, late: str = "1 day") -> DataFrame:
    """Median of the readings within half_days of each epoch (a static table), once its days are past the watermark."""
    spread = epochs.select(F.col("epoch"), F.explode(F.sequence(F.date_sub("epoch", half_days), F.date_add("epoch", half_days))).alias("date"))
    end = F.to_timestamp(F.date_add("epoch", half_days + 1))
    joined = obs.withColumn("date", F.to_date("ts")).join(spread, "date").withColumn("closes", end - F.expr("interval 1 second"))
    agg = joined.withWatermark("closes", late).groupBy(F.window("closes", "1 day").alias("w"), "station", "epoch").agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"))
    return agg.select("station", "epoch", "n", F.when(F.col("n") >= least, F.col("median")).alias("median"))


def epoch_match_streams(obs: DataFrame, epochs: DataFrame, half_days: int = 3, least: int = 4, late: str = "1 day", late_epochs: str = "1 day") -> DataFrame:
    """station, epoch, n, median of the readings within half_days of each epoch, both as streams.

    obs: station, ts, value; epochs: epoch (timestamp of a day). Readings and epochs wait for each other as long as their
    watermarks allow; an epoch's row comes once no reading of its days can come any more, and late ones are left out. A median
    of fewer than ``least`` readings is null; an epoch without readings has no row.
    """
    o = obs.where("value is not null").select("station", "ts", "value", F.to_date("ts").alias("day")).withWatermark("ts", late)
    e = epochs.select(F.col("epoch").alias("at")).withWatermark("at", late_epochs)
    # A stream joins on equal keys: an epoch waits once for each of its days. The range lets either side's state end.
    e = e.withColumn("day", F.explode(F.sequence(F.date_sub("at", half_days), F.date_add("at", half_days))))
    near = (o["day"] == e["day"]) & (F.col("ts") >= F.col("at") - F.expr(f"interval {half_days} days")) & (F.col("ts") < F.col("at") + F.expr(f"interval {half_days + 1} days"))
    agg = o.join(e, near).groupBy(F.window("at", "1 day").alias("w"), "station").agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"))
    return agg.select("station", F.to_date("w.start").alias("epoch"), "n", F.when(F.col("n") >= least, F.col("median")).alias("median"))


def sliding_medians(obs: DataFrame, late: str = "1 day", wide: str = "7 days", slide: str = "1 day", least: int = 4) -> DataFrame:
    """station, start, n, median of each window of ``wide`` that begins every ``slide``, once the watermark has passed it."""
    agg = obs.where("value is not null").withWatermark("ts", late).groupBy(F.window("ts", wide, slide).alias("w"), "station")
    out = agg.agg(F.count("value").alias("n"), F.percentile("value", F.lit(0.5)).alias("median"))
    return out.select("station", F.col("w.start").alias("start"), "n", F.when(F.col("n") >= least, F.col("median")).alias("median"))
