"""Tables that cut the lineage of loops, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, in local mode only, a new temporary folder for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Saved:
    """The states of one loop. ``keep(df)`` writes and reads again; ``drop(df, ...)`` deletes what is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/state-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *states: DataFrame | None) -> None:
        for s in states:
            if id(s) in self.paths:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(s))[1])
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once and read again; for results, which stay."""
    return Saved(df.sparkSession).keep(df)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
