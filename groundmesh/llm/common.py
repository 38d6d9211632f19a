"""What the operators of this subpackage share: word rules, lineage cuts, global row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    The plan that made it is not run again, by a second reader or after an executor is lost.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


def global_row_numbers(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number the rows 0, 1, ... in the order of ``keys`` without a single-task window; also the row count.

    Rows are range-partitioned and sorted, numbered inside their partition, and shifted by the rows of the
    partitions before (one small count for each partition goes through the driver). Rows that agree in all
    keys are numbered next to each other in any order.
    """
    spark = df.sparkSession
    part = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_g", F.monotonically_increasing_id()))
    part = part.withColumn("_p", F.shiftright("_g", 33))
    counts = sorted((r["_p"], r["count"]) for r in part.groupBy("_p").count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_p long, _before long")
    out = part.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col("_g").bitwiseAND((1 << 33) - 1))
    return out.drop("_g", "_p", "_before"), total


#: UTF-8 bytes of text that a helper takes into Python objects at once.
SLICE_BYTES = 2 << 20


def slices(batch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut an Arrow record batch into consecutive pieces with about ``limit`` bytes of text; one row at least each."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, distinct, counts): all words of the texts as indexes into the distinct words; words of each text."""
    import pandas as pd

    found = [WORDS.findall(t) for t in texts]
    counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.empty(int(counts.sum()), dtype=object)
    at = 0
    for words in found:
        flat[at : at + len(words)] = words
        at += len(words)
    codes, distinct = pd.factorize(flat)
    return codes.astype(np.int64), distinct, counts


def word_hashes(distinct: np.ndarray) -> np.ndarray:
    import pandas as pd

    return pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.zeros(0, dtype=np.uint64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given lengths, each on its own; 0 for an empty group."""
    out = np.zeros(len(counts), dtype=values.dtype)
    full = np.flatnonzero(counts > 0)
    if len(full):
        out[full] = np.add.reduceat(values, np.cumsum(counts)[full] - counts[full])
    return out


#: Bits of a filter on 64-bit keys. A wrong yes costs a detour, never a result.
FILTER_BITS = 1 << 24


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each key modulo FILTER_BITS; at most FILTER_BITS / 64 rows reach the driver."""
    at = f"pmod({column}, {FILTER_BITS})"
    words = keys.groupBy(F.expr(f"{at} div 64").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} % 64 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for word, bits in words.collect():
        out[word] = np.uint64(bits % (1 << 64))
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.mod(keys.astype(np.int64), len(bits) << 6)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, for nodes that have edges.

    Edges are turned into stars around ever smaller nodes until nothing changes: in a round each node hands its larger
    neighbours, then its smaller ones, to its least neighbour. No component is ever gathered in a task, and each
    round is written before the next.
    """

    def star(e, larger: bool):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.join(least, "a")
        if larger:
            return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lean = out.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return lean.unionByName(out.select("a", F.col("m").alias("b"))).where("a != b").distinct()

    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    e = cut(e)
    before = state(e)
    while before[0]:
        e = cut(star(star(e, True), False))
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
