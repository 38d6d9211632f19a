"""A reproducible shuffle whose shard and slot follow from a row's number alone."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_row_numbers, mix64, table

ROUNDS = 6


def permute(x: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0 .. n-1: a Feistel network over side x side cells, walked back into range.

    ``side`` is the least integer with side**2 >= n, so at most about 2*sqrt(n) cells lie outside and few
    numbers walk. Within one cycle a walk always ends, as the starting number itself lies in range.
    """
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    side = np.uint64(math.isqrt(n - 1) + 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed % (1 << 62)))
    out = np.asarray(x, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // side, out[todo] % side
        for k in keys:
            left, right = right, (left + mix64(right ^ k) % side) % side
        out[todo] = left * side + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Law ``rows``: shard sizes differ by one row at most and slots of a shard run from 0 without a gap. Rows are
    numbered by (doc_id, checksum, size), nulls first; equal rows get numbers next to each other, so the result is
    the same for any input order. A null text counts 16 bytes and has the checksum of the empty text; an empty
    table gives no rows; other columns are ignored. Copies are spread, as each row moves by its number only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    numbered, total = global_row_numbers(base, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), total, seed))

    placed = numbered.withColumn("place", place("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
