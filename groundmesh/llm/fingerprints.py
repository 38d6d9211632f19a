"""Context-triggered piecewise hashing of documents, compared by edit distance at compatible block sizes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, table

#: Bytes that a rolling hash sees.
WINDOW = 7
LEAST_BLOCK = 3
#: Characters of a signature, at most; the block size is the least that stays within it.
SIGNATURE = 64
#: A signature of fewer letters says too little where half the block would give more.
FEW = 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LETTERS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each position, fewer at the start."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), data.astype(np.uint64) + np.uint64(1)])
    h = np.zeros(len(data), np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + padded[k : k + len(data)]
    return mix64(h) >> np.uint64(16)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as long as the longest text so far."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), np.uint64(base))
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def signature(sums: np.ndarray, ends: np.ndarray) -> str:
    """A letter for each piece of the bytes: up to each end, and what is left after the last."""
    n = len(sums) - 1
    stops = np.append(ends + 1, n) if not len(ends) or ends[-1] + 1 < n else ends + 1
    starts = np.concatenate([[0], stops[:-1]])
    # sums[j] - sums[i] holds bytes i .. j-1 times rising powers; without the start's power, equal pieces are equal.
    with np.errstate(over="ignore"):
        piece = (sums[stops] - sums[starts]) * powers(INVERSE, n)[starts]
    return LETTERS[(mix64(piece + (stops - starts).astype(np.uint64)) % np.uint64(64)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``; empty signatures for empty data.

    A piece ends where the rolling hash plus 1 is a multiple of the block. The block is LEAST_BLOCK times the least
    power of two at which at most SIGNATURE pieces arise, so no piece is ever left out of the signature. A text that repeats
    itself may fall from more pieces to under FEW in one step; it takes the smaller block, and its last letter stands for all
    that follows the first SIGNATURE - 1 pieces.
    """
    if not data:
        return f"{LEAST_BLOCK}::"
    array = np.frombuffer(data, dtype=np.uint8)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((array.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(array)), dtype=np.uint64)])
    value = rolling(array) + np.uint64(1)
    at = np.flatnonzero(value % np.uint64(LEAST_BLOCK) == 0)
    times = value[at] // np.uint64(LEAST_BLOCK)
    level = np.log2((times & (~times + np.uint64(1))).astype(np.float64)).astype(np.int64)  # powers of two in it
    reach = np.append(np.cumsum(np.bincount(level)[::-1])[::-1], 0) if len(at) else np.zeros(1, np.int64)
    k = int(np.argmax(reach < SIGNATURE))
    if k and reach[k] + 1 < FEW:
        k -= 1
    return f"{LEAST_BLOCK << k}:{signature(sums, at[level >= k][: SIGNATURE - 1])}:{signature(sums, at[level > k])}"


def likeness(a, b):
    """Likeness of two fingerprint columns, 0 to 1.

    Signatures at the same block size are compared: both pairs if the sizes agree, one pair if one is twice the other,
    none (0) otherwise. A pair's likeness is 1 - edit distance / the longer length; the larger pair counts. Equal
    fingerprints give 1, null gives null.
    """
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    size = lambda p: p[0].cast("long")
    near = lambda x, y: F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))
    return (
        F.when(a == b, F.lit(1.0))
        .when(size(pa_) == size(pb), F.greatest(near(pa_[1], pb[1]), near(pa_[2], pb[2])))
        .when(size(pa_) == 2 * size(pb), near(pa_[1], pb[2]))
        .when(2 * size(pa_) == size(pb), near(pa_[2], pb[1]))
        .when(a.isNotNull() & b.isNotNull(), F.lit(0.0))
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; a null text has the fingerprint of the empty one."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint((t or "").encode()) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fingerprint string")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, by falling doc_id.

    The edited text has its last floor(n/2) characters replaced by the first as many (or all) of the next document.
    Documents are ranged by id and read in order, range by range; the last row of a range comes as a copy from the
    next one, so that each pair of neighbours meets in one task and each text is shuffled about once.
    Rows with equal ids are ordered by their text's hash, null ids come last. One row is its own neighbour. An empty
    table gives no rows; a null text is empty.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    kind = dict(docs.dtypes)["doc_id"]
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id", "h").repartitionByRange(parts, *order).select("doc_id", "h", F.spark_partition_id().alias("p"))
    # One row for each range: their number is set by the partitions, not by the documents.
    heads = [tuple(r["head"]) for r in ids.groupBy("p").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("minus"), "h")).alias("head")).collect()]
    heads.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    none, minus, hashes = (np.array([r[k] or 0 for r in heads], dtype=np.int64) for k in range(3))

    @F.pandas_udf("array<int>")
    def ranges(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        """The range of a row, and after it the range before for which it is a copy."""
        blank = doc_id.isna().to_numpy()
        key = -doc_id.fillna(0).to_numpy().astype(np.int64)
        out = []
        for n, m, x in zip(blank.astype(np.int64), np.where(blank, 0, key), h.to_numpy(), strict=True):
            lo, hi = 0, len(heads)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if (none[mid], minus[mid], hashes[mid]) <= (n, m, x) else (lo, mid)
            mine = lo - 1
            first = (none[mine], minus[mine], hashes[mine]) == (n, m, x)
            out.append([mine, (mine - 1) % len(heads)] if first else [mine])
        return pd.Series(out)

    dealt = rows.withColumn("to", ranges("doc_id", "h")).select("doc_id", "h", "text", F.posexplode("to").alias("copy", "part"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "copy", *order)

    def run(batches):
        last = None  # part, doc_id, text, bytes, fingerprint of the row that waits for its neighbour
        for batch in batches:
            for piece in slices(batch):
                out = []
                for part, copy, doc_id, text in zip(*(piece.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text")), strict=True):
                    if copy and (last is None or last[0] != part):
                        continue  # a further copy of the same head
                    mark = fingerprint(text.encode())
                    if last is not None and last[0] == part:
                        half = len(last[2]) // 2
                        edited = (last[2][: len(last[2]) - half] + text[:half]).encode()
                        out.append((last[1], len(last[2]), hashlib.sha256(edited).hexdigest(), last[3], fingerprint(edited), mark))
                    last = None if copy else (part, doc_id, text, mark)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 4]
    found = dealt.select("part", "copy", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
    return found.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
