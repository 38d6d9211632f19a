"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio of trusted against raw text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, sums, table, word_codes, word_hashes

#: n-grams are hashed into so many buckets; the model is two counts for each, whatever the corpus holds.
BUCKETS = 1 << 14
#: Documents whose log ratio, a mean over their n-grams, is below this go; plain text lies near 0.
THRESHOLD = -0.1
#: Counts that are added to a bucket at the corpus's own ratio, so rare n-grams say little.
SMOOTHING = 20.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BLANK = " \t\n\x0b\x0c\r"

FEATURES = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]


def grams(codes: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, n-grams of each text): single words, then pairs of neighbours, in text order."""
    h = hashes[codes]
    n = len(h)
    doc = np.repeat(np.arange(len(counts)), counts)
    mask = np.uint64(BUCKETS - 1)
    one = (mix64(h) & mask).astype(np.int64)
    pair = (mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) & mask).astype(np.int64) if n > 1 else np.zeros(0, np.int64)
    inside = doc[:-1] == doc[1:] if n > 1 else np.zeros(0, bool)
    both, owner = np.concatenate([one, pair[inside]]), np.concatenate([doc, doc[:-1][inside]])
    order = np.argsort(owner, kind="stable")
    return both[order], np.bincount(owner, minlength=len(counts)).astype(np.int64)


def base_counts(texts: list[str], codes: np.ndarray, distinct: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The columns of FEATURES for each text."""
    lengths = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct))
    symbols = [sum(t.count(c) for c in SYMBOLS) for t in texts]
    dup = []
    for t in texts:
        lines = t.split("\n")
        dup.append(0 if len(lines) == 1 else len(full := [x for x in lines if x.strip(BLANK)]) - len(set(full)))
    return [counts, sums(lengths[codes], counts) if len(codes) else np.zeros(len(texts), np.int64), np.array(symbols), np.array(dup), repeat_words(codes, counts)]


def repeat_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in that text."""
    n = len(codes)
    if n < 3:
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc[:-2] == doc[2:])
    window = codes[at]
    for k in (1, 2):  # exact ranks of pairs, then of triples, then of triples in a text
        window = np.unique(window * (codes.max() + 1) + codes[at + k], return_inverse=True)[1]
    _, rank, times = np.unique(window * len(counts) + doc[at], return_inverse=True, return_counts=True)
    twice = at[times[rank] > 1]
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[twice + k] = True
    return sums(covered.astype(np.int64), counts)


def _texts(piece, name: str = "text") -> list[str]:
    return [t or "" for t in piece.column(name).to_pylist()]


def _count(batches):
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for piece in slices(batch):
            codes, distinct, counts = word_codes(_texts(piece))
            found, per_text = grams(codes, word_hashes(distinct), counts)
            raw += np.bincount(found, minlength=BUCKETS)
            good = np.array(piece.column("good").to_pylist(), dtype=bool)
            trusted += np.bincount(found[np.repeat(good, per_text)], minlength=BUCKETS)
    hit = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(trusted[hit])], ["bucket", "raw", "trusted"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(trusted / raw) for each bucket, smoothed; trusted are the documents labelled quality 1.

    Each task sums its documents in vectors of BUCKETS counts before anything is shuffled, and BUCKETS rows at most
    reach the driver. All counts are of the whole corpus. Without trusted documents, all ratios are 0.
    """
    good = labels.where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    # Both sides are dealt by id at every size: how many labels there are is not bounded, so none are broadcast.
    marked = docs.select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = marked.mapInArrow(_count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).collect()
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in found:
        raw[bucket], trusted[bucket] = r, t
    if not trusted.sum():
        return np.zeros(BUCKETS)
    ratio = trusted.sum() / raw.sum()
    return np.log((trusted + SMOOTHING * ratio) / (raw + SMOOTHING)) - np.log(ratio)


def judge(texts: list[str], ratios: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, score, base_failed, kept) for each text."""
    codes, distinct, counts = word_codes(texts)
    found, per_text = grams(codes, word_hashes(distinct), counts)
    score = np.where(per_text > 0, sums(ratios[found], per_text) / np.maximum(per_text, 1), 0.0)
    base = base_counts(texts, codes, distinct, counts)
    failed = (base[0] < MIN_WORDS) | (100 * base[4] > MAX_REPEAT_PERCENT * base[0])
    return base, score, failed, ~failed & (np.round(score, 9) >= THRESHOLD)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base counts, llr, base_failed and kept for every row of ``docs``.

    A null text counts as one without words, which fails the base rule; repeated rows are judged one by one, and equal
    texts alike; an empty table gives no rows. Other columns than doc_id and text are ignored.
    """
    ratios = log_ratios(docs, labels)

    def score(batches):
        for batch in batches:
            for piece in slices(batch):
                base, llr, failed, kept = judge(_texts(piece), ratios)
                columns = [piece.column("doc_id"), *(pa.array(x, t) for x, (_, t) in zip(base, FEATURES, strict=True)), pa.array(llr), pa.array(failed), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(n for n, _ in FEATURES), "llr", "base_failed", "kept"])

    fields = ", ".join(f"{n} long" for n, _ in FEATURES)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, {fields}, llr double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score_documents keeps, with all their columns."""
    ratios = log_ratios(docs, labels)

    def keep(batches):
        for batch in batches:
            for piece in slices(batch):
                yield piece.filter(pa.array(judge(_texts(piece), ratios)[3]))

    return docs.mapInArrow(keep, docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
