"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, table, word_codes

BUCKETS = 1 << 16
DIM = 4
LENGTHS = (3, 4, 5)
#: The model is fitted on so many labelled rows at most of either label, those with the least hash of their text.
SAMPLE_ROWS = 4000
STEPS = 300
RATE = 0.05
#: A bucket is in the model if so many rows of the sample have it, and toxic rows have it so many times as often as others and
#: more often by so many standard errors: most words of a toxic text are like any other's, and would drown the few that are not.
MIN_ROWS = 4
LEAST_LIFT = 2.0
LEAST_Z = 3.5
DECAY = 1e-3
#: The mean is over the words in the model, each for as much as its subwords are, and so many blank ones.
BLANKS = 1.0
#: The mean is taken this many times, so that embeddings stay small.
SCALE = 8.0
CUT = 0.7


def subwords(words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how many of each word): character n-grams of each lower-cased word in boundary marks, and itself."""
    marked = [f"<{w.lower()}>" for w in words]
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(chars))
    found, owners = [], []
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        live = at + n <= ends
        h[live] = h[live] * np.uint64(0x100000001B3) + chars[at[live] + n - 1] + np.uint64(1)
        if n in LENGTHS:
            found.append(mix64(h[live] + np.uint64(n)) % np.uint64(BUCKETS))
            owners.append(owner[live])
    starts = np.cumsum(lengths) - lengths
    powers = np.uint64(0x9E3779B97F4A7C15) ** (at - np.repeat(starts, lengths)).astype(np.uint64)
    whole = np.add.reduceat(mix64(chars) * powers, starts) if len(marked) else np.zeros(0, np.uint64)
    found.append(mix64(whole) % np.uint64(BUCKETS))
    owners.append(np.arange(len(marked)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(owner, minlength=len(marked)).astype(np.int64)


def _distinct_words(codes: np.ndarray, counts: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of each distinct word of each text, in order."""
    pairs = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, n_words) + codes)
    return pairs // max(1, n_words), pairs % max(1, n_words)


#: Characters of the sample's texts that are cut into subwords at once on the driver.
PART_CHARS = 400_000


def _parts(texts: list[str]):
    """(first, last + 1) of consecutive texts with about PART_CHARS characters; one text at least."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > PART_CHARS:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def associated(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Which buckets are in the model, from the rows of either label that have them."""
    rows = np.zeros((2, BUCKETS))
    for lo, hi in _parts(texts):
        codes, distinct, counts = word_codes(texts[lo:hi])
        grams, per_word = subwords(distinct)
        doc, word = _distinct_words(codes, counts, len(distinct))
        starts, reps = np.cumsum(per_word) - per_word, per_word[word]
        where = np.repeat(starts[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        found = np.unique(np.repeat(doc, reps) * BUCKETS + grams[where])
        for label in (0, 1):
            rows[label] += np.bincount(found[toxic[lo + found // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    share = rows.sum(0) / n.sum()
    z = (rows[1] / n[1] - rows[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    return (z > LEAST_Z) & (rows[1] / n[1] >= LEAST_LIFT * rows[0] / n[0]) & (rows.sum(0) >= MIN_ROWS)


def bags(texts: list[str], live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight): a text is the mean of its distinct words, a word the mean of its subwords; only buckets in the
    model, and words for the share of their subwords that are."""
    codes, distinct, counts = word_codes(texts)
    grams, per_word = subwords(distinct)
    owner = np.repeat(np.arange(len(distinct)), per_word)
    owner, kept = owner[live[grams]], grams[live[grams]]
    n = np.bincount(owner, minlength=len(distinct)).astype(np.int64)
    doc, word = _distinct_words(codes, counts, len(distinct))
    doc, word = doc[n[word] > 0], word[n[word] > 0]
    starts, reps = np.cumsum(n) - n, n[word]
    where = np.repeat(starts[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    text, weight = np.repeat(doc, reps), np.repeat(1 / np.maximum(per_word[word], 1), reps)
    mass = np.bincount(text, weight, minlength=len(texts)) + BLANKS
    return text, kept[where], weight / mass[text] * SCALE


Model = tuple[np.ndarray, np.ndarray, float]


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """(logit of each bucket, which are in the model, bias), from embeddings and softmax weights trained together by Adam.

    With one class only, no bucket is in the model and the bias tells the class.
    """
    if len(texts) == 0 or toxic.min() == toxic.max():
        return np.zeros(BUCKETS), np.zeros(BUCKETS, bool), (4.0 if len(texts) and toxic.max() else -4.0)
    live = associated(texts, toxic)
    place, parts = np.cumsum(live) - 1, []
    for lo, hi in _parts(texts):
        text, bucket, weight = bags(texts[lo:hi], live)
        # One entry for each text and bucket, so there are at most as many as rows of the sample times buckets in the model.
        key, at = np.unique(text * BUCKETS + bucket, return_inverse=True)
        parts.append(((key // BUCKETS + lo).astype(np.int32), place[key % BUCKETS].astype(np.int32), np.bincount(at, weight, minlength=len(key))))
    doc, idx, val = (np.concatenate([p[k] for p in parts]) for k in range(3))
    rng, n, size = np.random.default_rng(seed), len(texts), int(live.sum())
    params = [rng.normal(0, 0.1, (size, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        emb, out, bias = params
        bag = np.stack([np.bincount(doc, emb[idx, k] * val, minlength=n) for k in range(DIM)], 1)
        z = bag @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), toxic] -= 1
        p /= n
        back = p @ out.T
        grads = [np.stack([np.bincount(idx, back[doc, k] * val, minlength=size) for k in range(DIM)], 1) + DECAY * emb, bag.T @ p + DECAY * out, p.sum(0)]
        rate = RATE * max(0.02, 1 - step / STEPS)
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
    emb, out, bias = params
    logits = np.zeros(BUCKETS)
    logits[live] = emb @ (out[:, 1] - out[:, 0])
    return logits, live, float(bias[1] - bias[0])


def scores(texts: list[str], model: Model) -> np.ndarray:
    """The softmax's share of the toxic class."""
    logits, live, bias = model
    text, bucket, weight = bags(texts, live)
    z = np.bincount(text, logits[bucket] * weight, minlength=len(texts)) + bias
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def held_out(doc_id):
    """Rows that no label is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``sample_rows`` labelled rows of either label, picked by hash among those not held out."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id"))).select("doc_id", "toxic").withColumn("h", F.xxhash64(F.lit(11), "doc_id"))
    picked = known.where("toxic = 1").orderBy("h", "doc_id").limit(sample_rows).unionByName(known.where("toxic = 0").orderBy("h", "doc_id").limit(sample_rows))
    # The sample is bounded by sample_rows, and so is what is sent to the executors and back.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("h", "doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["toxic"], r["text"]))
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=np.int64))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only the text makes the score, so equal texts score alike. A null, empty or blank text has no words and the score
    of the bias. A row whose doc_id is null is not held out. Rows with several labels teach each of them.
    """
    model = train(docs, labels, **options)

    def score(batches):
        for batch in batches:
            for piece in slices(batch):
                s = scores([t or "" for t in piece.column("text").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    marked = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return marked.mapInArrow(score, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op5(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
