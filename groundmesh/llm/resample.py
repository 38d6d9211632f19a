"""Target-distribution importance resampling: an Aho-Corasick dictionary whose payloads make up hashed n-grams."""

from __future__ import annotations

import zlib
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, global_row_numbers, slices, sums, table

#: Features are hashed into so many buckets; the model is two counts for each, whatever the corpus holds.
BUCKETS = 10_000
#: The dictionary has at most so many words of at most so many bytes, so it travels to every task; the CRC of any other
#: word is taken from its bytes, so the choice of words changes the speed and no result.
WORDS = 1 << 17
WORD_BYTES = 64
#: Documents with fewer words are never drawn; of the others this share is.
LEAST_WORDS = 20
PERCENT = 25
SEED = 7

#: Bytes of UTF-8 text: A-Z are lowered, what is neither a digit, a letter nor above ASCII parts words.
PLAIN = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """CRC-32 of each byte after a register of zeros."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


CRC = _crc_table()


@lru_cache(maxsize=1)
def _zero_bytes() -> list[np.ndarray]:
    """For k = 0, 1, ...: what 2^k zero bytes make of a register, by each of its four bytes (4 x 256)."""
    out = [np.stack([CRC if k == 0 else np.arange(256, dtype=np.uint32) << np.uint32(8 * k - 8) for k in range(4)])]
    for _ in range(31):
        last = out[-1]
        out.append(np.stack([_through(last, row) for row in last]))
    return out


def _through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & np.uint32(255)] ^ tables[1][(c >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(c >> np.uint32(16)) & np.uint32(255)] ^ tables[3][c >> np.uint32(24)]


def compose(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of two strings with a space between them, from their own CRCs and the second's bytes."""
    c = first ^ ONES
    c = (CRC[(c ^ np.uint32(32)) & np.uint32(255)] ^ (c >> np.uint32(8))) ^ ONES
    for k, tables in enumerate(_zero_bytes()):
        left = lengths >> k
        if not left.any():
            break
        at = np.flatnonzero(left & 1)
        c[at] = _through(tables, c[at])
    return c ^ second


def plain(texts) -> tuple[bytes, np.ndarray]:
    """The texts as one run of words between single bytes of space, and where each text ends in it."""
    parts = [(t or "").encode("utf-8", "replace").translate(PLAIN) for t in texts]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    return b" " + b" ".join(parts) + b" ", ends


_BUILT: tuple = (None, None)


def automaton(words: list[bytes]):
    """Finds `` word `` for each word; a find carries the word's CRC and, 32 bits up, its bytes. Kept from task to task."""
    global _BUILT
    key = zlib.crc32(b" ".join(words)), len(words)
    if _BUILT[0] != key:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for w in words:
            machine.add_word(f" {w.decode('latin-1')} ", zlib.crc32(w) | len(w) << 32)
        machine.make_automaton()
        _BUILT = key, machine
    return _BUILT[1]


def features(texts, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, buckets of all words, pairs of each text, buckets of all pairs), in text order.

    The automaton's finds give the CRCs of dictionary words where they end; those of pairs are composed of two
    neighbours' CRCs and the second's length.
    """
    data, text_ends = plain(texts)
    edges = np.flatnonzero(np.diff(np.frombuffer(data, dtype=np.uint8) != 32)) + 1
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    crc, length = np.zeros(n, np.uint32), np.zeros(n, np.int64)
    if words and n:
        found = np.fromiter(chain.from_iterable(automaton(words).iter(data.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
        at = np.searchsorted(ends, found[:, 0])
        crc[at], length[at] = (found[:, 1] & 0xFFFFFFFF).astype(np.uint32), found[:, 1] >> 32
    for k in np.flatnonzero(length == 0).tolist():
        crc[k], length[k] = zlib.crc32(data[starts[k] : ends[k]]), ends[k] - starts[k]
    owner = np.searchsorted(text_ends, starts, side="left")
    per_text = np.bincount(owner, minlength=len(text_ends)).astype(np.int64)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    pairs = compose(crc[:-1], crc[1:], length[1:])[inside] if n > 1 else np.zeros(0, np.uint32)
    return per_text, (crc % np.uint32(BUCKETS)).astype(np.int64), np.maximum(per_text - 1, 0), (pairs % np.uint32(BUCKETS)).astype(np.int64)


def frequent_words(*corpora: DataFrame, most: int = WORDS) -> list[bytes]:
    """At most ``most`` of the words that stand most often in the texts; words that a batch has once do not count."""

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for piece in slices(batch):
                seen.update(plain(piece.column(0).to_pylist())[0].split())
            kept = [(w, n) for w, n in seen.items() if n > 1 and len(w) <= WORD_BYTES]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    texts = corpora[0].select("text")
    for c in corpora[1:]:
        texts = texts.unionByName(c.select("text"))
    words = cut(texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # An eighth of a doubling is a level; from the levels that fit, at most ``most`` words in all come to the driver.
    level = F.floor(8 * F.log2("n")).cast("int")
    fits, total = [], 0
    for at, k in sorted(((r["level"], r["count"]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True):
        total += k
        if total > most:
            break
        fits.append(at)
    if not fits:
        return []
    return sorted(bytes(r["word"]) for r in words.where(level >= min(fits)).select("word").collect())


def bucket_counts(corpus: DataFrame, words: list[bytes]) -> np.ndarray:
    """How many features of the whole corpus lie in each bucket; tasks send BUCKETS sums at most."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for piece in slices(batch):
                _, ones, _, twos = features(piece.column(0).to_pylist(), words)
                total += np.bincount(ones, minlength=BUCKETS) + np.bincount(twos, minlength=BUCKETS)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in corpus.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier each bucket is in the target than in the raw corpus, floored."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of bucket gains over a document's words and word pairs.

    A null or wordless text has no features and weight 0; repeated rows are weighed one by one, and count as often in the
    corpus. Only ``doc_id`` and ``text`` of ``docs`` and ``text`` of ``target`` are read, so other columns may have any
    name. An empty target leaves all gains to the smoothing.
    """
    words = frequent_words(docs, target)
    gains = bucket_gains(bucket_counts(docs, words), bucket_counts(target, words))

    def weigh(batches):
        for batch in batches:
            for piece in slices(batch):
                n_ones, ones, n_twos, twos = features(piece.column("text").to_pylist(), words)
                n = n_ones + n_twos
                weight = (sums(gains[ones], n_ones) + sums(gains[twos], n_twos)) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n_ones), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weigh_documents with score and rank: a draw without replacement, likelier the more a document is like the target.

    score adds Gumbel noise that the seed and doc_id decide. Of the N documents with ``least_words`` words, the
    floor(percent * N / 100) highest scores are drawn and ranked 1, 2, ..., ties to the smaller doc_id, null ids last;
    equal rows are ranked next to each other. Others have no rank. A null id draws its noise as an empty one. Ranks come from a range
    partitioning on score and id, so no task orders all documents.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = cut(weigh_documents(docs, target).withColumn("score", F.col("weight") + noise).withColumn("drawable", F.col("n_words") >= least_words))
    quota = percent * scored.where("drawable").count() // 100
    placed, _ = global_row_numbers(scored, [F.desc("drawable"), F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    return placed.withColumn("rank", F.when(F.col("rank") < quota, F.col("rank") + 1)).drop("drawable")


def op12(spark, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: A CRC is taken bit by bit, least bit of each byte first, over distinct features.
OP12_SQL = f"""
with words as (select 'd' as side, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') as w from documents
  union all select 't', null, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+') from benchmark),
feats as (select side, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as f from words),
hexed as (select f, hex(encode(f)) as h from (select distinct f from feats)),
bits as (select f, list_transform(range(0, 4 * len(h)), lambda k: cast(('0x' || substr(h, cast(1 + 2 * (k // 8) as int), 2)) as bigint) >> (k % 8) & 1) as b from hexed),
crcs as (select f, xor(list_reduce(list_concat([4294967295::bigint], b), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % {BUCKETS} as bucket from bits),
counted as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from feats join crcs using (f) group by 1),
totals as (select sum(s) as ss, sum(t) as tt from counted),
gains as (select bucket, cast(floor(1000 * ln((t + 1)::double * (ss + {BUCKETS})::double / ((s + 1)::double * (tt + {BUCKETS})::double))) as bigint) as gain from counted, totals),
weights as (select doc_id, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight from feats join crcs using (f) join gains using (bucket) where side = 'd' group by 1),
scored as (select d.doc_id, len(d.w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from words d left join weights using (doc_id) where d.side = 'd'),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_words >= {LEAST_WORDS})
select doc_id, cast(n_features as bigint) as n_features, weight, score, case when r <= {PERCENT} * n // 100 then r end as rank from scored left join ranked using (doc_id)"""
