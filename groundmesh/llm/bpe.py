"""BPE encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_filter, cut, mix64, slices, table

#: A chunk ends where the hash of its last WINDOW characters is 0 modulo MEAN; it has LEAST to MOST characters.
WINDOW = 16
MEAN = 1024
LEAST = 256
MOST = 8192
#: Pre-token starts on either side of a join whose tokens must agree with the chunk's own.
GUARD = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def load(path: str):
    """(encoder, bytes of each id, their lengths) of a ranks file; the id after the last rank ends a text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = np.empty(len(ranks) + 1, dtype=object)
    for piece, i in ranks.items():
        pieces[i] = piece
    pieces[len(ranks)] = b"<|endoftext|>"
    encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return encoder, pieces, np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))


def encode(vocabulary, text: str) -> np.ndarray:
    return vocabulary[0].encode_to_numpy(text, allowed_special="all")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def cuts(chars: np.ndarray) -> list[int]:
    """Ends of the chunks of a text; where a chunk ends depends on nearby characters only, so copies are cut alike."""
    n = len(chars)
    if n <= LEAST:
        return [n] if n else []
    wide = chars.astype(np.uint64)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + wide[k : k + len(h)]
    out, last = [], 0
    for end in (np.flatnonzero(mix64(h) % np.uint64(MEAN) == 0) + WINDOW).tolist():
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST and end < n:
            out.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def chunk_key(chunk: str) -> int:
    return int.from_bytes(hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def safe_starts(chars: np.ndarray) -> np.ndarray:
    """Positions of a blank before a Latin letter or digit: a pre-token starts there whatever stands around it."""
    c = chars[1:]
    plain = ((c >= 48) & (c <= 57)) | ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c <= 0x24F) & (c != 0xD7) & (c != 0xF7))
    return np.flatnonzero((chars[:-1] == 32) & plain)


def assemble(vocabulary, text: str, known: dict[int, np.ndarray]) -> np.ndarray:
    """The ids of the whole text, from those of its chunks.

    Each chunk's ids are taken from ``known`` or made now. Around each join, from some pre-token start before it to one
    after it, the text is encoded anew; the outer tokens of that window must agree with the chunks' tokens, else the
    window grows, in the end to the whole text. Windows that meet become one.
    """
    chars = code_points(text)
    ends = cuts(chars)
    if len(ends) < 2:
        return encode(vocabulary, text)
    lengths = vocabulary[2]
    starts = [0, *ends[:-1]]
    parts = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    ids = [known.get(chunk_key(x)) if known else None for x in parts]
    ids = [encode(vocabulary, x) if i is None else i for x, i in zip(parts, ids, strict=True)]
    size = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))])
    bounds = [np.concatenate([[0], np.cumsum(lengths[i])]) + size[a] for i, a in zip(ids, starts, strict=True)]
    safe = safe_starts(chars)
    guard = [GUARD] * (len(ends) - 1)
    while True:
        windows = []  # start, end, start and end of what must agree, joins
        for j, c in enumerate(ends[:-1]):
            i, k = np.searchsorted(safe, c, side="right"), np.searchsorted(safe, c, side="left")
            lo, mid_lo = (int(safe[i - guard[j]]), int(safe[i - 1])) if i >= guard[j] else (0, 0)
            hi, mid_hi = (int(safe[k + guard[j] - 1]), int(safe[k])) if k + guard[j] <= len(safe) else (len(chars), len(chars))
            if windows and lo <= windows[-1][1]:
                windows[-1] = [min(lo, windows[-1][0]), max(hi, windows[-1][1]), windows[-1][2], mid_hi, [*windows[-1][4], j]]
            else:
                windows.append([lo, hi, mid_lo, mid_hi, [j]])
        out, at, bad = [], 0, []
        for lo, hi, mid_lo, mid_hi, joins in windows:
            new = encode(vocabulary, text[lo:hi])
            edge = np.concatenate([[0], np.cumsum(lengths[new])]) + size[lo]
            first, last = joins[0], joins[-1] + 1
            agree = _between(ids[first], bounds[first], size[lo], size[mid_lo]), _between(new, edge, size[lo], size[mid_lo]), _between(ids[last], bounds[last], size[mid_hi], size[hi]), _between(new, edge, size[mid_hi], size[hi])
            # Nothing needs to agree at an end of the text, nor where the window runs over the whole of a chunk.
            left = lo == 0 or (lo >= starts[first] and agree[0] is not None and agree[1] is not None and np.array_equal(agree[0], agree[1]))
            right = hi == len(chars) or (hi <= ends[last] and agree[2] is not None and agree[3] is not None and np.array_equal(agree[2], agree[3]))
            if not (left and right):
                bad += joins
                continue
            if at < lo:
                out.append(_between(ids[first], bounds[first], size[at], size[lo]))
            out.append(new)
            at = hi
        if not bad and all(x is not None for x in out):
            if at < len(chars):
                out.append(_between(ids[-1], bounds[-1], size[at], size[-1]))
            if all(x is not None for x in out):
                return np.concatenate(out)
            bad = range(len(guard))
        if all(g > len(safe) for g in guard):
            return encode(vocabulary, text)
        for j in bad or range(len(guard)):
            guard[j] *= 2


def _between(ids: np.ndarray, bounds: np.ndarray, lo: int, hi: int):
    """The tokens from byte lo to byte hi, None if a token lies across either."""
    i, j = np.searchsorted(bounds, lo), np.searchsorted(bounds, hi)
    if i >= len(bounds) or j >= len(bounds) or bounds[i] != lo or bounds[j] != hi:
        return None
    return ids[i:j]


def decode(vocabulary, ids: np.ndarray) -> str:
    return b"".join(vocabulary[1][ids]).decode("utf-8", "replace")


def digests(vocabulary, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest(), hashlib.sha256(decode(vocabulary, ids).encode()).hexdigest()


def _pieces(batches, columns):
    for batch in batches:
        for piece in slices(batch):
            yield piece, list(zip(*(piece.column(c).to_pylist() for c in columns), strict=True))


def shared_filter(docs: DataFrame) -> np.ndarray:
    """A filter of the chunks that stand in the corpus twice or more."""

    def keys(batches):
        for _, rows in _pieces(batches, ["text"]):
            found = []
            for (text,) in rows:
                last = 0
                for end in cuts(code_points(text)):
                    found.append(chunk_key(text[last:end]))
                    last = end
            # A task's chunks meet before they are shuffled.
            key, times = np.unique(np.array(found, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(times)], ["chunk", "times"])

    counts = docs.select("text").mapInArrow(keys, "chunk long, times long").groupBy("chunk").agg(F.sum("times").alias("times")).where("times > 1")
    return bit_filter(counts, "chunk")


def is_shared(bits: np.ndarray, key: int) -> bool:
    at = key % FILTER_BITS
    return bool((int(bits[at >> 6]) >> (at & 63)) & 1)


def encode_documents(docs: DataFrame, vocabulary_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of ``docs``, and ids if asked for.

    Texts are cut into content-defined chunks. A chunk that is shared, in one document or by many, is encoded once and
    its ids travel to the documents; documents without shared chunks are encoded where they are read. Joins of chunks
    are repaired until they agree exactly with the chunks' own tokens. A null text is empty and has no tokens; the
    string of a special token in a text is that token. Rows that repeat give rows that repeat.
    """
    spark = docs.sparkSession
    path = vocabulary_path or default_vocabulary()
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    bits = spark.sparkContext.broadcast(shared_filter(rows))

    def shared_chunks(batches):
        sent = set()
        for _, found in _pieces(batches, ["key", "text"]):
            out = []
            for key, text in found:
                last, mine = 0, set()
                for end in cuts(code_points(text)):
                    chunk = text[last:end]
                    last = end
                    if is_shared(bits.value, c := chunk_key(chunk)) and c not in mine:
                        mine.add(c)
                        if len(sent) > 100_000:
                            sent.clear()
                        out.append((key, c, None if c in sent else chunk))
                        sent.add(c)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "chunk", "part"])

    refs = cut(rows.select("key", "text").mapInArrow(shared_chunks, "key long, chunk long, part string"))

    def encode_once(batches):
        vocabulary, before = load(path), None
        for batch in batches:
            out = []
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("part").to_pylist(), strict=True):
                if chunk != before:
                    out.append((chunk, encode(vocabulary, part).astype("<u2").tobytes()))
                before = chunk
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["chunk", "ids"])

    texts = refs.where("part is not null").select("chunk", "part")
    once = texts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(encode_once, "chunk long, ids binary")
    lent = refs.select("key", "chunk").distinct().join(once, "chunk").groupBy("key").agg(F.collect_list(F.struct("chunk", "ids")).alias("lent"))

    fields = f"doc_id {kind}, key long, text string, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    columns = ["doc_id", "key", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def batch_of(piece, out):
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True))], columns)

    def result(vocabulary, text, known):
        ids = assemble(vocabulary, text, known)
        return (*digests(vocabulary, ids), ids.astype("<u2").tobytes() if keep_ids else None)

    def in_place(batches):
        vocabulary = load(path)
        for piece, found in _pieces(batches, ["key", "text"]):
            out = []
            for key, text in found:
                last, any_shared = 0, False
                for end in cuts(code_points(text)):
                    any_shared = any_shared or is_shared(bits.value, chunk_key(text[last:end]))
                    last = end
                out.append((key, text, None, None, None, None) if any_shared else (key, None, *result(vocabulary, text, {})))
            yield batch_of(piece, out)

    first = rows.select("doc_id", "key", "text").mapInArrow(in_place, fields)

    def finish(batches):
        vocabulary = load(path)
        for piece, found in _pieces(batches, ["key", "text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "lent"]):
            out = []
            for key, text, n, a, b, ids, lent_ids in found:
                if text is None:
                    out.append((key, None, n, a, b, ids))
                else:
                    out.append((key, None, *result(vocabulary, text, {x["chunk"]: np.frombuffer(x["ids"], dtype="<u2") for x in lent_ids or ()})))
            yield batch_of(piece, out)

    done = first.join(lent, "key", "left").select(*columns, "lent").mapInArrow(finish, fields)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else []))


def op10(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
