"""Removal of long repeated byte strings with run-length indexes over minimizer buckets."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, cut, in_filter, mix64, table

#: Bytes of a string that, found in an earlier document, is removed.
LENGTH = 50
#: Bytes of the k-mers whose least hash in a string of LENGTH bytes picks the string's bucket.
KMER = 24
#: Strings that one piece of text holds at most; a mark is a place in the text above SPAN bits for them.
SPAN = LENGTH - KMER + 1
#: Bytes of text that are hashed at once, and bits that hold a place among them.
PIECE = 1 << 21
PLACE_BITS = 22
#: A k-mer's 42-bit hash is a slice of the shared-k-mer filter and a key in that slice.
SLICES = 1 << 12
SLICE_BITS = 1 << 15
#: Distinct keys of a slice that a task counts at once; a slice with more counts as shared throughout.
SLICE_KEYS = 1 << 22
#: A bucket that more texts share than this is not indexed: its strings are compared one by one, by a shuffle.
HOT_TEXTS = 100_000
#: Bytes of candidate pieces that a task gathers before it packs them, and those of a piece beside its content.
FLUSH, PIECE_BYTES = 64 << 20, 40
#: Candidate pieces that a part of the shuffle holds, about 2 MB of text for each 30,000; a part is indexed by one task.
PART_PIECES = 200_000
#: Bits of the filter on pieces whose text the index needs; as it fills up more texts travel, results do not change.
ASKED_BITS = 1 << 27
#: Symbols that one index holds, if no single bucket is larger.
BLOCK = 1 << 19


def anchors(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash): for each run of strings with the same least k-mer, where the strings start.

    data: bytes of consecutive texts; doc: the text of each byte. Strings never cross texts. The least k-mer is the
    leftmost of those with the least hash, so equal strings have equal k-mers at equal places, in any text.
    """
    n = len(data) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    b = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        h, size, acc, acc_size, power = data.astype(np.uint64) + np.uint64(1), 1, None, 0, b
        while True:  # hashes of KMER bytes from those of powers of two
            if KMER & size:
                acc = h if acc is None else acc[: len(h) - acc_size] * power + h[acc_size:] if len(acc) >= len(h) else acc * power + h[acc_size : acc_size + len(acc)]
                acc_size += size
            if size * 2 > KMER:
                break
            h = h[:-size] * power + h[size:]
            power, size = power * power, size * 2
    v = mix64(acc[: n + SPAN - 1])
    v = (v >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(v), dtype=np.uint64)
    size = 1
    while size * 2 <= SPAN:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    v = np.minimum(v[:n], v[SPAN - size : SPAN - size + n])
    at = np.flatnonzero(doc[:n] == doc[LENGTH - 1 :])
    v = v[at]
    fresh = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else at
    ends = np.append(fresh[1:], len(at)) - 1 if len(at) else fresh
    return at[fresh], at[ends], v[fresh] >> np.uint64(PLACE_BITS)


def pieces(batches, ids: tuple[str, ...] = ()):
    """(texts as bytes, their other columns, data, text of each byte, offset of each text's part) in bounded pieces.

    A text longer than PIECE comes alone, in parts that overlap by LENGTH - 1 bytes, so each string is in one part.
    """
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        others = [batch.column(c).to_pylist() for c in ids]
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= PIECE:
                size += len(texts[stop])
                stop += 1
            group = texts[start:stop]
            for offset in range(0, max(1, size), PIECE) if stop == start + 1 else (0,):
                data = b"".join(group) if stop > start + 1 else group[0][offset : offset + PIECE + LENGTH - 1]
                array = np.frombuffer(data, dtype=np.uint8)
                owner = np.repeat(np.arange(len(group)), [len(t) for t in group]) if stop > start + 1 else np.zeros(len(array), np.int64)
                yield start, group, [c[start:stop] for c in others], array, owner, offset
            start = stop


def merged_counts(keys: np.ndarray, counts: np.ndarray, blobs: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, counts, loss): counts of keys with more blobs of keys added, at most ``most`` of them.

    If there are more, the next largest count is taken off all (as a Misra-Gries summary does), so a key's count is low by
    the losses in all at most, which are under all keys seen over ``most``.
    """
    every = np.concatenate([keys, *blobs])
    weight = np.concatenate([counts, np.ones(len(every) - len(keys), np.int64)])
    keys, at = np.unique(every, return_inverse=True)
    counts = np.bincount(at, weight).astype(np.int64)
    if len(keys) <= most:
        return keys, counts, 0
    loss = int(np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1])
    return keys[counts > loss], counts[counts > loss] - loss, loss


def shared_kmers(docs: DataFrame, kept) -> tuple[np.ndarray, np.ndarray, int]:
    """(filter bits by slice, hot keys, pieces): which least k-mers stand in two texts or more, and in very many.

    kept: takes the batches of a task and gives those rows that count, in the same Python process.
    Keys travel as sorted arrays of 4 bytes each. SLICES rows of fixed size reach the driver, and the hot keys, of which
    there are at most as many as least k-mers in the corpus over HOT_TEXTS. pieces: how many keys of a text are shared.
    """

    def keys(batches):
        held, size = [], 0

        def flush():
            key = np.sort(np.concatenate(held))
            part = (key >> np.uint64(30)).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            low = (key & np.uint64((1 << 30) - 1)).astype("<u4")
            blobs = [low[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array(blobs, pa.binary())], ["slice", "low"])

        for _, _, _, data, owner, _ in pieces(kept(batches)):
            first, _, key = anchors(data, owner)
            if len(key):
                order = np.lexsort((key, owner[first]))
                k, o = key[order], owner[first][order]
                held.append(k[np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])])
                size += len(held[-1])
                if size > 1 << 22:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(batches):
        none = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        now, held, size, seen, lost, total = None, [], 0, none, 0, 0

        def fold():
            nonlocal held, size, seen, lost
            *seen, loss = merged_counts(*seen, held, SLICE_KEYS)
            held, size, lost = [], 0, lost + loss

        def close():
            fold()
            bits, (low, times) = np.zeros(SLICE_BITS, np.uint8), seen
            bits[low[times > 1] % SLICE_BITS] = 1
            if lost:
                bits[:] = 1
            shared = total if lost else int(times[times > 1].sum())
            hot = (np.uint64(now) << np.uint64(30)) | low[times + lost > HOT_TEXTS].astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([hot.astype("<u8").tobytes()], pa.binary()), pa.array([shared], pa.int64())], ["slice", "bits", "hot", "shared"])

        for batch in batches:
            for part, low in zip(batch.column("slice").to_pylist(), batch.column("low").to_pylist(), strict=True):
                if part != now:
                    if now is not None:
                        yield close()
                    now, held, size, seen, lost, total = part, [], 0, none, 0, 0
                held.append(np.frombuffer(low, dtype="<u4"))
                size, total = size + len(held[-1]), total + len(held[-1])
                if size > SLICE_KEYS:
                    fold()
        if now is not None:
            yield close()

    low = docs.mapInArrow(keys, "slice int, low binary")
    found = low.repartition("slice").sortWithinPartitions("slice").mapInArrow(meet, "slice int, bits binary, hot binary, shared long").collect()
    bits = np.zeros((SLICES, SLICE_BITS // 8), np.uint8)
    for r in found:
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return bits, np.sort(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(r["hot"], "<u8") for r in found)])).astype(np.uint64), sum(r["shared"] for r in found)


#: Parts that the rows of one text are dealt to where copies meet their first.
SALTS = 16


class Copies:
    """Which rows have a text that a smaller doc_id has too, as two filters of fixed size on the rows' keys.

    The first filter has the keys of all copies, the second those of other rows that the first takes for copies. A row
    in the first only is a copy for certain. As the filters fill up at larger corpora fewer copies are known so, and
    the others are worked on as any text is; results do not change.
    """

    def __init__(self, rows: DataFrame):
        salt = F.expr(f"pmod(key, {SALTS}L)")
        known = cut(rows.where(f"octet_length(text) >= {LENGTH}").select("key", "nth", F.unhex(F.sha2("text", 256)).alias("sha"), salt.alias("salt")))
        least = known.groupBy("sha").agg(F.min("nth").alias("first"), F.max("nth").alias("last")).where("first < last")
        least = least.select("sha", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        told = cut(known.join(least, ["sha", "salt"], "left").select("key", F.coalesce(F.expr("nth > first"), F.lit(False)).alias("copy")))
        self.yes = yes = bit_filter(told.where("copy"), "key")

        def taken(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_filter(yes, batch.column("key").to_numpy())))

        self.no = bit_filter(told.where("not copy").select("key").mapInArrow(taken, "key long"), "key")

    def among(self, keys: np.ndarray) -> np.ndarray:
        return in_filter(self.yes, keys) & ~in_filter(self.no, keys)


def maybe_shared(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key & np.uint64(SLICE_BITS - 1)).astype(np.int64)
    return (bits[(key >> np.uint64(30)).astype(np.int64), at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def sorted_places(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their ranks, ties by place; the ranks in that order)."""
    bits = max(1, (len(rank) - 1).bit_length())
    if not len(rank) or int(rank.max()) >> (63 - bits):
        order = np.argsort(rank, kind="stable")
        return order, rank[order]
    both = np.sort((rank << bits) | np.arange(len(rank)))  # one sort of numbers is far quicker than one of their places
    return both & ((1 << bits) - 1), both >> bits


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of a set of strings, the earliest first.

    Kept are the runs alone: where each starts, its symbol, where the rows before its first lead (so one search among
    the starts does an LF step), and a sample, the run's least place in the text. Runs also end where rows stop
    sharing LENGTH symbols, so a match of that length is a range of whole runs and its earliest place the least sample.
    """

    def __init__(self, strings: list[bytes]):
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int((lengths + 1).sum()), dtype=np.int64)
        owner = np.repeat(np.arange(len(strings)), lengths + 1)
        ends = self.starts[owner] + lengths[owner]  # each string's own end symbol
        inside = np.ones(len(text), dtype=bool)
        inside[self.starts + lengths] = False
        text[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int64) + 1
        place = np.arange(len(text))
        left = ends - place
        # Ranks by 7 symbols, then by twice as many as before, until no string is longer; ties by place.
        padded = np.concatenate([text, np.zeros(7, np.int64)])
        rank = np.zeros(len(text), dtype=np.int64)
        for k in range(7):
            rank = (rank << 9) | np.where(k < left, padded[k : k + len(text)], 0)
        size, ranks = 7, {}
        while True:
            order, ordered = sorted_places(rank)
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])) + 1
            if size < LENGTH <= 2 * size:
                ahead = np.minimum(place + LENGTH - size, len(text) - 1)
                ranks = {"head": rank, "tail": rank[ahead]}
            if size > lengths.max():
                break
            ahead = np.where(left > size, rank[np.minimum(place + size, len(text) - 1)], 0)
            rank = rank * (int(rank.max()) + 1) + ahead
            size *= 2
        symbol = np.where(order == self.starts[owner[order]], 0, text[order - 1])
        enough = left[order] >= LENGTH
        same = np.zeros(len(text), dtype=bool)
        same[1:] = enough[1:] & enough[:-1] & (ranks["head"][order][1:] == ranks["head"][order][:-1]) & (ranks["tail"][order][1:] == ranks["tail"][order][:-1])
        run = np.flatnonzero(~same | np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        self.run_starts, self.run_symbols = run, symbol[run]
        self.run_samples = np.minimum.reduceat(order, run)
        sizes = np.diff(np.append(run, len(text)))
        by_symbol = np.lexsort((run, self.run_symbols))
        self.run_leads = np.empty(len(run), dtype=np.int64)
        self.run_leads[by_symbol] = np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        group = np.flatnonzero(~same[run])
        earliest = np.minimum.reduceat(self.run_samples, group)
        self.run_earliest = np.repeat(earliest, np.diff(np.append(group, len(run))))
        self.lengths = lengths

    def earliest_matches(self) -> np.ndarray:
        """The earliest place in the text of the LENGTH symbols at each place of each string, string after string.

        All strings are read backwards side by side, one LF step for each symbol.
        """
        n = np.maximum(self.lengths - LENGTH + 1, 0)
        base = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), dtype=np.int64)
        live = np.argsort(-self.lengths, kind="stable")  # the longest first, so those that go on stay in front
        row = live.copy()  # end symbols come first and in order
        run = np.searchsorted(self.run_starts, row, side="right") - 1
        more = len(self.lengths) - np.searchsorted(np.sort(self.lengths), np.arange(1, int(self.lengths.max()) + 1), side="left")
        for step, k in enumerate(more.tolist(), 1):
            live, run, row = live[:k], run[:k], row[:k]
            row = self.run_leads[run] + row - self.run_starts[run]
            run = np.searchsorted(self.run_starts, row, side="right") - 1
            if step >= LENGTH:
                out[base[live] + self.lengths[live] - step] = self.run_earliest[run]
        return out


def mark(strings: list[bytes], texts: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """For each string of a text (by its number), the bits of the places whose LENGTH bytes an earlier text has.

    Equal strings fold to the first text that has them; the others' are marked whole. The distinct strings of a bucket
    are indexed, the earliest first, unless the bucket has but one, which then has nothing else to match.
    """
    codes, distinct = pd.factorize(np.array(strings, dtype=object))
    first = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first, codes, texts)
    sizes = np.fromiter(map(len, distinct), dtype=np.int64, count=len(distinct)) - LENGTH + 1
    bits, full = np.zeros(len(distinct), dtype=np.int64), (np.int64(1) << sizes) - 1
    bucket = np.zeros(len(distinct), dtype=np.int64)
    bucket[codes] = buckets.astype(np.int64)
    _, inverse, times = np.unique(bucket, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[inverse] > 1)
    if len(several):
        order = several[np.argsort(first[several], kind="stable")]
        index = RunLengthIndex([distinct[i] for i in order])
        owner = np.repeat(first[order], index.lengths + 1)
        n = sizes[order]
        begin = np.cumsum(n) - n
        flat = owner[index.earliest_matches()] < np.repeat(first[order], n)
        bits[order] = np.add.reduceat(flat.astype(np.int64) << (np.arange(len(flat)) - np.repeat(begin, n)), begin)
    return np.where(texts > first[codes], full[codes], bits[codes])


@functools.lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for the 256 bytes, powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    up, down = (np.full(PIECE + LENGTH + 1, b, dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return mix64(np.arange(1, 257, dtype=np.uint64)), np.multiply.accumulate(up), np.multiply.accumulate(down)


def piece_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece data[first : last + LENGTH], from sums over the whole array."""
    byte, up, down = powers()
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[data] * up[: len(data)])])
        return mix64((total[last + LENGTH] - total[first]) * down[first] + (last - first).astype(np.uint64))


def asked_place(key: np.ndarray, digest: np.ndarray, nth: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(digest ^ mix64(key + mix64(nth.astype(np.uint64)))) % np.uint64(bits)).astype(np.int64)


def folded(key: np.ndarray, nth: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whole, asked): which pieces an earlier text has as they are, and which the index needs.

    The index needs a piece from the first text that has it, if its bucket has others and they are of several texts.
    """
    if not len(key):
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    order = np.lexsort((nth, digest, key))
    k, d, t = key[order], digest[order], nth[order]
    bucket = np.concatenate([[True], k[1:] != k[:-1]])
    piece = bucket | np.concatenate([[True], d[1:] != d[:-1]])
    later = t > t[np.flatnonzero(piece)][np.cumsum(piece) - 1]
    edge = np.flatnonzero(bucket)
    several = (np.add.reduceat(piece.astype(np.int64), edge) > 1) & (np.minimum.reduceat(t, edge) < np.maximum.reduceat(t, edge))
    whole, asked = np.empty(len(key), dtype=bool), np.empty(len(key), dtype=bool)
    whole[order], asked[order] = later, ~later & several[np.cumsum(bucket) - 1]
    return whole, asked


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def pack(key, nth, row, at, sizes, text) -> bytes:
    raw = b"".join((np.int64(len(key)).tobytes(), key.astype("<u8").tobytes(), nth.astype("<i8").tobytes(), row.astype("<u4").tobytes(), at.astype("<i4").tobytes(), sizes.astype("<u1").tobytes(), text.tobytes()))
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], decompressed_size=int(np.frombuffer(packed[:8], "<i8")[0]), codec="zstd", asbytes=True)
    n, at, out = int(np.frombuffer(raw[:8], "<i8")[0]), 8, []
    for kind in ("<u8", "<i8", "<u4", "<i4", "<u1"):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    out[4] = out[4].astype(np.int64)
    return [*out, np.frombuffer(raw, np.uint8, offset=at)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Each byte goes that lies in a string of LENGTH bytes which also starts in a text with a smaller doc_id. A text that
    a smaller doc_id has as a whole goes as a whole, and nothing else can need it (`Copies`). The other texts' strings
    are dealt to buckets by their least k-mer, as pieces of text that hold all neighbouring strings of one bucket;
    buckets of k-mers that one text alone has stay at home. Pieces first meet as hashes (64 bits beside the 42 of their
    bucket): a piece that an earlier text has goes whole, and only the first text's pieces of buckets with different ones
    travel as text, to be indexed in blocks of bounded size. Texts without marks are finished where they are read.
    A null text is empty; a null doc_id counts as larger than any other; rows with equal ids remove nothing from each
    other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("nth")).withColumn("key", F.xxhash64("nth", "text"))
    copies = spark.sparkContext.broadcast(Copies(rows))

    def others(batches):
        for batch in batches:
            yield batch.filter(pa.array(~copies.value.among(batch.column("key").to_numpy())))

    source = rows.select("key", "nth", "text")
    found, hot, n_pieces = shared_kmers(source, others)
    bits, hot_keys = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(hot)

    def is_hot(key):
        h = hot_keys.value
        return h[np.minimum(np.searchsorted(h, key), len(h) - 1)] == key if len(h) else np.zeros(len(key), dtype=bool)

    def candidates(batches, wanted):
        for _, group, (keys, nth), data, owner, offset in pieces(others(batches), ("key", "nth")):
            first, last, key = anchors(data, owner)
            take = maybe_shared(bits.value, key)
            take &= is_hot(key) == wanted
            first, last, key = first[take], last[take], key[take]
            begin = np.concatenate([[0], np.cumsum([len(t) for t in group])])[:-1]
            own = owner[first]
            yield data, first, last, key, np.array(keys, dtype=np.int64)[own], np.array(nth, dtype=np.int64)[own], first - begin[own] + offset

    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least_parts, -(-n_pieces // PART_PIECES))
    asked_bits = max(64, ASKED_BITS // parts // 8 * 8)

    def packed_by_part(batches, found, parts):
        """Pieces by bucket, packed and compressed by part; copies in a task lie side by side and cost little.

        found: gives key, nth, row, at, size, content and bytes of content of pieces.
        """
        held, size = [], 0

        def flush():
            key, nth, row, at, sizes, widths = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2, 3, 4, 6))
            content = np.concatenate([h[5] for h in held])
            part = (key % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((nth, key, part))
            edge = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
            starts = np.cumsum(widths) - widths
            packs = []
            for i, j in zip(edge, np.append(edge[1:], len(order)), strict=True):
                o = order[i:j]
                packs.append(pack(key[o], nth[o], row[o], at[o], sizes[o], gather(content, starts[o], widths[o])))
            return pa.RecordBatch.from_arrays([pa.array(part[order][edge].astype(np.int32)), pa.array(packs, pa.binary())], ["part", "pack"])

        for key, nth, row, at, sizes, content, widths in found(batches):
            held.append((key, nth, (row & 0xFFFFFFFF).astype(np.uint32), at.astype(np.int32), sizes, content, widths))
            size += len(content) + PIECE_BYTES * len(key)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def digests(batches):
        for data, first, last, key, row, nth, at in candidates(batches, False):
            yield key, nth, row, at, last - first + LENGTH, piece_hashes(data, first, last).astype("<u8").view(np.uint8), np.full(len(key), 8)

    def texts(batches):
        for data, first, last, key, row, nth, at in candidates(batches, False):
            place = asked_place(key, piece_hashes(data, first, last), nth, asked_bits)
            take = (asked.value[(key % np.uint64(parts)).astype(np.int64), place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
            sizes = (last - first + LENGTH)[take]
            yield key[take], nth[take], row[take], at[take], sizes, gather(data, first[take], sizes), sizes

    def by_part(batches, run):
        held, now = [], None
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                if part != now and held:
                    yield from run(now, held)
                    held = []
                now = part
                held.append(unpack(packed))
        if held:
            yield from run(now, held)

    def fold_part(part, packs):
        key, nth, row, at, sizes = (np.concatenate([x[k] for x in packs]) for k in range(5))
        digest = np.concatenate([x[5] for x in packs]).view("<u8").astype(np.uint64)
        whole, wanted = folded(key, nth, digest)
        bits = np.zeros(asked_bits, np.uint8)
        bits[asked_place(key[wanted], digest[wanted], nth[wanted], asked_bits)] = 1
        columns = nth[whole], row[whole].astype(np.int64), marks_of(at[whole], (np.int64(1) << (sizes[whole] - LENGTH + 1)) - 1)
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(columns[0]), pa.binary())], ["nth", "row", "mark", "bits"])
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, 0, int(wanted.sum()), np.packbits(bits).tobytes()), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["nth", "row", "mark", "bits"])

    def index_part(_, packs):
        key, nth, row, at, sizes = (np.concatenate([x[k] for x in packs]) for k in range(5))
        text = np.concatenate([x[5] for x in packs])
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(key, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(key[order]) != 0) + 1, len(order))
        total = np.cumsum(sizes[order])
        i = 0
        while i < len(order):  # blocks of whole buckets
            base = total[i - 1] if i else 0
            fit = np.searchsorted(total[ends - 1], base + BLOCK, side="right") - 1
            j = int(ends[max(fit, np.searchsorted(ends, i, side="right"))])
            o = order[i:j]
            mask = mark([text[s : s + n].tobytes() for s, n in zip(starts[o].tolist(), sizes[o].tolist(), strict=True)], nth[o], key[o])
            hit = mask != 0
            yield pa.RecordBatch.from_arrays([pa.array(nth[o][hit]), pa.array(row[o][hit].astype(np.int64)), pa.array(marks_of(at[o][hit], mask[hit]))], ["nth", "row", "mark"])
            i = j

    def shuffled(found, parts, run, fields):
        packs = source.mapInArrow(lambda batches: packed_by_part(batches, found, parts), "part int, pack binary")
        return packs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lambda batches: by_part(batches, run), fields)

    met = cut(shuffled(digests, parts, fold_part, "nth long, row long, mark long, bits binary"))
    wanted, n_wanted = np.zeros((parts, asked_bits // 8), np.uint8), 0
    for r in met.where("bits is not null").select("nth", "mark", "bits").collect():  # ASKED_BITS in all
        wanted[r["nth"]] = np.frombuffer(r["bits"], np.uint8)
        n_wanted += r["mark"]
    asked = spark.sparkContext.broadcast(wanted)
    marks = met.where("bits is null").drop("bits")
    marks = marks.unionByName(shuffled(texts, max(least_parts, -(-n_wanted // PART_PIECES)), index_part, "nth long, row long, mark long"))

    if len(hot):

        def single(batches):
            for data, first, last, _, row, nth, at in candidates(batches, True):
                sizes = last - first + 1
                where = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                start = np.repeat(at - first, sizes) + where
                string = [data[i : i + LENGTH].tobytes() for i in where]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nth, sizes)), pa.array(np.repeat(row & 0xFFFFFFFF, sizes)), pa.array(marks_of(start, 1)), pa.array(string, pa.binary())], ["nth", "row", "mark", "string"])

        each = cut(source.mapInArrow(single, "nth long, row long, mark long, string binary"))
        least = each.groupBy("string").agg(F.min("nth").alias("first"))
        marks = marks.unionByName(each.join(least, "string").where("nth > first").select("nth", "row", "mark"))

    name = F.xxhash64("nth", "row").alias("name")
    per_text = cut(marks.groupBy("nth", "row").agg(F.collect_list("mark").alias("marks")))
    marked = spark.sparkContext.broadcast(bit_filter(per_text.select(name), "name"))
    fields = f"doc_id {kind}, nth long, row long, text string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    columns = ["doc_id", "nth", "row", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    nothing = hashlib.sha256(b"").hexdigest()

    def in_place(batches):
        for batch in batches:
            flagged, copied = in_filter(marked.value, batch.column("name").to_numpy()), copies.value.among(batch.column("key").to_numpy())
            out = []
            for nth, row, text, flag, copy in zip(*(batch.column(c).to_pylist() for c in ("nth", "row", "text")), flagged, copied, strict=True):
                data = text.encode()
                if copy:
                    out.append((nth, row, None, len(data), len(data), 1, nothing))
                else:
                    out.append((nth, row, text, None, None, None, None) if flag else (nth, row, None, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True))], columns)

    def finish(batches):
        for batch in batches:
            out, marks = [], batch.column("marks")
            edges = marks.offsets.to_numpy()
            each = marks.values.to_numpy()
            for i, (nth, row, text, n, removed, spans, sha) in enumerate(zip(*(batch.column(c).to_pylist() for c in columns[1:]), strict=True)):
                lo, hi = edges[i], edges[i + 1]
                out.append((nth, row, None, n, removed, spans, sha) if text is None else (nth, row, None, *without(text.encode(), each[lo:hi])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True))], columns)

    first = rows.select("doc_id", "nth", F.expr("key & 4294967295").alias("row"), "key", "text").select("doc_id", "nth", "row", name, "key", "text").mapInArrow(in_place, fields)
    done = first.join(per_text, ["nth", "row"], "left").select(*columns, "marks").mapInArrow(finish, fields)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def marks_of(at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One number for each piece: its place in the text, and a bit for each of its strings that goes."""
    return (at.astype(np.int64) << SPAN) | mask


def without(data: bytes, marks: np.ndarray) -> tuple[int, int, int, str]:
    """(bytes, removed bytes, removed runs, SHA-256 of the rest) once the marked strings are gone."""
    starts = np.zeros(len(data) + 1, dtype=np.int64)
    places = (marks >> SPAN)[:, None] + np.arange(SPAN)
    starts[places[(marks[:, None] >> np.arange(SPAN)) & 1 == 1]] = 1
    seen = np.cumsum(starts)
    # A byte goes if a marked string starts at it or at one of the LENGTH - 1 bytes before.
    gone = seen[:-1] > np.concatenate([np.zeros(LENGTH, np.int64), seen])[: len(data)]
    spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
    return len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest()


def op4(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, p, substr(x, 2 * p + 1, {2 * LENGTH}) as s from (select doc_id, x, unnest(range(n - {LENGTH - 1})) as p from d where n >= {LENGTH})),
f as (select s, min(doc_id) as first from w group by s),
m as (select w.doc_id, w.p from w join f using (s) where w.doc_id > f.first),
e as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from m),
g as (select doc_id, p, sum(case when before is null or p > before + {LENGTH} then 1 else 0 end) over (partition by doc_id order by p) as span from e),
r as (select doc_id, span, min(p) as a, max(p) + {LENGTH} as b from g group by 1, 2),
k as (select r.doc_id, span, a, b, lag(b, 1, 0) over (partition by r.doc_id order by span) as from_, x from r join d using (doc_id)),
t as (select doc_id, sum(b - a) as removed, count(*) as spans, string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' order by span) || any_value(substr(x, 2 * last_b + 1)) as kept
  from (select *, max(b) over (partition by doc_id) as last_b from k) group by doc_id)
select d.doc_id, d.n as n_bytes, cast(coalesce(t.removed, 0) as bigint) as n_removed, cast(coalesce(t.spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(t.kept, d.x))) as kept_sha256
from d left join t using (doc_id)"""
