"""Near-duplicate documents by HyperMinHash sketches, verified on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, components, cut, free_names, in_filter, mix64, slices, sums, table, word_codes, word_hashes

SHINGLE = 5
#: Registers of a sketch, mantissa bits of a register, registers of a band.
REGISTERS = 160
MANTISSA = 10
BAND = 4
BANDS = REGISTERS // BAND
#: Documents are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Standard errors by which an estimate may miss.
DOUBT = 5.0
#: A group of so many classes is compared in one task, sketch by sketch; a larger one is split first.
GROUP = 2048
#: Ratio of the largest to the least size in a range of set sizes; buckets that count shingles.
RANGE = 1.05
COUNTERS = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, size of each text's set): each text's distinct shingles as sorted 64-bit hashes.

    A text with fewer than SHINGLE words has its whole sequence as one shingle; one without words has none.
    """
    codes, distinct, counts = word_codes([lower_ascii(t) for t in texts])
    words = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    starts = np.cumsum(counts) - counts
    with np.errstate(over="ignore"):
        long = counts >= SHINGLE
        doc = np.repeat(np.arange(len(texts)), counts)
        n = len(words) - SHINGLE + 1
        h, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > 0:
            at = np.flatnonzero(doc[:n] == doc[SHINGLE - 1 :])
            h = np.full(len(at), SHINGLE, dtype=np.uint64)
            for k in range(SHINGLE):
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
            owner = doc[at]
        short = np.flatnonzero(~long & (counts > 0))
        extra = counts[short].astype(np.uint64)
        for k in range(SHINGLE - 1):
            more = counts[short] > k
            extra[more] = mix64(extra[more] * np.uint64(0x9E3779B97F4A7C15) + words[starts[short[more]] + k])
    h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], np.bincount(owner[fresh], minlength=len(texts)).astype(np.int64)


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set: equal sets have equal keys."""
    with np.errstate(over="ignore"):
        a, b = sums(mix64(hashes + np.uint64(1)), sizes), sums(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), sizes)
        return mix64(a * np.uint64(3) + mix64(b + sizes.astype(np.uint64))).astype(np.int64)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HyperMinHash of each set: a row of REGISTERS 16-bit registers, 0 where no shingle fell.

    A shingle's hash picks a register; of a register's least remaining hash the count of leading zeros and the
    MANTISSA bits behind the first 1 are kept.
    """
    x = mix64(hashes ^ np.uint64(0xD1B54A32D192ED03))
    register = ((x >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    value = mix64(x + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(1)
    cell = np.repeat(np.arange(len(sizes)), sizes) * REGISTERS + register.astype(np.int64)
    least = np.full(len(sizes) * REGISTERS, np.uint64(1) << np.uint64(63), dtype=np.uint64)
    np.minimum.at(least, cell, value)
    empty = least == np.uint64(1) << np.uint64(63)
    exponent = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1].astype(np.int64)
    exponent = np.where(least >> np.maximum(exponent - 1, 0).astype(np.uint64) == 0, exponent - 1, exponent)  # rounded up
    zeros = 63 - exponent
    tail = np.where(exponent > MANTISSA, least >> np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64), least << np.maximum(MANTISSA + 1 - exponent, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    packed = ((np.minimum(zeros, 62) + 1) << MANTISSA) | tail.astype(np.int64)
    return np.where(empty, 0, packed).astype(np.uint16).reshape(len(sizes), REGISTERS)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """BANDS keys of each sketch. An empty register takes the next filled one's value and the distance to it."""
    n = len(rows)
    wide = np.concatenate([rows, rows], axis=1)
    at = np.where(wide > 0, np.arange(2 * REGISTERS), 4 * REGISTERS)
    nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]
    filled = np.take_along_axis(wide, np.minimum(nearest, 2 * REGISTERS - 1), axis=1).astype(np.uint64)
    with np.errstate(over="ignore"):
        filled += (nearest - np.arange(REGISTERS)).astype(np.uint64) << np.uint64(16)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (n, 1))
        parts = filled.reshape(n, BANDS, BAND)
        for k in range(BAND):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.astype(np.int64)


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers it rests on) of pairs of sketches.

    The share of equal registers among those filled on either side, less what unequal sets share by chance: two
    independent registers at rates na and nb agree with probability near ln 2 * 2**-MANTISSA * na*nb/(na+nb)**2.
    """
    used = ((a > 0) | (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    chance = np.log(2) * 2.0**-MANTISSA * na * nb / np.maximum(na + nb, 1) ** 2
    return (equal / np.maximum(used, 1) - chance) / (1 - chance), used


def passes(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether the estimates of pairs of sketches do not rule links out by DOUBT standard errors, the estimates)."""
    j, used = estimates(a, b, na.astype(np.float64), nb.astype(np.float64))
    p = PERCENT / 100
    return j + DOUBT * np.sqrt(p * (1 - p) / np.maximum(used, 1)) >= p, j


def _texts(piece) -> list[str]:
    return [t or "" for t in piece.column("text").to_pylist()]


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of equal sets alike) and sketch for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                h, n = shingle_sets(_texts(piece))
                rows = sketches(h, n)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(n), pa.array(set_keys(h, n)), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "text_key", "n_shingles", "set_key", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key long, n_shingles long, set_key long, sketch binary")


def bands(classes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("c").to_numpy(), BANDS))], ["key", "c"])

    return classes.select("c", "sketch").mapInArrow(run, "key long, c long")


def prefixes(sets: DataFrame) -> DataFrame:
    """(key, c): groups of which any two linked classes of ``sets`` (c, set) share one at least.

    Sets are put in order, rare shingles first. Two sets of x and y shingles with ``both`` in common share one among the
    first x - both + 1 and y - both + 1. Sizes fall into ranges RANGE wide, and a key has the ranges of both sides, so
    that what a link needs in common is known; a group of two ranges that holds only one of them goes. The order rests on counts in COUNTERS buckets: any order is right, one
    by rarity keeps groups small.
    """
    each = sets.select(F.explode("set").alias("h")).select(F.pmod("h", F.lit(COUNTERS)).cast("int").alias("bucket"))
    found = each.groupBy("bucket").count().where("count > 1").toPandas()
    counts = np.ones(COUNTERS, dtype=np.int64)
    counts[found["bucket"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    reach = int(np.ceil(np.log(100 / PERCENT) / np.log(RANGE)))

    def run(batches):
        for batch in batches:
            out, rows = [], 0
            for c, values in zip(batch.column("c").to_pylist(), batch.column("set"), strict=True):
                h = values.values.to_numpy(zero_copy_only=False)
                h = h[np.lexsort((h, shared.value[np.mod(h, COUNTERS)]))].astype(np.uint64)
                n, own = len(h), int(np.log(len(h)) / np.log(RANGE))
                keys, sides = [], []
                for other in range(max(0, own - reach), own + reach + 1):
                    least = max(int(RANGE**other * (1 - 1e-9)), -(-n * PERCENT // 100))
                    both = -(-PERCENT * (n + least) // (100 + PERCENT))
                    if both <= n:
                        ranges = np.uint64(min(own, other) * 1000 + max(own, other))
                        with np.errstate(over="ignore"):
                            keys.append(mix64(h[: n - both + 1] * np.uint64(0x9E3779B97F4A7C15) + ranges))
                        sides.append(np.full(n - both + 1, 2 if own == other else int(own > other), np.int32))
                keys, sides = np.concatenate(keys).astype(np.int64), np.concatenate(sides)
                out.append(pa.record_batch([pa.array(keys), pa.array(np.full(len(keys), c)), pa.array(sides)], ["key", "c", "side"]))
                rows += len(keys)
                if rows > 200_000 or len(out) > 500:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, rows = [], 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    rows = cut(sets.select("c", "set").mapInArrow(run, "key long, c long, side int"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high")).where("n > 1 and (low = 2 or low != high)")
    return rows.join(groups.select("key"), "key").select("key", "c")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose estimate does not rule the link out by DOUBT standard errors."""
    one = classes.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    sized = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            keep, _ = passes(a, b, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return sized.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """c and set, the sorted shingle hashes, for the classes in ``nodes`` (c): made again from the texts.

    Only texts that some wanted class has as its own (``rep``) are cut into shingles; copies travel once from a task.
    """
    wanted = classes.select("c", "rep").join(nodes, "c", "left_semi")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "rep"))

    def run(batches):
        sent = set()
        for batch in batches:
            picked = batch.filter(pa.array(in_filter(bits.value, batch.column("text_key").to_numpy())))
            for piece in slices(picked):
                h, n = shingle_sets(_texts(piece))
                keys = set_keys(h, n)
                ends = np.cumsum(n)
                out_c, out_s = [], []
                for i in np.flatnonzero(n > 0):
                    c = int(keys[i])
                    if c not in sent:
                        if len(sent) > 1_000_000:
                            sent.clear()
                        sent.add(c)
                        out_c.append(c)
                        out_s.append(h[ends[i] - n[i] : ends[i]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(out_c, pa.int64()), pa.array(out_s, pa.list_(pa.int64()))], ["c", "set"])

    sets = docs.select("text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "c long, set array<long>").join(nodes, "c", "left_semi")
    return cut(sets.dropDuplicates(["c"]))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of classes that are linked, by their full sets."""
    met = pairs.join(sets.select(F.col("c").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("c").alias("a"), F.col("set").alias("sa")), "a")
    met = met.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return cut(met.where(f"100 * both >= {PERCENT} * (size(sa) + size(sb) - both)").select("a", "b"))


def full_check(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, sets): the linked ones of candidate pairs (a, b) that the estimate has let pass, and the sets of both sides."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), classes, docs)
    return verify(pairs, sets), sets


def mixed_groups(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, many): members of groups (key, c, root) that still hold several components.

    few: groups of at most GROUP classes. many: larger ones, with their size and the root and size of their largest
    component. Of groups with the same members, by count and two hashes of 64 bits, one stays.
    """
    per = members.groupBy("key", "root").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c")).alias("y"))
    group = per.groupBy("key").agg(F.sum("k").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("parts"), F.max(F.struct("k", "root")).alias("main"))
    group = group.where("parts > 1").groupBy("n", "x", "y").agg(F.min(F.struct("key", "main")).alias("g"))
    group = group.select("g.key", "n", F.col("g.main.k").alias("main_n"), F.col("g.main.root").alias("main"))
    rows = cut(members.join(group, "key"))
    return rows.where(F.col("n") <= GROUP).select("key", "c", "root"), rows.where(F.col("n") > GROUP)


def whole_groups(batches, columns: list[str], blob: str):
    """Columns of rows sorted by ``key``, cut at ends of groups; the last one, ``blob``, as a list of bytes."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in columns] + [np.array(batch.column(blob).to_pylist(), dtype=object)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if last:
            yield [x[:last] for x in cols]
        held = [x[last:] for x in cols]
    if held is not None:
        yield held


def nearest(few: DataFrame, many: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): for each class of a mixed group, of all classes of other components there the one with the best estimate.

    Only partners whose estimate does not rule a link out count. Sketches go to the groups and are compared there.
    Large groups are dealt to groups of bounded size by a hash and searched there.
    """
    dealt = F.xxhash64("key", F.pmod(F.xxhash64("c"), F.ceil(2 * F.col("n") / GROUP).cast("int")))
    groups = few.unionByName(many.select(dealt.alias("key"), "c", "root"))
    rows = groups.join(classes.select("c", "n", "sketch"), "c").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for key, c, root, n, blobs in whole_groups(batches, ["key", "c", "root", "n"], "sketch"):
            sketch = np.frombuffer(b"".join(blobs), dtype=np.uint16).reshape(-1, REGISTERS)
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(edge)
            left = np.repeat(edge[1:], sizes) - np.arange(len(key)) - 1  # members behind each one in its group
            top = np.full(len(key), -1, dtype=np.int64)
            at = np.flatnonzero(left > 0)
            for d in range(1, int(sizes.max())):  # pairs by distance, all groups in one step
                at = at[left[at] >= d]
                to = at + d
                fine = (root[at] != root[to]) & (100 * np.minimum(n[at], n[to]) >= PERCENT * np.maximum(n[at], n[to]))
                x, y = at[fine], to[fine]
                for lo in range(0, len(x), 1 << 14):
                    u, v = x[lo : lo + (1 << 14)], y[lo : lo + (1 << 14)]
                    ok, j = passes(sketch[u], sketch[v], n[u], n[v])
                    u, v, j = u[ok], v[ok], np.round(j[ok] * 1e6).astype(np.int64) << 32
                    np.maximum.at(top, u, j | v)  # the estimate in front of the partner's place
                    np.maximum.at(top, v, j | u)
            u = np.flatnonzero(top >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[u]), pa.array(c[top[u] & 0xFFFFFFFF]), pa.array(top[u] >> 32)], ["a", "b", "j"])

    found = rows.select("key", "c", "root", "n", "sketch").mapInArrow(run, "a long, b long, j long")
    return found.groupBy("a").agg(F.max_by("b", F.struct("j", "b")).alias("b"))


def in_blocks(many: DataFrame) -> DataFrame:
    """(key, c, root, side): large groups as groups of bounded size that hold all their pairs across components.

    Classes outside the largest component (side 0) meet all classes (side 1), both dealt to blocks of about GROUP / 2.
    """
    block = lambda n: F.greatest(F.ceil(2 * F.col(n) / GROUP).cast("int"), F.lit(1))
    rows = many.withColumn("minor_n", F.col("n") - F.col("main_n")).withColumn("i", F.pmod(F.xxhash64(F.lit(1), "c"), block("minor_n")).cast("int")).withColumn("j", F.pmod(F.xxhash64(F.lit(2), "c"), block("n")).cast("int"))
    over = lambda n: F.explode(F.sequence(F.lit(0), block(n) - 1))
    one = rows.where("root != main").select("key", "c", "root", F.lit(0).alias("side"), "i", over("n").alias("j"))
    two = rows.select("key", "c", "root", F.lit(1).alias("side"), over("minor_n").alias("i"), "j")
    return one.unionByName(two).select(F.xxhash64("key", "i", "j").alias("key"), "c", "root", "side")


def packed_sets(sets: DataFrame, name: str, pack) -> DataFrame:
    """c, n and what ``pack`` makes of the sorted shingle hashes, as bytes in the column ``name``."""

    def run(batches):
        for batch in batches:
            made = [pack(v.values.to_numpy(zero_copy_only=False)) for v in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array([len(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], ["c", "n", name])

    return cut(sets.select("c", "set").mapInArrow(run, f"c long, n long, {name} binary"))


def short_sets(sets: DataFrame) -> DataFrame:
    """c, n and short: two bytes of each shingle hash, in order. Sets share no more shingles than short ones do values."""
    return packed_sets(sets, "short", lambda h: np.sort((h >> 40).astype(np.uint16)))


def overlaps(codes: np.ndarray, n: np.ndarray, own: np.ndarray, flag: np.ndarray):
    """(i, what set i has in common with each set) for the sets ``own``; codes: the sets' values one set after another."""
    ends = np.cumsum(n)
    for i in own:
        mine = codes[ends[i] - n[i] : ends[i]]
        flag[mine] = True
        yield i, np.add.reduceat(flag[codes], ends - n, dtype=np.int64)
        flag[mine] = False


def starters(root: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Places of a group's classes from which all its pairs are reached: side 0, or all outside the largest component."""
    names, sizes = np.unique(root, return_counts=True)
    return np.flatnonzero((side == 0) | ((side == 2) & (root != names[np.argmax(sizes)])))


def meet(groups: DataFrame, shorts: DataFrame) -> DataFrame:
    """(a, b): each class of a group (key, c, root, side) that may have a link there, and its likeliest partner.

    All pairs of a group with different roots, and not both of side 0 or both of side 1, are compared. Groups have a
    bounded size. Short sets go to the groups; what two of them have in common, with repeats, is never less than what the
    full sets have, so a pair that falls short here is not linked, and few unlinked ones pass. A group gives a row for
    a class at most, however many of its pairs pass.
    """
    rows = groups.join(shorts, "c").repartition("key").sortWithinPartitions("key")

    def run(batches):
        flag = np.zeros(1 << 20, dtype=bool)
        for key, c, root, side, n, blobs in whole_groups(batches, ["key", "c", "root", "side", "n"], "short"):
            flat = np.frombuffer(b"".join(blobs), dtype=np.uint16).astype(np.int64)
            ends = np.cumsum(n)
            # The k-th repeat of a value in a set is a value of its own, up to 15 repeats.
            new = np.ones(len(flat), dtype=bool)
            new[1:] = flat[1:] != flat[:-1]
            new[ends[:-1]] = True
            at = np.arange(len(flat))
            flat = flat * 16 + np.minimum(at - np.maximum.accumulate(np.where(new, at, 0)), 15)
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            best, partner = np.zeros(len(key)), np.full(len(key), -1, dtype=np.int64)
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                size = n[lo:hi]
                for i, both in overlaps(flat[ends[lo] - n[lo] : ends[hi - 1]], size, starters(root[lo:hi], side[lo:hi]), flag):
                    union = size + size[i] - both
                    to = np.flatnonzero((100 * both >= PERCENT * union) & (root[lo:hi] != root[lo + i]) & ((side[lo:hi] != 0) | (side[lo + i] != 0)))
                    if len(to):
                        like = both[to] / union[to]
                        k = np.argmax(like)
                        if like[k] > best[lo + i]:
                            best[lo + i], partner[lo + i] = like[k], lo + to[k]
                        to, like = lo + to[like > best[lo + to]], like[like > best[lo + to]]
                        best[to], partner[to] = like, lo + i
            a = np.flatnonzero(partner >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(c[a]), pa.array(c[partner[a]])], ["a", "b"])

    return rows.select("key", "c", "root", "side", "n", "short").mapInArrow(run, "a long, b long")


def still_mixed(groups: DataFrame) -> DataFrame:
    """The groups (key, c, root, side) that hold several components; of those with the same members one."""
    group = groups.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c", "side")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "c", "side")).alias("y"), F.min("root").alias("low"), F.max("root").alias("high"))
    one = group.where("low != high").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return groups.join(one.select("key"), "key", "left_semi")


def spanning_links(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that join whatever the links of a group (key, c, root, side) join; fewer than it has components.

    Full sets go to the groups and the pairs that ``meet`` describes are compared there, but only links that join two
    components not joined in the group before become rows.
    """
    rows = groups.join(packed_sets(sets, "whole", lambda h: h), "c").repartition("key").sortWithinPartitions("key")

    def run(batches):
        for key, c, root, side, n, blobs in whole_groups(batches, ["key", "c", "root", "side", "n"], "whole"):
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            out_a, out_b = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                values, codes = np.unique(np.frombuffer(b"".join(blobs[lo:hi]), dtype=np.int64), return_inverse=True)
                size, part = n[lo:hi], np.unique(root[lo:hi], return_inverse=True)[1]
                for i, both in overlaps(codes, size, starters(root[lo:hi], side[lo:hi]), np.zeros(len(values), dtype=bool)):
                    to = np.flatnonzero((100 * both >= PERCENT * (size + size[i] - both)) & (part != part[i]) & ((side[lo:hi] != 0) | (side[lo + i] != 0)))
                    joined, first = np.unique(part[to], return_index=True)
                    out_a.append(np.full(len(first), c[lo + i]))
                    out_b.append(c[lo + to[first]])
                    part[np.isin(part, joined)] = part[i]
            a, b = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in (out_a, out_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.select("key", "c", "root", "side", "n", "whole").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for every row of ``docs``; see near_duplicates."""
    made = cut(sketch_documents(docs))
    classes = cut(made.where("n_shingles > 0").groupBy(F.col("set_key").alias("c")).agg(
        F.min("doc_id").alias("label"), F.min("text_key").alias("rep"), F.first("n_shingles").alias("n"), F.min("sketch").alias("sketch")))
    rows = bands(classes)
    groups = rows.groupBy("key").agg(F.min("c").alias("lead"), F.max("c").alias("last")).where("lead != last").select("key", "lead")
    rows = cut(rows.join(groups, "key"))
    star = rows.groupBy("c").agg(F.min("lead").alias("lead")).where("c != lead").select(F.col("lead").alias("a"), F.col("c").alias("b"))
    links, _ = full_check(likely(star, classes), classes, docs)
    roots = components(links)

    def rooted(groups, *also):
        return cut(groups.select("key", "c", *also).join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("key", "c", F.coalesce("root", "c").alias("root"), *also))

    few, many = mixed_groups(rooted(rows))
    more, sets = full_check(nearest(few, many, classes), classes, docs)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
        few, many = mixed_groups(rooted(rows))
    shorts, groups = short_sets(sets), few.withColumn("side", F.lit(2))
    if not many.isEmpty():
        wanted = full_sets(many.select("c").distinct(), classes, docs)
        shorts = shorts.unionByName(short_sets(wanted.join(sets.select("c"), "c", "left_anti")))
        fine, wide = mixed_groups(rooted(prefixes(wanted)))
        groups = groups.unionByName(fine.withColumn("side", F.lit(2))).unionByName(in_blocks(wide))
    more, sets = full_check(meet(groups, shorts), classes, docs)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    left = still_mixed(rooted(groups.join(sets.select("c"), "c", "left_semi"), "side"))
    more = cut(spanning_links(left, sets))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = classes.select("c", "label").join(roots, F.col("c") == F.col("node"), "left").select("c", "label", F.coalesce("root", "c").alias("root"))
    least = named.groupBy("root").agg(F.min("label").alias("component_id"))
    named = named.join(least, "root").select(F.col("c").alias("set_key"), "component_id")
    out = made.select("doc_id", "text_key", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Texts with equal sets form a class, which its sketch stands for. Classes that agree in a band are candidates. Each
    meets one class of its band groups first; in groups that this leaves in several components it meets the class of
    another one with the best estimate; then all classes of a group with a likely partner meet across components, those of
    large groups only where they share rare shingles, which misses no link. Each is checked with its likeliest partner; in
    groups that are mixed even then, full sets are compared and a group gives links that span its components, never all its
    pairs. Candidates of the first two steps pass the corrected estimate before their full sets are compared.
    component_id is the least doc_id among the documents that links reach. A text without words (null, empty, blank) is
    linked with nothing. Rows with a null doc_id link like others; they have a null component_id only if no row reached
    has an id. Rows that repeat an id are rows of their own, and each has the result of its text. An empty table gives
    no rows.
    """
    return grouped(docs).drop("text_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with all their columns.

    Rows that agree in doc_id and text are one document and stay or go together; of rows with one id and different
    texts each has its own fate.
    """
    kept_id, kept_key = free_names(docs, "_kept_id", "_kept_key")
    kept = grouped(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key)).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(kept_id)) & (F.xxhash64(docs["text"]) == F.col(kept_key)), "left_semi")


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as materialized (select distinct doc_id, sh from (
  select doc_id, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') as sh from (select doc_id, ws, unnest(range(1, len(ws) - {SHINGLE - 2})) as i from w where len(ws) >= {SHINGLE})
  union all select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and {SHINGLE - 1})),
n as materialized (select doc_id, count(*) as n from s group by 1),
e as materialized (select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2) p join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * i >= {PERCENT} * (na.n + nb.n - i)),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d left join n using (doc_id) join (select a, min(b) as component_id from r group by 1) c on c.a = d.doc_id"""
