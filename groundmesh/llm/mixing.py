"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WORDS, cut, free_names, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Words of one slot of the schedule.
BLOCK = 128
#: Slots that are ranked together, and rows of one source that are ordered together.
CHUNK = 8192
BUCKET_ROWS = 2000
GOLDEN = (math.sqrt(5) - 1) / 2


def share_targets(sizes: list[int], weights: list[float], max_repeats: int = MAX_REPEATS) -> list[float]:
    """Share sum(sizes) by weight; what exceeds max_repeats times a size is shared again among the others."""
    total, capped = float(sum(sizes)), [n == 0 for n in sizes]
    while True:
        left = total - sum(max_repeats * n for n, c in zip(sizes, capped, strict=True) if c)
        w = sum(x for x, c in zip(weights, capped, strict=True) if not c)
        out = [float(max_repeats * n) if c else left * x / w for n, x, c in zip(sizes, weights, capped, strict=True)]
        over = [not c and t > max_repeats * n for t, n, c in zip(out, sizes, capped, strict=True)]
        if not any(over):
            return out
        capped = [c or o for c, o in zip(capped, over, strict=True)]


def source_table(sized: DataFrame, weights=WEIGHTS) -> list[dict]:
    """One dict for each source, by code point with null last: its number, rows, words, weight and target."""
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    targets = share_targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))])
    return [{"sid": i, "source": r["source"], "n": r["n"], "source_size": r["words"], "target": t} for i, (r, t) in enumerate(zip(found, targets, strict=True))]


def schedule(spark, sources: list[dict], block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Slot i goes to the source in whose share of the unit interval the point frac((i + 1/2) * golden) falls.

    Returns slot, sid, turn: the slot's rank among the slots of its source. Ranks are counted inside chunks of
    slots and shifted by the chunks before, so no source is ranked in one task.
    """
    total = sum(s["target"] for s in sources)
    slots = math.ceil(total / block)
    bound, pick = 0.0, F.lit(None).cast("int")
    live = [s for s in sources if s["target"] > 0]
    edges = []
    for s in live:
        bound += s["target"] / total
        edges.append(bound)
    if live:
        pick = F.element_at(
            F.array(*[F.lit(s["sid"]) for s in live]),
            F.least(F.lit(len(live)), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("u"))) + 1),
        )
    at = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    plan = spark.range(slots).select(F.col("id").alias("slot")).withColumn("u", at - F.floor(at)).select("slot", pick.alias("sid"), F.expr(f"slot div {chunk}").alias("chunk"))
    inside = plan.withColumn("r", F.row_number().over(Window.partitionBy("chunk", "sid").orderBy("slot")) - 1)
    per_chunk = plan.groupBy("sid", "chunk").agg(F.count("*").alias("k"))
    before = per_chunk.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("r")).alias("turn"))


def mix_rows(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, takes): rows has doc_id, key, nth, size, source_size, target; takes has key, nth, epoch, slot, from, to for
    each word range of a row that the mix takes.

    A source is an endless stream of epochs, each all its rows in an order of its own (by a hash of seed, epoch and
    row). The source's slot of rank r takes words r*block .. (r+1)*block of that stream, never beyond max_repeats
    epochs. Offsets in an epoch are summed in hash buckets of bounded size, shifted by the buckets before.
    Word counts, not texts, are shuffled. Null or blank text: size 0, never taken. Null source: a source of its own.
    Rows that repeat are separate rows; equal rows may swap places, which changes nothing in the result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", "source", row_key().alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    sized = cut(sized.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))))
    sources = source_table(sized, weights)
    fields = "sid int, source string, n long, source_size long, target double"
    dim = spark.createDataFrame([tuple(s.values()) for s in sources], fields)
    rows = sized.join(F.broadcast(dim), sized["source"].eqNullSafe(dim["source"])).select("doc_id", "key", "nth", "size", "sid", "n", "source_size", "target")

    slots = schedule(spark, sources, block)
    # A source's taken words: its slots are turns 0 .. k-1.
    counts = {r["sid"]: r["k"] for r in slots.groupBy("sid").agg((F.max("turn") + 1).alias("k")).collect()}
    taken = spark.createDataFrame([(s["sid"], min(counts.get(s["sid"], 0) * block, MAX_REPEATS * s["source_size"]), max(1, math.ceil(s["n"] / BUCKET_ROWS))) for s in sources], "sid int, upto long, buckets int")

    live = rows.where("size > 0").join(F.broadcast(taken), "sid").where("upto > 0")
    each = live.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast(least(2, (upto - 1) div source_size) as int)"))))
    each = each.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "key", "nth")).withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    order = Window.partitionBy("sid", "epoch", "bucket").orderBy("h", "key", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("inside", F.sum("size").over(order) - F.col("size"))
    totals = live.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("cast(least(2, (upto - 1) div source_size) as int)")))).withColumn("bucket", F.pmod(F.shiftright(F.xxhash64(F.lit(seed), "epoch", "key", "nth"), 20), F.col("buckets"))).groupBy("sid", "epoch", "bucket").agg(F.sum("size").alias("s"))
    totals = totals.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("sid", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("epoch") * F.col("source_size") + F.col("before") + F.col("inside")
    placed = each.join(totals, ["sid", "epoch", "bucket"]).withColumn("start", start).where("start < upto")
    # The equal-word blocks that a row lies in meet the slots that take them.
    spans = placed.select("doc_id", "key", "nth", "sid", "epoch", "start", "size", "upto", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(least(start + size, upto) - 1) div {block}"))).alias("turn"))
    takes = spans.join(slots, ["sid", "turn"]).select(
        "doc_id", "key", "nth", "sid", "epoch", "slot",
        (F.greatest(F.col("turn") * block, "start") - F.col("start")).alias("from"),
        (F.least((F.col("turn") + 1) * block, F.col("start") + F.col("size"), "upto") - F.col("start")).alias("to"),
    )
    return rows, takes


def row_key():
    """A row's key; rows that agree in all of it are told apart by a running number."""
    return F.xxhash64("doc_id", F.coalesce(F.col("source"), F.lit("\0")), F.coalesce(F.col("text"), F.lit("")))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    rows, takes = mix_rows(docs, **options)
    words = takes.groupBy("key", "nth").agg(F.sum(F.col("to") - F.col("from")).alias("words"))
    return rows.join(words, ["key", "nth"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, one row for each epoch of a document with the words that the mix takes.

    A document that is taken whole keeps its text as it is; one that is cut at a source's last block keeps the
    taken words and the white space between them; documents that the mix never reaches go.
    """
    _, takes = mix_rows(docs, **options)
    key, nth, row, number, epoch, lo_, hi_ = free_names(docs, "_key", "_nth", "_rk", "_n", "_epoch", "_from", "_to")
    ranges = takes.groupBy(F.col("key").alias(row), F.col("nth").alias(number), F.col("epoch").alias(epoch)).agg(F.min("from").alias(lo_), F.max("to").alias(hi_))
    keyed = docs.withColumn(key, row_key())
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    # As a difference, the number is no join key: the texts are dealt by their keys once.
    joined = keyed.join(ranges, (F.col(key) == F.col(row)) & (F.col(nth) - F.col(number) == 0))

    columns = docs.columns

    def cut_text(batches):
        for b in batches:
            out = []
            for text, lo, hi in zip(b["text"], b[lo_], b[hi_], strict=True):
                spans = [m.span() for m in WORDS.finditer(text)] if text else []
                out.append(text if lo == 0 and hi >= len(spans) else text[spans[lo][0] : spans[min(hi, len(spans)) - 1][1]])
            b["text"] = out
            if "n_chars" in b:
                b["n_chars"] = pd.Series([len(t) for t in out], index=b.index, dtype="int64")
            yield b[columns]

    return joined.mapInPandas(cut_text, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))
