"""Source divergence audit: kept terms by iceberg refinement of byte prefixes, then exact chi-square-like sums."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, bit_filter, cut, in_filter, slices, table

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCS = 3
#: Bytes of the first prefixes; each level doubles them.
FIRST = 3
#: Ranks of terms that a group reports.
TOP = 200
#: Shares are counted in parts of this.
SCALE = 1_000_000_000
#: UTF-8 bytes of text, and rows of terms, that a task looks at together.
TEXT_BYTES, TERM_ROWS = 12 << 20, 500_000
#: Terms, and sources of either side, that a task compares together at about most.
BLOCK_TERMS, BLOCK_SOURCES = 2048, 64

#: Bytes of UTF-8 text: A-Z are lowered, all else that is ASCII and no letter parts terms.
PLAIN = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256))
TERMS = "lang string, term binary, docs array<long>, sources array<string>, counts array<long>"


def _terms_of(texts) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts in order, as indexes into the distinct ones, and each one's text."""
    parts = [(t or "").encode("utf-8", "replace").translate(PLAIN) for t in texts]
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    full = data != 32
    edges = np.flatnonzero(np.diff(full)) + 1
    starts, stops = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[full].tobytes())])
    return flat.dictionary_encode(), np.searchsorted(ends, starts, side="left")


def _first_of_each(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, values): the LEAST_DOCS least distinct values of each key, sorted."""
    order = np.lexsort((values, keys))
    k, v = keys[order], values[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    k, v = k[new], v[new]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    rank = np.arange(len(k)) - np.repeat(begins, np.diff(np.append(begins, len(k))))
    return k[rank < LEAST_DOCS], v[rank < LEAST_DOCS]


def _lists(keys: np.ndarray, every: np.ndarray, values: pa.Array) -> pa.ListArray:
    """For each of ``every`` key, its values; keys are sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.append(every, np.iinfo(np.int64).max)).astype(np.int32)), values)


def _term_rows(batches):
    """For each language and term of some texts: LEAST_DOCS of its documents at most, and its count by source."""
    for batch in batches:
        for piece in slices(batch, limit=TEXT_BYTES):
            encoded, owner = _terms_of(piece.column("text").to_pylist())
            code, size = encoded.indices.to_numpy().astype(np.int64), max(1, len(encoded.dictionary))
            langs, sources = (piece.column(c).dictionary_encode() for c in ("lang", "source"))
            lang, source = (x.indices.to_numpy().astype(np.int64)[owner] for x in (langs, sources))
            key = lang * size + code
            row = piece.column("row").to_numpy()[owner]
            of_docs, docs = _first_of_each(key, row)
            n_sources = max(1, len(sources.dictionary))
            both, counts = np.unique(key * n_sources + source, return_counts=True)
            every = np.unique(both // n_sources)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(every // size)), encoded.dictionary.take(pa.array(every % size)).cast(pa.binary()), _lists(of_docs, every, pa.array(docs)),
                    _lists(both // n_sources, every, sources.dictionary.take(pa.array(both % n_sources))), _lists(both // n_sources, every, pa.array(counts.astype(np.int64))),
                ],
                ["lang", "term", "docs", "sources", "counts"],
            )


def _prefix_sets(width: int, bits: np.ndarray | None):
    """For each language and prefix of ``width`` bytes among some terms: LEAST_DOCS of its documents at most."""

    def found(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        if bits is not None:
            t = t.filter(pa.array(in_filter(bits, t.column("key").to_numpy())))
        if not len(t):
            return
        term, lang, docs = t.column("term").combine_chunks(), t.column("lang").combine_chunks().dictionary_encode(), t.column("docs").combine_chunks()
        prefix = pc.binary_slice(term, 0, width).dictionary_encode()
        whole = (pc.binary_length(term).to_numpy() <= width).astype(np.int64)
        size = len(prefix.dictionary)
        key = (lang.indices.to_numpy().astype(np.int64) * 2 + whole) * size + prefix.indices.to_numpy()
        k, doc = _first_of_each(np.repeat(key, pc.list_value_length(docs).to_numpy()), docs.flatten().to_numpy())
        first, whole = k // size, k // size % 2 == 1
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(first // 2)), prefix.dictionary.take(pa.array(k % size)), pa.array(whole), pa.array(doc)], ["lang", "prefix", "whole", "doc"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= TERM_ROWS:
                yield from found(held)
                held, n = [], 0
        if held:
            yield from found(held)

    return run


def kept_terms(terms: DataFrame) -> DataFrame:
    """(lang, term) of the terms that stand in LEAST_DOCS documents of the language, by prefixes from short to long.

    terms: rows of TERMS, a language's term in any number of them. Documents of a prefix are counted up to LEAST_DOCS:
    each task sends so many at most, which keeps the count exact below it and enough at it. Prefixes that fall short are
    discarded with all that begins with them; a prefix that is a whole term is kept; the rest is extended to twice the
    bytes, until none is left. What extends a surviving prefix is found by a filter of fixed size in each task, or by a join
    where the survivors would fill the filter; a wrong yes of the filter is counted again, and falls, at the next level.
    """
    width, bits, longer, kept = FIRST, None, None, []
    while True:
        rows = terms.select("lang", "term", "docs")
        if longer is None:
            rows = rows.withColumn("key", F.lit(0).cast("long"))
        else:
            rows = rows.where(F.octet_length("term") > width // 2).withColumn("prefix", F.substring("term", 1, width // 2)).withColumn("key", F.xxhash64("lang", "prefix"))
            if bits is None:
                rows = rows.join(longer, ["lang", "prefix"], "left_semi")
            rows = rows.select("lang", "term", "docs", "key")
        sets = rows.mapInArrow(_prefix_sets(width, bits), "lang string, prefix binary, whole boolean, doc long")
        level = cut(sets.distinct().groupBy("lang", "prefix", "whole").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST_DOCS))
        kept.append(level.where("whole").select("lang", F.col("prefix").alias("term")))
        longer = level.where("not whole").select("lang", "prefix")
        n = longer.count()
        if not n:
            return reduce(DataFrame.unionByName, kept)
        bits = bit_filter(longer.select(F.xxhash64("lang", "prefix").alias("key")), "key") if n <= FILTER_BITS // 4 else None
        width *= 2


def _share(count: str, total: str) -> F.Column:
    """1 + floor(SCALE * (count + 1) / total), exact."""
    return F.expr(f"cast(1 + (cast({count} + 1 as decimal(20,0)) * {SCALE}) div cast({total} as decimal(20,0)) as bigint)")


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """f summed over a block of terms for each ordered pair of sources, from rows of share p; rows without a term tell of
    a source's share p of a term it lacks, and the block's terms (terms)."""
    marks = pdf[pdf["term"].isna()].drop_duplicates("source").reset_index(drop=True)
    place = pd.Series(np.arange(len(marks)), index=marks["source"])
    cells = pdf[pdf["term"].notna()].drop_duplicates(["source", "term"])
    code, names = pd.factorize(cells["term"])
    zero = marks["p"].to_numpy(dtype=np.int64)
    p = np.repeat(zero[:, None], len(names) + 1, axis=1)  # the last column stands for all terms that no source here has
    p[place[cells["source"]].to_numpy(), code] = cells["p"].to_numpy(dtype=np.int64)
    times = np.ones(len(names) + 1, np.int64)
    times[-1] = (int(marks["terms"].iloc[0]) if len(marks) else 0) - len(names)
    tile, a, b = marks["tile"].to_numpy(), pdf["a"].iloc[0], pdf["b"].iloc[0]
    out = []
    for g in range(len(marks)):
        others = np.flatnonzero((tile == (b if tile[g] == a else a)) & (np.arange(len(marks)) != g))
        q = p[others]
        out.append(pd.DataFrame({"source": marks["source"][g], "item": marks["source"].to_numpy()[others], "value": ((p[g] - q) ** 2 // q * times).sum(axis=1)}))
    out = pd.concat(out, ignore_index=True)
    out.insert(0, "lang", pdf["lang"].iloc[0])
    return out


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: how far each language's sources are from each other, and by which terms.

    Terms are letters of the text (A-Z lowered, bytes above ASCII count as letters); a language keeps those of LEAST_DOCS
    documents (kept_terms). Shares are whole numbers, p = 1 + floor(SCALE (count + 1) / (N + V)), and f = floor((p - q)^2 / q).
    Part ``pair`` has, for each source of a language and each other one, f summed over all kept terms; part ``term`` the TOP
    terms that a source has more of than the language. A null text, lang or source is read as empty; every row is a
    document of its own, repeated or not; an empty table gives no rows; a source alone in its language has no pairs.
    Only these three columns are read. Terms are counted in tasks before rows move, sources are compared in blocks of terms
    and of sources, and no group is gathered.
    """
    text = docs.select(F.monotonically_increasing_id().alias("row"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = cut(text.mapInArrow(_term_rows, TERMS))
    kept = cut(kept_terms(terms))
    joined = terms.select("lang", "term", "sources", "counts").join(kept.hint("shuffle_hash"), ["lang", "term"])
    cells = joined.select("lang", "term", F.inline(F.arrays_zip("sources", "counts")))
    cells = cells.groupBy("lang", "term", F.col("sources").alias("source")).agg(F.sum("counts").alias("k"))
    cells = cut(cells.withColumn("lang_k", F.sum("k").over(Window.partitionBy("lang", "term"))))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = text.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("k").alias("n")), ["lang", "source"], "left").na.fill(0, ["n"])
    totals = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("s")).join(sizes, "lang", "left").na.fill(0, ["v"])
    totals = totals.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS))).withColumn("tiles", F.ceil(F.col("s") / BLOCK_SOURCES))
    groups = cut(groups.join(totals, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")))
    cells = cells.join(groups, ["lang", "source"]).withColumn("p", _share("k", "n + v"))

    best = cells.withColumn("q", _share("lang_k", "lang_n + v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP)

    blocks = kept.join(totals.select("lang", "blocks"), "lang").groupBy("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block")).agg(F.count("*").alias("terms"))
    marks = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(blocks, ["lang", "block"], "left").na.fill(0, ["terms"])
    marks = marks.select("lang", "source", "tile", "tiles", "block", F.lit(None).cast("binary").alias("term"), F.when(F.col("v") > 0, _share("0", "greatest(n + v, 1)")).otherwise(1).alias("p"), "terms")
    rows = cells.select("lang", "source", "tile", "tiles", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", "p", F.lit(0).cast("long").alias("terms")).unionByName(marks)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("lang", "source", "tile", "block", "term", "p", "terms", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    pairs = rows.groupBy("lang", "block", "a", "b").applyInPandas(_compared, "lang string, source string, item string, value long")
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    return pairs.unionByName(best)


def op11(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')) as term from d),
kept as (select lang, term from t group by 1, 2 having count(distinct id) >= {LEAST_DOCS}),
k as (select lang, source, term, count(*) as k from t join kept using (lang, term) group by 1, 2, 3),
g as (select lang, source, coalesce(sum(k), 0) as n from (select distinct lang, source from d) left join k using (lang, source) group by 1, 2),
v as (select lang, count(*) as v from kept group by 1),
p as (select g.lang, g.source, kept.term, coalesce(k.k, 0) as k, 1 + ({SCALE}::hugeint * (coalesce(k.k, 0) + 1)) // (g.n + v.v)::hugeint as p
  from g join v using (lang) join kept using (lang) left join k on k.lang = g.lang and k.source = g.source and k.term = kept.term),
q as (select lang, term, sum(k) as k from p group by 1, 2),
l as (select lang, sum(n) as n from g group by 1),
ql as (select q.lang, q.term, 1 + ({SCALE}::hugeint * (q.k + 1)::hugeint) // (l.n + v.v)::hugeint as q from q join l using (lang) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pr as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
tm as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from p join ql using (lang, term) where k > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pr union all select * from tm)) where part = 'pair' or rank <= {TOP}"""
