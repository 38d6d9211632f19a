"""Line dedup by a log-template tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Leading tokens that, after the token count, lead to a leaf of the tree.
DEPTH = 2
MIN_TOKENS = 3
#: A template that stands in so many documents is dropped.
MIN_DOCS = 5
#: Least share of a template's tokens that are constant.
CONSTANT_SHARE = 0.6
#: A leaf's lines form groups at levels MIN_DOCS, MIN_DOCS * GROWTH, MIN_DOCS * GROWTH^2, ... up to the leaf's documents: a
#: token is constant in its place if it stands there in so many documents of the leaf. Low levels tell templates apart,
#: high ones let common values of a field be a field, however many documents the field's values stand in.
GROWTH = 5


def _masked(line):
    """The tokens of a line, those with a digit as "<*>"."""
    spaced = line
    for blank in "\t\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    tokens = F.array_remove(F.split(spaced, " "), "")
    return F.when(line.rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))).otherwise(tokens)


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that can belong to a template: doc_id, row, pos, line, n tokens, template, leaf."""
    lines = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("masked", _masked(F.col("line"))).withColumn("n", F.size("masked")).where(F.col("n") >= MIN_TOKENS)
    lines = lines.where(F.size(F.array_remove("masked", "<*>")) >= F.lit(CONSTANT_SHARE) * F.col("n"))
    return lines.select("doc_id", "row", "pos", "line", "n", F.xxhash64("n", "masked").alias("template"), F.xxhash64("n", F.slice("masked", 1, DEPTH)).alias("leaf"))


def _levels(k: str):
    """The number of levels that a count reaches, 0 under MIN_DOCS; in whole numbers, for every count of 63 bits."""
    levels, n = [], MIN_DOCS
    while n < 1 << 63:
        levels.append(n)
        n *= GROWTH
    return F.size(F.filter(F.lit(levels).cast("array<long>"), lambda x: x <= F.col(k)))


def _documents(rows: DataFrame, key: str) -> DataFrame:
    """key and k: the documents of the lines, each once, and the weights of samples, which stand for exact templates."""
    return rows.select(key, "doc_id", "sample", "weight").distinct().groupBy(key).agg(F.sum("weight").alias("k"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(row, pos) of the lines whose template stands in MIN_DOCS documents.

    Tokens with a digit are masked. Lines that agree after masking are one template. The lines left are parsed down a
    tree of fixed depth, by token count and leading tokens, to a leaf, which holds several groups: at each level (GROWTH),
    tokens that stand in their place in so many documents of the leaf are constant, the other places are fields, and
    lines with the same constants are one group. A group is a template if enough of its places are constant, one behind
    the leading tokens at least, and it stands in MIN_DOCS documents. Lines dropped as they are count in the tree too,
    through one sample of each, weighted by its documents. All is counted by hashes of 64 bits, before rows of a key
    meet, and no leaf is gathered.
    """
    known = cut(_lines(docs).withColumn("sample", F.lit(None).cast("long")).withColumn("weight", F.lit(1).cast("long")))
    exact = cut(_documents(known, "template").where(F.col("k") >= MIN_DOCS))
    rest = known.join(exact, "template", "left_anti")
    samples = known.join(exact, "template").groupBy("template", "k", "leaf", "n").agg(F.first("line").alias("line"))
    samples = samples.select(F.lit(None).cast(known.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("pos"), "line", "n", "template", "leaf", F.col("template").alias("sample"), F.col("k").alias("weight"))
    both = rest.unionByName(cut(samples))
    leaves = both.groupBy("leaf").agg(F.sum("weight").alias("lines"), F.bool_or(F.col("sample").isNull()).alias("rest")).where(F.col("rest") & (F.col("lines") >= MIN_DOCS)).select("leaf")
    loose = both.join(cut(leaves), "leaf", "left_semi").withColumn("masked", _masked(F.col("line")))
    line = ["doc_id", "row", "pos", "sample", "weight"]
    lead = F.size(F.array_remove(F.slice("masked", 1, DEPTH), "<*>"))
    tokens = loose.select(*line, "n", lead.alias("lead"), "leaf", F.posexplode("masked").alias("at", "token")).where((F.col("at") >= DEPTH) & (F.col("token") != "<*>"))
    tokens = cut(tokens.select(*line, "n", "lead", F.xxhash64("leaf", "at", "token").alias("place"), "leaf"))
    common = _documents(tokens, "place").withColumn("level", _levels("k")).where("level > 0")
    fixed = tokens.join(common.select("place", "level"), "place").groupBy(*line, "n", "lead", "leaf").agg(F.collect_list(F.struct("place", "level")).alias("fixed"))
    # Only levels at which a place of the line drops out make another group.
    levels = F.array_distinct(F.transform("fixed", lambda c: c["level"]))
    constants = F.transform(levels, lambda k: F.transform(F.filter("fixed", lambda c: c["level"] >= k), lambda c: c["place"]))
    enough = F.filter(constants, lambda c: F.col("lead") + F.size(c) >= F.lit(CONSTANT_SHARE) * F.col("n"))
    groups = cut(fixed.select(*line, F.explode(F.transform(enough, lambda c: F.xxhash64("leaf", F.array_sort(c)))).alias("group")))
    templates = _documents(groups, "group").where(F.col("k") >= MIN_DOCS)
    wide = groups.where("sample is null").join(templates, "group", "left_semi").select("row", "pos").distinct()
    return known.join(exact, "template", "left_semi").select("row", "pos").unionByName(wide)


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without its recurring lines, and n_lines and n_dropped beside its columns.

    Only ``text`` (and ``n_chars``, where there) changes; all documents stay, with an empty text if all lines go.
    A null text stays null and has 0 lines; an empty one has 1. Equal rows count as one document; null ids too. Columns
    of ``docs`` that are called n_lines or n_dropped give way to these; any others stay.
    """
    gone = recurring_lines(docs.select("doc_id", "text")).groupBy("row").agg(F.collect_set("pos").alias("gone"))
    own = docs.drop("n_lines", "n_dropped").select(F.struct("*").alias("d"), F.xxhash64("doc_id", "text").alias("row"))
    out = own.join(gone, "row", "left")
    text = F.col("d.text")
    parts = F.split(text, "\n")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n"))
    new = {"text": kept}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(kept).cast("long")
    columns = [new[c].alias(c) if c in new else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*columns, F.when(text.isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_dropped"))


def op9(spark, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


OP9_SQL = f"""
with recursive l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents where text is not null),
m as (select *, list_transform(regexp_extract_all(line, '{WORD}'), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as masked from l),
e as (select *, len(masked) as n, array_to_string(masked, ' ') as template, masked[1:{DEPTH}] as lead from m
  where len(masked) >= {MIN_TOKENS} and len(list_filter(masked, lambda t: t <> '<*>')) >= {CONSTANT_SHARE} * len(masked)),
exact as (select template, count(*) as k from (select distinct template, doc_id from e) group by 1 having count(*) >= {MIN_DOCS}),
rest as (select doc_id, text, pos, masked, n, lead, null::varchar as sample, 1::hugeint as weight from e where template not in (select template from exact)),
samples as (select distinct null as doc_id, null as text, null as pos, masked, n, lead, template as sample, k::hugeint as weight from e join exact using (template)),
every as (select * from rest union all select * from samples),
leaves as (select n, lead from every group by 1, 2 having sum(weight) >= {MIN_DOCS} and bool_or(sample is null)),
tokens as (select doc_id, text, pos, sample, weight, n, lead, unnest(masked) as token, generate_subscripts(masked, 1) as p from every join leaves using (n, lead)),
places as (select n, lead, p, token, sum(weight) as k from (select distinct n, lead, p, token, doc_id, sample, weight from tokens where p > {DEPTH} and token <> '<*>') group by all),
levels as (select {MIN_DOCS}::hugeint as level union all select level * {GROWTH} from levels where level * {GROWTH} <= (select max(k) from places)),
grps as (select level, doc_id, text, pos, sample, weight, n, lead, string_agg(p || ' ' || token, chr(10) order by p) as form from tokens join places using (n, lead, p, token) join levels on k >= level
  group by level, doc_id, text, pos, sample, weight, n, lead having len(list_filter(lead, lambda t: t <> '<*>')) + count(*) >= {CONSTANT_SHARE} * n),
wide as (select n, lead, form from (select distinct n, lead, form, doc_id, sample, weight from grps) group by 1, 2, 3 having sum(weight) >= {MIN_DOCS}),
gone as (select doc_id, text, pos from e where template in (select template from exact)
  union select doc_id, text, pos from grps join wide using (n, lead, form) where sample is null),
kept as (select doc_id, text, string_agg(line, chr(10) order by pos) as t, count(*) as k from l where not exists (select 1 from gone g where g.doc_id = l.doc_id and g.text = l.text and g.pos = l.pos) group by 1, 2)
select d.doc_id, cast(case when d.text is null then 0 else len(string_split(d.text, chr(10))) end as int) as n_lines,
  cast(case when d.text is null then 0 else len(string_split(d.text, chr(10))) - coalesce(k.k, 0) end as int) as n_dropped,
  case when d.text is null then null else coalesce(k.t, '') end as text
from documents d left join kept k on k.doc_id = d.doc_id and k.text = d.text"""
