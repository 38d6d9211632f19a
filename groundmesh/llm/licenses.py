"""License scans by ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, table
from .license_rules import RULES_TEXT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lowered text, and what parts them; the classes count A-Z as parting because none are left.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A text without one of these, in any case, can hold no signature (a test holds every rule to that).
GATE = "licen|copyright|spdx|redistribut|permission|rights|domain|gpl|commons|proprietary|evil|advertising|prohibited"
#: No signature is longer; so many words from a keyword on are matched against its rules.
SPAN = 48
#: Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: How sure a finding of each priority is.
SURE = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.5}


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keywords: tuple[str, ...]
    regex: str


def rules(text: str = RULES_TEXT) -> list[Rule]:
    """The rules of ``label priority regex`` lines; keywords are the words that a match can begin with."""
    out = []
    for line in text.strip().split("\n"):
        label, priority, body = line.split(" ", 2)
        first = re.match(r"\(([a-z0-9|]+)\)|([a-z0-9]+)", body)
        out.append(Rule(len(out), label, int(priority), tuple((first[1] or first[2]).split("|")), f"^(?:{body}) "))
    return out


RULES = rules()


def _keyed() -> Column:
    """keyword -> its rules, as one constant."""
    by_word: dict[str, list[Rule]] = {}
    for r in RULES:
        for k in r.keywords:
            by_word.setdefault(k, []).append(r)
    kind = "array<struct<number:int,priority:int,label:string,regex:string>>"
    pairs = [x for k, rs in by_word.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(r.number).alias("number"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label"), F.lit(r.regex).alias("regex")) for r in rs]).cast(kind))]
    return F.create_map(*pairs)


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" ")))).cast("int")


def _resolved(places: Column) -> Column:
    """Findings that stay: none within one of its own or a stronger priority that is longer, stronger or of an earlier rule.

    places: findings by start, in order. A container starts less than SPAN words before, so only so many places before
    are looked at, and the work grows with the length of the text.
    """

    def within(place, found, at):
        same = F.exists(place["found"], lambda b: (b["priority"] <= found["priority"]) & ((b["end"] > found["end"]) | ((b["end"] == found["end"]) & (F.struct(b["priority"], b["number"]) < F.struct(found["priority"], found["number"])))))
        before = F.slice(places, F.greatest(F.lit(1), at - SPAN + 1), F.least(at, F.lit(SPAN)) - F.when(at < SPAN, 0).otherwise(1))
        return same | F.exists(before, lambda p: F.exists(p["found"], lambda b: (b["priority"] <= found["priority"]) & (b["end"] >= found["end"])))

    kept = F.transform(places, lambda p, at: F.filter(p["found"], lambda f: ~within(p, f, at)))
    return F.flatten(kept)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, base (place and label of each base phrase) and licenses (start, end, priority, number, label).

    A text that passes the keyword gate is lowered (A-Z only) and cut into words; where a word is a rule's keyword, the
    next SPAN words are matched against that word's rules. Of overlapping findings those within a longer or stronger one
    are suppressed. Places are numbers of words from 0, ends are exclusive. A null or empty text has 0 words and empty
    lists; repeated rows are scanned one by one; columns of ``docs`` that are called n_words, base or licenses give way.
    No row moves between tasks, and nothing of a document depends on another.
    """
    names = free_names(docs, "gated", "words", "places", "found")
    gated, words, places, found = names
    text = F.coalesce(docs["text"], F.lit(""))
    out = docs.drop("n_words", "base", "licenses").withColumn(gated, text.rlike(f"(?i){GATE}")).withColumn("n_words", F.regexp_count(text, F.lit(WORD)).cast("long"))
    lowered = F.regexp_replace(F.translate(text, UPPER, LOWER), PARTING, " ")
    out = out.withColumn(words, F.when(F.col(gated), F.filter(F.split(lowered, " "), lambda w: w != "")).otherwise(F.array().cast("array<string>")))
    keyed = _keyed()
    w = F.col(words)
    starts = F.transform(w, lambda x, i: F.when(F.try_element_at(keyed, x).isNotNull(), i))
    context = lambda i: F.concat(F.array_join(F.slice(w, i + 1, SPAN), " "), F.lit(" "))
    out = out.withColumn(places, F.transform(F.array_compact(starts), lambda i: F.struct(i.alias("start"), context(i).alias("text"), F.try_element_at(keyed, F.get(w, i)).alias("rules"))))
    base = F.transform(F.col(places), lambda p: F.struct(p["start"].alias("start"), F.coalesce(*[F.when(F.startswith(p["text"], F.lit(f"{k} ")), v) for k, v in BASE.items()]).alias("label")))
    tried = F.transform(F.col(places), lambda p: F.struct(p["start"].alias("start"), F.transform(p["rules"], lambda r: F.struct(r["priority"].alias("priority"), r["number"].alias("number"), r["label"].alias("label"), (p["start"] + _spaces(F.regexp_substr(p["text"], r["regex"]))).alias("end"))).alias("found")))
    out = out.withColumn(found, tried).withColumn("base", F.filter(base, lambda b: b["label"].isNotNull()))
    hits = F.transform(F.col(found), lambda p: F.struct(p["start"].alias("start"), F.filter(p["found"], lambda f: f["end"] > p["start"]).alias("found")))
    out = out.withColumn(found, F.filter(hits, lambda p: F.size(p["found"]) > 0))
    full = F.transform(F.col(found), lambda p: F.struct(p["start"].alias("start"), F.transform(p["found"], lambda f: F.struct(p["start"].alias("start"), f["end"].alias("end"), f["priority"].alias("priority"), f["number"].alias("number"), f["label"].alias("label"))).alias("found")))
    out = out.withColumn(found, full)
    return out.withColumn("licenses", _resolved(F.col(found))).drop(*names)


def license_columns(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of scan_licenses' rows.

    score is how sure the surest finding is (SURE), 0 without any.
    """
    names = lambda c: F.transform(F.col(c), lambda x: x["label"])
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    sure = F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv])
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(names("base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names("base"), names("licenses")))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda x: F.element_at(sure, x["priority"]))), F.lit(0.0)).alias("score"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return license_columns(scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({r.number}, {r.priority}, {quoted(r.label)}, {quoted(k)}, {quoted(r.regex)})" for r in RULES for k in r.keywords)
    base = " ".join(f"when starts_with(ctx, '{k} ') then '{v}'" for k, v in BASE.items())
    sure = " ".join(f"when {k} then {v}" for k, v in SURE.items())
    return f"""
with rules(number, priority, label, keyword, regex) as (values {rows}),
w as (select row_number() over () as id, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PARTING}', ' ', 'g'), '[^ ]+') as words from documents),
p as (select id, unnest(words) as word, unnest(range(len(words))) as start from w),
c as (select id, start, word, array_to_string(words[start + 1:start + {SPAN}], ' ') || ' ' as ctx from p join w using (id) where word in (select keyword from rules)),
base as (select id, start, case {base} end as label from c),
hits as (select id, start, number, priority, label, start + len(m) - len(replace(m, ' ', '')) as stop from (select c.*, number, priority, label, regexp_extract(ctx, regex) as m from c join rules on word = keyword) where m <> ''),
kept as (select * from hits a where not exists (select 1 from hits b where b.id = a.id and b.start <= a.start and b.stop >= a.stop and b.priority <= a.priority
  and (b.start < a.start or b.stop > a.stop or (b.priority, b.number) < (a.priority, a.number)))),
bl as (select id, count(*) as n, min(start) as lo, max(start) as hi, string_agg(distinct label, ',' order by label) as ls from base where label is not null group by 1),
al as (select id, string_agg(distinct label, ',' order by label) as ls, max(case priority {sure} end) as score from (select id, label, priority from kept union all select id, label, null from base where label is not null) group by 1)
select doc_id, len(words) as n_words, coalesce(bl.n, 0) as n_base, bl.lo as first_word, bl.hi as last_word, coalesce(bl.ls, '') as base_labels, coalesce(al.ls, '') as labels, coalesce(al.score, 0)::double as score
from w left join bl using (id) left join al using (id)"""


OP13_SQL = _sql()
