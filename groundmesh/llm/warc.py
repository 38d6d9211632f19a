"""WARC responses to linked metadata and plain-text conversion records."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Elements whose content is no text, elements that end a line.
NO_TEXT = "script|style|noscript|template|svg|head"
BLOCKS = "(?i:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|aside|main|blockquote|pre|hr|form|title|dd|dt|dl)"
#: A comment, or an element without text from its start to its end, in one pass that looks for "<" only.
HIDDEN = "<(?:!--(?s:.*?)-->|" + "|".join(f"{n}(?:\\s[^>]*)?>(?s:.*?)</{n}\\s*>" for n in (f"(?i:{x})" for x in NO_TEXT.split("|"))) + ")"
#: White space that a reference may stand for; it is a space like any other.
BLANK = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def uuid_urn(seed: Column) -> Column:
    """A record identifier that follows from ``seed``."""
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(seed), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _decoded(texts: pd.Series) -> pd.Series:
    """Character references decoded once, from left to right, by the rules and the table of HTML5.

    A "p" before it marks a page, whose text is found first, a "t" a text.
    """
    text = lambda t: scanned(t[1:]) if t[0] == "p" else t[1:]
    return texts.map(lambda t: "\n".join(html.unescape(x).translate(BLANK) for x in text(t).split("\n")), na_action="ignore")


def marked_up(body: Column) -> Column:
    """A page without scripts, styles, head, comments and tags; a line for each block element; references as they stand."""
    t = F.regexp_replace(body, HIDDEN, " ")
    for blank in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(blank), F.lit(" "))
    t = F.regexp_replace(t, rf"</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n")
    return F.regexp_replace(t, r"<[A-Za-z/!?][^>]*>", "")


#: A page of more characters is scanned in Python in time that grows with its length; regexes look to the end of the page
#: from each start that has no end, which short pages can bear. Both give the same text.
LONG = 1 << 15
#: White space of patterns, as Java has it.
SPACE = "[ \\t\\n\\x0b\\f\\r]"
STARTS = re.compile(f"<(?:(!--)|({NO_TEXT})(?:>|(?={SPACE})))", re.I | re.A)
STOPS = {n: re.compile(f"</{n}{SPACE}*>", re.I | re.A) for n in NO_TEXT.split("|")}
LINES = re.compile("</?(?:" + BLOCKS[4:-1] + ")(?:(/?>)|(?= ))", re.I | re.A)
TAGS = re.compile("<[A-Za-z/!?]")


class _Next:
    """Where ``what`` stands next; places are asked in rising order, and each part of the text is searched once."""

    def __init__(self, text: str, what: str):
        self.text, self.what, self.at = text, what, -2

    def __call__(self, start: int) -> int:
        if self.at == -2 or -1 < self.at < start:
            self.at = self.text.find(self.what, start)
        return self.at


def _replaced(text: str, starts: re.Pattern, put: str, stop) -> str:
    """``text`` with ``put`` for each stretch from a start to where ``stop`` says that it ends (-1: no stretch), from the left."""
    out, at = [], 0
    for m in starts.finditer(text):
        if m.start() >= at and (end := stop(m)) >= 0:
            out += [text[at : m.start()], put]
            at = end
    return "".join([*out, text[at:]])


def scanned(page: str) -> str:
    """What marked_up makes of a page, in one pass for each of its steps."""
    close, comment, stops = _Next(page, ">"), _Next(page, "-->"), {}

    def hidden(m):
        if m[1]:
            end = comment(m.end())
            return end + 3 if end >= 0 else -1
        name = m[2].lower()
        after = m.end() if m[0].endswith(">") else close(m.end()) + 1
        if after == 0:
            return -1
        if name not in stops:
            found = [x.span() for x in STOPS[name].finditer(page)]
            stops[name] = [x for x, _ in found], [x for _, x in found]
        k = bisect_left(stops[name][0], after)
        return stops[name][1][k] if k < len(stops[name][1]) else -1

    t = _replaced(page, STARTS, " ", hidden).translate(BLANK)
    close = _Next(t, ">")
    t = _replaced(t, LINES, "\n", lambda m: m.end() if m[1] else close(m.end()) + 1 or -1)
    close_tag = _Next(t, ">")
    return _replaced(t, TAGS, "", lambda m: close_tag(m.end()) + 1 or -1)


def with_text(rows: DataFrame, body: str, name: str = "text") -> DataFrame:
    """``rows`` with the readable text of the pages in ``body``. Null gives null.

    Character references, named, decimal and hexadecimal, are decoded once, in one pass from left to right, so what they
    give is never read as a reference again. White space inside a line, also such that references stand for, and
    no-break spaces shrink to one space, and blank lines go. Only texts with an ampersand go through Python.
    """
    # One stage of Python for both: pages that are scanned there, and texts of others that have references.
    long = F.length(body) > LONG
    rows = rows.withColumn(name, F.when(~long, marked_up(F.col(body))))
    sent = F.when(long, F.concat(F.lit("p"), F.col(body))).when(F.contains(F.col(name), F.lit("&")), F.concat(F.lit("t"), F.col(name)))
    rows = rows.withColumn("_refs", F.pandas_udf(_decoded, "string")(sent))
    t = F.regexp_replace(F.replace(F.coalesce("_refs", name), F.lit("\u00a0"), F.lit(" ")), r" {2,}", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return rows.withColumn(name, F.array_join(F.array_remove(lines, ""), "\n")).drop("_refs")


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Response records for a table of pages: page_id, url, html.

    The block holds the HTTP head and body. A null page has an empty body, a null URL stays null.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id"),
        uuid_urn(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), F.col("url"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.date_format(F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) + F.lit(1700000000)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("warc_date"),
        F.concat(head, body).alias("block"),
    )


def build_derivatives(responses: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response: ``metadata`` and ``conversion``, both referring to it.

    In: record_id, target_uri, warc_date, block (HTTP head, blank line, body); other columns are ignored unless named
    in ``carry``. Out: carry, record_type, record_id, refers_to, target_uri, warc_date, content_type,
    source_content_type, source_http_headers, source_block_digest, source_payload_digest, content_length,
    block_digest, payload (the block), headers (the WARC head). Digests are labelled SHA-256.
    The metadata record has the source's digests and each line of its HTTP head as a field of its own.
    A block without a blank line is all body. Null block: as the empty block. Repeated responses give repeated
    records with equal identifiers, as these follow from the response's identifier.
    """
    block = F.coalesce(F.col("block"), F.lit(""))
    at = F.instr(block, "\r\n\r\n")
    r = responses.select(
        *carry, F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise("").alias("source_http_headers"),
        F.when(at > 0, F.substring(block, at + 4, F.length(block))).otherwise(block).alias("body"),
        digest(block).alias("source_block_digest"),
    )
    r = r.withColumn("source_payload_digest", digest(F.col("body"))).withColumn("source_content_type", F.regexp_extract("source_http_headers", r"(?i)content-type: *([^\r\n]*)", 1))
    r = with_text(r, "body").drop("body")
    note = F.concat(
        F.lit("source-content-type: "), F.col("source_content_type"), F.lit("\r\nsource-block-digest: "), F.col("source_block_digest"),
        F.lit("\r\nsource-payload-digest: "), F.col("source_payload_digest"), F.lit("\r\nconversion-record-id: "), uuid_urn(F.concat(F.lit("conversion|"), F.col("refers_to"))),
        F.lit("\r\nconversion-chars: "), F.length("text").cast("string"), F.lit("\r\n"),
        F.when(F.col("source_http_headers") != "", F.concat(F.lit("source-http-header: "), F.replace("source_http_headers", F.lit("\r\n"), F.lit("\r\nsource-http-header: ")), F.lit("\r\n"))).otherwise(""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), note.alias("payload")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("payload")),
    )
    r = r.withColumn("k", F.explode(kinds)).select(*carry, "k.*", "refers_to", "target_uri", "warc_date", "source_content_type", "source_http_headers", "source_block_digest", "source_payload_digest")
    r = r.withColumn("record_id", uuid_urn(F.concat("record_type", F.lit("|"), "refers_to"))).withColumn("content_length", F.octet_length("payload").cast("long")).withColumn("block_digest", digest(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"), F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.col("target_uri")), F.lit("")), F.lit("\r\nWARC-Date: "), F.col("warc_date"),
        F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"), F.lit("\r\nContent-Type: "), F.col("content_type"),
        F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n"),
    )
    return r.withColumn("headers", head)


def warc_bytes(records: DataFrame) -> DataFrame:
    """One binary column ``record``: each record as it stands in a WARC file."""
    return records.select(F.concat(F.concat("headers", F.lit("\r\n"), "payload", F.lit("\r\n\r\n")).cast("binary")).alias("record"))


def op1(spark, sf_dir: str) -> DataFrame:
    return build_derivatives(responses_of_pages(table(spark, sf_dir, "pages")), carry=("page_id",))


def _oracle() -> str:
    body = "coalesce(html, '')"
    strip = f"regexp_replace({body}, '{HIDDEN}', ' ', 'g')"
    strip = f"regexp_replace({strip}, '[\\t\\n\\x0b\\x0c\\r]', ' ', 'g')"
    strip = f"regexp_replace({strip}, '</?(?:{BLOCKS})(?:\\s[^>]*)?/?>', chr(10), 'g')"
    strip = f"regexp_replace({strip}, '<[A-Za-z/!?][^>]*>', '', 'g')"
    blank = "\t\n\x0b\x0c\r"
    quoted = lambda v: "'" + "".join(" " if c in blank else c for c in v).replace("'", "''") + "'"
    named = ", ".join(f"('{k}', {quoted(v)})" for k, v in sorted(html5.items()))
    # Numbers below the surrogates and the two blocks of non-characters that do not stand for themselves.
    odd = [n for n in [*range(160), *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))] if html.unescape(f"&#{n};") != chr(n) or n < 14]
    numbers = ", ".join(f"({n}, {quoted(html.unescape(f'&#{n};'))})" for n in odd)
    urn = lambda s: f"'<urn:uuid:' || regexp_replace(md5({s}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    return f"""
with r as (
  select row_number() over () as rid, page_id, url as target_uri, {body} as body,
    {urn("concat_ws('|', 'response', cast(page_id as varchar), url)")} as refers_to,
    strftime(to_timestamp(page_id + 1700000000) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as warc_date,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen({body}) as source_http_headers,
    {strip} as t
  from pages),
named(name, val) as (values {named}), numbers(n, val) as (values {numbers}),
p as (select rid, unnest(string_split(t, '&')) as piece, generate_subscripts(string_split(t, '&'), 1) as i from r),
m as (select rid, i, piece, case when i > 1 then regexp_extract(piece, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)') else '' end as m from p),
w as (select rid, i, max(k) as k, arg_max(val, k) as val from (select rid, i, m, unnest(range(2, length(m) + 1)) as k from m where m not like '#%') join named on name = substr(m, 1, k) group by 1, 2),
c as (select rid, i, m, case when m[2:2] in ('x', 'X') then try_cast('0x' || rtrim(m[3:], ';') as bigint) else try_cast(rtrim(m[2:], ';') as bigint) end as c from m where m like '#%'),
d as (select rid, i, case when c.c is null or c.c > 1114111 or c.c between 55296 and 57343 then chr(65533) else coalesce(val, chr(cast(c.c as int))) end as val from c left join numbers on c.c = numbers.n),
j as (select m.rid, string_agg(case when m.i = 1 then piece when d.val is not null then d.val || substr(piece, length(m.m) + 1) when w.val is not null then w.val || substr(piece, w.k + 1) else '&' || piece end, '' order by m.i) as u
  from m left join w on w.rid = m.rid and w.i = m.i left join d on d.rid = m.rid and d.i = m.i group by 1),
x as (select r.*, array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(u, chr(160), ' '), ' {{2,}}', ' ', 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) as text,
  'text/html; charset=utf-8' as source_content_type,
  'sha256:' || sha256(source_http_headers || chr(13) || chr(10) || chr(13) || chr(10) || body) as source_block_digest,
  'sha256:' || sha256(body) as source_payload_digest from r join j using (rid)),
k as (
  select page_id, 'metadata' as record_type, 'application/warc-fields' as content_type,
    'source-content-type: ' || source_content_type || chr(13) || chr(10) || 'source-block-digest: ' || source_block_digest || chr(13) || chr(10)
    || 'source-payload-digest: ' || source_payload_digest || chr(13) || chr(10) || 'conversion-record-id: ' || {urn("'conversion|' || refers_to")} || chr(13) || chr(10)
    || 'conversion-chars: ' || length(text) || chr(13) || chr(10) || 'source-http-header: ' || replace(source_http_headers, chr(13) || chr(10), chr(13) || chr(10) || 'source-http-header: ') || chr(13) || chr(10) as payload,
    refers_to, target_uri, warc_date, source_content_type, source_http_headers, source_block_digest, source_payload_digest from x
  union all
  select page_id, 'conversion', 'text/plain; charset=utf-8', text, refers_to, target_uri, warc_date, source_content_type, source_http_headers, source_block_digest, source_payload_digest from x),
z as (select *, {urn("record_type || '|' || refers_to")} as record_id, cast(strlen(payload) as bigint) as content_length, 'sha256:' || sha256(payload) as block_digest from k)
select *, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || record_type || chr(13) || chr(10) || 'WARC-Record-ID: ' || record_id || chr(13) || chr(10) || 'WARC-Refers-To: ' || refers_to
  || coalesce(chr(13) || chr(10) || 'WARC-Target-URI: ' || target_uri, '') || chr(13) || chr(10) || 'WARC-Date: ' || warc_date || chr(13) || chr(10) || 'WARC-Block-Digest: ' || block_digest
  || chr(13) || chr(10) || 'Content-Type: ' || content_type || chr(13) || chr(10) || 'Content-Length: ' || content_length || chr(13) || chr(10) as headers
from z"""


OP1_SQL = _oracle()
