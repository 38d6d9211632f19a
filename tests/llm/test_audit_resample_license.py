"""The divergence audit, the resampling and the license scan against plain Python and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundmesh.llm import divergence, licenses, resample

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, None, None), (2, "", "", ""), (3, "Straße KELVIN K 7x7", "de", "a"), (3, "Straße KELVIN K 7x7", "de", "a"), (None, "null id, MIT\tLicense", "de", None), (4, "z" * 3000 + " " + "z" * 3000, "de", "b"), (5, "z" * 3000, "de", "b"), (6, "z" * 3000 + " straße", "de", "c")]


def some_docs(n=120):
    r = random.Random(5)
    words = [a + b for a in ("ri", "sto", "naï", "日", "q") for b in ("ver", "ne", "", "xyz", "tt")]
    return [(10 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), r.choice(["en", "de"]), r.choice("abcde")) for i in range(n)] + ODD


def frame(spark, rows, *extra):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for c in extra:
        df = df.withColumn(c, F.lit("clash"))
    return df


def plain_divergence(rows, least=divergence.LEAST_DOCS, top=divergence.TOP):
    seen, counts, groups = defaultdict(set), defaultdict(Counter), set()
    for k, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER)):
            seen[lang, t].add(k)
            counts[lang, source][t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in seen.items() if x == lang and len(d) >= least]
        mine = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in mine:
            total += counts[lang, s]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}  # noqa: B023,E731
        p, q = {s: share(counts[lang, s]) for s in mine}, share(total)
        for s in mine:
            pairs = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in mine if o != s)
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:  # several blocks, tiles, slices and joins instead of filters
        for name, value in (("BLOCK_TERMS", 3), ("BLOCK_SOURCES", 2), ("TEXT_BYTES", 500), ("TERM_ROWS", 7), ("FILTER_BITS", 0)):
            monkeypatch.setattr(divergence, name, value)
    rows = some_docs()
    got = [tuple(r) for r in divergence.divergence(frame(spark, rows, "term", "row", "k", "p")).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert divergence.divergence(frame(spark, rows).limit(0)).collect() == []


def test_large_counts_do_not_overflow(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_000)], "k long, n long").select(divergence._share("k", "n").alias("p"))
    assert df.first()["p"] == 1 + 10**9 * 9_000_000_000_001 // 10**13


def test_prefixes_fall_before_they_grow(spark):
    rows = [(i, f"junk{i:04d}abcdefgh".translate(str.maketrans("0123456789", "jklmnopqrs")) + " common", "en", "a") for i in range(50)]
    terms = spark.createDataFrame([("en", t.encode(), [i], ["a"], [1]) for i, x, _, _ in rows for t in x.split()], divergence.TERMS)
    assert [bytes(r["term"]) for r in divergence.kept_terms(terms).collect()] == [b"common"]
    deep = terms.mapInArrow(divergence._prefix_sets(8, None), "lang string, prefix binary, whole boolean, doc long").distinct().groupBy("prefix").count().where("count >= 3").collect()
    assert len(deep) < 10  # of 50 terms, only shared beginnings are extended


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    return w, [zlib.crc32(f.encode()) % resample.BUCKETS for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


@pytest.mark.parametrize("most", [0, 5, 1 << 17])
def test_resample(spark, monkeypatch, most):
    monkeypatch.setattr(resample.frequent_words, "__defaults__", (most,)) if resample.frequent_words.__defaults__ else monkeypatch.setitem(resample.frequent_words.__kwdefaults__, "most", most)
    rows = some_docs()
    bench = [(1, "river stone river"), (2, None), (3, "naïver 日tt " * 9)]
    target = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample.resample(frame(spark, rows, "rank", "score", "n_words"), target).collect()}
    s, t = Counter(), Counter()
    for r in rows:
        s.update(plain_features(r[1])[1])
    for _, x in bench:
        t.update(plain_features(x)[1])
    b, big_s, big_t = resample.BUCKETS, sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (big_s + b) / ((s[k] + 1) * (big_t + b))))
    scored = []
    for doc_id, text, _, _ in rows:
        w, f = plain_features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    drawable = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(drawable[: 25 * len(drawable) // 100])}
    assert got == {(x[0], x[2], x[3], x[4], rank.get(id(x))) for x in scored}
    assert resample.resample(frame(spark, rows).limit(0), target).collect() == []


def test_composed_crcs():
    r = random.Random(2)
    words = [bytes(r.randrange(256) for _ in range(r.choice([1, 2, 7, 300, 70_000]))) for _ in range(40)]
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    got = resample.compose(crc[:-1], crc[1:], np.array([len(w) for w in words[1:]]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]


def shortest(regex):
    """Texts that a rule matches, with every alternative of each group and no optional part."""
    regex = re.sub(r"\(((?:[^()]|\([^()]*\))*)\)\?", "", regex)
    regex = re.sub(r" \?|(\w)\?", "", regex)
    regex = re.sub(r"\( ?\\\w\+?\)\{(\d),\d+\}", lambda m: " some" * int(m[1]), regex)
    parts = re.split(r"\(([^()]*)\)", regex)
    return ["".join(x) for x in product(*[p.split("|") if k % 2 else [p] for k, p in enumerate(parts)])]


def test_every_rule_passes_the_gate_and_is_found(spark):
    assert len(licenses.RULES) >= 250
    rows = []
    for rule in licenses.RULES:
        for text in shortest(rule.regex[4:-2]):
            assert re.match(rule.regex, text + " "), (rule, text)
            assert re.search(licenses.GATE, text), (rule, text)
            assert len(text.split()) <= licenses.SPAN - 8, rule
            rows.append((rule.number, text.upper().replace(" ", "-\n"), None, None))
    assert len(rows) >= len(licenses.RULES)
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        rule = licenses.RULES[r["doc_id"]]
        whole = [x for x in r["licenses"] if x["start"] == 0]
        assert any(x["priority"] <= rule.priority for x in whole), (rule, r)


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    hits = []
    for i in range(len(w)):
        ctx = " ".join(w[i : i + licenses.SPAN]) + " "
        for r in licenses.RULES:
            if w[i] in r.keywords and (m := re.match(r.regex, ctx)):
                hits.append((i, i + m[0].count(" "), r.priority, r.number, r.label))
    kept = [a for a in hits if not any(b != a and b[0] <= a[0] and b[1] >= a[1] and b[2] <= a[2] and (b[0] < a[0] or b[1] > a[1] or b[2:4] < a[2:4]) for b in hits)]
    joined = f" {' '.join(w)} "
    base = sorted((len(joined[: m.start()].split()), v) for k, v in licenses.BASE.items() for m in re.finditer(f" {k}(?= )", joined))
    return len(w), base, sorted(kept)


def test_license_scan(spark):
    r = random.Random(9)
    bits = [x for rule in licenses.RULES for x in shortest(rule.regex[4:-2])] + ["MIT  license", "mit_license", "Apache\nLICENSE, Version 2.0", "the", "GNU General Public License, version 3", "mit", "license", "Permit license", "mit licenseé"]
    rows = [(i, " ".join(r.choice(bits) for _ in range(r.randint(1, 12))), None, None) for i in range(150)] + ODD
    rows += [(500, "mit license " * 4000, None, None), (501, ("word " * 60 + "under the MIT License\n") * 300, None, None)]
    got = licenses.scan_licenses(frame(spark, rows, "words", "base", "n_words", "PLACES")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    for row, g in zip(sorted(rows, key=key), sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "")), strict=True):
        n, base, kept = plain_scan(row[1])
        assert (g["n_words"], [tuple(x) for x in g["base"]], sorted(tuple(x) for x in g["licenses"])) == (n, base, kept), row
    columns = {r["doc_id"]: r for r in licenses.license_columns(licenses.scan_licenses(frame(spark, rows))).collect()}
    assert columns[500]["n_base"] == 4000 and columns[500]["last_word"] == 7998 and columns[500]["base_labels"] == "mit"
    assert columns[2]["labels"] == "" and columns[2]["first_word"] is None and columns[2]["score"] == 0.0
    assert licenses.scan_licenses(frame(spark, rows).limit(0)).collect() == []
