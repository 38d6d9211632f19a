"""Log ratios, signatures, shards and the mix against plain Python, one item at a time."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from groundmesh.llm import fingerprints, mixing, neardup, quality, repeats, sharding

WIDE = (1 << 64) - 1
SCHEMA = "doc_id long, text string, source string"


def mixed(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & WIDE
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & WIDE
    return x ^ x >> 33


def some_words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "river", "stone", "naïve", "日本"]) + str(r.randint(0, 30)) for _ in range(n))


PAIRS = [(i, some_words(20 + 9 * i, i), None if i % 5 == 4 else f"s{i % 4}") for i in range(23)]
PAIRS += [(30, None, "s0"), (31, "", "s1"), (32, " \n\t", None), (33, "one", "s2"), (None, some_words(70, 77), "s1"), (5, PAIRS[5][1], "s1"), (5, PAIRS[5][1], "s1"), (34, "x" * 300, "blank"), (35, None, "blank only")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(PAIRS, SCHEMA).repartition(3).cache()


def test_log_ratio_and_verdict(spark, docs):
    good = {i for i in range(0, 40, 3)}
    labels = spark.createDataFrame([(i, int(i in good), 0) for i in range(40)], "doc_id long, quality int, toxic int")

    def buckets(text):
        h = [int(x) for x in pd.util.hash_array(pd.Series(re.findall(r"[^\x20\x09-\x0D]+", text or ""), dtype=object).to_numpy(), categorize=False)]
        return [mixed(x) % quality.BUCKETS for x in h] + [mixed(x * 0x9E3779B97F4A7C15 + y & WIDE) % quality.BUCKETS for x, y in zip(h, h[1:])]

    raw, trusted = Counter(), Counter()
    for i, t, _ in PAIRS:
        raw.update(buckets(t))
        if i in good:
            trusted.update(buckets(t))
    share = sum(trusted.values()) / sum(raw.values())
    ratio = lambda b: math.log((trusted[b] + quality.SMOOTHING * share) / (raw[b] + quality.SMOOTHING)) - math.log(share)
    want = []
    for i, t, _ in PAIRS:
        found = buckets(t)
        want.append((i is None, i or 0, sum(map(ratio, found)) / len(found) if found else 0.0))
    got = quality.score_documents(docs, labels).collect()
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["llr"]) for r in got)
    assert [h[:2] for h in have] == [w[:2] for w in sorted(want)]
    assert [h[2] for h in have] == pytest.approx([w[2] for w in sorted(want)], abs=1e-9)
    assert all(r["kept"] == (not r["base_failed"] and round(r["llr"], 9) >= quality.THRESHOLD) for r in got)


def plain_fingerprint(data):
    if not data:
        return "3::"
    value = []
    for i in range(len(data)):
        h = 0
        for j in range(i - fingerprints.WINDOW + 1, i + 1):
            h = h * 0x100000001B3 + (data[j] + 1 if j >= 0 else 0) & WIDE
        value.append((mixed(h) >> 16) + 1)
    ends = lambda block: [i for i, v in enumerate(value) if v % block == 0]

    def letters(block):
        out, start = "", 0
        for stop in sorted({*(e + 1 for e in ends(block)[: fingerprints.SIGNATURE - 1]), len(data)}):
            piece, power = 0, 1
            for b in data[start:stop]:
                piece, power = piece + (b + 1) * power & WIDE, power * fingerprints.BASE & WIDE
            out += fingerprints.ALPHABET[mixed(piece + stop - start & WIDE) % 64]
            start = stop
        return out

    block = fingerprints.LEAST_BLOCK
    while len(ends(block)) >= fingerprints.SIGNATURE:
        block *= 2
    if block > fingerprints.LEAST_BLOCK and len(ends(block)) + 1 < fingerprints.FEW:
        block //= 2
    return f"{block}:{letters(block)}:{letters(2 * block)}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (n, *x), (m, *y) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    pairs = [(x[0], y[0]), (x[1], y[1])] if n == m else [(x[0], y[1])] if n == 2 * m else [(x[1], y[0])] if m == 2 * n else []
    return max([1 - distance(p, q) / max(len(p), len(q)) if p and q else 0.0 for p, q in pairs], default=0.0)


def test_signatures_and_likeness(spark):
    texts = {i: t for i, t, _ in PAIRS if i is not None and i != 5}
    texts |= {50: some_words(3000, 4), 51: "prefix " + some_words(3000, 4), 52: "y" * 2000, 53: "some lines come again and again\n" * 90, 54: "some lines come again and again\n" * 90 + "tail"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(rows).collect()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    for i, following in zip(order, [*order[1:], order[0]], strict=True):
        mine, other = texts[i] or "", texts[following] or ""
        half = len(mine) // 2
        marks = [plain_fingerprint(t.encode()) for t in (mine, mine[: len(mine) - half] + other[:half], other)]
        assert [got[i]["fingerprint"], got[i]["edited_fingerprint"]] == marks[:2]
        assert [got[i]["near_edited"], got[i]["near_next"]] == pytest.approx([plain_likeness(marks[0], m) for m in marks[1:]])


def test_a_text_of_megabytes_has_short_signatures():
    r = random.Random(8)
    text = " ".join(f"word{r.randrange(10**6)}" for _ in range(150_000)).encode()
    block, one, two = fingerprints.fingerprint(text).split(":")
    assert len(text) > 1 << 20 and 24 <= len(one) <= 64 and len(two) <= len(one)
    assert plain_likeness(fingerprints.fingerprint(text), fingerprints.fingerprint(b"head " + text)) > 0.9


@pytest.mark.parametrize("text", [some_words(200_000, 8).encode(), b"some lines come again and again\n" * 900])
def test_a_text_that_repeats_itself_is_like_its_edits(text):
    mark = fingerprints.fingerprint(text)
    assert len(mark.split(":")[1]) == 64
    assert plain_likeness(mark, fingerprints.fingerprint(b"head " + text)) > 0.9
    assert plain_likeness(mark, fingerprints.fingerprint(text + b" tail")) > 0.9


def test_places_of_shards(docs):
    n, seed = len(PAIRS), 20240229
    keys = sorted((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _ in PAIRS)
    side = math.isqrt(n - 1) + 1
    want = []
    for x, (some, i, crc, size) in enumerate(keys):
        while True:
            left, right = divmod(x, side)
            for k in range(1, sharding.ROUNDS + 1):
                left, right = right, (left + mixed(right ^ mixed(k + seed)) % side) % side
            x = left * side + right
            if x < n:
                break
        want.append((i if some else None, size, crc, x % 7, x // 7))
    got = [tuple(r) for r in sharding.shard_documents(docs, 7).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bucket_rows", [2, 2000])
def test_schedule_and_taken_words(spark, docs, monkeypatch, bucket_rows):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket_rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for *_, s in PAIRS}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size(t) for _, t, x in PAIRS if x == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, target, total = {s for s in names if not held[s]}, {}, sum(held.values())
    while True:
        left = total - sum(3 * held[s] for s in full)
        target = {s: 3 * held[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        if not (over := {s for s in names if s not in full and target[s] > 3 * held[s]}):
            break
        full |= over
    block, turns = 16, Counter()
    want_slots = []
    for slot in range(math.ceil(sum(target.values()) / block)):
        u, bound = (slot + 0.5) * mixing.GOLDEN % 1, 0.0
        for s in names:
            bound += target[s] / sum(target.values())
            if u < bound or s == [x for x in names if target[x]][-1]:
                break
        want_slots.append((slot, names.index(s), turns[s]))
        turns[s] += 1
    sources = [{"sid": k, "target": float(target[s])} for k, s in enumerate(names)]
    assert sorted(map(tuple, mixing.schedule(spark, sources, block, chunk=5).select("slot", "sid", "turn").collect())) == want_slots

    rows, _ = mixing.mix_rows(docs, block=block)
    rows = [r.asDict() for r in rows.select("*", *(F.xxhash64(F.lit(17), F.lit(e), "key", "nth").alias(f"h{e}") for e in range(3))).collect()]
    taken = Counter()
    for sid, s in enumerate(names):
        upto, at = min(turns[s] * block, 3 * held[s]), 0
        mine = [r for r in rows if r["sid"] == sid and r["size"]]
        buckets = max(1, math.ceil(sum(x == s for *_, x in PAIRS) / bucket_rows))
        for e in range(3):
            for r in sorted(mine, key=lambda r: ((r[f"h{e}"] >> 20) % buckets, r[f"h{e}"])):
                taken[r["key"], r["nth"]] += max(0, min(at + r["size"], upto) - at)
                at += r["size"]
    want = [(r["doc_id"], r["size"], taken[r["key"], r["nth"]]) for r in rows]
    got = mixing.taken_words(docs, block=block).collect()
    assert sorted(((r["doc_id"], r["size"], r["taken"]) for r in got), key=str) == sorted(want, key=str)


def test_inner_names_may_clash(docs):
    odd = docs.select("*", *(F.lit(7).alias(c) for c in ("_key", "_NTH", "_rk", "_n", "_epoch", "_from", "_to", "_kept_id", "_kept_key")))
    for stage in (mixing.mixed_documents, neardup.keep_one):
        out = stage(odd)
        assert out.columns == odd.columns
        assert sorted(map(str, out.select(docs.columns).collect())) == sorted(map(str, stage(docs).collect()))
        assert {tuple(r) for r in out.select(odd.columns[3:]).collect()} == {(7,) * 9}


def test_pieces_meet_by_hash_as_they_do_by_bytes():
    r = np.random.default_rng(8)
    data = np.tile(r.integers(97, 101, 300).astype(np.uint8), 3)
    data[450] = 120
    first = r.integers(0, len(data) - repeats.LENGTH - 40, 3000)
    last = first + r.integers(0, repeats.SPAN, len(first))
    text = [data[a : b + repeats.LENGTH].tobytes() for a, b in zip(first, last, strict=True)]
    digest = repeats.piece_hashes(data, first, last)
    assert len(set(digest.tolist())) == len(set(text)) == len(set(zip(digest.tolist(), text, strict=True)))
    key, nth = r.integers(0, 60, len(first)).astype(np.uint64), r.integers(-3, 40, len(first))
    whole, asked = repeats.folded(key, nth, digest)
    least, forms, owners = {}, {}, {}
    for k, t, n in zip(key.tolist(), text, nth.tolist(), strict=True):
        least[k, t] = min(n, least.get((k, t), n))
        forms.setdefault(k, set()).add(t)
        owners.setdefault(k, set()).add(n)
    for k, t, n, w, a in zip(key.tolist(), text, nth.tolist(), whole, asked, strict=True):
        assert w == (n > least[k, t]) and a == (not w and len(forms[k]) > 1 and len(owners[k]) > 1)
    assert [len(x) for x in repeats.folded(key[:0], nth[:0], digest[:0])] == [0, 0]
