"""Collocations: the filters as such, and the whole against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from formline.llm import phrases as P
from formline.llm import quotient_filter as Q


@pytest.mark.parametrize("k,width", [(2, 1), (2, 17), (2, 32), (3, 1), (3, 5), (3, 17), (3, 32), (4, 2), (4, 16), (4, 19), (4, 32)])
def test_keys_survive_packing_and_permuting(k, width):
    rng = np.random.default_rng(k * width)
    ids = [rng.integers(0, 1 << width, 500) for _ in range(k)]
    half = Q.half_bits(k, width)
    keys = Q.pack(ids, width)
    assert all((x < np.uint64(1 << half)).all() if half < 64 else True for x in keys)
    mixed = Q.permute(keys, half)
    assert [x.tolist() for x in Q.unpack(Q.restore(mixed, half), k, width)] == [x.tolist() for x in ids]
    assert len({*zip(*(x.tolist() for x in mixed), strict=True)}) == len({*zip(*(x.tolist() for x in keys), strict=True)})


@pytest.mark.parametrize("half,n,skip", [(3, 40, 0), (9, 300, 2), (20, 2000, 3), (34, 5000, 5), (64, 700, 0), (64, 1, 7), (40, 0, 1)])
def test_filters_are_lossless(half, n, skip):
    rng = np.random.default_rng(n)
    top = (1 << half) - 1
    a, b = (rng.integers(0, top, n, np.uint64, endpoint=True) for _ in range(2))
    prefix = 1 if skip else 0
    if skip:
        a = a & np.uint64((1 << half - skip) - 1) | np.uint64(prefix << half - skip)
    keys, counts = Q.counted((a, b), rng.integers(1, 600, n), half)
    raw = Q.encode(keys, counts, half, skip)
    (x, y), c = Q.decode(raw, prefix)
    assert (x.tolist(), y.tolist(), c.tolist()) == (keys[0].tolist(), keys[1].tolist(), counts.tolist())


def test_filters_are_compact():
    keys, counts = Q.counted(Q.permute(Q.pack([np.arange(50_000), np.arange(50_000)[::-1]], 17), 17), None, 17)
    assert len(Q.encode(keys, counts, 17)) < 6.5 * 50_000


def test_merging_adds_counts():
    rng = random.Random(4)
    parts, want = [], Counter()
    for _ in range(5):
        seen = Counter({(rng.randrange(30), rng.randrange(30)): rng.randrange(1, 400) for _ in range(200)})
        want += seen
        rows = sorted(seen)
        parts.append(Q.decode(Q.encode(tuple(np.array([r[i] for r in rows], np.uint64) for i in (0, 1)), np.array([seen[r] for r in rows]), 5)))
    (a, b), c = Q.merged(parts, 5)
    assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), c.tolist(), strict=True)) == want


def expected(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    out = {}
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        inside = any(
            other == lang and len(h) > len(g) and c >= least and 100 * c >= 80 * a and any(h[s : s + len(g)] == g for s in range(len(h) - len(g) + 1))
            for (other, h), c in f.items()
        )
        if inside:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, g[:j]] + f[lang, g[j:]]), j, f[lang, g[:j]], f[lang, g[j:]]) for j in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def rows():
    rng = random.Random(8)
    words = ["the", "a", "New", "York", "city", "É", "naïve", "x\x1cy", "of", "Of", " ", "z" * 30]
    out = [(None, None), ("", "en"), (None, "en"), (" \t.", None), ("one", "en"), ("New York City hall " * 30, "en"), ("a b. " * 40, "xx")]
    for _ in range(120):
        text = "".join(rng.choice([*words, "New York", "New York City", "the of a"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", "\r"]) for _ in range(rng.randrange(60)))
        out.append((text, rng.choice(["en", "en", "de", None, "und", "", "fr"])))
    return out + out[-5:]


@pytest.mark.parametrize("least,top", [(3, 40), (30, 2000)])
def test_collocations_by_counting(spark, least, top):
    table = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(rows())], "doc_id long, text string, lang string, word string")
    got = sorted(tuple(r) for r in P.collocations(table, least=least, top=top).collect())
    want = expected(rows(), least, top)
    assert got == want and len(want) > 5


def test_small_blocks_ranges_and_sieve(spark, monkeypatch):
    for name, value in (("BLOCK", 50), ("HELD", 64), ("RANGE", 16), ("SIEVE_BITS", 4), ("PART", 64)):
        monkeypatch.setattr(P, name, value)
    table = spark.createDataFrame(rows(), "text string, lang string").repartition(3)
    assert sorted(tuple(r) for r in P.collocations(table, least=3).collect()) == expected(rows(), 3, 2000)


def test_long_text_in_parts():
    raw = (b"Aa bB. " * 50 + b"q" * 300 + b" x,") * 3
    for size in (5, 64, 1000):
        assert b"".join(P.pieces(raw, size)) == raw.lower().translate(bytes(10 if c in b".,;:!?" else c for c in range(256)))


def test_nothing_and_session(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert P.collocations(spark.createDataFrame([("rare words only", "en")], "text string, lang string")).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
