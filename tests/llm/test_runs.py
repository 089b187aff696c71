"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from formline.llm import periodic_runs as P
from formline.llm.queries import _planted_period


def smallest_period(s):
    f, k = [0] * len(s), 0
    for i in range(1, len(s)):
        while k and s[i] != s[k]:
            k = f[k - 1]
        k += s[i] == s[k]
        f[i] = k
    return len(s) - f[-1]


def brute(s, least, times):
    out, n = [], len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and smallest_period(s[i : i + length]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def series(rng):
    s = [rng.randrange(1, rng.choice([2, 3, 4, 6])) for _ in range(rng.randrange(80))]
    for _ in range(rng.randrange(3)):
        a, p = rng.randrange(len(s) + 1), rng.randrange(1, 15)
        block = [rng.randrange(1, 4) for _ in range(p)]
        s[a:a] = (block * 6)[: rng.randrange(2 * p, 6 * p + 1)]
    return s


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2), (10, 4)])
def test_runs_of_every_kind(least, times):
    rng = random.Random(least)
    for _ in range(300):
        s = series(rng)
        want = brute(s, least, times)
        assert P.runs(s, least, times) == want
        assert P.text_runs([b"w%d" % x for x in s], least, times) == want


def test_common_extensions_and_order():
    rng = random.Random(3)
    for _ in range(50):
        s = series(rng) or [1]
        tree = P.SuffixTree(s)
        n = len(s)
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j][:400]

        def shared(i, j):
            k = 0
            while max(i, j) + k < n and s[i + k] == s[j + k]:
                k += 1
            return k

        if pairs:
            got = tree.common(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
            assert got.tolist() == [shared(*p) for p in pairs]
        order = sorted(range(n + 1), key=lambda i: [*s[i:], 0])
        assert [int(tree.rank[i]) for i in order] == list(range(n + 1))


def test_range_minimum():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1000, 3000).astype(np.int32)
    a, b = rng.integers(0, 3000, 2000), rng.integers(0, 3000, 2000)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    assert P.RangeMinimum(x).least(lo, hi).tolist() == [int(x[i : j + 1].min()) for i, j in zip(lo, hi, strict=True)]


def test_every_run_repeats_that_many_words():
    for least, times in ((24, 3), (6, 3), (4, 2), (100, 7), (2, 2)):
        assert P.least_repeat(least, times) == min(max(least, times * q) - q for q in range(1, 500))


def rows():
    rng = random.Random(9)
    out = [(None, "a b " * 40), (None, None), (0, None), (1, ""), (2, " \t\n"), (3, "x " * 23), (4, "x " * 24), (5, "é ü " * 30), (6, "a\x1cb " * 25), (7, "q" * 100_000)]
    for i in range(8, 90):
        out.append((i, rng.choice(["\n", " ", " \t"]).join(f"w{x}" for x in series(rng))))
    return out + out[-3:]


def expected(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc is not None:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words, 24, 3)
    gone = {k for a, m, q in found for k in range(a + q, a + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else None
    return (
        doc, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_by_brute_force(spark):
    table = spark.createDataFrame([(a, b, 1) for a, b in rows()], "doc_id long, text string, length int")
    got = [tuple(r) for r in P.find(table, rewrite=_planted_period).collect()]
    want = [expected(*r) for r in rows()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 20 and any(zlib.crc32(b"%d" % r[0]) % 10 == 0 for r in want if r[0])


def test_real_outputs_and_empty_table(spark):
    row = P.find(spark.createDataFrame([(1, "start " + "a b c " * 9 + "end")], "doc_id long, text string"), keep=True).first()
    assert row.collapsed == "start a b c end" and [tuple(r) for r in row.runs] == [(1, 27, 3)]
    assert P.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        P.find(spark.createDataFrame([], "doc_id long, text string"), min_times=1)
