"""The fuzzy alias rung against all pairs, and without pairs where names are short."""

import random

import pytest

from formline.functions.text import sorted_ratio
from formline.operators import resolve


def spoilt(rng, s, most):
    for _ in range(rng.randrange(most + 1)):
        i = rng.randrange(len(s) + 1)
        s = s[:i] + rng.choice(["", "", "a", "z", " "]) + s[i + rng.choice([0, 1]):]
    return s


@pytest.mark.parametrize("least", [90.0, 93.0])
def test_alias_equals_all_pairs_at_all_lengths(spark, least):
    rng = random.Random(int(least))
    base = ["".join(rng.choice("ab c") for _ in range(rng.choice([2, 5, 9, 14, 20, 28, 29, 30, 31, 32, 33, 34, 45]))) for _ in range(90)] + ["", "zoë x", "x  y", "x y"]
    known = [(i, n) for i, n in enumerate(base + [spoilt(rng, n, 2) for n in base])]
    asked = sorted({spoilt(rng, n, 5) for n in base} | {" ".join(reversed(n.split())) for n in base})
    want = {}
    for name in asked:
        same = [c for c, n in known if n == name]
        scores = sorted((-sorted_ratio(name, n), c) for c, n in known)[0]
        want[name] = ((same[0], "exact") if len(same) == 1 else (None, "ambiguous")) if same else (scores[1], "fuzzy") if -scores[0] >= least else (None, "unmatched")
    got = resolve.alias(spark.createDataFrame([(n,) for n in asked], "name string"), spark.createDataFrame(known, "code long, name string"), least=least)
    assert {r.name: (r.code, r.method) for r in got.collect()} == want
    assert sum(m == "fuzzy" for _, m in want.values()) > 40 and sum(m == "unmatched" for _, m in want.values()) > 10


def test_short_names_make_no_pairs(spark, monkeypatch):
    """Names that share nearly all their runs: 4,000,000 pairs by shared runs, none by what is left of a name."""
    monkeypatch.setattr(resolve, "sorted_similarity", lambda *_: pytest.fail("pairs are scored"))
    n = 2000
    known = spark.range(n).selectExpr("id AS code", "concat('household aaaaa', translate(lpad(id, 4, '0'), '0123456789', 'abcdefghij')) AS name")
    got = resolve.alias(known.selectExpr("concat(name, 's') AS name"), known).collect()
    assert len(got) == n and all(r.method == "fuzzy" and r.name.endswith("aaaaa" + f"{r.code:04}".translate(str.maketrans("0123456789", "abcdefghij")) + "s") for r in got)
