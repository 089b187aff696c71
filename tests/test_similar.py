"""Candidates from the index against all pairs, and how many pairs are scored as names grow."""

import random

import pytest

from formline.functions.text import token_score
from formline.operators import resolve, similar

SYLLABLES = ["an", "be", "ro", "ta", "li", "mo", "ke", "su", "da", "fi", "no", "ge", "x", "o", "st"]


def name(rng, syllables=SYLLABLES):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.choice([1, 1, 2, 3, 4]))) for _ in range(rng.choice([1, 2, 2, 3, 4])))


def spoilt(rng, s):
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        if s:
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice(["", "a", "e", " ", "xy"]) + s[i + rng.choice([0, 1]):]
    words = s.split(" ")
    if rng.random() < 0.3:
        rng.shuffle(words)
    if rng.random() < 0.3:
        words = words[:-1]
    return " ".join(words + words[:1] * (rng.random() < 0.1))


def frame(spark, rows):
    return spark.createDataFrame(rows, "block string, name string")


@pytest.mark.parametrize("least", [70.0, 85.0, 93.0, 99.0])
def test_nothing_is_missed(spark, least):
    rng = random.Random(int(least))
    right = [(rng.choice("ab"), name(rng)) for _ in range(200)] + [("a", ""), ("a", "a b c"), ("b", "j r r"), ("a", "o x"), ("a", "anan anan"), (None, "anan"), ("a", None)]
    left = [(rng.choice("ab"), spoilt(rng, rng.choice(right[:200])[1])) for _ in range(200)] + [("a", " "), ("a", "a c b"), ("a", "ab"), ("a", "anan"), (None, "anan"), ("b", None)]
    got = {(r.block, r.name, r.other, round(r.score, 6)) for r in similar.scored(frame(spark, left), frame(spark, right), least).collect()}
    want = {(b, x, y, round(token_score(x, y), 6)) for b, x in set(left) for c, y in set(right) if b and b == c and x is not None and y is not None and token_score(x, y) >= least}
    assert got == want and len(want) > 20


def test_pairs_grow_far_slower_than_all_pairs(spark):
    """Ten times the names of one block: all pairs are a hundred times as many, those scored under thirty times."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    syllables = [rng.choice(letters) + rng.choice("aeiou") + rng.choice(letters) for _ in range(400)]
    counts = []
    for n in (150, 1500):
        right = [("t", f"{rng.choice(syllables)}{rng.choice(syllables)} {rng.choice(syllables)}{rng.choice(syllables)}") for _ in range(n)]
        left = [("t", spoilt(rng, x[1])) for x in right]
        counts.append(similar.candidates(frame(spark, left), frame(spark, right), 85.0).count())
    assert counts[1] < 30 * counts[0] and counts[1] < 1500 * 1500 / 50, counts


def test_repeated_names_are_scored_once(spark):
    left, right = [("a", "ann lee")] * 50 + [("b", "ann lee")], [("a", "ann leo")] * 40 + [("b", "ann leo")]
    assert {tuple(r) for r in similar.candidates(frame(spark, left), frame(spark, right), 80.0).collect()} == {("a", "ann lee", "ann leo"), ("b", "ann lee", "ann leo")}
    assert similar.scored(frame(spark, []), frame(spark, right), 80.0).count() == 0


def test_near_names_of_one_block_meet_few(spark, monkeypatch):
    """Names of digits, all alike at the lowest score: the sure ones are found without making the pairs of their block."""
    n, real, counts = 400, similar.candidates, []

    def counted(*args):
        pairs = real(*args).localCheckpoint()
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(similar, "candidates", counted)
    digits = "translate(lpad(cast(id * 7919 % 1000000 AS string), 9, '0'), '0123456789', 'abcdefghij')"
    right = spark.range(n).selectExpr("id AS code", f"'building ' || {digits} AS name", "'t' AS team")
    left = right.selectExpr("code AS uid", "name || 's' AS name", "team").unionByName(spark.createDataFrame([(n, "nobody", "elsewhere")], "uid long, name string, team string"))
    got = resolve.resolve(left, right, left.where("false").selectExpr("uid", "uid AS code")).collect()
    assert {(r.uid, r.code, r.method, r.confidence) for r in got} == {(i, i, "fuzzy", 0.92) for i in range(n)} | {(n, None, "unmatched", None)}
    assert sum(counts) < 10 * n, counts


def test_a_pair_is_scored_in_one_place(spark):
    scored = similar.scored(frame(spark, [("a", "ann lee")]), frame(spark, [("a", "ann leo")]), 80.0)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in scored.collect()] == [("a", "ann lee", "ann leo", token_score("ann lee", "ann leo"))]


def test_words_part_where_python_parts_them(spark):
    left, right = frame(spark, [("a", "ann\tlee"), ("a", "bo\xa0ray")]), frame(spark, [("a", "lee ann"), ("a", "ray bo")])
    assert {(r.name, r.other, r.score) for r in similar.scored(left, right, 99.0).collect()} == {("ann\tlee", "lee ann", 100.0), ("bo\xa0ray", "ray bo", 100.0)}


def test_what_is_left_over():
    assert set(similar.left_over(["ab", "c"], 0)) == {"ab c"}
    assert set(similar.left_over(["ab", "c"], 1)) == {"ab c", "b c", "a c", "ab", "abc", "cab"}
    assert "" in similar.left_over(["a", "b"], 2) and similar.left_over([], 2) == [""]
