"""Ranks, places and quantiles in cut groups, top rows by weight, and the rating map's fit, each against a plain computation."""

import bisect
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formline.operators import evaluate, fits, ranks, seasons
from formline.operators.scoring import elo_probabilities


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        g = "big" if rng.random() < 0.8 else rng.choice(["a", "b", None])
        x = None if rng.random() < 0.05 else 1.0 if rng.random() < 0.3 else rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e6, float(rng.randrange(5))])
        rows.append((i, g, x, rng.gauss(0, 1)))
    pdf = pd.DataFrame(rows, columns=["id", "g", "x", "y"])
    return spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(5), pdf


@pytest.mark.parametrize("run_values,hot", [(10**6, 10**6), (50, 10**6), (7, 100)])
def test_average_ranks(frame, run_values, hot):
    df, pdf = frame
    want = pdf.groupby("g", dropna=False)["x"].rank()
    size = pdf.groupby("g", dropna=False)["x"].transform("count")
    got = {r.id: (r.rank, r.size) for r in ranks.average_ranks(df, ["g"], "x", "rank", "size", run_values, hot).collect()}
    assert len(got) == len(pdf)
    for i, w, n in zip(pdf.id, want, size, strict=True):
        assert got[i] == ((None, None) if math.isnan(w) else (w, n))


def test_ranks_of_nothing(frame):
    df, _ = frame
    assert ranks.average_ranks(df.limit(0), ["g"], "x").count() == 0 and ranks.rating(df.limit(0), ["g"], "x").count() == 0


def test_capped(frame):
    df, pdf = frame
    got = {r.id: r.place for r in ranks.capped(df, ["g"], "x", ["id"], salts=5).collect()}
    want = {}
    for _, part in pdf.groupby("g", dropna=False):
        order = sorted((-x, i) for i, x in zip(part.id, part.x, strict=True) if not math.isnan(x))
        want |= {i: 8 for i in part.id} | {i: min(k + 1, 8) for k, (_, i) in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("finish,bins", [(10_000, 256), (40, 256), (3, 4)])
def test_quantiles(frame, finish, bins):
    df, pdf = frame
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in ranks.quantiles(df, ["g"], "x", probs, finish, bins).collect()}
    want = {(None if isinstance(g, float) else g): np.quantile(part.x.dropna(), probs) for g, part in pdf.groupby("g", dropna=False)}
    assert got.keys() == want.keys()
    for g, q in want.items():
        np.testing.assert_allclose(got[g], q, rtol=1e-12, atol=1e-12)


def test_rank_correlation(frame):
    df, pdf = frame
    got = {r.g: r.rho for r in ranks.rank_correlation(df, ["g"], "x", "y", 50).collect()}
    for g, part in pdf.dropna(subset=["x"]).groupby("g", dropna=False):
        assert math.isclose(got[None if isinstance(g, float) else g], part.x.rank().corr(part.y.rank()), abs_tol=1e-12)


@pytest.mark.parametrize("held", [100_000, 5])
def test_best_per_weight(spark, monkeypatch, held):
    monkeypatch.setattr(evaluate, "HELD", held)
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), rng.randrange(4), float(rng.randrange(6)), None if rng.random() < 0.1 else rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, f string, r int, ev double, extra double, y double").repartition(6)
    weights = [0.0, 2.0, 50.0]
    got = sorted((r.weight, r.group.f, r.group.r, r.actual) for r in evaluate.best_per_weight(df, weights, ["f", "r"], "ev", "extra", "y", "id").collect())
    want = []
    for w in weights:
        for f in "ab":
            for r in range(4):
                scored = sorted((-(x[3] + w * x[4]), x[0], x[5]) for x in rows if x[1] == f and x[2] == r and x[4] is not None)
                want += [(w, f, r, y) for _, _, y in scored[:3]]
    assert got == sorted(want)


def test_what_is_shuffled_does_not_grow_with_the_weights(spark):
    """Tasks pass on some rows a group and weight at most, and one row for all the weights that pick it."""
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("f"), (F.col("id") % 3).alias("r"), F.rand(1).alias("ev"), F.rand(2).alias("extra"), F.rand(3).alias("y")).coalesce(2)
    few, many = (evaluate.near_best(df, [float(w) for w in range(n)], ["f", "r"], "ev", "extra", "y", "id", 3).count() for n in (2, 40))
    assert 2 * 6 * 3 <= few <= 2 * 2 * 6 * 3 and many < 2 * few + 100


def test_map_of_known_parameters(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.uniform(-400, 400),) for _ in range(3000)] + [(None,)], "gap double")
    for true, start in (((62.0, 0.26, 240.0), (50.0, 0.3, 300.0)), ((20.0, 0.33, 400.0), (90.0, 0.2, 150.0))):
        p = elo_probabilities(F.col("gap"), *true)
        hfa, c, s, loss = fits.fit_elo_map(df.select("gap", *[x.alias(n) for x, n in zip(p, "hda", strict=True)]), "gap", list("hda"), start)
        # the small number inside the logarithm moves the optimum by less than this
        assert abs(hfa - true[0]) < 1e-2 and abs(c - true[1]) < 1e-4 and abs(s - true[2]) < 0.1 and 0 < loss < 1.1
    assert fits.fit_elo_map(df.where("false").select("gap", *[F.lit(0.3).alias(n) for n in "hda"]), "gap", list("hda"))[3] is None


def test_derivatives_are_slopes():
    rng = np.random.default_rng(3)
    d, t = rng.uniform(-700, 700, 400), rng.dirichlet([2, 1, 2], 400).T
    theta, unit = np.array([55.0, 0.8, 260.0]), np.array([1e-3, 1e-6, 1e-3])  # with some draw shares clipped
    at = lambda x: np.array(fits.entropy_sums(d, t, [x])[0])
    here = at(theta)
    for i in range(3):
        step = np.eye(3)[i] * unit
        up, down = at(theta + step), at(theta - step)
        slope = (up - down) / (2 * unit[i])
        assert math.isclose(slope[0], here[1 + i], rel_tol=1e-4, abs_tol=1e-5)
        for j in range(3):
            k = 4 + fits._PAIRS.index("".join(sorted(fits._PARAMETERS[i] + fits._PARAMETERS[j], key=fits._PARAMETERS.index)))
            assert math.isclose(slope[1 + j], here[k], rel_tol=2e-2, abs_tol=2e-3 * abs(here[k]) + 1e-4)


def test_strengths_of_two_kinds(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, rng.random() * 3]), rng.choice([None, rng.random() * 3]), rng.choice([None, float(rng.randrange(20))]), rng.choice([None, float(rng.randrange(4))]), rng.random() + 0.1) for _ in range(700)]
    df = spark.createDataFrame(rows, "c double, p double, n double, y double, e double")
    stats = [seasons.Stat("a", "c", "p", "n", "y", None, 7.0), seasons.Stat("b", "c", "p", "n", "y", "e")]
    got = {r.stat: (r.k, r.loss, r.n_rows) for r in seasons.fit_strengths(df, stats, [1, 5, 50], least=100).collect()}
    for stat, grid in (("a", [1, 5, 7, 50]), ("b", [1, 5, 10, 50])):
        losses = []
        for k in grid:
            each = []
            for c, p, n, y, e in rows:
                if y is None or (c is None and p is None):
                    continue
                w = (n or 0.0) / ((n or 0.0) + k)
                g = p if c is None else c if p is None else w * c + (1 - w) * p
                mu = max(max(g, 0) * e, 1e-6)
                each.append((y - g) ** 2 if stat == "a" else 2 * ((y * math.log(y / mu) if y > 0 else 0) - (y - mu)))
            losses.append((round(sum(each) / len(each), 9), k, len(each)))
        loss, k, n = min(losses)
        assert got[stat][0] == k and math.isclose(got[stat][1], loss, abs_tol=1e-8) and got[stat][2] == n
    assert [r.k for r in seasons.fit_strengths(df.limit(3), stats, [1.0]).orderBy("stat").collect()] == [7.0, 10.0]


def test_ranges_are_looked_up_in_parts(spark):
    """Counts of smaller bounds against bisect, with no row that carries more than ``PART`` bounds at once."""
    rng = random.Random(4)
    sizes = {0: 0, 1: 1, 2: ranks.PART - 1, 3: ranks.PART, 4: ranks.PART + 1, 5: 1000, 6: ranks.PART**2, None: 200}
    edges = [(g, sorted(rng.uniform(0, 1) for _ in range(n))) for g, n in sizes.items()]
    values = [(g, v) for g, e in [*edges, (9, [])] for v in [-1.0, 2.0, *[rng.uniform(0, 1) for _ in range(60)], *rng.sample(e, min(len(e), 60)), *e[:1], *e[-1:]]]
    made = ranks.ranges_of(spark.createDataFrame(values, "g int, v double"), spark.createDataFrame(edges, "g int, _edges array<double>"), ["g"], "v", "run")
    bounds = dict(edges)
    got = made.collect()
    assert len(got) == len(values) and all(r.run == bisect.bisect_left(bounds.get(r.g, []), r.v) for r in got)


def test_shorter_steps_are_summed_without_derivatives(spark):
    rng = np.random.default_rng(3)
    d, thetas = rng.uniform(-900, 900, 500), [(62.0, 0.26, 240.0), (-300.0, 0.9, 40.0), (5.0, 0.01, 900.0)]
    targets = list(rng.dirichlet([1, 1, 1], 500).T)
    whole = fits.entropy_sums(d, targets, thetas)
    assert np.allclose([fits.entropy(d, targets, t) for t in thetas], [w[0] for w in whole], rtol=1e-12)
    points = spark.createDataFrame([tuple(map(float, r)) for r in zip(d, *targets, strict=True)], "d double, t0 double, t1 double, t2 double")
    got = fits._summed(points, thetas)
    assert np.allclose(got[0], whole[0], rtol=1e-9) and [any(r[1:]) for r in got] == [True, False, False] and np.allclose([r[0] for r in got], [w[0] for w in whole], rtol=1e-12)
