"""Parameter fits: losses and their derivatives are summed where the rows are, and one small row is left to decide on."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators.scoring import LEAST_PROB, elo_probabilities
from formline.sources.staging import written


def log_rising(y: Column, r: Column) -> Column:
    """ln of r (r+1) ... (r+y-1): lgamma(y + r) - lgamma(r) for whole y."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(y, F.lit(0))), F.lit(0.0), lambda a, j: a + F.when(j < y, F.ln(r + j)).otherwise(0.0))


def fit_dispersion(df: DataFrame, group: str, y: str, mean: str, grid: Sequence[float], least: int = 500) -> DataFrame:
    """Per group the dispersion of highest negative binomial log-likelihood, for groups of at least ``least`` rows.

    Rows are first counted by (group, y, mean), so the grid multiplies distinct values, not rows.
    """
    small = df.where(F.col(y).isNotNull() & (F.col(mean) > 0)).groupBy(group, y, mean).agg(F.count(F.lit(1)).alias("n"))
    alphas = df.sparkSession.createDataFrame([(float(a),) for a in grid], "alpha double")
    r, mu = 1 / F.col("alpha"), F.col(mean)
    ll = log_rising(F.col(y), r) - F.ln(F.factorial(y).cast("double")) + r * F.ln(r / (r + mu)) + F.col(y) * F.ln(mu / (r + mu))
    by = small.crossJoin(F.broadcast(alphas)).groupBy(group, "alpha").agg(F.sum(ll * F.col("n")).alias("ll"), F.sum("n").alias("n_rows"))
    return by.groupBy(group).agg(F.max_by("alpha", "ll").alias("alpha"), F.max("n_rows").alias("n_rows"), F.max("ll").alias("ll")).where(F.col("n_rows") >= least)


def choose_family(held: DataFrame, fitted: DataFrame, group: str, y: str, mean: str) -> DataFrame:
    """Per group with a fitted dispersion: mean held-out log-likelihood of Poisson and of the negative binomial, and the better one.

    Ties go to Poisson.  Rows are first counted by (group, y, mean), as in the fit.
    """
    small = held.where(F.col(y).isNotNull() & (F.col(mean) > 0)).groupBy(group, y, mean).agg(F.count(F.lit(1)).alias("n"))
    r, mu, k = 1 / F.col("alpha"), F.col(mean), F.col(y)
    fact = F.ln(F.factorial(y).cast("double"))
    poisson = k * F.ln(mu) - mu - fact
    negative = log_rising(k, r) - fact + r * F.ln(r / (r + mu)) + k * F.ln(mu / (r + mu))
    mean_of = lambda ll: F.round(F.sum(ll * F.col("n")) / F.sum("n"), 9)
    by = small.join(F.broadcast(fitted.select(group, "alpha")), group).groupBy(group).agg(mean_of(poisson).alias("poisson"), mean_of(negative).alias("negbin"))  # one row per group
    return by.withColumn("family", F.when(F.col("negbin") > F.col("poisson"), "negbin").otherwise("poisson"))


def held_out_losses(df: DataFrame, result: str, routes: dict[str, Sequence[Column]]) -> DataFrame:
    """(route, loss): mean log loss of each route's home, draw and away probabilities."""
    one = lambda p: F.avg(-F.ln(F.element_at(F.array(*p), F.col(result) + 1) + LEAST_PROB))
    row = df.agg(*[one(p).alias(n) for n, p in routes.items()])
    return row.unpivot([], list(routes), "route", "loss")


_PARAMETERS = "hcs"
_PAIRS = [a + b for i, a in enumerate(_PARAMETERS) for b in _PARAMETERS[i:]]


def _shares(d: np.ndarray, theta: Sequence[float]) -> dict[str, dict[str, np.ndarray]]:
    """Home (h), draw (d) and away (a) shares at gaps d, with first and second derivatives by the parameters' letters.

    The draw share is c exp(-x**2 / 2 s**2) at x = gap + hfa, the home share a logistic less half of it, the rest is away; all
    are clipped, where they have no derivatives, and scaled to sum to one.
    """
    h, c, s = (float(x) for x in theta)
    x, rate = d + h, math.log(10) / 400
    bell, even = np.exp(-(x**2) / (2 * s * s)), 1 / (1 + 10 ** (-x / 400))
    raw = c * bell
    draw = {
        "h": -raw * x / s**2, "c": bell, "s": raw * x * x / s**3, "hh": raw * (x * x / s**4 - 1 / s**2), "hc": -bell * x / s**2, "hs": raw * (2 * x / s**3 - x**3 / s**5), "cc": 0 * x,
        "cs": bell * x * x / s**3, "ss": raw * (x**4 / s**6 - 3 * x * x / s**4),
    }
    clipped = lambda raw, slopes, high=np.inf: {"": np.clip(raw, LEAST_PROB, high)} | {k: v * ((raw > LEAST_PROB) & (raw < high)) for k, v in slopes.items()}
    draw = clipped(raw, draw, 0.6)
    slopes = {k: -draw[k] / 2 for k in draw if k}
    slopes["h"] = slopes["h"] + rate * even * (1 - even)
    slopes["hh"] = slopes["hh"] + rate**2 * even * (1 - even) * (1 - 2 * even)
    home = clipped(even - draw[""] / 2, slopes)
    away = clipped(1 - home[""] - draw[""], {k: -home[k] - draw[k] for k in slopes})
    total = {k: home[k] + draw[k] + away[k] for k in draw}
    out = {}
    for name, q in (("h", home), ("d", draw), ("a", away)):
        p = {"": q[""] / total[""]}
        for k in _PARAMETERS:
            p[k] = (q[k] - p[""] * total[k]) / total[""]
        for k in _PAIRS:
            p[k] = (q[k] - p[k[0]] * total[k[1]] - p[k[1]] * total[k[0]] - p[""] * total[k]) / total[""]
        out[name] = p
    return out


def entropy_sums(d: np.ndarray, targets: Sequence[np.ndarray], thetas: Sequence[Sequence[float]]) -> list[list[float]]:
    """Of each map the summed cross-entropy, its gradient and its second derivatives, ten numbers, over some points."""
    out = []
    for theta in thetas:
        sums = np.zeros(1 + len(_PARAMETERS) + len(_PAIRS))
        for t, p in zip(targets, _shares(d, theta).values(), strict=True):
            q = p[""] + LEAST_PROB
            sums[0] -= (t * np.log(q)).sum()
            sums[1:4] -= [(t * p[k] / q).sum() for k in _PARAMETERS]
            sums[4:] -= [(t * (p[k] / q - p[k[0]] * p[k[1]] / q**2)).sum() for k in _PAIRS]
        out.append(sums.tolist())
    return out


def entropy(d: np.ndarray, targets: Sequence[np.ndarray], theta: Sequence[float]) -> float:
    """The summed cross-entropy of a map over some points, as ``entropy_sums`` has it, without derivatives."""
    h, c, s = (float(x) for x in theta)
    x = d + h
    draw = np.clip(c * np.exp(-(x**2) / (2 * s * s)), LEAST_PROB, 0.6)
    home = np.clip(1 / (1 + 10 ** (-x / 400)) - draw / 2, LEAST_PROB, np.inf)
    away = np.clip(1 - home - draw, LEAST_PROB, np.inf)
    total = home + draw + away
    return -sum(float((t * np.log(p / total + LEAST_PROB)).sum()) for t, p in zip(targets, (home, draw, away), strict=True))


def _summed(points: DataFrame, thetas: Sequence[Sequence[float]]) -> list[list[float]]:
    """``entropy_sums`` of the first map over all points, and of the others the loss alone: each task gives one short row a map, and these are added up."""
    thetas = [list(map(float, t)) for t in thetas]
    size = 1 + len(_PARAMETERS) + len(_PAIRS)

    def run(batches):
        total = np.zeros((len(thetas), size))
        for batch in batches:
            d, *targets = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            total[0] += entropy_sums(d, targets, thetas[:1])[0]
            total[1:, 0] += [entropy(d, targets, t) for t in thetas[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(total[:, j]) for j in range(size)]], names=["i", *[f"x{j}" for j in range(size)]])

    made = points.select("d", "t0", "t1", "t2").mapInArrow(run, "i int, " + ", ".join(f"x{j} double" for j in range(size)))
    rows = made.groupBy("i").agg(*[F.sum(f"x{j}").alias(f"x{j}") for j in range(size)]).collect()  # one row a map
    return [list(r)[1:] for r in sorted(rows)]


def fit_elo_map(df: DataFrame, diff: str, targets: Sequence[str], start: Sequence[float] = (50.0, 0.3, 300.0), tolerance: float = 1e-8, rounds: int = 60) -> tuple[float, float, float, float]:
    """(hfa, c, s, loss): the map of least mean cross-entropy against target probabilities of home, draw and away.

    Newton's method: a pass over the different gaps sums the losses at eight steps along the direction, with gradient and
    second derivatives at the whole step, and the best is where the next round starts; where that is a shorter one a second pass
    has its derivatives.  Where the second derivatives don't show
    down, the direction is damped towards the gradient's.  It stops when a step moves no parameter by more than
    ``tolerance`` of its size.  Rows with a null are left out; without rows the start stands, with a null loss.
    """
    known = F.col(diff).isNotNull()
    for t in targets:
        known &= F.col(t).isNotNull()
    sums = [F.sum(t).alias(f"t{i}") for i, t in enumerate(targets)]
    points = written(df.where(known).groupBy(F.col(diff).cast("double").alias("d")).agg(*sums), "elo-points")
    weight = points.agg(F.sum(F.col("t0") + F.col("t1") + F.col("t2"))).first()[0]
    if not weight:
        return (*map(float, start), None)
    theta, damp = np.array(start, float), 0.0
    unit = np.abs(theta) + 1e-3
    here = _summed(points, [theta])[0]
    for _ in range(rounds):
        gradient = np.array(here[1:4]) * unit
        second = dict(zip(_PAIRS, here[4:], strict=True))
        hessian = np.array([[second["".join(sorted(a + b, key=_PARAMETERS.index))] for b in _PARAMETERS] for a in _PARAMETERS]) * np.outer(unit, unit)
        low, top = np.linalg.eigvalsh(hessian)[0], max(np.abs(hessian).max(), 1e-12)
        shift = damp * top + max(0.0, 1e-6 * top - low)
        step = -np.linalg.solve(hessian + shift * np.eye(3), gradient) * unit
        tries = [t for t in (theta + step * 0.5**i for i in range(8)) if t[1] > 0 and t[2] > 0]
        sums = _summed(points, tries) if tries else []
        best = min(range(len(tries)), key=lambda i: sums[i][0], default=None)
        if best is None or sums[best][0] >= here[0]:
            if np.max(np.abs(step) / unit) <= max(tolerance, 1e-7) or damp > 1e6:
                break
            damp = max(10 * damp, 1e-3)
            continue
        moved = np.max(np.abs(tries[best] - theta) / unit)
        theta, here, damp = tries[best], sums[0] if best == 0 else _summed(points, [tries[best]])[0], damp / 10 if damp > 1e-9 else 0.0
        if moved <= tolerance:
            break
    return (*theta.tolist(), here[0] / weight)
