"""Evaluation of predictions against actual values, the fold as a grouping key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.windows import average_rank

EPS = 1e-9
#: Rows that a task keeps of groups it may see again.
HELD = 100_000


def fold_parts(year: str, round_no: str, folds: Sequence[tuple[str, int, int | None]]) -> Column:
    """Array of (fold, part) of a row, for folds (name, test year, round after which its test begins or None for the whole year).

    ``test`` is the test year, after the split; ``valid`` the year before it; ``fit`` all earlier years, and the
    test year up to the split.  Train rows are those of fit and valid.  A null round is before no split.
    """
    parts = []
    for name, y, split in folds:
        held = F.col(year) == y
        test = held if split is None else held & (F.col(round_no) > split)
        fit = F.col(year) < y - 1 if split is None else (F.col(year) < y - 1) | (held & (F.col(round_no) <= split))
        part = F.when(test, "test").when(F.col(year) == y - 1, "valid").when(fit, "fit")
        parts.append(F.struct(F.lit(name).alias("fold"), part.alias("part")))
    return F.filter(F.array(*parts), lambda x: x["part"].isNotNull())


def point_metrics(df: DataFrame, keys: Sequence[str], predicted: str, actual: str) -> DataFrame:
    e = F.col(predicted) - F.col(actual)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def top_mae(df: DataFrame, keys: Sequence[str], predicted: str, actual: str, tie: str, n: int = 50) -> DataFrame:
    """MAE over the n highest predictions of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(predicted).desc(), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy(*keys).agg(F.avg(F.abs(F.col(predicted) - F.col(actual))).alias("top_mae"))


def early_metrics(df: DataFrame, keys: Sequence[str], round_no: str, predicted: str, actual: str, tie: str, last: int = 8, least: int = 100, top: int = 50) -> DataFrame:
    """Point metrics and top MAE of each key's rows up to round ``last``; keys with fewer than ``least`` such rows have none."""
    early = df.where(F.col(round_no) <= last)
    return point_metrics(early, keys, predicted, actual).where(F.col("n") >= least).join(top_mae(early, keys, predicted, actual, tie, top), list(keys))


def spearman(df: DataFrame, keys: Sequence[str], round_key: str, predicted: str, actual: str) -> DataFrame:
    """Mean over rounds of the rank correlation, ties at average ranks; rounds with one constant side are left out."""
    part = [*keys, round_key]
    ranked = df.select(*part, average_rank(predicted, part).alias("a"), average_rank(actual, part).alias("b"))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    per = ranked.groupBy(*part).agg(F.try_divide(F.covar_pop("a", "b"), F.when(spread > 0, spread)).alias("rho"))
    return per.where("rho is not null").groupBy(*keys).agg(F.avg("rho").alias("spearman"), F.count(F.lit(1)).alias("rounds"))


def tail_metrics(df: DataFrame, keys: Sequence[str], predicted: str, actual: str, marks: Sequence[float], least: int = 20) -> DataFrame:
    """Per key and mark: RMSE and MAE over rows at or above the mark, where there are enough."""
    marked = df.withColumn("mark", F.explode(F.filter(F.array(*[F.lit(float(m)) for m in marks]), lambda m: F.col(actual) >= m)))
    return point_metrics(marked, [*keys, "mark"], predicted, actual).where(F.col("n") >= least)


def probability_metrics(df: DataFrame, keys: Sequence[str], p: str, hit: str) -> DataFrame:
    y = F.col(hit).cast("double")
    q = F.greatest(F.least(F.col(p), F.lit(1 - EPS)), F.lit(EPS))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - y, 2)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate")
    )


def reliability(df: DataFrame, p: str, hit: str, bins: int = 10, least: int = 50) -> DataFrame:
    """Equal-width bins up to the largest probability: mean probability, hit rate and size; thin bins are left out."""
    most = df.agg(F.max(p).alias("_most"))
    binned = df.crossJoin(F.broadcast(most)).withColumn("bin", F.least(F.floor(F.col(p) / (F.col("_most") / bins)), F.lit(bins - 1)).cast("int"))  # one row
    by = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(hit).cast("double")).alias("rate"))
    return by.where(F.col("n") >= least)


def quantile_metrics(df: DataFrame, keys: Sequence[str], actual: str, quantiles: dict[float, str], low: str, high: str) -> DataFrame:
    """Mean pinball loss per quantile column and the share of actual values inside [low, high]."""
    y = F.col(actual)
    loss = {q: F.avg(F.greatest(q * (y - F.col(c)), (q - 1) * (y - F.col(c)))).alias(f"pinball_{c}") for q, c in quantiles.items()}
    return df.groupBy(*keys).agg(*loss.values(), F.avg(y.between(F.col(low), F.col(high)).cast("double")).alias("coverage"))


def class_log_loss(df: DataFrame, keys: Sequence[str], label: str, probs: Sequence[str]) -> DataFrame:
    picked = F.element_at(F.array(*[F.col(p) for p in probs]), F.col(label) + 1)
    return df.groupBy(*keys).agg((-F.avg(F.ln(picked + EPS))).alias("log_loss"))


def best_route(df: DataFrame, keys: Sequence[str], routes: Sequence[str], actual: str) -> DataFrame:
    """Per key the prediction column of least mean absolute error on the given (held-out) rows, ties to the first named."""
    errors = df.groupBy(*keys).agg(*[F.avg(F.abs(F.col(r) - F.col(actual))).alias(r) for r in routes])
    least = F.array_min(F.array(*[F.struct(F.round(r, 9).alias("mae"), F.lit(i).alias("i"), F.lit(r).alias("route")) for i, r in enumerate(routes)]))
    return errors.select(*keys, least.alias("x")).select(*keys, "x.route", "x.mae")


def near_best(df: DataFrame, weights: Sequence[float], group: Sequence[str], ev: str, extra: str, actual: str, tie: str, top: int) -> DataFrame:
    """(_g, _ev, _extra, _actual, _tie, _key): rows that can be among a group's ``top`` for some weight, as far as their task knows.

    Each task keeps, batch after batch, the rows that are so among those it has seen; with over HELD of them it passes
    them on.  Groups are told apart by a 64-bit hash.
    """
    rows = df.select(F.struct(*group).alias("_g"), F.col(ev).cast("double").alias("_ev"), F.col(extra).cast("double").alias("_extra"), F.col(actual).cast("double").alias("_actual"), F.col(tie).cast("long").alias("_tie"))
    rows = rows.where(F.col("_ev").isNotNull() & F.col("_extra").isNotNull() & F.col("_tie").isNotNull()).withColumn("_key", F.xxhash64("_g"))
    grid = np.array([float(w) for w in weights])

    def cut(keys: np.ndarray, values: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Places (of index) of rows among the first ``top`` of their key for some weight."""
        kept = np.zeros(len(keys), bool)
        for w in grid:
            order = np.lexsort((values[:, 2], -(values[:, 0] + w * values[:, 1]), keys))
            first = np.concatenate([[0], (keys[order][1:] != keys[order][:-1]).nonzero()[0] + 1])
            place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            kept[order[place < top]] = True
        return index[kept]

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ev_, ex, tie_ = (held.column(n).to_numpy() for n in ("_ev", "_extra", "_tie"))
            keep = cut(held.column("_key").to_numpy(), np.stack([ev_, ex, tie_], 1), np.arange(held.num_rows))
            held = held.take(pa.array(keep)).combine_chunks()
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return rows.mapInArrow(run, rows.schema)


def best_per_weight(df: DataFrame, weights: Sequence[float], group: Sequence[str], ev: str, extra: str, actual: str, tie: str, top: int = 3) -> DataFrame:
    """(weight, group, actual): of each group the ``top`` rows by ev + weight * extra, ties to the smaller ``tie``, for every weight.

    Only what ``near_best`` leaves is multiplied by the weights and shuffled.  ``tie`` is a whole number; rows with a null
    score are no picks.
    """
    score = lambda w: F.col("_ev") + F.lit(float(w)) * F.col("_extra")
    near = near_best(df, weights, group, ev, extra, actual, tie, top)
    each = near.select("_g", "_actual", "_tie", F.explode(F.array(*[F.struct(F.lit(float(w)).alias("weight"), score(w).alias("_s")) for w in weights])).alias("w"))
    w = Window.partitionBy("w.weight", "_g").orderBy(F.col("w._s").desc(), "_tie")
    picks = each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return picks.select(F.col("w.weight").alias("weight"), F.col("_g").alias("group"), F.col("_actual").alias("actual"))


def pick_weight(
    df: DataFrame, grid: Sequence[float], fold: str, round_key: str, ev: str, extra: str, actual: str, tie: str, top: int = 3, haul: float = 10,
    tolerance: float = 0.02
) -> DataFrame:
    """Per weight on the extra term: mean points and haul rate of each (fold, round)'s top picks, whether its points are
    within the tolerance of the best, and whether its haul rate is a standard error above weight 0's; then the choice."""
    picks = best_per_weight(df, grid, [fold, round_key], ev, extra, actual, tie, top)
    by = picks.groupBy("weight").agg(F.avg("actual").alias("points"), F.avg((F.col("actual") >= haul).cast("double")).alias("haul_rate"), F.count(F.lit(1)).alias("n"))
    best = by.agg(F.max("points").alias("best"), F.max_by("haul_rate", -F.col("weight")).alias("base"), F.max("n").alias("m"))
    out = by.crossJoin(F.broadcast(best))  # a row per weight
    error = F.sqrt(F.col("base") * (1 - F.col("base")) / F.col("m"))
    allowed = (F.col("points") >= F.col("best") * (1 - tolerance)) & ((F.col("weight") == 0) | (F.col("haul_rate") >= F.col("base") + error))
    return out.select("weight", "points", "haul_rate", "n", allowed.alias("allowed"))


def acceptance(metrics: DataFrame, fold: str, model: str, new: str, old: str, at: object, mae_tolerance: float, spearman_tolerance: float) -> DataFrame:
    """(check, passed) of the new model against the old one, with a last row ``all``.

    ``metrics`` has a row per fold and model: mae, spearman, brier, tail_rmse, and whether the fold's test
    season has the late rule and whether its training rows could fit it.  At the fold ``at`` rank
    correlation and MAE may be worse by their tolerances and the Brier score must be better; the tail
    error must be better on every fold where the two flags agree, of which there must be one.
    """
    of = lambda m, c: F.max(F.when(F.col(model) == m, F.col(c)))
    pairs = metrics.groupBy(fold).agg(*[of(m, c).alias(f"{side}_{c}") for side, m in (("n", new), ("o", old)) for c in ("mae", "spearman", "brier", "tail_rmse")],
                                      F.bool_and(F.col("rule_in_test") == F.col("rule_fitted")).alias("agree"))
    there = lambda c: F.coalesce(F.max(F.when(F.col(fold) == at, c)), F.lit(False))
    tail = F.coalesce(F.min(F.when(F.col("agree"), F.coalesce(F.col("n_tail_rmse") < F.col("o_tail_rmse"), F.lit(False)))), F.lit(False))
    one = pairs.agg(
        there(F.col("n_spearman") > F.col("o_spearman") - spearman_tolerance).alias("spearman_tolerance"), tail.alias("tail_rmse"),
        there(F.col("n_brier") < F.col("o_brier")).alias("haul_calibration"), there(F.col("n_mae") < F.col("o_mae") + mae_tolerance).alias("mae_tolerance"),
    )
    checks = ["spearman_tolerance", "tail_rmse", "haul_calibration", "mae_tolerance"]
    every = one.withColumn("all", F.expr(" AND ".join(checks)))
    return every.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in [*checks, "all"]])).alias("x")).select("x.*")


def differing(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Per column the number of keys whose values differ (null-safe): all zero when a change of the future reaches no past feature."""
    both = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)

    def off(c):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.coalesce(F.abs(x - y) > tolerance, ~x.eqNullSafe(y))

    counts = both.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(off(c)).alias(c) for c in columns])
    return counts.unpivot(["n"], list(columns), "feature", "n_changed")
