"""Season totals, trailing years, priors and shrinkage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def season_totals(df: DataFrame, keys: Sequence[str], year: str, points: str, exposure: str, stats: Sequence[str], start_at: float) -> DataFrame:
    """Per (keys, year): points, exposure, games with a value, starts, and per stat its sum and the exposure where it was recorded."""
    return df.groupBy(*keys, year).agg(
        F.sum(points).alias("points"), F.sum(exposure).alias("exposure"), F.count(points).alias("games"), F.count_if(F.col(exposure) >= start_at).alias("starts"),
        *[F.sum(s).alias(f"{s}_sum") for s in stats], *[F.sum(F.when(F.col(s).isNotNull(), F.col(exposure))).alias(f"{s}_exposure") for s in stats],
    )


def trailing(value: Column, keys: Sequence[str], year: str, span: int, how=F.sum) -> Column:
    """``how`` over the ``span`` years before each row's."""
    return how(value).over(Window.partitionBy(*keys).orderBy(year).rangeBetween(-span, -1))


def trailing_rate(keys: Sequence[str], year: str, span: int, points: str = "points", games: str = "games", exposure: str = "exposure", least: float = 900) -> Column:
    """Points per game over the years before, null under ``least`` exposure."""
    return F.when(trailing(F.col(exposure), keys, year, span) >= least, trailing(F.col(points), keys, year, span) / trailing(F.col(games), keys, year, span))


def previous(value: str, keys: Sequence[str], year: str) -> Column:
    """The value of exactly the year before; null where that year is missing."""
    return F.max(value).over(Window.partitionBy(*keys).orderBy(year).rangeBetween(-1, -1))


def prior_ladder(stat_sum: str, stat_exposure: str, keys: Sequence[str], year: str, per: float, enough: float, pooled_enough: float) -> Column:
    """Last year's rate with enough exposure; else three years pooled by exposure; else last year's whatever it has."""
    s, e = (lambda span, c: trailing(F.col(c), keys, year, span)), F.nullif
    last_e, last = s(1, stat_exposure), s(1, stat_sum) / e(s(1, stat_exposure), F.lit(0)) * per
    pool_e, pool = s(3, stat_exposure), s(3, stat_sum) / e(s(3, stat_exposure), F.lit(0)) * per
    return F.when(last_e >= enough, last).when(pool_e >= pooled_enough, pool).otherwise(last)


def league_prior(df: DataFrame, year: str, group: str, bucket: str, rate: str, least: int = 20) -> DataFrame:
    """(year, group, bucket, prior): mean rate of strictly earlier years by cell with at least ``least`` rows, else by group.

    Sums per (year, cell) are made first, so the windows run over small tables whatever the input's size.
    """
    seen = df.where(F.col(rate).isNotNull())
    cells = seen.groupBy(year, group, bucket).agg(F.sum(rate).alias("s"), F.count(rate).alias("n"))
    spine = df.select(year).distinct().crossJoin(df.select(group, bucket).distinct())
    full = spine.join(cells, [year, group, bucket], "left").fillna(0, ["s", "n"])

    def before(c, *k):
        return F.coalesce(F.sum(c).over(Window.partitionBy(*k).orderBy(year).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))

    s, n, gs, gn = before("s", group, bucket), before("n", group, bucket), before("s", group), before("n", group)
    prior = F.when(n >= least, s / F.nullif(n, F.lit(0))).otherwise(F.when(gn > 0, gs / F.nullif(gn, F.lit(0))))
    return full.select(year, group, bucket, prior.alias("prior"))


def blend(current: Column, prior: Column, n: Column, k: float) -> tuple[Column, Column]:
    """(blend, weight) with w = n / (n + k); where one side is null the other stands alone."""
    w = n / (n + F.lit(float(k)))
    return F.coalesce(w * current + (1 - w) * prior, current, prior), w


def fit_strength(
    df: DataFrame, grid: Sequence[float], current: str, prior: str, n: str, target: str, exposure: str | None = None, default: float = 10.0,
    least: int = 500
) -> DataFrame:
    """One row (k, n_rows) of a single statistic, among rows with a prior: see ``fit_strengths``."""
    one = Stat("stat", current, prior, n, target, exposure, default)
    return fit_strengths(df.where(F.col(prior).isNotNull() & F.col(n).isNotNull()), [one], grid, least).select("k", "n_rows")


@dataclass(frozen=True)
class Stat:
    """A statistic's columns: this season's value, the prior, how much is behind the value, and what came; with an exposure
    column the target is a count over it and losses are Poisson deviances, without they are squared errors."""

    name: str
    current: str
    prior: str
    n: str
    target: str
    exposure: str | None = None
    default: float = 10.0


def _loss(stat: Stat, k: float) -> Column:
    """A row's loss at strength k."""
    cur, prior, y = (F.col(c).cast("double") for c in (stat.current, stat.prior, stat.target))
    w = F.coalesce(F.col(stat.n).cast("double"), F.lit(0.0))
    guess = blend(cur, prior, w, k)[0]
    if not stat.exposure:
        return F.pow(y - guess, 2)
    mean = F.greatest(F.greatest(guess, F.lit(0.0)) * F.col(stat.exposure), F.lit(1e-6))
    return 2 * (F.when(y > 0, y * F.ln(F.when(y > 0, y) / mean)).otherwise(0.0) - (y - mean))


def fit_strengths(df: DataFrame, stats: Sequence[Stat], grid: Sequence[float], least: int = 500) -> DataFrame:
    """(stat, k, loss, n_rows): of each statistic the strength of least mean loss among the grid and its default, ties to the smallest.

    All losses of all statistics are sums of one aggregate, so rows are read once and none is multiplied.  A statistic
    with fewer than ``least`` rows that have a target and a value or a prior keeps its default, without a loss.
    """
    sums, tried = [], []
    for i, s in enumerate(stats):
        usable = F.coalesce(s.current, s.prior).isNotNull() & F.col(s.target).isNotNull()
        if s.exposure:
            usable &= F.col(s.exposure).isNotNull()
        ks = sorted({float(k) for k in grid} | {float(s.default)})
        tried.append(ks)
        sums.append(F.count_if(usable).alias(f"n{i}"))
        sums += [F.sum(F.when(usable, _loss(s, k))).alias(f"l{i}_{j}") for j, k in enumerate(ks)]
    row = df.agg(*sums)

    def chosen(i: int, s: Stat, ks: list[float]) -> Column:
        losses = F.array(*[F.struct(F.round(F.col(f"l{i}_{j}") / F.col(f"n{i}"), 9).alias("loss"), F.lit(k).alias("k")) for j, k in enumerate(ks)])
        best = F.when(F.col(f"n{i}") >= least, F.array_min(losses))
        return F.struct(F.lit(s.name).alias("stat"), F.coalesce(best["k"], F.lit(float(s.default))).alias("k"), best["loss"].alias("loss"), F.col(f"n{i}").alias("n_rows"))

    return row.select(F.explode(F.array(*[chosen(i, s, ks) for i, (s, ks) in enumerate(zip(stats, tried, strict=True))])).alias("x")).select("x.*")
