"""Pricing event counts with a rules table, auditing recorded totals, and closed-form expectations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators.ranks import quantiles
from formline.operators.spread import null_safe_join
from formline.sources.staging import written

# Points per event, by position 1 to 4 where a list; a count step means points per so many events.
RULES = {
    "long_play": 2, "short_play": 1, "goals": [6, 6, 5, 4], "assists": 3, "clean_sheets": [4, 4, 1, 0], "goals_conceded": [-1, -1, 0, 0], "saves": 1,
    "penalties_saved": 5, "penalties_missed": -2, "yellow_cards": -1, "red_cards": -3, "own_goals": -2, "bonus": 1, "dc_award": [0, 0, 0, 0], "dc_threshold": [0, 10, 12, 12],
}
RULES_WITH_DC = RULES | {"dc_award": [0, 2, 2, 2]}
CONCEDED_STEP, SAVES_STEP, FULL_GAME, LONG_PLAY_AT, LEAST_PROB = 2, 3, 90, 60, 1e-6
LINEAR = ("assists", "penalties_saved", "penalties_missed", "yellow_cards", "red_cards", "own_goals", "bonus")


def rules_table(spark: SparkSession, seasons: Mapping[str, Mapping]) -> DataFrame:
    """One row per (season, position): a dimension of a few rows."""
    rows = [{"season": s, "position": p} | {f"r_{k}": float(v[p - 1] if isinstance(v, list) else v) for k, v in r.items()} for s, r in seasons.items() for p in range(1, 5)]
    return spark.createDataFrame(rows, "season string, position int, " + ", ".join(f"r_{k} double" for k in RULES))


def _count(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)


def price(df: DataFrame, rules: DataFrame, out: str = "priced", without: Sequence[str] = ()) -> DataFrame:
    """Adds points of each row by its season's and position's rules; absent counts and nulls are 0."""
    c = lambda n: _count(df, n)
    r = lambda n: F.col(f"r_{n}")
    pts = F.when(c("minutes") >= LONG_PLAY_AT, r("long_play")).when(c("minutes") > 0, r("short_play")).otherwise(0.0)
    pts += r("goals") * c("goals") + r("clean_sheets") * c("clean_sheets")
    pts += r("goals_conceded") * F.floor(c("goals_conceded") / CONCEDED_STEP) + r("saves") * F.floor(c("saves") / SAVES_STEP)
    for name in LINEAR:
        pts += r(name) * c(name)
    if "dc" not in without:
        pts += F.when(c("defensive_contribution") >= r("dc_threshold"), r("dc_award")).otherwise(0.0)
    return df.join(F.broadcast(rules), ["season", "position"]).withColumn(out, pts).drop(*[x for x in rules.columns if x.startswith("r_")])


def audit(df: DataFrame, rules: DataFrame, recorded: str = "total_points") -> DataFrame:
    """Per season: rows and rows whose recorded total is not what the counts give."""
    return price(df, rules).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("priced") - F.col(recorded)) > 1e-9).alias("mismatches"))


def recovered_thresholds(df: DataFrame, rules: DataFrame, recorded: str = "total_points") -> DataFrame:
    """Per position with an award: the least count where the rest of the total is the award, the most where it is 0, and whether they overlap."""
    award = rules.select("season", "position", F.col("r_dc_award").alias("award")).where("award != 0")
    rest = price(df, rules, without=("dc",)).join(F.broadcast(award), ["season", "position"]).withColumn("rest", F.col(recorded) - F.col("priced"))
    dc = F.coalesce("defensive_contribution", F.lit(0))
    by = rest.groupBy("position").agg(F.min(F.when(F.abs(F.col("rest") - F.col("award")) < 1e-8, dc)).alias("threshold"), F.max(F.when(F.abs("rest") < 1e-8, dc)).alias("quiet_to"))
    return by.where("threshold is not null").withColumn("overlap", F.coalesce(F.col("quiet_to") >= F.col("threshold"), F.lit(False)))


# -- distributions and expectations --------------------------------------------------------------


def _series(mean: Column, most: int, alpha: float | None) -> tuple[Column, list[float]]:
    """(x, weights) with probabilities of 0..most events in proportion to weight[k] * x**k."""
    if not alpha:
        return mean, [1.0 / math.factorial(k) for k in range(most + 1)]
    r = 1.0 / alpha
    return mean / (r + mean), [math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1)) for k in range(most + 1)]


def _polynomial(x: Column, weights: Sequence[float]) -> Column:
    out = F.lit(float(weights[-1]))
    for w in reversed(weights[:-1]):
        out = out * x + float(w)
    return out


def count_pmf(mean: Column, most: int = 10, alpha: float | None = None) -> Column:
    """Probabilities of 0..most events, Poisson or negative binomial with dispersion ``alpha``, scaled to sum to one."""
    x, weights = _series(mean, most, alpha)
    total = _polynomial(x, weights)
    return F.when(mean.isNotNull(), F.array(*[w * F.pow(x, F.lit(k)) / total for k, w in enumerate(weights)]))


def expected_count_steps(mean: Column, step: int, most: int = 20, alpha: float | None = None) -> Column:
    """E[floor(k / step)] under ``count_pmf(mean, most, alpha)``: two polynomials in the mean, no list per row."""
    x, weights = _series(mean, most, alpha)
    return _polynomial(x, [w * (k // step) for k, w in enumerate(weights)]) / _polynomial(x, weights)


def expected_steps(pmf: Column, step: int, most: int, exposure: float = 1.0) -> Column:
    """E[floor(k / step)] under a list of probabilities of 0..most where each event is kept with probability ``exposure``.

    The exposure is one number for all rows, so what n events are worth is too: a sum of most + 1 products.
    """
    worth = [sum((k // step) * math.comb(n, k) * exposure**k * (1 - exposure) ** (n - k) for k in range(n + 1)) for n in range(most + 1)]
    out = F.lit(0.0)
    for n, w in enumerate(worth):
        if w:
            out = out + F.coalesce(F.get(pmf, F.lit(n)), F.lit(0.0)) * w
    return F.when(pmf.isNotNull(), out)


def thinned(pmf: Column, exposure: Column, most: int) -> Column:
    """The list of probabilities when each event is kept with a row's own ``exposure``: a sum over totals of binomial terms."""
    kept = lambda n, k: F.get(pmf, F.lit(n)) * float(math.comb(n, k)) * F.pow(exposure, F.lit(k)) * F.pow(1 - exposure, F.lit(n - k))
    return F.array(*[sum((kept(n, k) for n in range(k + 1, most + 1)), kept(k, k)) for k in range(most + 1)])


def step_scale(minutes: Column, edges: Sequence[tuple[float, float]] | None) -> Column:
    """The value of the largest edge at or below the minutes; without a curve, minutes / 90 clipped to 0..1."""
    if not edges:
        return F.when(minutes.isNotNull(), F.greatest(F.least(minutes / FULL_GAME, F.lit(1.0)), F.lit(0.0)))
    out = F.lit(0.0)
    for edge, value in sorted(edges):
        out = F.when(minutes >= edge, F.lit(float(value))).otherwise(out)
    return out


def expected_points(df: DataFrame, rules: DataFrame, pool: Mapping[str, float], pmf: str = "pmf", pmf_most: int = 10) -> DataFrame:
    """Adds the expectation by component (``ev_*``) and in total (``ev``) from rates and probabilities.

    Columns: season, position, p_cameo, p_start, goals_rate, assists_rate, saves_rate, p_dc, p_yellow,
    p_red, bonus_if_start, bonus_if_cameo and the list ``pmf`` of goals conceded.  ``pool``: mean minutes
    of a cameo and of a start, and the award scale of each.  Step functions are evaluated inside each
    minutes class and then averaged by the classes' probabilities.
    """
    r = lambda n: F.col(f"r_{n}")
    start, cameo = F.col("p_start"), F.col("p_cameo")
    xs, xc = float(pool["start"]) / FULL_GAME, float(pool["cameo"]) / FULL_GAME
    exposure = cameo * xc + start * xs
    saves = lambda x: expected_count_steps(F.col("saves_rate") * max(x, 1e-9), SAVES_STEP)
    conceded = lambda x: expected_steps(F.col(pmf), CONCEDED_STEP, pmf_most, x)
    parts = {
        "ev_minutes": start * r("long_play") + cameo * r("short_play"),
        "ev_goals": r("goals") * F.col("goals_rate") * exposure,
        "ev_assists": r("assists") * F.col("assists_rate") * exposure,
        "ev_clean_sheet": r("clean_sheets") * F.element_at(pmf, 1) * start,
        "ev_conceded": r("goals_conceded") * (start * conceded(1.0) + cameo * conceded(xc)),
        "ev_saves": r("saves") * (start * saves(xs) + cameo * saves(xc)),
        "ev_dc": r("dc_award") * F.col("p_dc") * (start * float(pool["dc_start"]) + cameo * float(pool["dc_cameo"])),
        "ev_cards_bonus": (
            r("yellow_cards") * F.col("p_yellow") + r("red_cards") * F.col("p_red")
        ) * (start + cameo) + r("bonus") * (start * F.col("bonus_if_start") + cameo * F.col("bonus_if_cameo")),
    }
    joined = df.join(F.broadcast(rules), ["season", "position"])
    made = joined.select(*df.columns, *[v.alias(k) for k, v in parts.items()])  # a stage of its own keeps generated code small
    total = F.lit(0.0)
    for k in parts:
        total += F.col(k)
    return made.withColumn("ev", total)


def returns_split(mean: Column) -> tuple[Column, Column, Column]:
    """Probabilities of 0, 1 and 2 or more returns at a Poisson mean."""
    p0 = F.exp(-mean)
    return p0, mean * p0, F.greatest(F.lit(0.0), 1 - p0 - mean * p0)


def two_stage(p_start: Column, if_start: Column, p_cameo: Column, if_cameo: Column) -> Column:
    return p_start * if_start + p_cameo * F.coalesce(if_cameo, F.lit(0.0))


def gate(df: DataFrame, gated: Column, zero: Sequence[str], one: str = "p_blank") -> DataFrame:
    """Outcome columns to 0 and the blank probability to 1 where gated; a null condition does not gate."""
    shut = F.coalesce(gated, F.lit(False))
    return df.withColumns({c: F.when(shut, 0.0).otherwise(F.col(c)) for c in zero} | {one: F.when(shut, 1.0).otherwise(F.col(one))})


def sample_summary(df: DataFrame, keys: Sequence[str], draw: str, value: str, marks: tuple[float, float, float] = (2, 5, 10), finish: int = 10_000) -> DataFrame:
    """Mean, tail shares and quantiles per keys; values of one draw are summed first, so doubles add before quantiles.

    Groups with over ``finish`` draws find their quantiles in passes that narrow the values down, so no group is held in one task.
    """
    sums = written(df.groupBy(*keys, draw).agg(F.sum(value).alias("x")), "summary-sums")
    low, mid, high = marks
    share = lambda hit: F.avg(hit.cast("int"))
    by = sums.groupBy(*keys).agg(F.avg("x").alias("mean"), share(F.col("x") <= low).alias("p_blank"), share(F.col("x") >= mid).alias("p_return"), share(F.col("x") >= high).alias("p_haul"))
    both = null_safe_join(by, quantiles(sums, keys, "x", (0.1, 0.5, 0.9), finish), keys)
    return both.select(*keys, "mean", "p_blank", "p_return", "p_haul", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def conditional_distribution(df: DataFrame, bucket: str, returns: str, outcome: str, least: int = 40) -> DataFrame:
    """(bucket, returns, expectation): mean outcome of the cell, falling back to bucket, then returns, then 0.

    All levels come from one grouping-sets aggregate.
    """
    sets = df.groupingSets(
        [[F.col(bucket), F.col(returns)], [F.col(bucket)], [F.col(returns)]], bucket, returns
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("m"), F.grouping_id().alias("g"))
    sets = sets.where(F.col("n") >= least)
    cells = df.select(bucket).distinct().crossJoin(df.select(returns).distinct())  # both are capped categories
    level = lambda g, k, name: F.broadcast(sets.where(F.col("g") == g).select(*k, F.col("m").alias(name)))
    out = cells.join(level(0, [bucket, returns], "m0"), [bucket, returns], "left").join(level(1, [bucket], "m1"), bucket, "left").join(level(2, [returns], "m2"), returns, "left")
    return out.select(bucket, returns, F.coalesce("m0", "m1", "m2", F.lit(0.0)).alias("expectation"))


def hit_scaling(df: DataFrame, bucket: str, hit: Column, full: int, least: int = 100) -> DataFrame:
    """Hit rate by minutes bucket relative to the full bucket; thin cells are 0, the full one 1."""
    by = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("rate"))
    base = by.where(F.col(bucket) == full).select(F.col("rate").alias("base"))
    rel = F.when(F.col(bucket) == full, 1.0).when(
        (F.col("n") < least) | F.col("base").isNull() | (F.col("base") == 0), 0.0
    ).otherwise(F.col("rate") / F.when(F.col("base") != 0, F.col("base")))
    return by.join(F.broadcast(base), how="left").select(bucket, "n", rel.alias("scale"))


def elo_probabilities(diff: Column, hfa: float, c: float, s: float) -> tuple[Column, Column, Column]:
    """Home, draw and away probabilities from a rating difference; the draw share narrows with the gap, all clipped and scaled."""
    gap = diff + hfa
    draw = F.greatest(F.least(c * F.exp(-F.pow(gap, 2) / (2 * s * s)), F.lit(0.6)), F.lit(LEAST_PROB))
    home = F.greatest(1 / (1 + F.pow(F.lit(10.0), -gap / 400)) - draw / 2, F.lit(LEAST_PROB))
    away = F.greatest(1 - home - draw, F.lit(LEAST_PROB))
    total = home + draw + away
    return tuple(F.when(diff.isNotNull(), p / total) for p in (home, draw, away))


def implied(home: Column, draw: Column, away: Column) -> tuple[Column, Column, Column]:
    """Probabilities that odds imply, scaled to sum to one."""
    total = 1 / home + 1 / draw + 1 / away
    return tuple(1 / x / total for x in (home, draw, away))


def outcome(home: Column, away: Column) -> Column:
    """0 home win, 1 draw, 2 away win (also where a score is missing)."""
    return F.when(home > away, 0).when(home == away, 1).otherwise(2)
