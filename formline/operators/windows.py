"""Per-entity ordered windows: rolling form, decay, season-to-date values, flags and ranks.

One partitioning and one sort by (keys; order) serve every column that these add.  ``order`` should
end in a unique column, so that results do not depend on how ties fall.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = Sequence[str]


def over(keys: Names, order: Names) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def rolling(value: Column, keys: Names, order: Names, rows: int, how: str = "avg", min_obs: int = 1, lagged: bool = True) -> Column:
    """``how`` over the last ``rows`` rows, nulls counting as rows; null below ``min_obs`` non-null values."""
    frame = over(keys, order).rowsBetween(-rows, -1) if lagged else over(keys, order).rowsBetween(1 - rows, 0)
    made = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how](value).over(frame)
    return F.when(F.count(value).over(frame) >= min_obs, made)


def rolling_rate(value: Column, exposure: Column, keys: Names, order: Names, rows: int, per: float = 90.0, lagged: bool = True) -> Column:
    """sum(value) per ``per`` units of summed exposure (at least 1) over the last rows; null where either is all null."""
    frame = over(keys, order).rowsBetween(-rows, -1) if lagged else over(keys, order).rowsBetween(1 - rows, 0)
    total = F.sum(exposure).over(frame)
    return F.when(total.isNotNull(), F.sum(value).over(frame) / F.greatest(total, F.lit(1)) * per)


def with_lagged_ewma(df: DataFrame, value: Column, keys: Names, order: Names, half_lives: dict[str, float]) -> DataFrame:
    """Adds, per name, the exponentially weighted mean of earlier rows by half-life; nulls weigh nothing but still age what is before them.

    A series is cut into segments of 64 half-lives, inside which 2 ** (place / half-life) stays in double
    precision: prefix sums give numerator and denominator, and the last two earlier segments with any value
    are carried in, faded by their distance.  What is further back weighs under 2 ** -64 of that and vanishes.
    All windows of a half-life are by the keys: one shuffle, and no row looks at more than running sums.
    """
    made = df.withColumns({"_x": value.cast("double"), "_i": F.row_number().over(over(keys, order)) - 1})
    for name, half_life in half_lives.items():
        size = max(int(64 * half_life), 1)
        segment, place = F.floor(F.col("_i") / size), F.col("_i") % size
        weight = F.when(F.col("_x").isNotNull(), F.pow(F.lit(2.0), place / half_life))
        made = made.withColumns({"_g": segment, "_w": weight})
        inside = Window.partitionBy(*keys, "_g").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys, "_g").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        made = made.withColumns({
            "_s": zero(F.sum(F.col("_x") * F.col("_w")).over(inside)), "_n": zero(F.sum("_w").over(inside)),
            "_t": F.when(F.sum("_w").over(whole) > 0, F.struct("_g", F.sum(F.col("_x") * F.col("_w")).over(whole).alias("s"), F.sum("_w").over(whole).alias("n"))),
        })
        earlier = Window.partitionBy(*keys).orderBy("_g").rangeBetween(Window.unboundedPreceding, -1)
        fade = F.pow(F.lit(2.0), (F.col("_c._g") - F.col("_g")) * F.lit(size / half_life))
        with_carried = lambda c, d, f: c + F.coalesce(F.col(f"_c.{d}") * f, F.lit(0.0))
        made = made.withColumn("_c", F.last("_t", ignorenulls=True).over(earlier))
        both = F.struct("_g", *[with_carried(F.col(f"_t.{d}"), d, fade).alias(d) for d in "sn"])  # a segment may hold values at its start only
        made = made.withColumn("_t", F.when(F.col("_t").isNotNull(), both)).withColumn("_c", F.last("_t", ignorenulls=True).over(earlier))
        alone = F.when(F.col("_n") > 0, fade).otherwise(1.0)  # where nothing else counts the scale cancels
        s, n = with_carried(F.col("_s"), "s", alone), with_carried(F.col("_n"), "n", alone)
        made = made.withColumn(name, F.when(n > 0, s / F.when(n > 0, n))).drop("_g", "_w", "_s", "_n", "_t", "_c")
    return made.drop("_x", "_i")


def season_to_date(value: Column, keys: Names, order: Names) -> Column:
    """Mean of earlier rows per row so far; null where the row just before has no value."""
    w = over(keys, order)
    return F.when(F.lag(value).over(w).isNotNull(), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)) / (F.row_number().over(w) - 1))


def rate_to_date(value: Column, exposure: Column, keys: Names, order: Names, per: float = 90.0) -> tuple[Column, Column]:
    """(rate, exposure) over earlier rows that recorded the value; the rate is null without exposure."""
    frame = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(value.isNotNull(), exposure)).over(frame), F.lit(0))
    return F.when(seen > 0, F.sum(value).over(frame) / F.when(seen > 0, seen) * per), seen


def total_to_date(value: Column, keys: Names, order: Names) -> Column:
    """Sum over earlier rows, 0 at the first."""
    return F.coalesce(F.sum(value).over(over(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def changed(value: Column, keys: Names, order: Names) -> Column:
    """1.0 where the value differs from the row before, and on the first row."""
    before = F.lag(value).over(over(keys, order))
    return F.coalesce((before != value).cast("double"), F.when(F.row_number().over(over(keys, order)) == 1, 1.0).otherwise(0.0))


def lagged_flag(condition: Column, keys: Names, order: Names) -> Column:
    """The row before's condition as 0/1; 0.0 where it is null or there is none."""
    return F.coalesce(F.lag(condition.cast("double")).over(over(keys, order)), F.lit(0.0))


def expanding(value: Column, keys: Names, order: Names) -> tuple[Column, Column]:
    """(mean, count) of all earlier rows of the keys."""
    frame = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.avg(value).over(frame), F.count(value).over(frame)


def rest_days(ts: Column, keys: Names, order: Names, most: int = 60) -> Column:
    """Whole days of 24 hours since the row before, at most ``most``; null on the first row."""
    before = F.lag(ts).over(over(keys, order))
    days = F.floor((F.unix_micros(ts) - F.unix_micros(before)) / 86_400_000_000)
    return F.when(days.isNotNull(), F.greatest(F.least(days, F.lit(most)), F.lit(0)))


def recency(keys: Names, order: Names) -> Column:
    """1 for the latest row of the keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))


def capped_rank(value: str, keys: Names, tie: Names, most: int = 8) -> Column:
    """Place within the keys by value, largest first, ties in ``tie`` order; at most ``most``, which nulls get too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), *tie))
    return F.when(F.col(value).isNull(), F.lit(most)).otherwise(F.least(place, F.lit(most)))


def average_rank(value: str, keys: Names) -> Column:
    """Ascending rank with ties at their mean place."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def rating(value: str, keys: Names, labels: Sequence[tuple[float, str]] = ((0.90, "excellent"), (0.65, "good"), (0.35, "average")), lowest: str = "poor") -> Column:
    """Label by average rank over group size."""
    return labelled(average_rank(value, keys) / F.count(F.lit(1)).over(Window.partitionBy(*keys)), labels, lowest)


def _spread(df: DataFrame, value: str, parts: int) -> DataFrame:
    """Adds ``_b``, the number of about evenly spaced approximate quantiles below the value: a range partition without a sort."""
    probs = F.array(*[F.lit(i / parts) for i in range(1, max(parts, 2))])
    edges = df.agg(F.array_distinct(F.percentile_approx(value, probs, F.lit(1000))).alias("_edges"))
    below = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(value))), F.lit(0))
    return df.crossJoin(F.broadcast(edges)).withColumn("_b", below).drop("_edges")  # one row


def _running(counts: DataFrame, value: str, parts: int) -> DataFrame:
    """(value, n, before): rows before each distinct value, from counts by value; ranges sum by themselves, their totals are a short table."""
    ranged = _spread(counts, value, parts)
    totals = ranged.groupBy("_b").agg(F.sum("n").alias("_n"))  # at most ``parts`` rows
    starts = totals.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.sum("n").over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(starts), "_b").select(value, "n", (F.col("_start") + F.col("_inside")).alias("before"))


def rank_share(df: DataFrame, value: str, out: str = "share", parts: int = 64) -> DataFrame:
    """Adds the average rank of the value over the number of rows with one, over the whole table; null stays null.

    Ranges of values are ranked beside each other, so no task sorts the table.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    every = df.agg(F.count(value).alias("_all"))
    share = _running(counts, value, parts).crossJoin(F.broadcast(every)).select(value, ((F.col("before") + (F.col("n") + 1) / 2) / F.col("_all")).alias(out))  # one row
    return df.join(share, value, "left").select(*df.columns, out)


def labelled(share: Column, labels: Sequence[tuple[float, str]] = ((0.90, "excellent"), (0.65, "good"), (0.35, "average")), lowest: str = "poor") -> Column:
    """The label of the highest bound that the share reaches."""
    out = F.lit(lowest)
    for bound, label in reversed(labels):
        out = F.when(share >= bound, F.lit(label)).otherwise(out)
    return out


def quantile_edges(df: DataFrame, value: str, probs: Sequence[float], parts: int = 64) -> DataFrame:
    """One row: the distinct linear-interpolated quantiles of a column, ascending; nulls are left out.

    Exact: rows are counted by value, the counts run along ranges of values, and only the values at the
    quantiles' places (two for each) come together.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    place = lambda p: F.lit(float(p)) * (F.col("_all") - 1)
    wanted = F.array(*[f(place(p)) for p in probs for f in (F.floor, F.ceil)])
    rows = _running(counts, "v", parts).crossJoin(F.broadcast(every.withColumn("_at", wanted)))  # one row
    hit = F.filter("_at", lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    found = rows.select("v", "_all", F.explode(F.array_distinct(hit)).alias("k")).agg(
        F.max("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")
    )  # two places for each quantile
    at = lambda p: F.try_element_at("m", F.floor(place(p))) + (
        F.try_element_at("m", F.ceil(place(p))) - F.try_element_at("m", F.floor(place(p)))
    ) * (place(p) - F.floor(place(p)))
    return found.select(F.array_distinct(F.array_compact(F.array(*[at(p) for p in probs]))).alias("edges"))


def quantile_buckets(df: DataFrame, value: str, probs: Sequence[float], out: str = "bucket") -> DataFrame:
    """The number of distinct quantile edges at or below each value."""
    joined = df.crossJoin(F.broadcast(quantile_edges(df, value, probs)))  # one row
    return joined.withColumn(out, F.size(F.filter("edges", lambda e: e <= F.col(value)))).drop("edges")
