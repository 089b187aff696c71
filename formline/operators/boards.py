"""Rows that a reader asks for first: one wide row per entity, latest and last seasons, first choices, shares and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.ranking import top_n
from formline.operators.windows import recency

Names = Sequence[str]


def values_text(values: Column, of: str) -> Column:
    """The named field of an array of structs as text, parted by semicolons."""
    return F.array_join(F.transform(values, lambda x: x[of].cast("string")), ";")


def player_board(df: DataFrame, entity: str, order: Names, round_key: str, points: str, minutes: str, opponent: str, coming: Column, form_rows: int = 5,
                 recent_rows: int = 10, next_rows: int = 3, least: float = 200, started: float = 60) -> DataFrame:
    """(entity, form, recent, day_points, day_min, starts, next_kinds, next_diff): one wide row per entity.

    Form is the mean of the last ``form_rows`` rows, null under ``least`` minutes; ``recent`` the last values in order; the day's
    sums are those of the entity's latest round; the next opponents and their mean come from the first ``next_rows`` rows
    where ``coming`` holds, null where there are none.  One window and one aggregate serve everything but the last two.
    """
    ranked = df.withColumns({"_rn": recency([entity], order), "_last": F.max(round_key).over(Window.partitionBy(entity))})
    close, own = F.col("_rn") <= form_rows, F.col(round_key) == F.col("_last")
    kept = F.when(F.col("_rn") <= recent_rows, F.struct((-F.col("_rn")).alias("_o"), F.col(points).alias("points")))
    per = ranked.groupBy(entity).agg(
        F.avg(F.when(close, F.col(points))).alias("form"), F.sum(F.when(close, F.col(minutes))).alias("_min"), F.array_sort(F.collect_list(kept)).alias("_r"),  # at most recent_rows
        F.sum(F.when(own, F.col(points))).alias("day_points"), F.sum(F.when(own, F.col(minutes))).alias("day_min"), F.count_if(own & (F.col(minutes) >= started)).alias("starts"),
    )
    following = next_opponents(df.where(coming), entity, order, opponent, minutes, next_rows)
    made = per.join(following, entity, "left")
    return made.select(entity, F.when(F.col("_min") >= least, F.col("form")).alias("form"), values_text(F.col("_r"), "points").alias("recent"), "day_points", "day_min", "starts", "next_kinds", "next_diff")


def next_opponents(coming: DataFrame, entity: str, order: Names, opponent: str, difficulty: str, rows: int = 3) -> DataFrame:
    """(entity, next_kinds, next_diff): the first rows' opponents in order as text, and their mean difficulty to four places."""
    first = top_n(coming, [entity], [F.col(c) for c in order], rows, "_k")
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(opponent).alias("o")))), lambda x: x["o"]), ", ")
    return first.groupBy(entity).agg(named.alias("next_kinds"), F.round(F.avg(difficulty), 4).alias("next_diff"))


def recent_values(df: DataFrame, entity: str, order: Names, value: str, rows: int = 10) -> DataFrame:
    """(entity, recent): the last values in chronological order as an array of structs."""
    last = df.withColumn("_rn", recency([entity], order)).where(F.col("_rn") <= rows)
    return last.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("_o"), value))).alias("recent"))


def latest_season(df: DataFrame, key: str, season: str, sums: Names) -> DataFrame:
    """(key, season, n, sums): each key's latest season with its rows and totals; seasons are summed before one is picked."""
    by = df.groupBy(key, season).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return by.groupBy(key).agg(F.max(season).alias(season), *[F.max_by(c, season).alias(c) for c in ["n", *sums]])


def last_completed(df: DataFrame, key: str, season: str, sums: Names) -> DataFrame:
    """(key, n, sums) of the season before the table's latest one."""
    last = df.agg((F.max(season) - 1).alias("_y"))
    return df.join(F.broadcast(last), F.col(season) == F.col("_y")).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])  # one row


def first_choice(df: DataFrame, group: str, member: str, weight: str, value: str, per: float = 90.0) -> DataFrame:
    """(group, member, rate): each group's member of most weight, ties to the smaller, with its value per ``per`` units of weight (at least 1)."""
    by = df.groupBy(group, member).agg(F.sum(weight).alias("_w"), (F.sum(value) / F.greatest(F.sum(weight), F.lit(1)) * per).alias("rate"))
    return top_n(by, [group], [F.desc("_w"), F.col(member)], 1).select(group, member, "rate")


def class_shares(df: DataFrame, flag: str, label: str) -> DataFrame:
    """(flag, label, n, share): rows of each label and their share within the flag."""
    n = df.groupBy(flag, label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(flag)))


def round_rollup(df: DataFrame, keys: Names, order: Names, sums: Names = (), most: Names = (), means: Names = (), first: Names = ()) -> DataFrame:
    """One row per keys where a round has several games: sums, maxima (``top_``), means (``mean_``) and the first game's values (``first_``)."""
    made = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(f"top_{c}") for c in most] + [F.avg(c).alias(f"mean_{c}") for c in means]
    return df.groupBy(*keys).agg(*made, *[F.min_by(c, F.struct(*order)).alias(f"first_{c}") for c in first])


def component_sums(df: DataFrame, keys: Names, component: str, value: str, names: Names) -> DataFrame:
    """A column per named component with its sum, 0 where there is none."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(component) == n, F.col(value)).otherwise(0.0)).alias(n) for n in names])


def pool_report(df: DataFrame, round_key: str, entity: str) -> DataFrame:
    """One row: different rounds, the first of them, rows, and different entities."""
    return df.agg(F.count_distinct(round_key).alias("rounds"), F.min(round_key).alias("first_round"), F.count(F.lit(1)).alias("n"), F.count_distinct(entity).alias("pool"))


def strength_ranking(df: DataFrame, key: str, attack: Column, defence: Column) -> DataFrame:
    """(key, attack, defence, total) by total, ties to the smaller key."""
    return df.select(key, attack.alias("attack"), defence.alias("defence"), (attack + defence).alias("total")).orderBy(F.desc("total"), key)


def ordered_history(df: DataFrame, key: str, order: Names, out: str = "place") -> DataFrame:
    """Adds each row's place in its key's order, from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
