"""Top-k, pruning, pivots, diffs, row filters and row-wise top values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "place") -> DataFrame:
    """The first ``n`` rows of each key; the engine prunes each task's rows before they meet."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


def sort_nulls_last(df: DataFrame, column: str, descending: bool, tie: Sequence[str], limit: int | None = None) -> DataFrame:
    """Sorted by a column with nulls last in both directions."""
    c = F.col(column)
    out = df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *tie)
    return out.limit(limit) if limit else out


def prune(df: DataFrame, group: str, total: str, peak: str, cost: str, tie: str, widths: tuple[int, int, int]) -> DataFrame:
    """Per group the union of the best by total, the best by peak and the cheapest: three places, one filter."""
    w = Window.partitionBy(group)
    places = [F.row_number().over(w.orderBy(o, tie)) for o in (F.col(total).desc(), F.col(peak).desc(), F.col(cost).asc())]
    marked = df.select("*", *[p.alias(f"_p{i}") for i, p in enumerate(places)])
    return marked.where(reduce(lambda a, b: a | b, [F.col(f"_p{i}") <= n for i, n in enumerate(widths)])).drop("_p0", "_p1", "_p2")


def spread(df: DataFrame, keys: Sequence[str], slot: str, value: str, slots: Sequence) -> DataFrame:
    """One row per keys with a column per slot (0 where missing), their sum and their largest."""
    wide = df.groupBy(*keys).pivot(slot, list(slots)).agg(F.sum(value)).fillna(0.0)
    cols = [F.col(f"`{s}`") for s in slots]
    return wide.withColumns({"total": reduce(lambda a, b: a + b, cols), "peak": F.greatest(*cols) if len(cols) > 1 else cols[0]})


def changes(df: DataFrame, owner: str, week: str, member: str, starts: str) -> DataFrame:
    """(owner, week, member, change) between consecutive weeks: in, out, promoted, demoted.

    Both sides are keyed by (owner, week, member), so it is one full join of the table with itself a week on.
    """
    now = df.select(owner, week, member, F.col(starts).alias("_now"))
    before = df.select(owner, (F.col(week) + 1).alias(week), member, F.col(starts).alias("_was"))
    weeks = df.select(owner, week).distinct()
    both = now.join(before, [owner, week, member], "full_outer").join(weeks, [owner, week], "left_semi")
    first = Window.partitionBy(owner)
    kind = F.when(F.col("_was").isNull(), "in").when(F.col("_now").isNull(), "out").when(F.col("_now") & ~F.col("_was"), "promoted").when(~F.col("_now") & F.col("_was"), "demoted")
    return both.withColumn("_first", F.min(week).over(first)).where(F.col(week) > F.col("_first")).select(owner, week, member, kind.alias("change")).where("change is not null")


def row_filter(
    df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]] = {}, sets: Mapping[str, Sequence] = {}, search: str | None = None,
    over: Sequence[str] = ()
) -> DataFrame:
    """Stacked predicates: membership, minimum and maximum bounds (null fails a bound), and a case-blind search."""
    conditions = [F.col(c).isin(list(v)) for c, v in sets.items() if v]
    for c, (low, high) in bounds.items():
        conditions += [F.col(c) >= low] * (low is not None) + [F.col(c) <= high] * (high is not None)
    if search:
        conditions.append(F.lower(F.concat_ws(" ", *over)).contains(search.lower()))
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def top_values(columns: Sequence[str], n: int, least: float = 0.01) -> Column:
    """The row's n largest named values by size, those at or under ``least`` dropped: an array of (name, value)."""
    named = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in columns])
    kept = F.filter(named, lambda x: F.abs(x["value"]) > least)
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct((-F.abs(x["value"])).alias("o"), x["name"].alias("name"), x["value"].alias("value"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
