"""Ordered windows over keys of any size.

A window puts all rows of a key into one task.  Here the rows of a key with more than ``run_rows`` rows are
cut along their time into runs of about that many, which are windows of their own:

* bounded frames (``bounded``): each run gets copies of the last rows before it, its halo, as many as the
  frames look back, so every frame is whole; the copies go when the columns are made;
* cumulative frames (``running``): each run sums by itself, and what earlier runs sum to comes from
  a table with one row a run.

Which keys are cut is found by counting rows by key and time bucket, which is combined before the
shuffle.  Where no key is large nothing is cut, copied or joined, and the plan is the plain window's.
``order`` starts with the time column, and should end in a unique one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.sources.staging import written

Names = Sequence[str]

RUN_ROWS = 1_000_000
#: Keys are cut at bounds of such buckets; a bucket is never cut itself.
BUCKET_SECONDS = 3600
#: Tables with one row a run or a bucket are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Cut:
    """A frame with its rows' run in ``_run`` (0 where the key is whole) and whether the key was cut in ``_cut``."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    any: bool
    small: bool

    @property
    def part(self) -> list[str]:
        return [*self.keys, "_run"]

    def window(self) -> Window:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def with_table(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Left join with a table of one row a run; null keys are keys like others."""
        return null_safe_join(rows, F.broadcast(table) if self.small else table, self.part)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Names, how: str = "left") -> DataFrame:
    """Join on equal keys, where null equals null; the right side's keys go."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def cut(df: DataFrame, keys: Names, order: Names, run_rows: int = RUN_ROWS, bucket_seconds: int = BUCKET_SECONDS) -> Cut:
    """The rows with their runs: one small aggregate decides, and only keys over ``run_rows`` rows are joined with it."""
    bucket = F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / bucket_seconds)
    counts = df.select(*keys, bucket.alias("_b")).groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    large = counts.withColumns({"_before": before, "_all": F.sum("_n").over(whole)}).where(F.col("_all") > run_rows)
    runs = written(large.select(*keys, "_b", F.floor(F.col("_before") / run_rows).alias("_run")), "spread-runs")
    n = runs.count()
    if not n:
        return Cut(df.withColumns({"_run": F.lit(0).cast("long"), "_cut": F.lit(False)}), tuple(keys), tuple(order), False, True)
    small = n <= BROADCAST_ROWS
    named = runs.withColumn("_cut", F.lit(True))
    rows = null_safe_join(df.withColumn("_b", bucket), F.broadcast(named) if small else named, [*keys, "_b"])
    rows = rows.withColumns({"_run": F.coalesce("_run", F.lit(0)), "_cut": F.coalesce("_cut", F.lit(False))}).drop("_b")
    return Cut(rows, tuple(keys), tuple(order), True, small)


def bounded(df: DataFrame, keys: Names, order: Names, rows: int, build: Callable[[list[str], list[str]], Mapping[str, Column]], run_rows: int = RUN_ROWS,
            bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds ``build(keys, order)``: window columns by these keys whose frames look back at most ``rows`` rows.

    ``build`` gets the keys to part by, the run's among them.  A first row of a key is a first row still, since only
    a key's first run has no halo.  Rows with a null time come first, as in a plain window.
    """
    c = cut(df, keys, order, run_rows, bucket_seconds)
    if not c.any:
        return df.withColumns(build(list(keys), list(order)))
    sizes = c.rows.where("_cut").groupBy(*c.part).agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_run").rowsBetween(1, rows)  # every run has a row at least
    later = sizes.withColumn("_later", F.collect_list(F.struct("_run", "_n")).over(ahead))
    gaps = F.expr("transform(_later, (x, i) -> struct(x._run AS run, aggregate(slice(_later, 1, i), 0L, (s, y) -> s + y._n) AS gap))")
    later = later.select(*c.part, gaps.alias("_later"))
    last_first = Window.partitionBy(*c.part).orderBy(*[F.col(o).desc() for o in order])
    tails = c.rows.where("_cut").withColumn("_t", F.row_number().over(last_first)).where(F.col("_t") <= rows)
    copies = c.with_table(tails, later).withColumn("_to", F.explode(F.filter("_later", lambda x: x["gap"] + F.col("_t") <= rows)))
    copies = copies.withColumn("_run", F.col("_to.run")).drop("_t", "_later", "_to").withColumn("_halo", F.lit(True))
    both = c.rows.withColumn("_halo", F.lit(False)).unionByName(copies)
    return both.withColumns(build(c.part, list(order))).where(~F.col("_halo")).drop("_run", "_cut", "_halo")


def running(df: DataFrame, keys: Names, order: Names, sums: Mapping[str, Column], last: Mapping[str, Column] | None = None, place: str = "_place",
            left: str | None = None, run_rows: int = RUN_ROWS, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds, of each key's earlier rows: the sum of every column of ``sums`` (null where none has a value), the value of every
    column of ``last`` in the row just before, and their number as ``place``; with ``left`` the number of later rows too.
    """
    last = last or {}
    c = cut(df, keys, order, run_rows, bucket_seconds)
    w = c.window()
    frame = w.rowsBetween(Window.unboundedPreceding, -1)
    made = {n: F.sum(v).over(frame) for n, v in sums.items()} | {n: F.lag(v).over(w) for n, v in last.items()}
    made |= {place: (F.row_number().over(w) - 1).cast("long")}
    if left:
        made |= {left: F.count(F.lit(1)).over(w.rowsBetween(1, Window.unboundedFollowing))}
    rows = c.rows.withColumns(made)
    if not c.any:
        return rows.drop("_run", "_cut")
    ends = F.max_by(F.struct(F.lit(True).alias("_there"), *[v.alias(n) for n, v in last.items()]), F.struct(*order))
    totals = c.rows.where("_cut").groupBy(*c.part).agg(*[F.sum(v).alias(n) for n, v in sums.items()], F.count(F.lit(1)).alias("_n"), ends.alias("_end"))
    by = Window.partitionBy(*keys).orderBy("_run")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *c.part, *[F.sum(n).over(earlier).alias(f"_sum_{n}") for n in sums], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before_n"),
        F.lag("_end").over(by).alias("_before_end"), F.coalesce(F.sum("_n").over(by.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_after_n"),
    )
    rows = c.with_table(rows, carry)
    plus = lambda n: F.when(F.col(n).isNull(), F.col(f"_sum_{n}")).otherwise(F.col(n) + F.coalesce(F.col(f"_sum_{n}"), F.lit(0)))
    out = {n: plus(n) for n in sums} | {n: F.when((F.col(place) == 0) & F.col("_cut"), F.col(f"_before_end.{n}")).otherwise(F.col(n)) for n in last}
    out |= {place: F.col(place) + F.coalesce("_before_n", F.lit(0))}
    if left:
        out |= {left: F.col(left) + F.coalesce("_after_n", F.lit(0))}
    return rows.withColumns(out).drop("_run", "_cut", "_before_n", "_before_end", "_after_n", *[f"_sum_{n}" for n in sums])


def season_to_date(df: DataFrame, value: Column, keys: Names, order: Names, out: str, **cuts: int) -> DataFrame:
    """Adds the mean of earlier rows per row so far; null where the row just before has no value."""
    rows = running(df, keys, order, {"_s": value}, {"_l": value}, **cuts)
    return rows.withColumn(out, F.when(F.col("_l").isNotNull(), F.col("_s") / F.col("_place"))).drop("_s", "_l", "_place")


def rate_to_date(df: DataFrame, value: Column, exposure: Column, keys: Names, order: Names, out: str, seen: str, per: float = 90.0, **cuts: int) -> DataFrame:
    """Adds the rate per exposure over earlier rows that recorded the value (null without any) and that exposure."""
    rows = running(df, keys, order, {"_s": value, "_e": F.when(value.isNotNull(), exposure)}, **cuts)
    e = F.coalesce("_e", F.lit(0))
    return rows.withColumns({seen: e, out: F.when(e > 0, F.col("_s") / F.when(e > 0, e) * per)}).drop("_s", "_e", "_place")


def total_to_date(df: DataFrame, value: Column, keys: Names, order: Names, out: str, **cuts: int) -> DataFrame:
    """Adds the sum over earlier rows, 0 at the first."""
    return running(df, keys, order, {"_s": value}, **cuts).withColumn(out, F.coalesce("_s", F.lit(0))).drop("_s", "_place")


def expanding(df: DataFrame, value: Column, keys: Names, order: Names, mean: str, count: str, **cuts: int) -> DataFrame:
    """Adds the mean and count of all earlier values."""
    rows = running(df, keys, order, {"_s": value, "_k": value.isNotNull().cast("long")}, **cuts)
    n = F.coalesce("_k", F.lit(0))
    return rows.withColumns({count: n, mean: F.when(n > 0, F.col("_s") / F.when(n > 0, n))}).drop("_s", "_k", "_place")


def recency(df: DataFrame, keys: Names, order: Names, out: str, **cuts: int) -> DataFrame:
    """Adds 1 for the latest row of the keys, 2 for the one before, and so on."""
    return running(df, keys, order, {}, left="_left", **cuts).withColumn(out, (F.col("_left") + 1).cast("long")).drop("_left", "_place")


def lagged_ewma(df: DataFrame, value: Column, keys: Names, order: Names, half_lives: Mapping[str, float], **cuts: int) -> DataFrame:
    """Adds, per name, the exponentially weighted mean of earlier rows by half-life, nulls weighing nothing but ageing the rest.

    Rows are numbered along the key, and every 64 half-lives make a segment that is a window of its own.  What a
    segment starts from comes from a table of segments: the weighted sums of the last two that hold a value, faded
    by their distance; anything further back weighs under 2 ** -64 of that.
    """
    made = running(df.withColumn("_x", value.cast("double")), keys, order, {}, place="_i", **cuts)
    for name, half_life in half_lives.items():
        size = max(int(64 * half_life), 1)
        weight = F.when(F.col("_x").isNotNull(), F.pow(F.lit(2.0), (F.col("_i") % size) / half_life))
        made = made.withColumns({"_g": F.floor(F.col("_i") / size), "_w": weight})
        inside = Window.partitionBy(*keys, "_g").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        segments = made.groupBy(*keys, "_g").agg(F.sum(F.col("_x") * F.col("_w")).alias("s"), F.sum("_w").alias("n"))
        earlier = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
        fade = lambda c: F.pow(F.lit(2.0), (F.col(f"{c}._g") - F.col("_g")) * F.lit(size / half_life))
        segments = segments.withColumn("_p", F.last(F.when(F.col("n") > 0, F.struct("_g", "s", "n")), ignorenulls=True).over(earlier))
        both = F.struct("_g", *[(F.col(d) + zero(F.col(f"_p.{d}") * fade("_p"))).alias(d) for d in "sn"])
        segments = segments.withColumn("_c", F.last(F.when(F.col("n") > 0, both), ignorenulls=True).over(earlier)).select(*keys, "_g", "_c")
        made = made.withColumns({"_s": zero(F.sum(F.col("_x") * F.col("_w")).over(inside)), "_n": zero(F.sum("_w").over(inside))})
        made = null_safe_join(made, segments, [*keys, "_g"])
        alone = F.when(F.col("_n") > 0, fade("_c")).otherwise(1.0)  # where nothing else counts the scale cancels
        s, n = F.col("_s") + zero(F.col("_c.s") * alone), F.col("_n") + zero(F.col("_c.n") * alone)
        made = made.withColumn(name, F.when(n > 0, s / F.when(n > 0, n))).drop("_g", "_w", "_s", "_n", "_c")
    return made.drop("_x", "_i")
