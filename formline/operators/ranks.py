"""Ranks and quantiles inside groups of any size: large groups are cut into ranges of values, counts run along the ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.spread import BROADCAST_ROWS, null_safe_join
from formline.operators.windows import labelled
from formline.sources.staging import written

Names = Sequence[str]

#: Groups with more different values than this are cut; ranges of them hold about as many.
RUN_VALUES = 1_000_000
MOST_RANGES = 4096
#: Bounds of ranges are looked up in parts of so many, so that no row carries them all.
PART = 64
#: A value with more rows than this is joined by broadcast, so its rows stay where they are.
HOT_ROWS = 1_000_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where it is counted small; written tables only."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _below(edges: str, value: str) -> Column:
    """How many of an ascending array's values, at most ``PART``, are less: 0 without an array."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(PART.bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda i, h: F.when(F.get(F.col(edges), i + h - 1) < F.col(value), i + h).otherwise(i))


def ranges_of(df: DataFrame, edges: DataFrame, groups: Names, value: str, out: str) -> DataFrame:
    """Adds how many of its group's ``_edges`` (ascending, at most ``PART`` ** 2) a value is above: first by each ``PART``-th of them, then by those
    between two such."""
    starts = F.sequence(F.lit(0), F.size("_edges") - 1, F.lit(PART))
    some = edges.where(F.size("_edges") > 0)
    coarse = some.select(*groups, F.transform(starts, lambda i: F.get("_edges", i)).alias("_firsts"))
    fine = some.select(*groups, F.posexplode(F.transform(starts, lambda i: F.slice("_edges", i + 1, F.lit(PART)))).alias("_part", "_fine"))
    rows = null_safe_join(df, _small(coarse), groups).withColumn("_part", _below("_firsts", value) - 1).drop("_firsts")
    rows = null_safe_join(rows, _small(fine), [*groups, "_part"])
    return rows.withColumn(out, F.when(F.col("_part") >= 0, F.col("_part") * PART + _below("_fine", value)).otherwise(0)).drop("_part", "_fine")


def running_counts(df: DataFrame, groups: Names, value: str, run_values: int = RUN_VALUES) -> DataFrame:
    """(groups, value, n, before, all): each different non-null value of a group with its rows, those below it, and the group's.

    Rows are counted by value first.  A group with over ``run_values`` different ones is cut at approximate quantiles
    of them; each range sums by itself, and a table of ranges says what those before it hold.
    """
    counts = written(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")), "ranks-counts")
    sizes = counts.groupBy(*groups).agg(F.count(F.lit(1)).alias("_m"))
    large = written(sizes.where(F.col("_m") > run_values), "ranks-large")
    most = large.agg(F.max("_m")).first()[0]
    if most is None:
        whole = Window.partitionBy(*groups)
        before = F.coalesce(F.sum("n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumns({"before": before, "all": F.sum("n").over(whole)})
    ranges = min(MOST_RANGES, 2 * -(-most // run_values))
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    named = null_safe_join(counts, _small(large).withColumn("_large", F.lit(True)), groups, "inner")
    edges = written(named.groupBy(*groups).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, probs, F.lit(10 * ranges)))).alias("_edges")), "ranks-edges")
    cut = ranges_of(counts, edges, groups, value, "_run")
    totals = cut.groupBy(*groups, "_run").agg(F.sum("n").alias("_n"))
    along = Window.partitionBy(*groups).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*groups, "_run", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_carry"), F.sum("_n").over(Window.partitionBy(*groups)).alias("all"))
    inside = F.sum("n").over(Window.partitionBy(*groups, "_run").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    rows = null_safe_join(cut.withColumn("_inside", F.coalesce(inside, F.lit(0))), carry, [*groups, "_run"])
    return rows.select(*groups, value, "n", (F.col("_carry") + F.col("_inside")).alias("before"), "all")


def average_ranks(df: DataFrame, groups: Names, value: str, rank: str = "rank", size: str | None = None, run_values: int = RUN_VALUES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the ascending rank inside the group, ties at their mean place, and with ``size`` the group's rows with a value; null where the value is.

    Ranks come back by a join on the value; values with over ``hot_rows`` rows come by broadcast, only those with more where they are too many.
    """
    made = running_counts(df, groups, value, run_values)
    ranks = written(made.select(*groups, value, F.col("n").alias("_n"), (F.col("before") + (F.col("n") + 1) / 2).alias(rank), F.col("all").alias(size or "_all")), "ranks")
    while (hot := ranks.where(F.col("_n") > hot_rows)).count() > BROADCAST_ROWS:
        hot_rows *= 10
    keys, out = [*groups, value], [*df.columns, rank, *([size] if size else [])]
    if hot.isEmpty():
        return null_safe_join(df, ranks, keys).select(*out)
    of_hot = null_safe_join(df, F.broadcast(hot), keys)  # counted above
    rest = null_safe_join(of_hot.where(F.col("_n").isNull()).select(*df.columns), ranks.where(F.col("_n") <= hot_rows), keys)
    return of_hot.where(F.col("_n").isNotNull()).select(*out).unionByName(rest.select(*out))


def rating(df: DataFrame, groups: Names, value: str, out: str = "rating", run_values: int = RUN_VALUES) -> DataFrame:
    """Adds the label of the average rank over the group's size."""
    ranked = average_ranks(df, groups, value, "_rank", "_size", run_values)
    return ranked.withColumn(out, labelled(F.col("_rank") / F.col("_size"))).drop("_rank", "_size")


def capped(df: DataFrame, groups: Names, value: str, tie: Names, out: str = "place", most: int = 8, salts: int = 64) -> DataFrame:
    """Adds the place inside the group by value, largest first, ties in ``tie`` order (which tells its rows apart); at most ``most``, which nulls get too.

    Only the first ``most`` of a group have a place to look up: each of its salts names its own, and those meet.
    """
    order = [F.col(value).desc(), *tie]
    near = df.where(F.col(value).isNotNull()).select(*groups, value, *tie).withColumn("_salt", F.pmod(F.xxhash64(*tie), F.lit(salts)))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order))).where(F.col("_r") < most)
    first = near.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(out) < most)
    placed = null_safe_join(df, first.select(*groups, *tie, out), [*groups, *tie])
    return placed.withColumn(out, F.coalesce(out, F.lit(most)))


def quantiles(df: DataFrame, keys: Names, value: str, probs: Sequence[float], finish: int = 10_000, bins: int = 256) -> DataFrame:
    """(keys, q): the linear-interpolated quantiles of each group's non-null values as an array, exact for groups of any size.

    Groups of at most ``finish`` rows are done by themselves.  In the others every wanted place has a range of values, first the
    whole group's: a pass counts the rows in ``bins`` parts of each range, which is combined before the shuffle, and keeps the
    part that holds the place.  When the parts are down to ``finish`` rows or one value, what is left is sorted.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "quantiles-sizes")
    small = null_safe_join(rows, sizes.where(F.col("_n") <= finish).select(*keys, F.lit(True).alias("_in")), keys, "inner")
    done = small.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    large = sizes.where(F.col("_n") > finish)
    if large.isEmpty():
        return done
    at = lambda p, f: f(F.lit(float(p)) * (F.col("_n") - 1)).cast("long")
    places = F.array_distinct(F.array(*[at(p, f) for p in probs for f in (F.floor, F.ceil)]))
    state = written(large.select(*keys, F.explode(places).alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_m")), "quantiles-state")
    while not (open_ := state.where((F.col("_m") > finish) & (F.col("_lo") < F.col("_hi")))).isEmpty():
        ranges = open_.groupBy(*keys).agg(F.collect_list(F.struct("_k", "_lo", "_hi")).alias("_ranges"))  # a range for each wanted place
        ranges = written(ranges, "quantiles-ranges")
        inside = null_safe_join(rows, _small(ranges), keys, "inner")
        inside = inside.withColumn("_x", F.explode(F.filter("_ranges", lambda x: F.col("_v").between(x["_lo"], x["_hi"]))))
        part = F.least(F.floor((F.col("_v") - F.col("_x._lo")) / (F.col("_x._hi") - F.col("_x._lo")) * bins), F.lit(bins - 1))
        counts = inside.groupBy(*keys, F.col("_x._k").alias("_k"), part.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        along = Window.partitionBy(*keys, "_k").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
        counts = counts.withColumn("_b", F.coalesce(F.sum("_c").over(along), F.lit(0)))
        joined = null_safe_join(open_, counts, [*keys, "_k"], "inner").withColumn("_b", F.col("_b") + F.col("_below"))
        held = joined.where((F.col("_k") >= F.col("_b")) & (F.col("_k") < F.col("_b") + F.col("_c")))
        narrowed = held.select(*keys, "_k", F.col("_l").alias("_lo"), F.col("_h").alias("_hi"), F.col("_b").alias("_below"), F.col("_c").alias("_m"))
        state = written(state.where((F.col("_m") <= finish) | (F.col("_lo") >= F.col("_hi"))).unionByName(narrowed), "quantiles-state")
    left = written(state.where(F.col("_lo") < F.col("_hi")).groupBy(*keys).agg(F.collect_list(F.struct("_k", "_lo", "_hi", "_below")).alias("_ranges")), "quantiles-left")
    found = null_safe_join(rows, _small(left), keys, "inner").withColumn("_x", F.explode(F.filter("_ranges", lambda x: F.col("_v").between(x["_lo"], x["_hi"]))))
    found = found.groupBy(*keys, F.col("_x._k").alias("_k"), F.col("_x._below").alias("_below")).agg(F.array_sort(F.collect_list("_v")).alias("_vs"))  # at most ``finish`` values
    values = found.select(*keys, "_k", F.get("_vs", (F.col("_k") - F.col("_below")).cast("int")).alias("_v"))
    values = values.unionByName(state.where(F.col("_lo") >= F.col("_hi")).select(*keys, "_k", F.col("_lo").alias("_v")))
    by = null_safe_join(values, large.select(*keys, "_n"), keys, "inner").groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    low, high = (lambda p: F.element_at("_m", at(p, F.floor))), (lambda p: F.element_at("_m", at(p, F.ceil)))
    part = lambda p: F.lit(float(p)) * (F.col("_n") - 1) - at(p, F.floor)
    return done.unionByName(by.select(*keys, F.array(*[low(p) + (high(p) - low(p)) * part(p) for p in probs]).alias("q")))


def rank_correlation(df: DataFrame, keys: Names, a: str, b: str, run_values: int = RUN_VALUES) -> DataFrame:
    """(keys, rho): Spearman's correlation of two columns in each group, ties at mean ranks; groups with a constant side have none.

    Rows where one of the two is null are left out before ranking.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = average_ranks(average_ranks(both, keys, a, "_a", None, run_values), keys, b, "_b", None, run_values)
    spread: Column = F.stddev_pop("_a") * F.stddev_pop("_b")
    per = ranked.groupBy(*keys).agg(F.try_divide(F.covar_pop("_a", "_b"), F.when(spread > 0, spread)).alias("rho"))
    return per.where("rho is not null")
