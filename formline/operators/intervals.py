"""Counts of another table's rows in trailing intervals, by differences of running counts: no range join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.spread import null_safe_join

MICROS = 86_400_000_000
BUCKET_SECONDS = 30 * 86_400


def clipped_days(later: Column, earlier: Column, most: float) -> Column:
    """Days with their fraction between two times in microseconds, from 0 to ``most``; null where one is null."""
    days = (later - earlier) / F.lit(float(MICROS))
    return F.when(days.isNotNull(), F.greatest(F.least(days, F.lit(float(most))), F.lit(0.0)))


def trailing_counts(left: DataFrame, right: DataFrame, keys: Sequence[str], row: Sequence[str], ts: str, right_ts: str, days: Mapping[str, float], since: str | None = None,
                    most: float = 60, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Adds to each left row, per name of ``days``, the number of right rows of its keys in [t - days, t), and as ``since`` the
    days, with their fraction and at most ``most``, since the latest of them before t.

    ``row`` names left columns that tell its rows apart.  A key that the right side lacks, a null key and a null time give
    nulls; a key that has right rows, but none before t, gives counts of 0 and a null ``since``.  Right rows without a time
    or a key are left out.

    Each left row asks how many right rows lie before t and before t - d, and the differences are the counts.  Rows
    are numbered inside buckets of time, and a table with a row per (key, bucket) says what the buckets before
    them hold; so a key with very many rows is spread over its buckets.
    """
    part = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(p) for k, p in zip(keys, part, strict=True)]
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    probe = F.array(F.struct(F.lit(0).alias("q"), micros(ts).alias("t")), *[F.struct(F.lit(i + 1).alias("q"), (micros(ts) - int(d * MICROS)).alias("t")) for i, d in enumerate(days.values())])
    asked = left.where(known & F.col(ts).isNotNull()).select(*named, *[F.col(c).alias(f"_row_{c}") for c in row], F.explode(probe).alias("p"))
    asked = asked.select(*part, *[f"_row_{c}" for c in row], "p.q", "p.t", F.lit(0).alias("_is"))
    seen = right.where(known & F.col(right_ts).isNotNull()).select(*named, micros(right_ts).alias("t"), F.lit(1).alias("_is"))
    both = seen.unionByName(asked, allowMissingColumns=True).withColumn("_b", F.floor(F.col("t") / (bucket_seconds * 1_000_000)))
    before = Window.partitionBy(*part, "_b").orderBy("t", "_is").rowsBetween(Window.unboundedPreceding, -1)  # at one time, questions come first
    hit = F.when(F.col("_is") == 1, F.col("t"))
    inside = both.withColumns({"_n": F.coalesce(F.sum("_is").over(before), F.lit(0)), "_last": F.max(hit).over(before)}).where("_is = 0")
    totals = both.groupBy(*part, "_b").agg(F.sum("_is").alias("_m"), F.max(hit).alias("_end"))
    earlier = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    carry = totals.select(*part, "_b", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_c"), F.max("_end").over(earlier).alias("_cend"), F.sum("_m").over(whole).alias("_all"))
    numbered = inside.join(carry, [*part, "_b"])
    at = lambda i: F.max(F.when(F.col("q") == i, F.col("_n") + F.col("_c")))
    got = numbered.groupBy(*[f"_row_{c}" for c in row]).agg(
        *[F.when(F.max("_all") > 0, at(0) - at(i + 1)).alias(n) for i, n in enumerate(days)], F.max(F.when(F.col("q") == 0, F.coalesce("_last", "_cend"))).alias("_before"),
    )
    made = null_safe_join(left, got.withColumnsRenamed({f"_row_{c}": c for c in row}), row)
    if since:
        made = made.withColumn(since, clipped_days(micros(ts), F.col("_before"), most))
    return made.drop("_before")
