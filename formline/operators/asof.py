"""As-of and interval joins by tagged unions and ordered windows: one shuffle, no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.intervals import clipped_days

BUCKET_SECONDS = 30 * 86_400


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, right_ts: str, values: Sequence[str], exact: bool = True,
              tie: Sequence[str] = (), bucket_seconds: int | None = BUCKET_SECONDS) -> DataFrame:
    """Each left row with the latest right row of its keys at or before (``exact``) or before its time.

    The matched row is taken whole: its null values stay null.  Left rows with a null key or time get
    nulls.  ``tie`` orders right rows of one time, the last winning.  Keys are cut into time buckets:
    each bucket starts from the last right row of the buckets before it, which come from one small
    aggregate, so no key has to be sorted in one task.  Without ``bucket_seconds`` a key is sorted whole.
    """
    names = left.columns
    row = F.struct(*[F.col(right_ts).alias("_rts"), *values])
    own = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(ts).alias("_t"), F.lit(0 if not exact else 1).alias("_side"), F.struct(*names).alias("_left"),
                      F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_right"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(tie)])
    other = right.where(F.col(right_ts).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_ts).alias("_t"), F.lit(0 if exact else 1).alias("_side"),
                         F.lit(None).cast(own.schema["_left"].dataType).alias("_left"), row.alias("_right"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(tie)])
    part = [f"_k{i}" for i in range(len(keys))]
    both = own.unionByName(other).withColumn("_later", F.lit(1))
    order = ["_t", "_side", *[f"_o{i}" for i in range(len(tie))]]
    bucket = []
    if bucket_seconds:
        bucket = ["_b"]
        both = both.withColumn("_b", F.floor(F.unix_seconds(F.col("_t").cast("timestamp")) / bucket_seconds))
        ends = both.groupBy(*part, "_b").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct(*order))).alias("_right"))
        before = F.last("_right", ignorenulls=True).over(Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        firsts = ends.withColumn("_right", before).where("_right is not null").withColumn("_later", F.lit(0))  # what a bucket starts from
        both = both.unionByName(firsts, allowMissingColumns=True)
    w = Window.partitionBy(*part, *bucket).orderBy("_later", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_hit", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    known = F.col("_t").isNotNull()
    for p in part:
        known &= F.col(p).isNotNull()
    hit = F.when(known, F.col("_hit"))
    return out.select("_left.*", hit["_rts"].alias(f"{right_ts}_asof"), *[hit[v].alias(v) for v in values])


def with_age(joined: DataFrame, ts: str, asof_ts: str, out: str = "days", most: int = 1500, recent: int = 35) -> DataFrame:
    """Whole days since the matched row (at most ``most``) and whether within ``recent`` days (0.0 where unmatched)."""
    days = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(asof_ts).cast("timestamp"))) / 86_400_000_000)
    return joined.withColumn(out, F.when(days.isNotNull(), F.least(days, F.lit(most)))).withColumn(f"{out}_recent", F.coalesce((days <= recent).cast("double"), F.lit(0.0)))


def trailing_count(ts: str, keys: Sequence[str], days: int) -> Column:
    """Rows of the keys in [t - days, t)."""
    return F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(-days * 86_400_000_000, -1))


def days_since_last(ts: str, keys: Sequence[str], most: int = 60) -> Column:
    """Days, with their fraction, since the latest earlier row of the keys, at most ``most``; null without one."""
    w = Window.partitionBy(*keys).orderBy(F.unix_micros(ts)).rangeBetween(Window.unboundedPreceding, -1)
    return clipped_days(F.unix_micros(ts), F.max(F.unix_micros(ts)).over(w), most)
