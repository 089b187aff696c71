"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

Every document gets a uniform number from a hash of seed and id, and that number is put through
the inverse of a Poisson distribution whose mean is its source's repetition rate (target share
of the output over the source's share of the input).  The count is a pure function of the row,
so a task that runs again repeats it; copies then go to random places by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import written

#: So many sources' rates are at most a few megabytes.
BROADCAST_SOURCES = 100_000
SALTS = 64
#: A source of a higher rate has its documents' copies made by several tasks.
MANY_COPIES = 10_000


def uniform(seed: str, *parts: Column) -> Column:
    """In (0, 1), from 48 bits of an MD5 over seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long").cast("double") + 0.5) / float(2**48)


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k whose cumulative Poisson probability reaches ``u``.

    The sum runs over mean -/+ (12 * sqrt(mean) + 40), outside which the tails are below any u's distance to 0
    and 1, so what a row holds grows with the square root of its mean.  Terms are held as logarithms: exp(-mean)
    itself is 0 in double precision from a mean of about 745.  A sum that starts above 0 takes its first term from
    Stirling's series, which is exact to double precision at the 50 or more where that happens.
    """
    reach = 12 * F.sqrt(mean) + 40
    low = F.floor(mean - reach).cast("long")
    first = F.when(low < 50, F.lit(0)).otherwise(low)
    series = first * F.log(mean / first) + (first - mean) - F.log(2 * math.pi * first) / 2 - 1 / (12 * first) + 1 / (360 * F.pow(first.cast("double"), 3))
    log_p = F.when(low < 50, -mean).otherwise(series)
    state = F.struct(log_p.alias("log_p"), F.exp(log_p).alias("c"), first.alias("k"))
    step = lambda s, j: F.when(u <= s["c"], s).otherwise(
        F.struct((s["log_p"] + F.log(mean / j)).alias("log_p"), (s["c"] + F.exp(s["log_p"] + F.log(mean / j))).alias("c"), j.alias("k"))
    )
    return F.aggregate(F.sequence(first + 1, F.ceil(mean + reach).cast("long")), state, step, lambda s: s["k"])


def copies(counted: DataFrame, spread_by: Column | None = None) -> DataFrame:
    """Each row once for every ``mix_copy`` from 1 to ``mix_count``, none where the count is 0.

    A row becomes blocks and a block copies, each as many as the root of the count, so no array is longer than that.
    With ``spread_by`` the blocks of a row are dealt over tasks before copies are made.
    """
    side = F.ceil(F.sqrt("mix_count"))
    n_blocks = F.when(F.col("mix_count") > 0, F.ceil(F.col("mix_count") / side)).otherwise(0).cast("int")
    blocks = counted.select("*", F.posexplode(F.array_repeat(F.lit(1), n_blocks)).alias("block", "one"))
    if spread_by is not None:
        blocks = blocks.repartition(spread_by, F.col("block"))
    held = F.least(side, F.col("mix_count") - F.col("block") * side).cast("int")
    out = blocks.drop("one").select("*", F.posexplode(F.array_repeat(F.lit(1), held)).alias("before", "one"))
    return out.withColumn("mix_copy", F.col("block") * side + F.col("before") + 1)


def rates(df: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source", other_weight: float = 1.0) -> DataFrame:
    """Per source: ``mix_source``, ``n_docs``, ``rate``.

    ``weights`` are relative target shares by source; a source that they don't name, the null one
    included, gets ``other_weight``, so a source leaves only where 0 is stated for it (None: every
    source the same; an empty dict states no target, and the mix is empty);
    ``total`` is the wanted number of output documents (None: as many as the input has).
    A null source is a source of its own, named ''.
    """
    counts = df.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        weight = F.coalesce(F.try_element_at(table, F.col("mix_source")), F.lit(float(other_weight)))
    else:
        weight = F.lit(0.0)
    sums = counts.withColumn("w", weight).groupBy().agg(F.sum("w").alias("w_all"), F.sum("n_docs").alias("n_all"))
    wanted = F.col("n_all").cast("double") if total is None else F.lit(float(total))
    share = F.when(F.col("w_all") > 0, weight / F.when(F.col("w_all") > 0, F.col("w_all"))).otherwise(0.0)
    return counts.crossJoin(F.broadcast(sums)).select("mix_source", "n_docs", (share * wanted / F.col("n_docs")).alias("rate"))  # sums is one row


def mix(df: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = "mix",
        id_col: str = "doc_id", source_col: str = "source", shuffle: bool = True, other_weight: float = 1.0) -> DataFrame:
    """Every input column plus ``mix_rate``, ``mix_count``, ``mix_copy`` (1..count) and ``mix_key`` (place in the global order).

    Inside, input columns go by number, so no name of theirs can clash; an input column with one of
    the four added names is replaced.  Documents with count 0 leave.  Repeated rows have equal ids and
    so equal counts.  The rates, one row per source, are written and counted: up to BROADCAST_SOURCES
    they are broadcast and no text moves for the join; more are joined by (source, salt), so that a hot
    source is dealt over SALTS tasks.  Sources with a rate above MANY_COPIES take a branch of their own, in
    which several tasks make the copies of one document; without such sources the plan has no such branch.
    """
    by = written(rates(df, weights, total, source_col, other_weight), "rates").select("mix_source", F.col("rate").alias("mix_rate"))
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])
    doc, source = (F.col(f"c{names.index(c)}") for c in (id_col, source_col))
    named = F.coalesce(source.cast("string"), F.lit(""))
    n_sources, most = by.agg(F.count(F.lit(1)), F.max("mix_rate")).first()

    def counted(part: DataFrame) -> DataFrame:
        if n_sources <= BROADCAST_SOURCES:
            joined = rows.join(F.broadcast(part), named == F.col("mix_source"))
        else:
            salted = part.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = rows.join(salted, (named == F.col("mix_source")) & (F.pmod(F.xxhash64(doc), F.lit(SALTS)).cast("int") == F.col("salt")))
        return joined.withColumn("mix_count", poisson_inverse(uniform(seed, doc), F.col("mix_rate")))

    if most is None or most <= MANY_COPIES:
        out = copies(counted(by))
    else:
        many = F.col("mix_rate") > MANY_COPIES
        out = copies(counted(by.where(~many))).unionByName(copies(counted(by.where(many)), doc))
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed + "-order"), F.coalesce(doc.cast("string"), F.lit("~")), F.col("mix_copy").cast("string"))))
    out = out.orderBy("mix_key", doc, "mix_copy") if shuffle else out
    added = ("mix_rate", "mix_count", "mix_copy", "mix_key")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in added], *added)
