"""Conforming raw columns: lenient parses, first-row deduplication, id mapping, season names, decay."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: the first in ``order`` (or the last)."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_r = 1").drop("_r")


def map_ids(df: DataFrame, column: str, mapping: DataFrame, source: str, target: str, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the stable code, one row with the number dropped)."""
    coded = df.join(mapping.select(F.col(source).alias(column), F.col(target).alias(out)), column, "left")
    return coded.where(F.col(out).isNotNull()), coded.agg(F.count_if(F.col(out).isNull()).alias("n_dropped"))


def conform(df: DataFrame, schema: StructType, renames: Mapping[str, str] = {}) -> DataFrame:
    """Projected onto the schema: renamed, leniently cast, missing columns as typed nulls, NaN as null."""
    have = {renames.get(c, c): c for c in df.columns}
    out = []
    for f in schema.fields:
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{have[f.name]}`").try_cast(f.dataType)
        if f.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def season_name(deadline: Column) -> Column:
    """'2026-27' from the first deadline's timestamp or text."""
    y = F.year(F.try_to_timestamp(deadline.cast("string")))
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def season_code(name: Column) -> Column:
    """'2122' from '2021-22'."""
    return F.concat(F.substring(name, 3, 2), F.substring(name, 6, 2))


def start_year(name: Column) -> Column:
    return F.substring(name, 1, 4).try_cast("int")


# Minutes that stand for progress levels 1 to 7 where only squad membership is known.
PROGRESS_MINUTES = (180.0, 270.0, 340.0, 420.0, 500.0, 580.0, 580.0)


def fading_load(minutes: Column, progress: Column, round_no: Column, first: int = 1, span: int = 8, there: Column | None = None,
                proxy: Sequence[float] = PROGRESS_MINUTES) -> tuple[Column, Column]:
    """(minutes, progress) of an earlier tournament, fading to nothing over ``span`` rounds from ``first``.

    A null or zero level counts as the first.  Null minutes stand by their level, levels out of range by the first.
    Rows that were not ``there``, and rows without a round, have 0 of both.
    """
    there = F.lit(True) if there is None else F.coalesce(there, F.lit(False))
    fade = F.when(there & (round_no >= first), F.greatest(F.lit(0.0), 1 - (round_no - first) / span)).otherwise(0.0)
    level = F.coalesce(F.nullif(progress, F.lit(0)), F.lit(1))
    place = F.when(level.between(1, len(proxy)), level.cast("int")).otherwise(1)
    stood = F.element_at(F.array(*[F.lit(float(p)) for p in proxy]), place)
    return F.coalesce(minutes, stood) * fade, level * fade


def age_years(at: Column, born: Column) -> Column:
    """Whole days lived over 365.25."""
    return F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(born.cast("timestamp"))) / 86_400_000_000) / 365.25
