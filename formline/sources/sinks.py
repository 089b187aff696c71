"""Keyed tables on Parquet: idempotent upserts, partial updates, versioned predictions, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.operators.clean import first_rows
from formline.sources import staging


def one_a_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the last in ``order``.  Without an order, rows of one key must be equal; else the job fails."""
    if order:
        return first_rows(rows, keys, order, last=True)
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    made = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_a"), F.max(F.struct(*rest)).alias("_z"))
    clash = F.raise_error(F.concat(F.lit("rows of one key differ and no order says which counts: "), F.to_json(F.struct(*keys))))
    sure = F.when(F.col("_a").eqNullSafe(F.col("_z")), F.col("_a")).otherwise(clash)
    return made.withColumn("_a", sure).select(*keys, "_a.*").select(*rows.columns)


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The target after inserting or updating by key: supplied columns win, supplied nulls too, others stay.

    Rows that supply keys only insert what is missing and change nothing else.  Of several rows of one
    key the last in ``order`` counts; without an order they must be equal.  One shuffle on the keys; running it
    again changes nothing.
    """
    rows = one_a_key(rows, keys, order)
    given = [c for c in rows.columns if c not in keys and c in target.columns]
    src = rows.select(*keys, F.lit(True).alias("_there"), *[F.col(c).alias(f"_s_{c}") for c in given])
    both = target.join(src, list(keys), "full_outer")
    pick = lambda c: F.when(F.col("_there"), F.col(f"_s_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c)
    return both.select(*[pick(c) if c in given else F.col(c) for c in target.columns])


def update(target: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Named columns overwritten for existing keys only; several rows of one key must be equal."""
    src = one_a_key(rows.select(*keys, *columns), keys).select(*keys, F.lit(True).alias("_there"), *[F.col(c).alias(f"_s_{c}") for c in columns])
    both = target.join(src, list(keys), "left")
    return both.select(*[F.when(F.col("_there"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def flip_current(df: DataFrame, key: str, current: object, flag: str = "is_current") -> DataFrame:
    return df.withColumn(flag, F.col(key) == F.lit(current))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows) of each table, one count each."""
    frames = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, t in tables.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Only the partitions that the rows touch are replaced; rows of a partition are written together."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


#: Parts of a key index; an upsert reads and writes those that its keys fall into.
INDEX_PARTS = 64
#: So many touched partitions are broadcast to the table's scan; more are joined by shuffle.
BROADCAST_PARTITIONS = 100_000


def _part_of(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(INDEX_PARTS)).cast("int").alias("_part")


def build_index(spark: SparkSession, path: str, keys: Sequence[str], by: Sequence[str]) -> str:
    """Writes the table's key index beside it: which partition each key is in, itself partitioned by the key's hash."""
    beside = path.rstrip("/") + "_index"
    write_partitioned(spark.read.parquet(path).select(*keys, *[F.col(c).alias(f"_in_{c}") for c in by], _part_of(keys)), beside, ["_part"])
    return beside


def _exists(spark: SparkSession, path: str):
    """(file system, path) of a folder, or None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return (fs, at) if fs.exists(at) else None


def upsert_table(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], by: Sequence[str], order: Sequence[str] = ()) -> None:
    """Upsert into a partitioned table on disk; reads and rewrites only partitions that the rows name or that their keys are in.

    An index beside the table says where a key is, so a row that moves to another partition leaves its old one.  The new
    partitions are staged first, so that the read does not meet its own write; then they replace the old ones, partitions
    without a row left go, and last the index follows.  A run that stopped anywhere can be run again: until the index
    is written it names the old place, and a key met twice by then is one row again.
    """
    table = spark.read.parquet(path)
    index_path = path.rstrip("/") + "_index"
    if not _exists(spark, index_path):
        build_index(spark, path, keys, by)
    rows = staging.staged(one_a_key(rows, keys, order), path)
    parts = [r[0] for r in rows.select(_part_of(keys)).distinct().collect()]  # at most INDEX_PARTS
    index = spark.read.parquet(index_path).where(F.col("_part").isin(parts))
    old = index.join(rows.select(*keys), list(keys), "left_semi").select(*[F.col(f"_in_{c}").alias(c) for c in by])
    named = [c for c in by if c in rows.columns]
    new = rows.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in by]).unionByName(old) if len(named) == len(by) else old
    touched = staging.staged(new.distinct(), path)
    hit = F.broadcast(touched) if touched.count() <= BROADCAST_PARTITIONS else touched
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    read = table.withColumn("_file", F.col("_metadata.file_path")).join(hit.select(*[F.col(c).alias(f"_t_{c}") for c in by]), same, "left_semi")
    merged = staging.staged(upsert(read.drop("_file").dropDuplicates(list(keys)), rows, keys), path)
    left = read.join(merged.select(*[F.col(c).alias(f"_t_{c}") for c in by]).distinct(), same, "left_anti")
    emptied = [r[0] for r in left.select(F.regexp_replace("_file", "/[^/]*$", "").alias("d")).distinct().collect()]  # at most as many as were touched
    write_partitioned(merged, path, by)
    for folder in emptied:
        if there := _exists(spark, unquote(folder)):
            there[0].delete(there[1], True)
    moved = merged.join(rows.select(*keys), list(keys), "left_semi").select(*keys, *[F.col(c).alias(f"_in_{c}") for c in by], _part_of(keys))
    kept = index.join(rows.select(*keys), list(keys), "left_anti")
    write_partitioned(staging.staged(kept.unionByName(moved), path), index_path, ["_part"])


def model_version(df: DataFrame, version: str) -> DataFrame:
    """The predictions of one version: rolling back is reading another."""
    return df.where(F.col("model_version") == version)


def drivers_json(components: Column, p_start: Column, p_cameo: Column, if_start: Column, gated: Column) -> Column:
    return F.to_json(F.struct(components.alias("components"), p_start.alias("p_start"), p_cameo.alias("p_cameo"), if_start.alias("expected_if_start"), gated.alias("gated")))
