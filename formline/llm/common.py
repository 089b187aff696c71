"""Shared by the operators: narrow inputs, bounded Arrow batches, tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Stands for a null id inside the operators: smaller than every real id.
NULL_ID = 1 - 2**63


def narrow(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, both without nulls, whatever else the input has."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def real_id(name: str = "doc_id") -> F.Column:
    """The id as it was given: null again where ``narrow`` filled it."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str, rows: int = 256) -> DataFrame:
    """Apply ``fn`` to column lists of at most ``rows`` rows at a time.

    Texts have no length limit, so what a task holds is bounded by slicing what Arrow hands over.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    names, kinds = df.columns, to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                if out and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return df.mapInArrow(run, schema)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, a temporary one in local mode and an error elsewhere."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-formline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, with no lineage behind it."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unique_ids(docs: DataFrame) -> DataFrame:
    """The narrow input, with ids renumbered in the order of (id, text) where an id has several texts; other columns stay.

    The new ids count the rows of a range-partitioned, written sort, so an id with very many texts is spread too.
    """
    several = docs.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b")
    if several.isEmpty():
        return docs.withColumn("given_id", F.col("doc_id"))
    same = {"_h": F.xxhash64("text"), "_n": F.length("text")}
    order = docs.select("doc_id", "text").distinct().repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    keys = written(order.select(F.col("doc_id").alias("given_id"), *[c.alias(n) for n, c in same.items()], F.monotonically_increasing_id().alias("doc_id")), "ids")
    found = docs.withColumnRenamed("doc_id", "given_id").withColumns(same).join(keys, ["given_id", "_h", "_n"])
    return found.select("doc_id", "text", "given_id", *[c for c in docs.columns if c not in ("doc_id", "text")])


def keep_freed_memory() -> None:
    """Lets this process keep what it frees, some 62 MB, for its next arrays.

    The C library hands large arrays back at once and raises its bound for that to the largest one freed, 32 MB at most.
    Fresh pages from the system for each array of a few MB cost more than the arithmetic on it.
    """
    np.empty(31 << 20, np.uint8)


def commonest(table: DataFrame, most: int) -> list[tuple]:
    """(key, c) of the rows with the largest counts, at most ``most``: all from the least count that keeps to it."""
    by = table.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(most).collect()  # each count has a row at least
    cut, held = None, 0
    for r in by:
        held += r.n
        if held > most:
            break
        cut = r.c
    return [] if cut is None else [tuple(r) for r in table.where(F.col("c") >= cut).select(table.columns[0], "c").collect()]


class Cache(dict):
    """A dict that fills itself by ``make``; at ``limit`` keys it ages, and what is not asked for again while it refills is forgotten."""

    def __init__(self, make: Callable, limit: int = 400_000) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
