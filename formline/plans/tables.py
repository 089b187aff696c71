"""The given tables in the roles that the library's operators know, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: CTEs that queries' SQL starts from.
FACT_SQL = """f AS (SELECT event_id, ts, user_id AS entity, event_type AS kind, value AS points,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS minutes, date_trunc('day', ts) AS round FROM events)"""
YEARLY_SQL = """fy AS (SELECT o_orderkey AS id, o_custkey AS entity, year(o_orderdate) AS year, o_totalprice * 1.00037 AS points, o_orderpriority AS grp,
  (o_orderkey % 91)::INTEGER AS minutes, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice * 0.0010037 END AS stat,
  CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1 WHEN o_totalprice < 300000 THEN 2 ELSE 3 END AS bucket FROM orders)"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` may start with {f} or {fy} for the shared CTEs."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE_SQL[key] = sql.replace("{f}", FACT_SQL).replace("{fy}", YEARLY_SQL)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the fact: entity, time, points, exposure minutes, kind, round (day)."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity"), F.col("event_type").alias("kind"), F.col("value").alias("points"),
        F.get_json_object("props", "$.k").cast("int").alias("minutes"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("round"),
    )


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a fact over years, with a statistic that some rows lack."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), (price * 1.00037).alias("points"), F.col("o_orderpriority").alias("grp"),
        (F.col("o_orderkey") % 91).cast("int").alias("minutes"), F.when(F.col("o_orderkey") % 5 != 0, price * 0.0010037).alias("stat"),
        F.when(price < 100000, 0).when(price < 200000, 1).when(price < 300000, 2).otherwise(3).alias("bucket"),
    )


def r6(c) -> F.Column:
    """Rounded to six places, so that two engines' sums compare."""
    return F.round(c, 6)
