"""Streams: upserts as the body of foreachBatch, and windowed totals with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from formline.sources.sinks import upsert_table


def upsert_stream(stream: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is upserted; as upserts are idempotent, a batch that runs again changes nothing."""

    def body(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            upsert_table(batch.sparkSession, path, batch, keys, by, order)

    return stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_totals(events: DataFrame, ts: str, keys: Sequence[str], value: str, window: str, late: str) -> DataFrame:
    """Sum and count per time window and keys, rows later than ``late`` left out; works on streams and tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "total", "n")
