"""Incremental price sync: a stream of price rows merged by (symbol, date), later arrivals winning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import VersionedPrices


def sync(stream: DataFrame, target: str, checkpoint: str):
    """Merge every micro-batch of (symbol, date, price, ord) into the versioned table at `target`.

    Batch k is merge k + 1: it rewrites the months of its rows and no others, and a repeated batch rewrites
    the same files. Call awaitTermination() on the result.
    """

    def merge(batch: DataFrame, n: int) -> None:
        VersionedPrices(batch.sparkSession, target).merge(batch, n + 1)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_extremes(ticks: DataFrame, late: str = "7 days") -> DataFrame:
    """(symbol, week, high, low, n) of a stream (symbol, ts, price), in weeks that end on Fridays, with a watermark."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", "7 days", startTime="2 days").alias("w"))
        .agg(F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n"))
        .select("symbol", F.date_sub(F.col("w.end").cast("date"), 1).alias("week"), "high", "low", "n")
    )
