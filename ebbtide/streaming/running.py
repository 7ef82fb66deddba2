"""Running drawdown of a stream by keyed state, equal to the window query over the same rows in any order of arrival."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "symbol string, id long, at timestamp, value double, peak double, dd double"
ROW = "symbol string, id long, at timestamp, value double"
PEAK, MARK = "symbol string, peak double", "mark long"


def running_drawdown(ticks: DataFrame, folder: str, late: str = "1 day"):
    """Append (symbol, id, at, value, peak, dd) of a stream (symbol, id, at timestamp, value) to `folder`/out.

    A row is final once the watermark, `late` behind the latest time met, has reached its time: until then it
    waits in the state, so the result does not depend on batches, only on times and, for equal times, ids. Rows
    that arrive at or behind the watermark are dropped. The state is the peaks of all symbols, the waiting rows
    and the watermark, as tables of each batch; a batch reads those of the one before and writes its own, so one
    that is repeated writes the same again, and all symbols of a batch are one join and one window. Rows without
    symbol, time or a finite value are left out; the drawdown from a peak of at most 0 is null. Call
    awaitTermination() on the result.
    """
    delay = int(pd.Timedelta(late) / pd.Timedelta(milliseconds=1))
    us = F.unix_micros("at")

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession

        def before(name: str, schema: str) -> DataFrame:
            return spark.read.schema(schema).parquet(f"{folder}/state/{name}/batch-{n - 1}") if n else spark.createDataFrame([], schema)

        def keep(rows: DataFrame, name: str) -> None:
            rows.write.mode("overwrite").parquet(f"{folder}/state/{name}/batch-{n}")

        old = before("mark", MARK).first()
        known = batch.where("symbol is not null and at is not null and value is not null and not isnan(value)")
        known = known.select("symbol", F.col("id").cast("long").alias("id"), "at", F.col("value").cast("double").alias("value"))
        last = known.agg(F.max(us)).first()[0]
        marks = ([old.mark] if old else []) + ([last // 1000 - delay] if last is not None else [])
        mark = max(marks, default=None)
        rows = before("waiting", ROW).unionByName(known.where(us > old.mark * 1000) if old else known)
        final = us <= mark * 1000 if marks else F.lit(False)
        upto = Window.partitionBy("symbol").orderBy(us, "id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        peaks = before("peaks", PEAK)
        top = rows.where(final).withColumn("top", F.max("value").over(upto)).join(peaks, "symbol", "left").withColumn("peak", F.greatest("top", "peak"))
        dd = F.when(F.col("peak") > 0, 1 - F.col("value") / F.col("peak"))
        out = f"{folder}/out/batch={n}"
        top.select("symbol", "id", "at", "value", "peak", dd.alias("dd")).write.mode("overwrite").parquet(out)
        new = spark.read.schema(OUT).parquet(out).select("symbol", "peak")
        keep(peaks.unionByName(new).groupBy("symbol").agg(F.max("peak").alias("peak")), "peaks")
        keep(rows.where(~final), "waiting")
        keep(spark.createDataFrame([(mark,)] if marks else [], MARK), "mark")

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def replay(batches: list[DataFrame], folder: str, late: str = "1 day") -> DataFrame:
    """Feed batches (symbol, id, at, value) to running_drawdown one after the other, from its checkpoint each time.

    After the last batch a row of no symbol's, far in the future, makes all rows final; it is never final itself.
    """
    spark = batches[0].sparkSession
    end = spark.createDataFrame([("", -1, 0.0)], "symbol string, id long, value double").select("symbol", "id", F.timestamp_seconds(F.lit(1 << 33)).alias("at"), "value")
    for rows in [*batches, end]:
        rows.select("symbol", "id", "at", "value").write.mode("append").parquet(f"{folder}/in")
        running_drawdown(spark.readStream.schema(ROW).parquet(f"{folder}/in"), folder, late).awaitTermination()
    return spark.read.schema(f"{OUT}, batch int").parquet(f"{folder}/out").drop("batch")
