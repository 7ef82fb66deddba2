"""Price, FX and candidate relations read from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, price): mean order value per priority and day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("price")
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, price): mean item price per supplier and day, a wide panel with gaps."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").cast("date").alias("date")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("price")
    )
