"""Stationary bootstrap of return series and the quantiles of what it projects, as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stationary_paths(returns: DataFrame, horizon: int, sims: int = 2000, mean_block: int = 26, seed: int = 7) -> DataFrame:
    """(symbol, sim, step, r): blocks of geometric length from uniform starts, circular over each series.

    Chance comes from md5 of (symbol, sim, step, seed), so a rerun of a lost task draws the same path.
    """
    order = Window.partitionBy("symbol").orderBy("week")
    rows = returns.select("symbol", (F.row_number().over(order) - 1).alias("i"), "r")
    size = rows.groupBy("symbol").agg(F.count("*").alias("t"))
    steps = size.select("symbol", "t", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("step")
    )
    digest = F.md5(F.concat_ws("|", "symbol", "sim", "step", F.lit(seed)))
    a, b = (F.conv(F.substring(digest, k, 8), 16, 10).cast("long") for k in (1, 9))
    restart = (F.col("step") == 0) | (a * mean_block < F.lit(1 << 32))
    upto = Window.partitionBy("symbol", "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last(F.when(restart, b % F.col("t") - F.col("step")), ignorenulls=True).over(upto)
    picked = steps.select("symbol", "sim", "step", F.pmod(at + F.col("step"), "t").cast("int").alias("i"))
    return picked.join(rows, ["symbol", "i"]).select("symbol", "sim", "step", "r")


def project(returns: DataFrame, horizon: int = 520, sims: int = 2000, mean_block: int = 26, seed: int = 7, periods: int = 52) -> DataFrame:
    """Quantiles per symbol of the final multiple, its annual rate and the maximum drawdown, and the chance of a loss."""
    upto = Window.partitionBy("symbol", "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    eq = stationary_paths(returns, horizon, sims, mean_block, seed).withColumn("eq", F.product(1 + F.col("r")).over(upto))
    dd = eq.withColumn("dd", 1 - F.col("eq") / F.max("eq").over(upto))
    ends = dd.groupBy("symbol", "sim").agg(F.max_by("eq", "step").alias("multiple"), F.max("dd").alias("mdd"))
    ends = ends.withColumn("rate", F.pow("multiple", F.lit(periods / horizon)) - 1)

    def q(col, p, name):
        return F.round(F.percentile(col, F.lit(p)), 6).alias(name)

    return ends.groupBy("symbol").agg(
        *[q("multiple", p, f"multiple_p{n}") for p, n in ((0.05, 5), (0.5, 50), (0.95, 95))],
        *[q("rate", p, f"rate_p{n}") for p, n in ((0.05, 5), (0.5, 50), (0.95, 95))],
        *[q("mdd", p, f"mdd_p{n}") for p, n in ((0.5, 50), (0.95, 95), (0.99, 99))],
        F.round(F.avg((F.col("multiple") < 1).cast("int")), 6).alias("loss"),
    )
