"""Backfilled histories: real returns spliced behind returns reconstructed from a proxy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fitted(fund: DataFrame, proxy: DataFrame, least: int = 8, smoothed: bool = False) -> DataFrame:
    """(symbol, proxy, start, points, n, beta, alpha, resid, r2, confidence, level) of funds (symbol, proxy, week, r).

    beta is the sample covariance over the population variance, the residual spread a population one; without
    a fit the spread is the fund's own. `smoothed` funds (expert values) are trusted less.
    """
    start = fund.groupBy("symbol", "proxy").agg(F.min("week").alias("start"), F.count("r").alias("points"))
    j = fund.join(proxy, ["proxy", "week"])
    s = j.groupBy("symbol").agg(
        F.count("*").alias("n"), F.covar_samp("r", "p").alias("c"), F.var_pop("p").alias("v"), F.var_pop("r").alias("vr"),
        F.covar_pop("r", "p").alias("cp"), F.avg("r").alias("mr"), F.avg("p").alias("mp"),
    )
    ok = F.coalesce((F.col("n") >= least) & (F.col("v") > 0), F.lit(False))
    beta = F.when(ok, F.col("c") / F.col("v")).otherwise(1.0)
    out = start.join(s, "symbol", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("beta", beta)
    out = out.withColumn("alpha", F.when(ok, F.col("mr") - F.col("beta") * F.col("mp")).otherwise(0.0))
    # Sums of squares about the fit, by moments: the fit passes through the means.
    left = F.greatest(F.lit(0.0), F.col("vr") - 2 * F.col("beta") * F.col("cp") + F.col("beta") * F.col("beta") * F.col("v"))
    out = out.withColumn("resid", F.when(ok, F.sqrt(left)).otherwise(F.coalesce(F.sqrt("vr"), F.lit(0.0))))
    out = out.withColumn("r2", F.when(ok & (F.col("vr") > 0), 1 - left / F.col("vr")).otherwise(0.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "r2")) * F.col("n") / (F.col("n") + 6) * (0.6 if smoothed else 1.0)
    level = F.when(score > 0.5, "data").when(score > 0.2, "mixed").otherwise("prior")
    return out.select("symbol", "proxy", "start", "points", "n", "beta", "alpha", "resid", "r2", F.round(100 * score).cast("int").alias("confidence"), level.alias("level"))


def spliced(fund: DataFrame, proxy: DataFrame, annual_fee: float = 0.0, periods: int = 52, least: int = 8) -> DataFrame:
    """(symbol, week, r, real): reconstructed before a fund's first week, its own returns from then on.

    The fit is net of fees, so they cancel; with few common weeks it is the proxy itself. A fund with
    fewer than `least` points is reconstructed throughout: the proxy less the period's fee.
    """
    fee = (1.0 + annual_fee) ** (1.0 / periods) - 1.0 if annual_fee else 0.0
    fit = fitted(fund, proxy, least)
    short = F.col("points") < least
    deep = proxy.join(fit, "proxy").where(short | (F.col("week") < F.col("start"))).select(
        "symbol", "week", F.when(short, F.col("p") - fee).otherwise(F.col("alpha") + F.col("beta") * F.col("p")).alias("r"), F.lit(False).alias("real")
    )
    known = fit.where(~short).select("symbol")
    return deep.unionByName(fund.join(known, "symbol", "left_semi").select("symbol", "week", "r", F.lit(True).alias("real")))


def levelled(proxy: DataFrame, realised: DataFrame, annual_fee: float = 0.0, periods: int = 52) -> DataFrame:
    """(symbol, week, r): the proxy of each fund (symbol, proxy, annual) moved to the net yearly return it is known to have had.

    A fund of unknown return follows the proxy less the period's fee.
    """
    fee = (1.0 + annual_fee) ** (1.0 / periods) - 1.0 if annual_fee else 0.0
    mean = proxy.groupBy("proxy").agg(F.avg("p").alias("mean"))
    shift = F.when(F.col("annual").isNotNull(), F.pow(1 + F.col("annual"), F.lit(1.0 / periods)) - 1 - F.col("mean")).otherwise(-fee)
    return proxy.join(realised.join(mean, "proxy"), "proxy").select("symbol", "week", (F.col("p") + shift).alias("r"))


def basket(factors: DataFrame, weights: DataFrame, fee: float = 0.0, realised: DataFrame | None = None, periods: int = 52) -> DataFrame:
    """(fund, week, r): weighted sum of the factors present in each week, less the period fee.

    A fund in `realised` (fund, annual) is moved so that its mean after the fee is that of its net yearly return.
    """
    raw = factors.join(weights, "symbol").groupBy("fund", "week").agg(F.sum(F.col("r") * F.col("w")).alias("r"))
    if realised is None:
        return raw.withColumn("r", F.col("r") - fee)
    shift = F.pow(1 + F.col("annual"), F.lit(1.0 / periods)) - 1 - F.col("mean")
    moved = raw.groupBy("fund").agg(F.avg("r").alias("mean")).join(realised, "fund", "left").select("fund", F.coalesce(shift, F.lit(-fee)).alias("shift"))
    return raw.join(moved, "fund").select("fund", "week", (F.col("r") + F.col("shift")).alias("r"))
