"""Batches of contracts in one plan: a contract that fails gives one row that says why, and leaves the others as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .series import between_weeks, drawdowns, equity_metrics, rounded


FEW_SYMBOLS = 2000


def _weighted(menus: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, week, r): sums of the returns of each menu [(symbol, w)] with weights scaled to one, named by its `first`."""
    total = F.aggregate("menu", F.lit(0.0), lambda s, x: s + x["w"])
    lines = menus.select(F.col("first").alias("of"), total.alias("total"), F.explode("menu").alias("x"))
    lines = lines.select("of", F.col("x.symbol").alias("symbol"), (F.col("x.w") / F.col("total")).alias("share"))
    pair = F.collect_list(F.struct("week", "r")).alias("p")
    series = settled(returns.groupBy("symbol").agg(pair).select("symbol", F.col("p.week").alias("weeks"), F.col("p.r").alias("rs")), "contract-series")
    if series.count() <= FEW_SYMBOLS:
        each = lines.repartition("of").join(F.broadcast(series), "symbol")
    else:
        each = lines.join(series, "symbol").repartition("of")
    each = each.select(F.col("of").alias("symbol"), "share", F.explode(F.arrays_zip("weeks", "rs")).alias("x"))
    return each.groupBy("symbol", F.col("x.weeks").alias("week")).agg(F.sum(F.col("share") * F.col("x.rs")).alias("r"))


def measured(contracts: DataFrame, menu: DataFrame, prices: DataFrame, least_funds: int = 2, least_weeks: int = 8) -> DataFrame:
    """(contract, ok, error, funds, cagr, vol, max_dd) of contracts (contract), lines (contract, symbol, weight text) and prices (symbol, date, price text).

    The first of these that holds is the error: no menu; a weight that is no positive number; fewer than
    `least_funds` lines with prices; a price that is no positive number; fewer than `least_weeks` weekly
    returns; otherwise the metrics are those of the weighted sum of the lines' returns, weights scaled to one.
    A contract listed twice is one. Bad lines and prices become nulls by try_ expressions, so nothing raises.

    Contracts with the same lines and weights are measured once. Weeks travel as arrays, one a symbol (some
    thousand weeks at most), to the tasks of the menus that hold it; no row of a contract and week is shuffled.
    """
    lines = menu.select("contract", "symbol", F.col("weight").try_cast("double").alias("w"))
    lines = lines.withColumn("bad", F.col("w").isNull() | F.isnan("w") | (F.col("w") <= 0))
    px = prices.select("symbol", "date", F.col("price").try_cast("double").alias("price"))
    px = px.withColumn("bad", F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0))
    week = F.next_day(F.date_sub("date", 1), "FRI").alias("week")
    weeks = px.join(lines.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol", week).agg(
        F.max_by(F.when(~F.col("bad"), F.col("price")), F.when(~F.col("bad"), F.col("date"))).alias("price"), F.max("bad").alias("bad")
    )
    weeks = settled(weeks, "contract-weeks")
    seen = weeks.groupBy("symbol").agg(F.max("bad").alias("bad_price"))
    state = lines.join(seen, "symbol", "left").groupBy("contract").agg(
        F.count("*").alias("lines"), F.max("bad").alias("bad_weight"), F.count("bad_price").alias("funds"), F.max(F.coalesce("bad_price", F.lit(False))).alias("bad_price")
    )
    early = (
        F.when(F.col("lines").isNull(), "no menu").when(F.col("bad_weight"), "bad weight")
        .when(F.col("funds") < least_funds, "too few funds").when(F.col("bad_price"), "bad price")
    )
    every = contracts.select("contract").distinct().join(state, "contract", "left")
    every = settled(every.select("contract", F.coalesce("funds", F.lit(0)).alias("funds"), early.alias("error")), "contract-states")
    # Only contracts and symbols without an error go on, so a bad price harms none but those that hold it.
    fine = lines.join(every.where("error is null").select("contract"), "contract", "left_semi")
    held = fine.join(seen.select("symbol"), "symbol", "left_semi")
    menus = held.groupBy("contract").agg(F.array_sort(F.collect_list(F.struct("symbol", "w"))).alias("menu"))
    menus = settled(menus.join(menus.groupBy("menu").agg(F.min("contract").alias("first")), "menu"), "contract-menus")
    sums = _weighted(menus.where("contract = first"), between_weeks(weeks.where("price is not null").select("symbol", "week", "price")))
    found = drawdowns(sums).groupBy("symbol").agg(F.count("*").alias("weeks"), *equity_metrics())
    metrics = menus.select("contract", "first").join(
        found.select(F.col("symbol").alias("first"), "weeks", *[rounded(F.col(c), 4).alias(c) for c in ("cagr", "vol", "max_dd")]), "first"
    )
    out = every.join(metrics.drop("first"), "contract", "left")
    short = F.coalesce("weeks", F.lit(0)) < least_weeks
    error = F.coalesce("error", F.when(short, F.lit("too few weeks")))
    shown = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return out.withColumn("error", error).select("contract", F.col("error").isNull().alias("ok"), "error", "funds", shown("cagr"), shown("vol"), shown("max_dd"))
