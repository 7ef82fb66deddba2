"""Time-series operators on long relations (symbol, date, price) and (symbol, week, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_history(prices: DataFrame, least: int) -> DataFrame:
    enough = prices.groupBy("symbol").count().where(F.col("count") >= least).select("symbol")
    return prices.join(enough, "symbol", "left_semi")


def history_depth(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(
        F.count("*").alias("points"), F.min("date").alias("start"), F.max("date").alias("end")
    ).withColumn("years", F.round(F.datediff("end", "start") / 365.25, 1))


def common_window(prices: DataFrame) -> DataFrame:
    """Dates on which every symbol has a price."""
    n = prices.agg(F.countDistinct("symbol").alias("all"))
    full = prices.groupBy("date").agg(F.countDistinct("symbol").alias("n")).join(F.broadcast(n), F.col("n") == F.col("all"))
    return prices.join(full.select("date"), "date", "left_semi")


def weekly_last(prices: DataFrame) -> DataFrame:
    """Last price of each week that ends on a Friday."""
    week = F.next_day(F.date_sub("date", 1), "FRI")
    return prices.groupBy("symbol", week.alias("week")).agg(F.max_by("price", "date").alias("price"))


def weekly_returns(prices: DataFrame, over_gaps: bool = True) -> DataFrame:
    """Simple returns between kept weeks; without over_gaps only between neighbouring weeks."""
    return between_weeks(weekly_last(prices), over_gaps)


def between_weeks(weeks: DataFrame, over_gaps: bool = True) -> DataFrame:
    """Returns (symbol, week, r) of weekly prices (symbol, week, price)."""
    w = Window.partitionBy("symbol").orderBy("week")
    out = weeks.select(
        "symbol", "week", F.lag("week").over(w).alias("before"), F.try_divide(F.col("price"), F.lag("price").over(w)).alias("q")
    ).where("q is not null")
    if not over_gaps:
        out = out.where(F.datediff("week", "before") == 7)
    return out.select("symbol", "week", (F.col("q") - 1).alias("r"))


def drawdowns(returns: DataFrame) -> DataFrame:
    """Equity from 1, its running peak (from the first period on) and positive drawdown; after a total loss from the start it is null."""
    upto = Window.partitionBy("symbol").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    eq = returns.withColumn("equity", F.product(1 + F.col("r")).over(upto))
    return eq.withColumn("peak", F.max("equity").over(upto)).withColumn("dd", 1 - F.try_divide("equity", "peak"))


def rounded(x: Column, digits: int) -> Column:
    """Rounded, with the sign of a small negative number kept in -0.0."""
    y = F.round(x, digits)
    return F.when((y == 0) & (x < 0), F.lit(-0.0)).otherwise(y)


def equity_metrics(periods: int = 52) -> list[Column]:
    """Unrounded CAGR, volatility and maximum drawdown of rows of drawdowns(), as aggregates."""
    total = F.max_by("equity", "week")
    return [
        F.when(total > 0, F.pow(total, F.lit(float(periods)) / F.count("*")) - 1).alias("cagr"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))).alias("vol"),
        F.max("dd").alias("max_dd"),
    ]


def summary(returns: DataFrame, alpha: float = 0.95, periods: int = 52) -> DataFrame:
    """CAGR, volatility, Sharpe, maximum drawdown, CDaR and Calmar per symbol."""
    dd = drawdowns(returns)
    tail = dd.groupBy("symbol").agg(F.percentile("dd", F.lit(alpha)).alias("cut"))
    base = dd.join(tail, "symbol").groupBy("symbol").agg(*equity_metrics(periods), F.avg(F.when(F.col("dd") >= F.col("cut"), F.col("dd"))).alias("cdar"))
    return base.select(
        "symbol", rounded(F.col("cagr"), 4).alias("cagr"), F.round("vol", 4).alias("vol"),
        rounded(F.try_divide(F.col("cagr"), F.nullif(F.col("vol"), F.lit(0.0))), 3).alias("sharpe"),
        F.round("max_dd", 4).alias("max_dd"), F.round("cdar", 4).alias("cdar"),
        rounded(F.when(F.col("max_dd") > 1e-9, F.col("cagr") / F.col("max_dd")), 3).alias("calmar"),
    )


def covariance(returns: DataFrame, block: int = 256) -> DataFrame:
    """(x, y, cov, corr) of every pair of symbols with common weeks; the correlation with a constant series is null.

    Symbols are dealt into blocks by hash, `block` weeks of one block at most meet in a task: rows are
    joined by (block of x, block of y, week), so no week with many symbols stands alone.
    """
    n = F.greatest(F.lit(1), F.ceil(F.count("*") / block))
    size = returns.select("symbol").distinct().agg(n.cast("int").alias("blocks"))
    rows = returns.join(F.broadcast(size)).withColumn("at", F.pmod(F.xxhash64("symbol"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = rows.select("symbol", "week", "r", F.col("at").alias("i"), F.explode(every).alias("j")).alias("a")
    b = rows.select("symbol", "week", "r", F.explode(every).alias("i"), F.col("at").alias("j")).alias("b")
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & (F.col("a.week") == F.col("b.week"))
    scale = F.stddev_pop("a.r") * F.stddev_pop("b.r")
    return a.join(b, same).where("a.symbol <= b.symbol").groupBy(F.col("a.symbol").alias("x"), F.col("b.symbol").alias("y")).agg(
        F.covar_samp("a.r", "b.r").alias("cov"), F.try_divide(F.covar_pop("a.r", "b.r"), F.nullif(scale, F.lit(0.0))).alias("corr")
    )


def means(returns: DataFrame) -> DataFrame:
    return returns.groupBy("symbol").agg(F.avg("r").alias("mu"))


def summed_drawdowns(returns: DataFrame) -> DataFrame:
    """(symbol, week, cum, dd): sums of returns from 0, uncompounded, and their distance from the peak, 0 included."""
    upto = Window.partitionBy("symbol").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = returns.withColumn("cum", F.sum("r").over(upto))
    return cum.select("symbol", "week", "cum", (F.greatest(F.lit(0.0), F.max("cum").over(upto)) - F.col("cum")).alias("dd"))


def regression(fund: DataFrame, proxy: DataFrame, least: int = 8) -> DataFrame:
    """beta = covar_samp / var_pop, alpha and n of each fund symbol on one proxy (week, p)."""
    j = fund.join(proxy, "week").groupBy("symbol").agg(
        F.count("*").alias("n"), F.covar_samp("r", "p").alias("c"), F.var_pop("p").alias("v"), F.avg("r").alias("mr"), F.avg("p").alias("mp")
    )
    ok = (F.col("n") >= least) & (F.col("v") > 0)
    beta = F.when(ok, F.try_divide(F.col("c"), F.nullif(F.col("v"), F.lit(0.0)))).otherwise(1.0)
    return j.withColumn("beta", beta).select(
        "symbol", "n", "beta", F.when(ok, F.col("mr") - F.col("beta") * F.col("mp")).otherwise(0.0).alias("alpha")
    )


def unsmoothed(returns: DataFrame) -> DataFrame:
    """Geltner: (r - phi * previous) / (1 - phi), phi the lag-1 autocorrelation within 0 and 0.9."""
    w = Window.partitionBy("symbol").orderBy("week")
    lagged = returns.withColumn("before", F.lag("r").over(w))
    pair = F.col("before").isNotNull()
    sd = F.stddev_pop(F.when(pair, F.col("r"))) * F.stddev_pop("before")
    phi = lagged.groupBy("symbol").agg(
        F.when(F.count("*") >= 4, F.greatest(F.lit(0.0), F.least(F.lit(0.9), F.try_divide(F.covar_pop("r", "before"), F.nullif(sd, F.lit(0.0)))))).alias("phi")
    ).withColumn("phi", F.coalesce("phi", F.lit(0.0)))
    return lagged.join(phi, "symbol").select(
        "symbol", "week", F.coalesce((F.col("r") - F.col("phi") * F.col("before")) / (1 - F.col("phi")), F.col("r")).alias("r")
    )


def week_spine(returns: DataFrame, key: str = "panel", step: int = 7) -> DataFrame:
    """(key, week): every week from the first to the last of each key, with or without rows."""
    ends = returns.groupBy(key).agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    return ends.select(key, F.explode(F.sequence("lo", "hi", F.make_interval(days=F.lit(step)))).alias("week"))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum per (portfolio, week) over every week of the panel; absent assets and null returns count zero."""
    weeks = returns.select("week").distinct()
    every = weights.select("portfolio").distinct().join(weeks)
    held = returns.join(weights, "symbol").groupBy("portfolio", "week").agg(F.sum(F.col("r") * F.col("w")).alias("r"))
    return every.join(held, ["portfolio", "week"], "left").select("portfolio", "week", F.coalesce("r", F.lit(0.0)).alias("r"))


def walk_forward(returns: DataFrame, train: int = 260, test: int = 52, step: int = 52) -> DataFrame:
    """(fold, role, symbol, week, r): rolling training and test spans by row number."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("week")) - 1
    rows = returns.withColumn("i", i).withColumn("t", F.count("*").over(Window.partitionBy("symbol")))
    last = F.floor((F.col("t") - train - 1) / step)
    lo, hi = F.greatest(F.lit(0), F.ceil((F.col("i") - train - test + 1) / step)), F.least(last, F.floor(F.col("i") / step))
    fold = rows.where((F.col("t") > train) & (lo <= hi)).withColumn("fold", F.explode(F.sequence(lo, hi)))
    role = F.when(F.col("i") < F.col("fold") * step + train, "train").otherwise("test")
    return fold.select("fold", role.alias("role"), "symbol", "week", "r")


def top_per_class(rows: DataFrame, k: int, cls: str, score: Column, order: Column) -> DataFrame:
    w = Window.partitionBy(cls).orderBy(score.desc(), order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], latest: Column) -> DataFrame:
    """Existing rows replaced by the latest row of the batch for each key."""
    one = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(latest.desc()))).where("_n = 1").drop("_n")
    return existing.join(one, keys, "left_anti").unionByName(one)
