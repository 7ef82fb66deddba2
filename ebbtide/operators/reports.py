"""Rankings, versions, screening and report relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def panel_meta(returns: DataFrame) -> DataFrame:
    """One row: assets, weeks, first and last week, years."""
    return returns.agg(
        F.countDistinct("symbol").alias("n_assets"), F.countDistinct("week").alias("n_weeks"), F.min("week").alias("start"), F.max("week").alias("end")
    ).withColumn("years", F.round(F.datediff("end", "start") / 365.25, 1))


def first_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key; empty and null keys drop out."""
    for k in keys:
        rows = rows.where(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "")
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def versions(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Numbered versions of each key, the last of which is current."""
    w = Window.partitionBy(key)
    n = F.row_number().over(w.orderBy(order))
    return rows.withColumn("version", n).withColumn("is_current", F.col("version") == F.count("*").over(w))


def downsample(rows: DataFrame, most: int = 320) -> DataFrame:
    """Every step-th row of each symbol by week, step = max(1, rows // most)."""
    w = Window.partitionBy("symbol")
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))
    return rows.withColumn("_i", F.row_number().over(w.orderBy("week")) - 1).withColumn("_s", step).where("_i % _s = 0").drop("_i", "_s")


def screening_score(metrics: DataFrame, ranges: int = 64) -> DataFrame:
    """Weighted percentile ranks over all candidates: return 22, Sharpe 24, Calmar 24, CDaR 18, drawdown 12 per cent.

    Missing measures rank last. Ranks are counts of smaller values, summed inside ranges of values and
    over the ranges before, so no window runs over all candidates in one task.
    """
    parts = {"cagr": (22, 1), "sharpe": (24, 1), "calmar": (24, 1), "cdar": (18, -1), "max_dd": (12, -1)}
    each = [F.struct(F.lit(c).alias("metric"), F.lit(w).alias("weight"), (sign * F.col(c)).alias("at")) for c, (w, sign) in parts.items()]
    rows = metrics.select("symbol", F.explode(F.array(*each)).alias("x")).select("symbol", "x.*")
    counts = rows.where("at is not null").groupBy("metric", "at").agg(F.count("*").alias("k"))
    cuts = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    edges = counts.groupBy("metric").agg(F.percentile_approx("at", cuts).alias("edges"))  # a row a metric
    placed = counts.join(F.broadcast(edges), "metric").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("at")))).drop("edges")
    sums = placed.groupBy("metric", "bin").agg(F.sum("k").alias("bk"))
    m = Window.partitionBy("metric")
    base = F.coalesce(F.sum("bk").over(m.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("metric", "bin", base.alias("base"), F.sum("bk").over(m).alias("total"))  # at most `ranges` rows a metric
    inside = Window.partitionBy("metric", "bin").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("base") + F.coalesce(F.sum("k").over(inside), F.lit(0))
    rank = F.when(F.col("total") > 1, below / (F.col("total") - 1)).otherwise(0.0)
    ranks = placed.join(F.broadcast(sums), ["metric", "bin"]).select("metric", "at", rank.alias("rank"))
    total = F.sum(F.col("weight") * F.coalesce("rank", F.lit(0.0)))
    return rows.join(ranks, ["metric", "at"], "left").groupBy("symbol").agg(F.round(total, 2).alias("score"))


def stacked(weights: DataFrame) -> DataFrame:
    """(point, asset, lo, hi): cumulative shares of each point's weights, assets in order."""
    w = Window.partitionBy("point")
    share = F.col("w") / F.sum("w").over(w)
    hi = F.sum("share").over(w.orderBy("asset").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return weights.withColumn("share", share).withColumn("hi", hi).select("point", "asset", (F.col("hi") - F.col("share")).alias("lo"), "hi")


def leaderboard(runs: DataFrame, score: Column) -> DataFrame:
    """Runs by score, best first; missing or zero scores count -1; ties by id."""
    key = F.coalesce(F.nullif(score, F.lit(0.0)), F.lit(-1.0))
    return runs.withColumn("score", key).orderBy(F.desc("score"), "id")


def shortlist(candidates: DataFrame, covers: str = "2008-09-01", prefix: int = 12, per_class: int = 5, without: tuple[str, ...] = ("monétaire",)) -> DataFrame:
    """(classe, rank, symbol, name, score) of candidates (symbol, name, classe, start, score) that were there before a crisis.

    Shares of one fund have names that begin alike: of names that agree in their first `prefix` letters and
    digits, case aside, the best score stays (ties: first symbol), whatever its class; then come the best
    `per_class` of each class. Money-market funds, names and scores that are missing and late starts drop out.
    """
    name = F.substring(F.upper(F.regexp_replace("name", r"[^\p{L}\p{N}]", "")), 1, prefix)
    fit = candidates.where((F.col("start") <= F.lit(covers).cast("date")) & F.col("score").isNotNull() & ~F.isnan("score") & ~F.coalesce("classe", F.lit("")).isin(*without))
    one = fit.withColumn("share", F.nullif(name, F.lit(""))).where("share is not null").groupBy("share").agg(
        F.min_by(F.struct("symbol", "name", "classe", "score"), F.struct(-F.col("score"), "symbol")).alias("c")
    ).select("c.*")
    w = Window.partitionBy("classe").orderBy(F.desc("score"), "symbol")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_class).select("classe", "rank", "symbol", "name", "score")
