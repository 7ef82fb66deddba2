"""Walk-forward evaluation of given weights, and the choice that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import drawdowns


def adaptive_windows(n: Column) -> tuple[Column, Column]:
    """(training weeks, test weeks) for a history of n weeks."""
    train = F.least(F.lit(260), F.greatest(F.lit(104), F.floor(n / 2)))
    return train, F.when(n > 220, 52).otherwise(F.greatest(F.lit(20), F.floor(n / 6)))


def fold_returns(folds: DataFrame, weights: DataFrame) -> DataFrame:
    """(method, fold, role, week, r) of folds (fold, role, symbol, week, r) under weights (method, fold, symbol, w)."""
    return folds.join(weights, ["fold", "symbol"]).groupBy("method", "fold", "role", "week").agg(F.sum(F.col("r") * F.col("w")).alias("r"))


def out_of_sample(returns: DataFrame) -> DataFrame:
    """Test returns of all folds in order: (method, i, fold, week, r), i counted from 0."""
    i = F.row_number().over(Window.partitionBy("method").orderBy("fold", "week")) - 1
    return returns.where("role = 'test'").select("method", i.alias("i"), "fold", "week", "r")


def fold_metrics(returns: DataFrame, alpha: float = 0.95, least: int = 4) -> DataFrame:
    """(method, fold, insample_cdar, oos_maxdd): the promise in training and the drawdown in the test, where it has `least` weeks."""
    each = returns.withColumn("symbol", F.concat_ws("|", "method", "fold", "role"))
    dd = drawdowns(each)
    cut = dd.where("role = 'train'").groupBy("symbol").agg(F.percentile("dd", F.lit(alpha)).alias("cut"))
    train = dd.where("role = 'train'").join(cut, "symbol").where("dd >= cut").groupBy("method", "fold").agg(F.round(F.avg("dd"), 4).alias("insample_cdar"))
    test = dd.where("role = 'test'").groupBy("method", "fold").agg(F.round(F.when(F.count("*") >= least, F.max("dd")), 4).alias("oos_maxdd"))
    return train.join(test, ["method", "fold"], "left")


def honesty(folds: DataFrame) -> DataFrame:
    """(method, insample_cdar, oos_maxdd, ratio): mean realised drawdown over mean promise; methods without either drop out."""
    m = folds.groupBy("method").agg(F.avg("insample_cdar").alias("a"), F.avg("oos_maxdd").alias("b")).where("a is not null and b is not null")
    return m.select("method", F.round("a", 4).alias("insample_cdar"), F.round("b", 4).alias("oos_maxdd"), F.round(F.when(F.col("a") != 0, F.col("b") / F.col("a")), 2).alias("ratio"))


def recommended(ratios: DataFrame, calmars: DataFrame, first: str = "min_cdar", other: str = "hrp", most: float = 1.4) -> DataFrame:
    """One row: `first` if it keeps its promise and its out-of-sample Calmar is no worse, else `other`, with the reason."""
    row = (
        ratios.where(F.col("method") == first).agg(F.max("ratio").alias("ratio"))
        .join(calmars.agg(F.max(F.when(F.col("method") == first, F.col("calmar"))).alias("c1"), F.max(F.when(F.col("method") == other, F.col("calmar"))).alias("c2")))
    )
    kept = F.col("ratio").isNull() | (F.col("ratio") <= most)
    calm = F.col("c1").isNotNull() & (F.col("c2").isNull() | (F.col("c1") >= F.col("c2")))
    reason = F.when(kept & calm, "holds").when(~kept, "overfits").otherwise("less robust")
    return row.select(F.when(kept & calm, first).otherwise(other).alias("method"), reason.alias("reason"))


def grid(lo: Column, hi: Column, n: int) -> Column:
    """n values from lo to hi at equal steps, as an array."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / (n - 1))


def percent(c: Column, places: int = 1) -> Column:
    """A share as per cent with a sign for the reader; a dash for null."""
    return F.coalesce(F.format_string(f"%.{places}f %%", 100 * c), F.lit("–"))
