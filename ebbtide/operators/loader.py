"""The euro loader: menus of many panels to weekly returns in euros after fees, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import after_fee, row_key
from ..sources.shared import settled
from . import candidates, currency
from .series import weekly_returns

LEAST_POINTS = 60


def kept_lines(menu: DataFrame, prices: DataFrame, catalogue: DataFrame, fund_envelope: bool = True) -> DataFrame:
    """(panel, key, symbol, isin, code, name, classe, ccy, points) of the menu lines whose series has 60 prices.

    Lines are (panel, isin, code, exchange, name, classe, ord). In a fund envelope a line without an exchange is
    on EUFUND. The currency comes from the catalogue by ISIN or code, else from the venue. Of lines of a panel
    with one key the last counts.
    """
    clean = lambda c: F.upper(currency.text(c))
    venue = F.when((clean("exchange") == "") & F.lit(fund_envelope), "EUFUND").otherwise(clean("exchange"))
    lines = menu.select("panel", clean("isin").alias("isin"), clean("code").alias("code"), venue.alias("exchange"), "name", "classe", "ord")
    symbol = candidates.price_symbol(F.col("isin"), F.col("code"), F.col("exchange"), F.lit(fund_envelope))
    lines = currency.resolved(lines.withColumn("symbol", symbol), catalogue)
    deep = prices.groupBy("symbol").agg(F.count("*").alias("points")).where(F.col("points") >= LEAST_POINTS)
    keyed = lines.join(deep, "symbol").withColumn("key", row_key(F.col("isin"), F.col("code"), F.col("symbol")))
    last = F.max_by(F.struct("symbol", "isin", "code", "name", "classe", "ccy", "points"), "ord").alias("x")
    return keyed.groupBy("panel", "key").agg(last).select("panel", "key", "x.*")


def euro_panel(lines: DataFrame, prices: DataFrame, fx: DataFrame, annual_fee: float = 0.0) -> DataFrame:
    """(panel, key, week, r) of kept_lines(): prices in euros, on the days that all of a panel's lines have, weekly, after the fee.

    A line whose currency has no rates leaves its panel without common days, as it has no price in euros.
    """
    size = F.count("*").over(Window.partitionBy("panel"))
    # A table of one row a line, as it costs a pass over all prices.
    kept = settled(lines.where("panel is not null").select("panel", "key", "symbol", "ccy", size.alias("all")), "euro-lines")
    px = prices.join(kept, "symbol").select(F.struct("panel", "key", "all").alias("symbol"), "ccy", "date", "price")
    euro = currency.as_of(px, fx).where("eur is not null")
    # The number of different lines of a panel on a day is the last one's rank.
    day = Window.partitionBy("symbol.panel", "date")
    ranked = euro.withColumn("n", F.dense_rank().over(day.orderBy("symbol.key")))
    common = ranked.withColumn("n", F.max("n").over(day)).where("n = symbol.all")
    r = weekly_returns(common.select("symbol", "date", F.col("eur").alias("price")))
    return r.select("symbol.panel", "symbol.key", "week", after_fee(F.col("r"), annual_fee).alias("r"))
