"""Currencies of instruments from venue catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Venues in order of priority, and the currency of a venue whose catalogue is silent.
VENUES = ("EUFUND", "XETRA", "PA", "LSE")
VENUE_CURRENCY = {"XETRA": "EUR", "PA": "EUR", "AS": "EUR", "MI": "EUR", "F": "EUR", "LSE": "GBP", "US": "USD", "SW": "CHF"}


def text(c) -> Column:
    """Trimmed; null and NaN in any case are empty."""
    s = F.trim(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")))
    return F.when(F.lower(s) == "nan", "").otherwise(s)


def catalogue(rows: DataFrame, key: str, venues: tuple[str, ...] = VENUES) -> DataFrame:
    """(key, currency) of catalogue rows (exchange, isin, code, currency, ord): first venue, then first row, with both given."""
    place = F.array_position(F.array(*map(F.lit, venues)), F.upper(text("exchange")))
    known = rows.select(F.upper(text(key)).alias(key), F.upper(text("currency")).alias("currency"), place.alias("venue"), "ord")
    known = known.where((F.col("venue") > 0) & (F.col(key) != "") & (F.col("currency") != ""))
    return known.groupBy(key).agg(F.min_by("currency", F.struct("venue", "ord")).alias("currency"))


def resolved(instruments: DataFrame, rows: DataFrame, venues: tuple[str, ...] = VENUES) -> DataFrame:
    """instruments (isin, code, exchange) with `ccy`: by ISIN, else by code, else by venue, else EUR."""
    by_isin = catalogue(rows, "isin", venues).select(F.col("isin").alias("_isin"), F.col("currency").alias("_c1"))
    by_code = catalogue(rows, "code", venues).select(F.col("code").alias("_code"), F.col("currency").alias("_c2"))
    venue = F.create_map(*[F.lit(x) for pair in VENUE_CURRENCY.items() for x in pair])
    out = instruments.join(by_isin, F.upper(text("isin")) == F.col("_isin"), "left").join(by_code, F.upper(text("code")) == F.col("_code"), "left")
    ccy = F.coalesce("_c1", "_c2", F.try_element_at(venue, F.upper(text("exchange"))), F.lit("EUR"))
    return out.withColumn("ccy", ccy).drop("_isin", "_c1", "_code", "_c2")


def foreign_counts(instruments: DataFrame) -> DataFrame:
    """(ccy, n) of the instruments that are not in euros."""
    return instruments.where("ccy <> 'EUR'").groupBy("ccy").agg(F.count("*").alias("n"))


def dollars_to_euros(prices: DataFrame, eurusd: DataFrame) -> DataFrame:
    """(symbol, date, price) divided by the dollar rate (date, rate) of the symbol's last day that has one.

    Rates of days on which the symbol has no price do not count; days before its first rate drop out. Of two
    rates of one day the larger counts. A symbol has one row a day at most, so its history is a small window.
    """
    rate = eurusd.where("rate is not null").groupBy("date").agg(F.max("rate").alias("rate"))
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = prices.join(rate, "date", "left").withColumn("used", F.last("rate", ignorenulls=True).over(upto))
    return used.where("used is not null").select("symbol", "date", F.try_divide("price", "used").alias("price"))


def carried(fx: DataFrame) -> DataFrame:
    """(ccy, month, rates, before, after): a month's rates by date, and the last one before and the first one after it.

    Every month from a currency's first rate to its last has a row, so a join by month needs no sort of prices;
    a month holds at most 31 days, a currency some hundred months.
    """
    day = fx.where("rate is not null").groupBy("ccy", "date").agg(F.max("rate").alias("rate"))
    month = day.groupBy("ccy", F.trunc("date", "MM").alias("month")).agg(
        F.array_sort(F.collect_list(F.struct("date", "rate"))).alias("rates"), F.max_by("rate", "date").alias("last"), F.min_by("rate", "date").alias("first")
    )
    span = month.groupBy("ccy").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    every = span.select("ccy", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))
    w = Window.partitionBy("ccy").orderBy("month")
    none = F.array().cast("array<struct<date:date,rate:double>>")
    return every.join(month, ["ccy", "month"], "left").select(
        "ccy", "month", F.coalesce("rates", none).alias("rates"),
        F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )


def as_of(prices: DataFrame, fx: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """Prices (symbol, ccy, date, price) in euros by the last rate (ccy, date, rate), else the next one; pence are pounds.

    Of two rates of one day the larger counts. The rates' months are broadcast up to `broadcast_rows` of
    them (a count that is checked) and joined by shuffle beyond it; prices never move by currency.
    """
    from ..functions.money import canonical_currency
    from ..sources.shared import settled

    # The rate of each day of a month is found once, so a price takes it by its place.
    past = lambda d: F.filter("rates", lambda r: F.dayofmonth(r["date"]) <= d)
    day = lambda d: F.coalesce(F.try_element_at(past(d), F.lit(-1))["rate"], F.col("before"), F.get("rates", 0)["rate"], F.col("after"))
    days = F.transform(F.sequence(F.lit(1), F.lit(31)), day)
    table = settled(carried(fx).select("ccy", "month", days.alias("days"), "before", "after"), "fx-months")
    ends = table.groupBy("ccy").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    hint = F.broadcast if table.count() <= broadcast_rows else (lambda df: df)
    code, factor = canonical_currency(F.col("ccy"))
    rows = prices.withColumn("price", F.col("price") * factor).withColumn("ccy", code)
    # A price outside the months of its currency's rates takes the nearest of them.
    placed = rows.join(hint(ends), "ccy", "left").withColumn("month", F.greatest(F.least(F.trunc("date", "MM"), "hi"), "lo"))
    j = placed.join(hint(table), ["ccy", "month"], "left")
    own = F.trunc("date", "MM")
    at = F.when(own > F.col("month"), 31).when(own < F.col("month"), 1).otherwise(F.dayofmonth("date"))
    used = F.coalesce(F.get("days", at - 1), "before", "after")
    euro = F.col("ccy").isin("EUR", "")
    return j.select("symbol", "date", "ccy", (F.col("price") * F.when(euro, 1.0).otherwise(used)).alias("eur"))
