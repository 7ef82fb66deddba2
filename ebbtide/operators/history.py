"""Price files and answers as relations, the cascade of sources, stored series and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: suffixes of a fund's quotations, in the order they are tried.
SUFFIXES = ("EUFUND", "US", "PA", "XETRA", "LSE")


def from_csv(files: DataFrame, day: str = "Date", price: str = "Close") -> DataFrame:
    """(symbol, date, price) of CSV texts (symbol, body) with a header; the last of two rows of one day counts.

    Bodies without both columns, rows without a date and prices that are no numbers drop out.
    """
    rows = files.where("body is not null").withColumn("lines", F.split("body", r"\r?\n"))
    head = F.transform(F.split(F.get("lines", 0), ","), lambda c: F.lower(F.trim(c)))
    placed = rows.select("symbol", "lines", (F.array_position(head, day.lower()) - 1).cast("int").alias("a"), (F.array_position(head, price.lower()) - 1).cast("int").alias("b"))
    each = placed.where("a >= 0 and b >= 0").select("symbol", "a", "b", F.posexplode(F.slice("lines", 2, 1 << 30)).alias("i", "line"))
    cells = each.withColumn("c", F.split("line", ","))
    got = cells.select("symbol", "i", F.get("c", F.col("a")).try_cast("date").alias("date"), F.trim(F.get("c", F.col("b"))).try_cast("double").alias("price"))
    return got.where("date is not null and price is not null and not isnan(price)").groupBy("symbol", "date").agg(F.max_by("price", "i").alias("price"))


def from_answers(answers: DataFrame) -> DataFrame:
    """(symbol, ok, date, price) of JSON answers (symbol, body): a list of days is one row a day, adjusted close, else close.

    The close counts only where a day has no adjusted close at all; one that is null is a day without a price.
    An empty list is a good answer without days: one row with nulls. Anything else is a refusal: ok is false.
    """
    parts = answers.select(
        "symbol", F.coalesce(F.ltrim("body").startswith("["), F.lit(False)).alias("ok"), F.from_json("body", "array<map<string,string>>").alias("days")
    )
    each = parts.select("symbol", "ok", F.explode_outer(F.when(F.col("ok"), F.col("days"))).alias("x"))
    key = F.when(F.map_contains_key("x", F.lit("adjusted_close")), "adjusted_close").otherwise("close")
    return each.select("symbol", "ok", F.try_element_at("x", F.lit("date")).try_cast("date").alias("date"), F.try_element_at("x", key).try_cast("double").alias("price"))


def base_100(returns: DataFrame) -> DataFrame:
    """(symbol, week, level): returns chained from 100."""
    w = Window.partitionBy("symbol").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return returns.select("symbol", "week", (100 * F.product(1 + F.col("r")).over(w)).alias("level"))


def cascade(funds: DataFrame, prices: DataFrame, least: int = 100, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(isin, symbol, points): the first quotation of each fund (isin, a symbol where it has a point) with `least` prices."""
    tries = F.when(F.col("isin").contains("."), F.array("isin")).otherwise(F.array(*[F.concat("isin", F.lit("." + s)) for s in suffixes]))
    tried = funds.select("isin", F.posexplode(tries).alias("place", "symbol"))
    deep = prices.groupBy("symbol").agg(F.count("*").alias("points")).where(F.col("points") >= least)
    return tried.join(deep, "symbol").groupBy("isin").agg(F.min_by(F.struct("symbol", "points"), "place").alias("s")).select("isin", "s.symbol", "s.points")


def coverage(funds: DataFrame, found: DataFrame) -> DataFrame:
    """(isin, symbol, points, method): what is real and what is to be reconstructed."""
    j = funds.select("isin").distinct().join(found, "isin", "left")
    return j.select("isin", "symbol", F.coalesce("points", F.lit(0)).alias("points"), F.when(F.col("symbol").isNull(), "reconstructed").otherwise("real").alias("method"))


def last_dates(prices: DataFrame) -> DataFrame:
    return prices.groupBy("symbol").agg(F.max("date").alias("last"))


def to_fetch(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted symbols that the store lacks."""
    return wanted.select("symbol").distinct().join(stored.select("symbol").distinct(), "symbol", "left_anti")


def new_days(prices: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows from each symbol's last stored day on, that day again; all rows of new symbols."""
    last = last_dates(stored)
    return prices.join(last, "symbol", "left").where("last is null or date >= last").drop("last")


def search(catalogue: DataFrame, words: str, limit: int = 10) -> DataFrame:
    """The first `limit` catalogue rows (isin, code, name) whose name, code or ISIN holds all words."""
    text = F.lower(F.concat_ws(" ", "name", "code", "isin"))
    hit = catalogue
    for w in words.lower().split():
        hit = hit.where(text.contains(w))
    return hit.orderBy("isin", "code").limit(limit)


def first_dates(prices: DataFrame) -> DataFrame:
    """(symbol, start, binding): the symbol that bounds the common window has the latest start, the first symbol of ties."""
    start = prices.groupBy("symbol").agg(F.min("date").alias("start"))
    bound = start.groupBy("start").agg(F.min("symbol").alias("_b")).agg(F.max_by("_b", "start").alias("_b"))
    return start.join(F.broadcast(bound)).select("symbol", "start", (F.col("symbol") == F.col("_b")).alias("binding"))


def identifiers(pages: DataFrame, pattern: str) -> DataFrame:
    """(page_id, ident): what the pattern's first group finds first in a page; null where it finds nothing."""
    return pages.select("page_id", F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), pattern, 1), F.lit("")).alias("ident"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, value) of two maps of unique keys; the right one wins."""
    r = right.select("key", F.col("value").alias("_r"), F.lit(True).alias("_in"))
    return left.join(r, "key", "full").select("key", F.when(F.col("_in"), F.col("_r")).otherwise(F.col("value")).alias("value"))


def date_union(*panels: DataFrame) -> DataFrame:
    """Every date that any panel has, once."""
    out = panels[0].select("date")
    for p in panels[1:]:
        out = out.union(p.select("date"))
    return out.distinct()


def universe_symbols(rows: DataFrame) -> DataFrame:
    """(symbol, universes): rows (key, universe array) turned round, symbols in capitals, names once and in order."""
    each = rows.select(F.upper(F.trim("key")).alias("symbol"), F.explode("universe").alias("u"))
    return each.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("u")), ",").alias("universes"))
