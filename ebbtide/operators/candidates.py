"""Candidate lists: what they are called, which are left out, and the best of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Name patterns of gold, broad baskets and single commodities.
GOLD = r"(?i)\b(gold|bullion|gold\s*bugs)\b"
BROAD = (
    r"(?i)(crb|rogers|rici|core\s*commodity|corecommodity|diversified\s+commodit|broad\s+commodit|all\s+commodit|"
    r"commodities\s+refinitiv|bloomberg\s+commodit|energy\s*&\s*metals|energy\s+and\s+metals)"
)
SINGLE = (
    r"(?i)(cattle|livestock|lean\s*hog|\bhogs?\b|coffee|sugar|cocoa|wheat|\bcorn\b|maize|\bgrain(s)?\b|soybean|\bsoya?\b|"
    r"natural\s*gas|gasoline|heating\s*oil|crude|\bwti\b|brent|petroleum|nickel|\bzinc\b|\blead\b|alumin|copper|\btin\b|cotton|"
    r"silver|platinum|palladium|\bsofts?\b|agricultur|precious\s*metal|carbon)"
)
# Class patterns on lower-cased names, the first that matches names the class.
CLASSES = (
    ("monétaire", r"court\s*terme|mon[ée]taire|money\s*market|overnight|eonia|ester"),
    ("oblig", r"oblig|bond"),
    ("immobilier", r"immobil|epra|nareit|\breit"),
    ("actions émergents/thème", r"emerging|[ée]mergent|inde\b|india|china|chine|latin|turkey|asia|asie|hscei|water|eau\b"),
    ("actions Japon", r"japan|topix|nikkei"),
    ("actions Europe", r"europe|\beuro\b|emu|stoxx|\bcac\b|\bdax\b"),
    ("actions US", r"s&p\s*500|nasdaq|dow\s*jones|msci\s*usa|united\s*states|\bus\b"),
    ("actions monde", r"world|monde|acwi|global"),
)
OTHER_CLASS, CASH_CLASS = "actions/autre", "monétaire"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def exotic(name: Column) -> Column:
    """A bet on one commodity; gold and broad baskets are none."""
    n = F.coalesce(name, F.lit(""))
    return ~n.rlike(GOLD) & ~n.rlike(BROAD) & n.rlike(SINGLE)


def asset_class(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(OTHER_CLASS)
    for cls, pattern in reversed(CLASSES):
        out = F.when(n.rlike(pattern), cls).otherwise(out)
    return out


def number(c: Column) -> Column:
    """A number, or 0 for what is none."""
    s = c.cast("string")
    return F.coalesce(F.when(s.rlike(NUMBER), F.trim(s).try_cast("double")), F.lit(0.0))


def price_symbol(isin: Column, code: Column, exchange: Column, insurance: Column) -> Column:
    """ISIN.EUFUND for insurance contracts, else CODE.EXCHANGE."""
    up = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(insurance, F.concat(up(isin), F.lit(".EUFUND"))).otherwise(F.concat_ws(".", up(code), up(exchange)))


def isin_of(symbol: Column) -> Column:
    return F.when(symbol.endswith(".EUFUND"), F.substring_index(symbol, ".", 1))


def selected(rows: DataFrame, per_class: int = 4, min_years: float | None = None) -> DataFrame:
    """The `per_class` best scores (string or number; none counts 0) of each class, ties by `ord`; no class is `?`.

    `class_order` is the place of a class by its first row.
    """
    pool = rows.withColumn("classe", F.coalesce("classe", F.lit("?"))).withColumn("_s", number(F.col("score")))
    if min_years:
        pool = pool.where(number(F.col("years")) >= min_years)
    first = pool.groupBy("classe").agg(F.min("ord").alias("class_order"))
    rank = F.row_number().over(Window.partitionBy("classe").orderBy(F.desc("_s"), "ord"))
    return pool.withColumn("rank", rank).where(F.col("rank") <= per_class).drop("_s").join(first, "classe")


def of_menus(menus: DataFrame, screened: DataFrame, least: int = 5) -> DataFrame:
    """Menu rows (contract, isin, ord) whose ISIN is screened, with all repeats, of contracts with `least` such rows."""
    key = lambda c: F.upper(F.trim(c))
    held = menus.join(screened.select(key(F.col("isin")).alias("_i")).distinct(), key(F.col("isin")) == F.col("_i"), "left_semi")
    enough = held.groupBy("contract").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("contract")
    return held.join(enough, "contract", "left_semi")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (key) with their label, the key itself where there is none."""
    one = labels.groupBy("key").agg(F.min("label").alias("label"))
    return rows.join(one, "key", "left").withColumn("label", F.coalesce("label", "key"))


def shown_weights(weights: DataFrame, least: float = 5e-4) -> DataFrame:
    """Weights (portfolio, symbol, w) over `least`, rounded to four places."""
    return weights.where(F.col("w") > least).withColumn("w", F.round("w", 4))


def benchmark_weights(weights: DataFrame, universe: DataFrame) -> DataFrame:
    """(symbol, w): benchmark weights (symbol, w) within the universe (symbol), scaled to one; equal weights if none is in it."""
    all_ = universe.select("symbol").distinct()
    held = all_.join(weights, "symbol", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = held.agg(F.sum("w").alias("t"), F.count("*").alias("n"))
    return held.join(F.broadcast(total)).select("symbol", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1.0 / F.col("n")).alias("w"))


def frontier_pick(points: DataFrame, target: float) -> DataFrame:
    """Per panel the point (panel, point, max_dd, cagr) of most growth whose drawdown keeps the target, the first of ties."""
    ok = points.where(F.col("max_dd") <= target)
    return ok.groupBy("panel").agg(F.min_by("point", F.struct(-F.col("cagr"), "point")).alias("point"))


def merged_points(points: DataFrame) -> DataFrame:
    """Chart points (name, vol, cagr) that coincide to three places, as one with joined names."""
    at = [F.round(c, 3).alias(c) for c in ("vol", "cagr")]
    return points.groupBy(*at).agg(F.array_join(F.array_sort(F.collect_list("name")), " + ").alias("names"), F.count("*").alias("n"))
