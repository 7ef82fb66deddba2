"""Comparisons of portfolios: assets in order, allocation matrix, lines with where their series come from; small readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asset_order(lines: DataFrame) -> DataFrame:
    """(asset, place): assets of (asset, ord) by first appearance, from 0."""
    first = lines.groupBy("asset").agg(F.min("ord").alias("ord"))
    # One row an asset.
    return first.select("asset", (F.row_number().over(Window.orderBy("ord", "asset")) - 1).alias("place"))


def allocation_matrix(weights: DataFrame, profiles: list[str]) -> DataFrame:
    """(asset, one column a profile, top): weights (profile, asset, w), absent ones 0, of the assets held over 0.05 % somewhere."""
    by = weights.groupBy("asset").pivot("profile", profiles).agg(F.sum("w"))
    cells = [F.coalesce(F.col(f"`{p}`"), F.lit(0.0)).alias(p) for p in profiles]
    top = F.greatest(*[F.coalesce(F.col(f"`{p}`"), F.lit(0.0)) for p in profiles]) if len(profiles) > 1 else F.coalesce(F.col(f"`{profiles[0]}`"), F.lit(0.0))
    return by.select("asset", *cells, top.alias("top")).where("top > 0.0005")


def provenance(lines: DataFrame) -> DataFrame:
    """Lines (.., source) with the kind of their series: real, rebuilt or modelled; null where no source is given."""
    source = F.col("source")
    kind = F.when(source.startswith("réel"), "real").when(source == "reconstruit", "rebuilt").when(F.coalesce(source, F.lit("")) != "", "modelled")
    return lines.withColumn("kind", kind)


def pdf_only(files: DataFrame) -> DataFrame:
    """Files (.., content binary) that begin as a PDF does."""
    return files.where(F.substring("content", 1, 4) == F.lit(b"%PDF"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, trimmed and in upper case, the last in an order; rows without a key drop out."""
    name = F.nullif(F.upper(F.trim(F.col(key).cast("string"))), F.lit(""))
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn(key, name).where(F.col(key).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def venue_choice(hits: DataFrame, kind: str = "ETF", venues: tuple[str, ...] = ("LSE", "XETRA", "MI", "AS", "PA", "F", "SW")) -> DataFrame:
    """Per query the hit (query, ord, type, exchange, ..) that counts: of the kind on a listed venue, else of the kind, else any; the first of equals."""
    right = F.upper(F.coalesce("type", F.lit(""))) == kind
    rank = F.when(right & F.col("exchange").isin(*venues), 0).when(right, 1).otherwise(2)
    w = Window.partitionBy("query").orderBy(rank, "ord")
    return hits.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


class Sources:
    """Named builders of series; a name can be tried in turn with others."""

    def __init__(self, **builders: Callable[[], DataFrame]):
        self.builders = builders

    def get(self, name: str) -> DataFrame:
        """One source, or with `a,b` the first of several whose table is there and has rows; the last one's error is raised."""
        error: Exception = KeyError(name)
        for part in name.split(","):
            try:
                found = self.builders[part]()
                if not found.isEmpty():
                    return found
                error = LookupError(f"{part} has no rows")
            except (AnalysisException, KeyError) as e:
                error = e
        raise error
