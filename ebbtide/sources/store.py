"""Stored series: a partitioned store with get-or-fetch, and a versioned table whose merges touch changed months only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import upsert
from .shared import settled


def is_there(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows exists."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def code(column: str = "symbol"):
    """Symbols are kept trimmed and in upper case; blank ones are none."""
    return F.nullif(F.upper(F.trim(column)), F.lit(""))


def complete(spark: SparkSession, path: str, column: str) -> list[int]:
    """The numbers k of the folders path/column=k whose writing has ended."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = fs.Path(f"{path}/{column}=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


class SeriesStore:
    """Series (symbol, date, price) with where they come from, one folder a write, whose files hold many symbols in order.

    Writing symbols replaces them as a whole and leaves all files as they are: a symbol's rows are those of the
    last write that has it, and a write is seen as a whole or not at all. So files follow the rows, not the
    symbols; replaced rows stay in their files. One writer at a time. The manifest is derived from the rows and
    cannot disagree with them. Rows without a symbol or date are left out; of two rows of one day the larger
    price counts; a symbol without rows is not stored.
    """

    SCHEMA = "date date, price double, source string, fetched_on date, symbol string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _written(self) -> DataFrame:
        """Rows of all writes, with `write`."""
        schema, paths = f"{self.SCHEMA}, write int", [f"{self.path}/write={n}" for n in complete(self.spark, self.path, "write")]
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        rows = self._written()
        # Symbols of one write alone, most of them, take no part in the join.
        again = rows.groupBy(F.col("symbol").alias("s")).agg(F.min("write").alias("first"), F.max("write").alias("last")).where("first < last")
        return rows.join(again, (F.col("symbol") == F.col("s")) & (F.col("write") < F.col("last")), "left_anti").drop("write")

    def write(self, series: DataFrame, source: str = "", fetched_on: str | None = None) -> None:
        rows = series.select(code().alias("symbol"), F.col("date").cast("date").alias("date"), F.col("price").cast("double").alias("price"))
        rows = rows.where("symbol is not null and date is not null").repartition("symbol").groupBy("symbol", "date").agg(F.max("price").alias("price"))
        rows = rows.select("date", "price", F.lit(source).alias("source"), F.lit(fetched_on).cast("date").alias("fetched_on"), "symbol")
        n = max(complete(self.spark, self.path, "write"), default=0) + 1
        rows.sortWithinPartitions("symbol", "date").write.mode("overwrite").parquet(f"{self.path}/write={n}")

    def manifest(self) -> DataFrame:
        """(symbol, points, start, end, source, fetched_on)."""
        return self.read().groupBy("symbol").agg(
            F.count("*").alias("points"), F.min("date").alias("start"), F.max("date").alias("end"), F.max("source").alias("source"),
            F.max("fetched_on").alias("fetched_on"),
        )

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Wanted (symbol) that are not stored."""
        asked = wanted.select(code().alias("symbol")).where("symbol is not null").distinct()
        return asked.join(self._written().select("symbol").distinct(), "symbol", "left_anti")

    def get(self, wanted: DataFrame, fetch: Callable[[DataFrame], DataFrame] | None = None, source: str = "", fetched_on: str | None = None, refetch: bool = False) -> DataFrame:
        """(symbol, date, price, from_cache) of the wanted symbols; what is missing is fetched and stored first.

        `fetch` takes (symbol) and gives (symbol, date, price). Without it a missing symbol is a KeyError that
        names the first. With refetch all wanted symbols are fetched; one the source does not know stays as it is.
        """
        asked = wanted.select(code().alias("symbol")).where("symbol is not null").distinct()
        # A table, as the store changes between the question and the answer.
        todo = settled(asked if refetch else self.missing(wanted), "store-missing")
        first = todo.orderBy("symbol").head()
        if first and fetch is None:
            raise KeyError(f"{first.symbol} is not stored")
        if first:
            self.write(fetch(todo), source, fetched_on)
        held = self.read().join(asked, "symbol", "left_semi")
        return held.join(todo.withColumn("new", F.lit(True)), "symbol", "left").select("symbol", "date", "price", F.col("new").isNull().alias("from_cache"))


class VersionedPrices:
    """Prices (symbol, date, price, ord) under (symbol, date), later ords winning, in months that have versions of their own.

    A merge reads and writes the months of its rows alone: month=M/version=N holds a month as of merge N, and
    log/version=N lists which version of each month counts, with its rows and last days. Readers follow the
    last complete list, so they see a merge as a whole or not at all, and a merge that is repeated after a
    failure writes the same files again. Rows without symbol, date or a finite price are left out; an older
    row that arrives late does not replace a newer one; a merge without rows only moves the list on.
    """

    ROW = "symbol string, date date, price double, ord long"
    LOG = "month string, at long, rows long, last date"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self, n: int) -> DataFrame:
        return self.spark.read.schema(self.LOG).parquet(f"{self.path}/log/version={n}") if n else self.spark.createDataFrame([], self.LOG)

    def latest(self) -> int:
        """The last merge whose list is complete; 0 before the first."""
        return max(complete(self.spark, f"{self.path}/log", "version"), default=0)

    def months(self, n: int | None = None) -> DataFrame:
        """(month, at, rows, last): the list of a merge, one row a month."""
        return self._log(self.latest() if n is None else n)

    def read(self, n: int | None = None, months: list[str] | None = None) -> DataFrame:
        """Rows as of merge n, the last by default; only the folders that count, and of `months` if given, are opened."""
        log = self.months(n)
        listed = (log if months is None else log.where(F.col("month").isin(months))).select("month", "at").collect()
        paths = [f"{self.path}/month={r.month}/version={r.at}" for r in listed]
        return self.spark.read.schema(self.ROW).parquet(*paths) if paths else self.spark.createDataFrame([], self.ROW)

    def merge(self, batch: DataFrame, n: int) -> None:
        """Merge rows as merge n, on top of merge n - 1."""
        rows = batch.where("symbol is not null and date is not null and price is not null and not isnan(price)")
        month = F.date_format("date", "yyyy-MM")
        new = settled(rows.select("symbol", "date", "price", "ord").withColumn("month", month), "merge-rows")
        # One row a month of the batch: some hundred in thirty years.
        changed = [r.month for r in new.select("month").distinct().collect()]
        old = self.read(n - 1, changed).withColumn("month", month)
        order = F.struct("ord", "price")
        merged = upsert(old, new.unionByName(old), ["symbol", "date"], order)
        if changed:
            laid = merged.withColumn("version", F.lit(n))
            laid.repartition("month").sortWithinPartitions("month", "symbol", "date").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("month", "version").parquet(self.path)
        fresh = self.spark.createDataFrame([], self.LOG)
        if changed:
            paths = [f"{self.path}/month={m}/version={n}" for m in changed]
            fresh = self.spark.read.schema(self.ROW).parquet(*paths).groupBy(month.alias("month")).agg(F.count("*").alias("rows"), F.max("date").alias("last"))
            fresh = fresh.select("month", F.lit(n).cast("long").alias("at"), "rows", "last")
        kept = self._log(n - 1).where(~F.col("month").isin(changed)) if changed else self._log(n - 1)
        kept.unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={n}")

    def high_water(self) -> DataFrame:
        """(symbol, last): where the next fetch of each symbol begins."""
        return self.read().groupBy("symbol").agg(F.max("date").alias("last"))
