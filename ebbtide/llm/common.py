"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's setting, else (in local mode, as in tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None, **options) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder, which outlives lost executors; `by` a column, in parts.

    The write is a query of its own; when the table is there, Spark deletes the shuffle files that led to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # With a writer open for each part, rows need no sort by part.
    wanted = {CLEAN_UP: "true"} | ({"spark.sql.maxConcurrentOutputFileWriters": "8"} if by else {})
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.options(**options).parquet(path, partitionBy=by)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path) if by else spark.read.parquet(path)  # no part, no file, if there is no row


def trim() -> None:
    """Give memory that a finished task no longer needs back to the system; workers live on, next to the heap of their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def tidy(run):
    """A map over batches that gives its memory back at its end."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def drop(table: DataFrame, part: str = "") -> None:
    """Delete a table made by written(), or a part of it, that nothing reads any more; a copy that is gone is no error."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if part in path and (path.startswith(shared_dir(spark)) or path.startswith(f"file://{shared_dir(spark)}")):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_columns(df: DataFrame) -> list:
    """A frame's columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors, which share no local folder with the driver, this package; once an application."""
    app = spark.sparkContext.applicationId
    if app not in SHIPPED:
        root = Path(__file__).parents[2]
        out = tempfile.mkdtemp(prefix="spark-ship-", dir="/tmp")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{out}/ebbtide", "zip", root, "ebbtide"))
        SHIPPED.add(app)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)
