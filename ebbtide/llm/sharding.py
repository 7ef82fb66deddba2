"""Sharding by sampled splitters.

Rows are ordered by (hash of text, hash of doc_id, row), so equal texts lie together and a large group of
copies, or of repeated rows, is still divisible. Size-weighted samples of these keys give quantile
boundaries, whose number follows the rows; every row falls into one range; ranges whose exact size is
far over the mean are sampled again and subdivided until none is. Running sizes within ranges, plus the
sizes of all ranges before, give each row's exact place among all bytes; shard s takes the s-th of equally
large stretches (law `bytes`). Only narrow columns move.

Groups of equal texts stay in one shard. Those over a hundredth of a shard, of which there are at most a
hundred times the shards, go first, the largest to the emptiest shard; the others follow in order and
fill the shards up, a group going where its middle lies. Only a group larger than a shard is divided.

Null texts have size 16 and crc 0 and are a group; empty texts are another; very long texts are rows like
others; null doc_ids are keys like others; repeated rows take successive slots; an empty table gives no
rows; other columns are not read. No Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import load, written

KEY = ["h", "g", "rid"]
BUCKETS = 1 << 12
UNIT = float(1 << 31)


def _bucket(h: str = "h") -> Column:
    """A row's place among equal stretches of hashes, in their order."""
    return F.shiftright(F.col(h), 52) + F.lit(BUCKETS // 2)


def _sampled(rows: DataFrame, rate: Column, seed: int) -> DataFrame:
    """Rows drawn with chance min(1, size * rate) by a hash of the key; weight 1 or size * rate."""
    p = F.col("size") * rate
    u = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(1 << 31)) / F.lit(UNIT)
    return rows.where(u < p).withColumn("weight", F.greatest(F.lit(1.0), p))


def _splitters(sample: DataFrame, ranges: int) -> DataFrame:
    """(bucket, h, g, rid): weighted quantile boundaries; sums run within buckets of hashes, and over the buckets' own sums."""
    placed = sample.withColumn("bucket", _bucket())
    sums = placed.groupBy("bucket").agg(F.sum("weight").alias("w"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most BUCKETS rows
    base = sums.select("bucket", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("base"), F.sum("w").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("bucket").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor((F.col("base") + F.coalesce(F.sum("weight").over(inside), F.lit(0.0))) * ranges / F.col("total"))
    marked = placed.join(F.broadcast(base), "bucket").withColumn("q", at)
    return marked.where("q > 0").groupBy("q").agg(F.min(F.struct("bucket", *KEY)).alias("k")).select("k.*")


def _inner(sample: DataFrame) -> DataFrame:
    """Splitters inside overfull ranges: weighted quantiles of each range's own sample."""
    w = Window.partitionBy("r").orderBy(*KEY)
    cum = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1))
    at = F.floor(F.coalesce(cum, F.lit(0.0)) * F.col("pieces") / F.sum("weight").over(Window.partitionBy("r")))
    return sample.withColumn("q", at).where("q > 0").groupBy("r", "q").agg(F.min(F.struct(_bucket().alias("bucket"), *KEY)).alias("k")).select("k.*")


def _ranged(rows: DataFrame, splitters: DataFrame) -> DataFrame:
    """rows with their range r: the number of splitters at or below the key, from a broadcast table of the buckets.

    There is a splitter for some ten thousand rows, so the table has a few bytes for each of those.
    """
    every = splitters.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    held = splitters.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias("cuts"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<struct<h:bigint,g:bigint,rid:bigint>>")
    table = every.join(held, "bucket", "left").select(
        "bucket", F.coalesce("cuts", none).alias("cuts"), F.coalesce(F.sum(F.coalesce(F.size("cuts"), F.lit(0))).over(before), F.lit(0)).alias("passed")
    )
    table = table.withColumn("passed", F.when(F.col("passed") < 0, 0).otherwise(F.col("passed")))
    key = F.struct(*KEY)
    j = rows.withColumn("bucket", _bucket()).join(F.broadcast(table), "bucket")
    return j.withColumn("r", F.col("passed") + F.size(F.filter("cuts", lambda c: c <= key))).drop("bucket", "cuts", "passed")


def _large_groups(rows: DataFrame, total: int, shards: int) -> tuple[list[tuple], list[float]]:
    """([(h, shard)], bytes of each shard): groups over a hundredth of a shard and no larger than one, by size."""
    full = total / shards
    sums = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("b") > full / 100) & (F.col("b") <= full))
    load = [0.0] * shards
    placed = []
    for r in sorted(sums.collect(), key=lambda r: (-r.b, r.h)):  # at most 100 * shards rows
        s = min(range(shards), key=lambda s: (load[s], s))
        if load[s] + r.b > full and placed:
            continue  # no shard has room for it whole: it stays among the others, which keep their order
        load[s] += r.b
        placed.append((r.h, s))
    return placed, load


def shard(docs: DataFrame, shards: int = 40, range_rows: int = 10_000, per_range: int = 48, overfull: float = 2.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text.isNull(), text).alias("h"),
            F.xxhash64("doc_id").alias("g"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-rows",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not count:
        return _law(rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")))
    ranges = max(16, -(-count // range_rows))
    mean = total / ranges
    cuts = written(_splitters(_sampled(rows, F.lit(per_range / mean), 17), ranges), "shard-cuts")
    seed = 18
    while True:
        placed = _ranged(rows, cuts)
        # A range of one row cannot be divided.
        heavy = placed.groupBy("r").agg(F.sum("size").alias("bytes"), F.max("size").alias("most")).where(
            (F.col("bytes") > overfull * mean) & (F.col("bytes") > 2 * F.col("most"))
        ).select("r", F.ceil(F.col("bytes") / F.lit(mean)).alias("pieces"))
        heavy = written(heavy, "shard-heavy")
        if heavy.isEmpty():
            break
        again = _sampled(placed.join(F.broadcast(heavy), "r"), F.lit(per_range / mean), seed)
        cuts, seed = written(cuts.union(_inner(again)).distinct(), "shard-cuts"), seed + 1

    groups, load = _large_groups(rows, total, shards)
    big = spark.createDataFrame(groups, "h long, own_shard int")
    placed = _ranged(rows, cuts).join(F.broadcast(big), "h", "left")
    rest = F.when(F.col("own_shard").isNull(), F.col("size")).otherwise(0)
    sums = placed.groupBy("r").agg(F.sum(rest).alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = sums.select("r", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    run = Window.partitionBy("r").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = written(
        placed.withColumn("upto", F.sum(rest).over(run)).withColumn("nth", F.count("*").over(run)).join(F.broadcast(base), "r").select(
            "doc_id", "size", "text_crc32", "h", "own_shard", (F.col("bytes_before") + F.col("upto") - rest).alias("start"), (F.col("rows_before") + F.col("nth") - 1).alias("row")
        ),
        "shard-places",
    )
    # Where the middle of a group lies decides for all of it, unless it alone exceeds a shard.
    several = exact.where("own_shard is null").groupBy("h").agg(F.count("*").alias("n"), F.min("start").alias("lo"), F.sum("size").alias("b")).where(
        (F.col("n") > 1) & (F.col("b") <= total / shards)
    )
    middle = F.coalesce(F.col("lo") + F.col("b") / 2, F.col("start") + F.col("size") / 2)
    room = [max(0.0, total / shards - x) for x in load]
    scale = (total - sum(load)) / (sum(room) or 1.0)
    bounds, at = [], 0.0
    for x in room[:-1]:
        at += x * scale
        bounds.append(at)
    edges = F.array(*[F.lit(x) for x in bounds]) if bounds else F.array().cast("array<double>")
    chosen = F.coalesce("own_shard", F.size(F.filter(edges, lambda e: e <= middle))).cast("int")
    dealt = written(exact.join(several.select("h", "lo", "b"), "h", "left").select("doc_id", "size", "text_crc32", "h", "own_shard", "row", chosen.alias("shard")), "shard-dealt")
    return _law(_slots(dealt))


def _slots(dealt: DataFrame) -> DataFrame:
    """Slots within shards: rows in order first, then the large groups one after another.

    Rows before a row in order are counted by its place, less the rows of large groups before it.
    """
    own = dealt.where("own_shard is not null").groupBy("h", "shard").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    past = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row a large group
    own = own.withColumn("passed", F.coalesce(F.sum("n").over(past), F.lit(0)))
    plain = dealt.where("own_shard is null").groupBy("shard").agg(F.count("*").alias("plain"))
    within = Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    offset = own.join(plain, "shard", "left").select(
        "h", "first", (F.coalesce("plain", F.lit(0)) + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("offset")
    )
    large = dealt.where("own_shard is not null").join(F.broadcast(offset), "h").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first") + F.col("offset")).alias("slot"))
    # The places of large groups are intervals of rows; those below a row come from a broadcast sorted table.
    table = own.agg(F.array_sort(F.collect_list(F.struct("first", "n", "passed"))).alias("own"))
    below = F.filter("own", lambda o: o["first"] < F.col("row"))
    order = F.col("row") - F.coalesce(F.try_element_at(below, F.lit(-1))["passed"] + F.try_element_at(below, F.lit(-1))["n"], F.lit(0))
    counted = dealt.where("own_shard is null").join(F.broadcast(table)).select("doc_id", "size", "text_crc32", "shard", order.alias("order"))
    first = counted.groupBy("shard").agg(F.min("order").alias("from"))
    rest = counted.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("order") - F.col("from")).alias("slot"))
    return rest.union(large)


def _law(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir):
    return shard(load(spark, sf_dir, "documents"))
