"""Stored series, merges by month, and keyed state against the same computed at once."""

import datetime as dt
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ebbtide.sources.store import SeriesStore, VersionedPrices
from ebbtide.streaming.running import OUT, ROW, replay, running_drawdown
from ebbtide.streaming.sync import sync

PRICES = "symbol string, date date, price double"
ROWS = "symbol string, date date, price double, ord long"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


@pytest.fixture
def top():
    return tempfile.mkdtemp(prefix="spark-store-", dir="/tmp")


def files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(folder).rglob("*.parquet")}


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def test_store_fetches_what_is_missing(spark, top):
    store = SeriesStore(spark, f"{top}/s")
    source = spark.createDataFrame([(s, day(i), float(i)) for s in ("A", "B", "C") for i in range(5)] + [("A", None, 1.0), (None, day(1), 1.0)], PRICES)
    asked = []

    def fetch(missing):
        asked.append(sorted(r.symbol for r in missing.collect()))
        return source.join(missing, "symbol", "left_semi")

    want = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    with pytest.raises(KeyError, match="A is not"):
        store.get(want("b", "a"))
    assert store.read().count() == 0 and store.manifest().count() == 0
    got = store.get(want(" a", "A", None, " "), fetch, "eod", "2024-01-01")
    assert sorted((r.symbol, r.price, r.from_cache) for r in got.collect()) == [("A", float(i), False) for i in range(5)]
    before = files(f"{top}/s")
    got = store.get(want("A", "b", "zzz"), fetch, "eod", "2024-01-02")
    assert {(r.symbol, r.from_cache) for r in got.collect()} == {("A", True), ("B", False)}
    assert asked == [["A"], ["B", "ZZZ"]] and before.items() <= files(f"{top}/s").items()
    assert {(r.symbol, r.points, r.start, r.end, r.source, str(r.fetched_on)) for r in store.manifest().collect()} == {
        ("A", 5, day(0), day(4), "eod", "2024-01-01"), ("B", 5, day(0), day(4), "eod", "2024-01-02"),
    }
    # Again: nothing is missing, nothing is written.
    before = files(f"{top}/s")
    assert store.get(want("A", "B")).count() == 10 and before == files(f"{top}/s")
    store.get(want("a"), lambda m: m.select("symbol", F.lit(day(9)).alias("date"), F.lit(9.0).alias("price")), "new", "2024-02-01", refetch=True)
    assert {(r.symbol, r.points, r.source) for r in store.manifest().collect()} == {("A", 1, "new"), ("B", 5, "eod")}


def test_merge_leaves_other_months_alone(spark, top):
    t = VersionedPrices(spark, f"{top}/m")
    t.merge(spark.createDataFrame([(s, day(i), float(i), 1) for s in "ab" for i in range(0, 90, 10)], ROWS), 1)
    before = files(f"{top}/m")
    second = spark.createDataFrame([("a", day(40), 400.0, 2), ("a", day(41), 410.0, 2), ("b", day(40), 1.0, 0), ("c", day(41), None, 2), (None, day(1), 1.0, 2), ("d", day(300), 5.0, 2)], ROWS)
    t.merge(second, 2)
    after = files(f"{top}/m")
    assert before.items() <= after.items()
    assert {p.split("/")[0] for p in after.keys() - before.keys()} == {"month=2020-02", "month=2020-10", "log"}
    want = {(s, day(i)): float(i) for s in "ab" for i in range(0, 90, 10)} | {("a", day(40)): 400.0, ("a", day(41)): 410.0, ("d", day(300)): 5.0}
    rows = lambda n=None: {(r.symbol, r.date): r.price for r in t.read(n).collect()}
    assert rows() == want and rows(1) == {(s, day(i)): float(i) for s in "ab" for i in range(0, 90, 10)}
    assert {r.month: (r.at, r.rows) for r in t.months().collect()}["2020-02"] == (2, 5)
    t.merge(second, 2)
    assert rows() == want and t.latest() == 2
    t.merge(second.limit(0), 3)
    assert rows() == want and t.latest() == 3
    assert {r.symbol: r.last for r in t.high_water().collect()} == {"a": day(80), "b": day(80), "d": day(300)}


def test_unfinished_merge_is_not_seen(spark, top):
    t = VersionedPrices(spark, f"{top}/m")
    t.merge(spark.createDataFrame([("a", day(1), 1.0, 1)], ROWS), 1)
    # The months of merge 2 are written but its list is not.
    spark.createDataFrame([("a", day(1), 9.0, 2, "2020-01", 2)], f"{ROWS}, month string, version int").write.mode("append").partitionBy("month", "version").parquet(f"{top}/m")
    assert [r.price for r in t.read().collect()] == [1.0]
    t.merge(spark.createDataFrame([("a", day(1), 3.0, 2)], ROWS), 2)
    assert [r.price for r in t.read().collect()] == [3.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_the_last_ord(spark, top, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), day(rng.randrange(100)), float(rng.randrange(1000)), k) for k in range(300)]
    want = {}
    for s, d, p, k in rows:
        want[s, d] = max(want.get((s, d), (-1, 0)), (k, p))
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], ROWS).write.mode("append").parquet(f"{top}/in")
        sync(spark.readStream.schema(ROWS).parquet(f"{top}/in"), f"{top}/out", f"{top}/check").awaitTermination()
    assert {(r.symbol, r.date): (r.ord, r.price) for r in VersionedPrices(spark, f"{top}/out").read().collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_running_drawdown_in_random_batches(spark, top, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(["x", "y", "z", None]), k, start + dt.timedelta(seconds=rng.randrange(100), microseconds=rng.randrange(3)), float(rng.choice([-1, 0, 1, 2, 5, 9]))) for k in range(120)]
    rows += [("x", 500, None, 1.0), ("x", 501, start, float("nan")), ("y", 502, start, None)]
    want = {}
    peaks = {}
    for s, k, at, v in sorted((r for r in rows if r[0] and r[2] and r[3] == r[3] and r[3] is not None), key=lambda r: (r[0], r[2], r[1])):
        peaks[s] = max(peaks.get(s, v), v)
        want[k] = (s, v, peaks[s], 1 - v / peaks[s] if peaks[s] > 0 else None)
    rng.shuffle(rows)
    frames = [spark.createDataFrame(rows[k::3], "symbol string, id long, at timestamp, value double") for k in range(3)]
    got = replay(frames, f"{top}/r", "1 hour").collect()
    assert {r.id: (r.symbol, r.value, r.peak, r.dd) for r in got} == want and len(got) == len(want)


def test_rows_behind_the_watermark_are_dropped(spark, top):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    frames = [
        spark.createDataFrame(r, "symbol string, id long, at timestamp, value double")
        for r in ([("x", 1, at(0), 5.0), ("x", 2, at(30), 4.0)], [("x", 3, at(10), 100.0), ("x", 4, at(28), 8.0)], [("x", 5, at(40), 2.0)])
    ]
    got = sorted((r.id, r.peak) for r in replay(frames, f"{top}/r", "5 minutes").collect())
    assert got == [(1, 5.0), (2, 8.0), (4, 8.0), (5, 8.0)]


def test_files_follow_rows_and_the_last_write_counts(spark, top):
    store = SeriesStore(spark, f"{top}/s")
    store.write(spark.createDataFrame([(f"s{k}", day(i), 1.0) for k in range(60) for i in range(3)], PRICES), "old")
    assert len(files(f"{top}/s")) <= 4
    store.write(spark.createDataFrame([("s7", day(9), 2.0)], PRICES), "new")
    # What an unfinished write leaves is not seen.
    spark.createDataFrame([("S8", day(1), 9.0)], PRICES).write.parquet(f"{top}/s/write=3")
    Path(f"{top}/s/write=3/_SUCCESS").unlink()
    got = {r.symbol: (r.points, r.source) for r in store.manifest().collect()}
    assert len(got) == 60 and got["S7"] == (1, "new") and all(v == (3, "old") for s, v in got.items() if s != "S7")


def test_a_repeated_batch_writes_the_same(spark, top):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    frames = [spark.createDataFrame([("x", k, at(10 * k), float(9 - k)), ("y", k, at(10 * k + 1), float(k))], "symbol string, id long, at timestamp, value double") for k in range(4)]
    first = sorted(map(tuple, replay(frames, f"{top}/r", "5 minutes").collect()))
    assert len(first) == 8
    last = max(int(p.name) for p in Path(f"{top}/r/checkpoint/commits").iterdir() if p.name.isdigit())
    for p in Path(f"{top}/r/checkpoint/commits").glob(f"*{last}*"):
        p.unlink()
    running_drawdown(spark.readStream.schema(ROW).parquet(f"{top}/r/in"), f"{top}/r", "5 minutes").awaitTermination()
    assert sorted(map(tuple, spark.read.schema(OUT).parquet(f"{top}/r/out").select("symbol", "id", "at", "value", "peak", "dd").collect())) == first
