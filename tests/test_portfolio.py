"""Allocation against grids of weights, screening against ranks in pandas, the stream against one merge."""

import itertools
import tempfile

import numpy as np
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as E
from ebbtide.operators import allocate as A
from ebbtide.operators import series as S
from ebbtide.sources.panel import ticks
from ebbtide.sources.store import VersionedPrices
from ebbtide.streaming.sync import sync

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def returns(seed, n=3, t=300):
    rng = np.random.default_rng(seed)
    return rng.normal(0.001, [0.01, 0.02, 0.03][:n], (t, n)) + rng.normal(0, 0.01, (t, 1))


def grid(cap, step=0.02):
    k = round(1 / step)
    return [np.array([a, b, k - a - b]) * step for a, b in itertools.product(range(k + 1), repeat=2) if a + b <= k and max(a, b, k - a - b) * step <= cap + 1e-9]


@pytest.mark.parametrize("seed", range(3))
def test_cdar_weights(seed):
    r = returns(seed)
    cum = np.vstack([np.zeros(3), r.cumsum(0)])
    risk = lambda w: A.cdar_and_slope(w, cum, 0.95)[0]
    w = A.min_cdar(r, cap=0.6)
    assert abs(w.sum() - 1) < 1e-6 and w.max() < 0.6 + 1e-6
    best = min(map(risk, grid(0.6)))
    assert risk(w) <= best * 1.01
    budget = 1.2 * best
    m = A.max_return(r, budget, cap=0.6)
    assert risk(m) <= budget + 1e-6
    assert r.mean(0) @ m >= max(r.mean(0) @ g for g in grid(0.6) if risk(g) <= budget) - 2e-5
    assert A.max_return(r, best / 2, cap=0.6) is None


def test_cdar_value():
    r = returns(5)
    w = np.full(3, 1 / 3)
    path = np.concatenate([[0], (r @ w).cumsum()])
    dd = np.sort((np.maximum.accumulate(path) - path)[1:])
    assert np.isclose(A.cdar_and_slope(w, np.vstack([np.zeros(3), r.cumsum(0)]), 0.95)[0], dd[-15:].mean())


def test_other_weights():
    r = returns(1)
    for w in (A.risk_parity(r), A.min_variance(r, 0.5)):
        assert np.isclose(w.sum(), 1) and (w >= 0).all() and w[0] > w[2]
    assert A.min_variance(r, 0.5).max() <= 0.5 + 1e-9
    assert sorted(A.leaf_order(np.abs(np.subtract.outer([0, 9, 1, 10], [0, 9, 1, 10])).astype(float))) == [0, 1, 2, 3]


def test_screening(spark):
    m = S.summary(S.weekly_returns(ticks(spark, SF))).toPandas()
    want = 0
    for c, w, up in (("cagr", 22, True), ("sharpe", 24, True), ("calmar", 24, True), ("cdar", 18, False), ("max_dd", 12, False)):
        v = m[c] if up else -m[c]
        want += w * ((v.rank(method="min") - 1) / (v.count() - 1)).fillna(0)
    got = E.queries()["screening_score"](spark, SF).toPandas().set_index("symbol").score
    assert np.allclose(got[m.symbol].to_numpy(), want, atol=0.006)


@pytest.mark.parametrize("name", ["weights_min_cdar", "weights_min_variance", "frontier"])
def test_registered(spark, name):
    rows = E.queries()[name](spark, SF).toPandas()
    by = ["panel", "point"] if "point" in rows else ["panel"]
    assert len(rows) and np.allclose(rows.groupby(by).w.sum(), 1, atol=1e-6)


def test_stream(spark):
    top = tempfile.mkdtemp(prefix="spark-sync-", dir="/tmp")
    schema = "symbol string, date date, price double, ord long"
    for k, rows in enumerate([[("a", 1.0), ("b", 2.0), (None, 1.0)], [("a", 3.0), ("c", float("nan"))]]):
        spark.createDataFrame([(s, p, k) for s, p in rows], "symbol string, price double, ord long").selectExpr(
            "symbol", "date '2020-01-03' as date", "price", "ord"
        ).write.mode("append").parquet(f"{top}/in")
        sync(spark.readStream.schema(schema).parquet(f"{top}/in"), f"{top}/out", f"{top}/check").awaitTermination()
    got = sorted((r.symbol, r.price) for r in VersionedPrices(spark, f"{top}/out").read().collect())
    assert got == [("a", 3.0), ("b", 2.0)]


def test_frontier_points(spark):
    rows = E.queries()["frontier"](spark, SF).toPandas()
    assert rows.point.max() == 13 and np.allclose(rows.groupby("point").w.sum(), 1, atol=1e-6)
