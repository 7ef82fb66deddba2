"""Panel relations against numpy on small panels: hierarchical risk parity, shrinkage, spanning trees, baskets."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import allocate as A
from ebbtide.operators import backfill, baskets, panel_risk
from ebbtide.operators import series as S

RETURNS = "panel string, symbol string, week date, r double"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def week(t):
    return dt.date(2000, 1, 7) + dt.timedelta(7 * t)


def panels():
    rng, rows, full = np.random.default_rng(1), [], {}
    for name, n, t in [("a", 6, 60), ("b", 9, 40), ("c", 1, 30), ("d", 2, 50), ("e", 17, 100), ("short", 3, 7)]:
        x = rng.normal(0, rng.uniform(0.5, 2, n), (t, n)) @ rng.normal(0, 1, (n, n)) * 0.02
        rows += [(name, f"s{i:02d}", week(k), float(x[k, i])) for k in range(t) for i in range(n)]
        full[name] = x
    # A week that one symbol lacks and one in which it is null do not count, nor does a constant symbol get weight.
    rows += [("a", "s00", week(900), 9.0), ("b", "s00", week(900), None), *[("b", f"s{i:02d}", week(900), 5.0) for i in range(1, 9)]]
    rows += [("flat", s, week(k), v) for k in range(20) for s, v in (("one", 0.5), ("two", float(k % 3)), ("three", float(k % 2)))]
    return rows, full


@pytest.fixture(scope="module")
def returns(spark):
    return spark.createDataFrame(panels()[0], RETURNS).repartition(3)


def by_panel(rows, value):
    out = {}
    for r in rows:
        out.setdefault(r.panel, {})[r.symbol] = r[value]
    return out


@pytest.mark.parametrize("cap", [None, 0.2])
def test_risk_parity_equals_numpy(returns, cap):
    got = by_panel(panel_risk.risk_parity(returns, cap).collect(), "w")
    full = panels()[1]
    assert set(got) == {"a", "b", "c", "d", "e", "flat"} and set(got["flat"]) == {"two", "three"}
    for name in "abde":
        want = A.risk_parity(full[name], cap)
        assert np.allclose([got[name][f"s{i:02d}"] for i in range(len(want))], want, atol=1e-12)
    assert got["c"] == {"s00": 1.0} and abs(sum(got["flat"].values()) - 1) < 1e-12


def test_shrinkage_equals_numpy(returns):
    got = panel_risk.shrunk_covariance(returns).collect()
    for name, x in panels()[1].items():
        mine = [r for r in got if r.panel == name]
        if name == "short":
            assert not mine
            continue
        cov, k = A.shrunk_covariance(x)
        n = x.shape[1]
        assert len(mine) == n * (n + 1) // 2 and np.allclose([r.shrinkage for r in mine], k, atol=1e-9)
        assert np.allclose([r["cov"] for r in mine], [cov[int(r.x[1:]), int(r.y[1:])] for r in mine], atol=1e-12)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_pairs_do_not_depend_on_blocks(returns, block):
    one = returns.where("panel = 'e'")
    rows = lambda b: {(r.x, r.y): (r.n, round(r.sxy, 8)) for r in panel_risk.pair_sums(one, b).collect()}
    assert rows(block) == rows(256) and len(rows(block)) == 17 * 18 // 2


def kruskal(edges):
    tree, of = [], {}
    for d, x, y in sorted(edges):
        a, b = of.get(x, {x}), of.get(y, {y})
        if a is not b and not a & b:
            tree.append((d, x, y))
            for s in a | b:
                of[s] = a | b
    return tree


def test_spanning_trees_with_ties(spark):
    rng = np.random.default_rng(2)
    rows, want = [], set()
    for p, n in [("x", 2), ("y", 5), ("z", 23), ("line", 40)]:
        names = [f"n{i:02d}" for i in range(n)]
        edges = [(float(j - i if p == "line" else rng.integers(0, 4)), names[i], names[j]) for i in range(n) for j in range(i + 1, n)]
        rows += [(p, x, y, d) for d, x, y in edges]
        want |= {(p, *e) for e in kruskal(edges)}
    got = panel_risk.spanning_trees(spark.createDataFrame(rows, "panel string, x string, y string, d double"))
    assert {tuple(r) for r in got.select("panel", "d", "x", "y").collect()} == want and got.count() == len(want)


def test_no_panels(spark):
    none = spark.createDataFrame([], RETURNS)
    assert panel_risk.risk_parity(none).count() == 0 and panel_risk.shrunk_covariance(none).count() == 0


NAMES = ["WORLD", "EUROPE", "BONDS", "RE", "GOLD"]


def funds():
    rng = np.random.default_rng(3)
    t = 200
    f = rng.normal(0, 0.02, (t, 1)) + rng.normal(0, 0.01, (t, 5))
    rows, priors, data = [], [], {}
    for k in range(24):
        n = [0, 1, 2, 3, 5, 10, 50, 200][k % 8]
        y = f @ np.maximum(0, rng.normal(0.2, 0.3, 5)) + rng.normal(0, 0.005, t)
        if k == 21:
            y[:] = 0.01
        at = int(rng.integers(0, t - n + 1))
        rows += [(k, week(i), float(y[i])) for i in range(at, at + n)] + [(k, week(900), 0.5), (k, week(0) if at else week(901), None)]
        prior = dict(zip(NAMES, rng.dirichlet(np.ones(5)).tolist())) | {"CASH": 0.1}
        if k % 5 == 0:
            prior.pop("RE")
        priors += [(k, name, w) for name, w in prior.items()]
        data[k] = (f[at : at + n], y[at : at + n], prior)
    factors = [(name, week(i), float(f[i, j])) for j, name in enumerate(NAMES) for i in range(t)] + [("WORLD", week(900), 0.1), ("CASH", week(3), 0.0)]
    return rows, factors, priors, data


def test_baskets_are_optimal(spark):
    rows, factors, priors, data = funds()
    tables = spark.createDataFrame(rows, "fund int, week date, y double"), spark.createDataFrame(factors, "factor string, week date, f double")
    prior = spark.createDataFrame(priors, "fund int, factor string, w double")
    raw, mixed = ({(r.fund, r.factor): r for r in baskets.fit(*tables, prior, NAMES, blend=b).collect()} for b in (False, True))
    for k, (x, y, p) in data.items():
        n = len(y)
        if n < 2:
            assert {f: raw[g, f].w for g, f in raw if g == k} == p
            continue
        base = np.array([p.get(f, 0.0) for f in NAMES])
        w = np.array([raw[k, f].w if (k, f) in raw else 0.0 for f in NAMES])
        slope = x.T @ (x @ w - y) + 6 / n * (w - base)
        # The conditions of a minimum: no slope where a weight is positive, none downwards where it is zero, but for weights left out.
        assert np.abs(slope[w > 0]).max(initial=0) < 1e-6 and slope[w == 0].min(initial=0) > -4e-4
        one = next(raw[g, f] for g, f in raw if g == k)
        r2 = 1 - ((y - x @ w) ** 2).sum() / (((y - y.mean()) ** 2).sum() if k != 21 else 1.0)
        assert one.n == n and abs(one.r2 - r2) < 1e-6
        c = min(1, max(0, r2)) * n / (n + 6)
        both = c * w + (1 - c) * base
        assert np.allclose([mixed[k, f].w if (k, f) in mixed else 0 for f in NAMES], np.where(both > 1e-4, both, 0), atol=1e-5)


def test_trained_priors(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(0, 0.02, (400, 5))
    true = np.array([0.6, 0.0, 0.3, 0.1, 0.0])
    rows = [("mix", week(i), float(f[i] @ true)) for i in range(400)] + [("none", week(2000), 0.1)]
    factors = [(name, week(i), float(f[i, j])) for j, name in enumerate(NAMES) for i in range(400)]
    got = {}
    for r in baskets.trained_priors(spark.createDataFrame(rows, "fund string, week date, y double"), spark.createDataFrame(factors, "factor string, week date, f double"), NAMES).collect():
        got.setdefault(r.fund, {})[r.factor] = r.w
    assert got["none"] == {n: pytest.approx(0.2) for n in NAMES} and sum(got["mix"].values()) == pytest.approx(1)
    assert np.allclose([got["mix"].get(n, 0) for n in NAMES], true, atol=0.03)


def test_priors_add_up(spark):
    by = baskets.category_priors(spark).groupBy("category").agg(F.round(F.sum("w"), 9).alias("w")).collect()
    assert len(by) == 10 and all(r.w == 1.0 for r in by) and baskets.factor_symbols(spark).where("to_eur").count() == 4


def test_degenerate_series(spark):
    rows = [("flat", week(i), 0.0) for i in range(9)] + [("lost", week(i), -1.0 if i == 0 else 0.1) for i in range(9)] + [("x", week(i), i * 0.01) for i in range(9)]
    r = spark.createDataFrame(rows, "symbol string, week date, r double")
    corr = {(c.x, c.y): c.corr for c in S.covariance(r).collect()}
    assert corr["flat", "x"] is None and corr["flat", "flat"] is None and corr["x", "x"] == pytest.approx(1)
    assert {d.dd for d in S.drawdowns(r).where("symbol = 'lost'").collect()} == {None}
    assert S.summary(r).count() == 3


def test_every_week_of_the_panel(spark):
    r = spark.createDataFrame([("a", week(0), 0.1), ("a", week(3), None), ("b", week(1), 0.2), ("c", week(5), 0.3)], "symbol string, week date, r double")
    w = spark.createDataFrame([("p", "a", 1.0), ("q", "zzz", 1.0)], "portfolio string, symbol string, w double")
    got = {(x.portfolio, x.week): x.r for x in S.portfolio_returns(r, w).collect()}
    assert got == {(p, week(i)): 0.1 if (p, i) == ("p", 0) else 0.0 for p in "pq" for i in (0, 1, 3, 5)}
    spine = S.week_spine(r.withColumn("panel", F.lit("all")))
    assert [x.week for x in spine.orderBy("week").collect()] == [week(i) for i in range(6)]


def test_basket_level(spark):
    f = spark.createDataFrame([("x", week(i), 0.01 * i) for i in range(5)], "symbol string, week date, r double")
    w = spark.createDataFrame([("f", "x", 0.5), ("g", "x", 0.5)], "fund string, symbol string, w double")
    level = spark.createDataFrame([("f", 0.05)], "fund string, annual double")
    got = {(r.fund, r.week): r.r for r in backfill.basket(f, w, 0.001, level).collect()}
    assert np.mean([got["f", week(i)] for i in range(5)]) == pytest.approx(1.05 ** (1 / 52) - 1)
    assert got["g", week(4)] == pytest.approx(0.019)


def test_descent_equals_a_plain_loop(spark):
    import pyarrow as pa

    rng = random.Random(3)
    rows = []
    for n in (0, 1, 2, 5, 40):
        f = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(n)]
        y = [rng.gauss(0, 1) for _ in range(n)]
        g = [[sum(a[i] * a[j] for a in f) + 0.0 for j in range(3)] for i in range(3)]
        rows.append({"n": n, "b": [sum(a[i] * v for a, v in zip(f, y)) + 0.0 for i in range(3)], "g": g, "prior": [0.2, 0.5, 0.0]})
    got = next(baskets._descended(3, 6.0, 60)(iter([pa.RecordBatch.from_pylist(rows)]))).to_pylist()
    for r in got:
        w = list(r["prior"])
        for step in range(60 if r["n"] >= 2 else 0):
            j, lam = step % 3, 6.0 / r["n"]
            dot = sum(a * b for a, b in zip(r["g"][j], w))
            w[j] = max(0.0, (r["b"][j] + lam * r["prior"][j] - dot + r["g"][j][j] * w[j]) / (r["g"][j][j] + lam))
        assert r["w"] == pytest.approx(w, abs=1e-12)
