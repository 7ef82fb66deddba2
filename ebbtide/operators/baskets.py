"""Factor baskets: non-negative ridge fits towards a prior for many funds at once.

Funds are (fund, week, y), factors (factor, week, f), priors (fund, factor, w); what a prior lacks is 0. A week
counts if it has a return of the fund and of every factor. The sums of products, k (k + 1) / 2 of k factors, are
aggregates, so a fund of any length is one row when it is solved, and no fund's weeks meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.shared import settled

# The factors' symbols and whether they are converted to euros, and the priors of the fund categories.
FACTOR_SYMBOLS = {
    "WORLD": ("VFINX.US", True), "EUROPE": ("MSE.PA", False), "EM": ("VEIEX.US", True), "BONDS": ("IBCX.LSE", False),
    "RE": ("IPRP.LSE", False), "INFRA": ("XLU.US", True), "GOLD": ("XAUUSD.FOREX", True),
}
CATEGORY_PRIORS = {
    "OPCI": {"RE": 0.62, "BONDS": 0.28, "CASH": 0.10},
    "SCPI": {"RE": 0.92, "CASH": 0.08},
    "INFRA_NON_COTE": {"INFRA": 0.65, "WORLD": 0.15, "BONDS": 0.20},
    "MIXTE_PRUDENT": {"EUROPE": 0.32, "BONDS": 0.33, "CASH": 0.25, "RE": 0.05, "WORLD": 0.05},
    "MIXTE_EQUILIBRE": {"WORLD": 0.30, "EUROPE": 0.30, "BONDS": 0.30, "CASH": 0.10},
    "FLEXIBLE_OFFENSIF": {"WORLD": 0.35, "EUROPE": 0.35, "GOLD": 0.12, "CASH": 0.13, "RE": 0.05},
    "ACTIONS_MONDE": {"WORLD": 0.70, "EUROPE": 0.30},
    "ACTIONS_EUROPE": {"EUROPE": 0.90, "WORLD": 0.10},
    "OBLIGATIONS": {"BONDS": 0.90, "CASH": 0.10},
    "MONETAIRE": {"CASH": 1.00},
}
LEAST_WEIGHT = 1e-4


def category_priors(spark) -> DataFrame:
    """(category, factor, w)."""
    return spark.createDataFrame([(c, f, w) for c, p in CATEGORY_PRIORS.items() for f, w in p.items()], "category string, factor string, w double")


def factor_symbols(spark) -> DataFrame:
    """(factor, symbol, to_eur)."""
    return spark.createDataFrame([(f, *v) for f, v in FACTOR_SYMBOLS.items()], "factor string, symbol string, to_eur boolean")


def factor_panel(returns: DataFrame, names: list[str]) -> DataFrame:
    """(week, f): returns of the factors in the order of `names`, of the weeks that have them all."""
    known = returns.where(F.col("factor").isin(names) & F.col("f").isNotNull() & ~F.isnan("f"))
    by = known.groupBy("week").agg(*[F.max(F.when(F.col("factor") == n, F.col("f"))).alias(f"f{i}") for i, n in enumerate(names)])
    return by.dropna().select("week", F.array(*[f"f{i}" for i in range(len(names))]).alias("f"))


def _sums(funds: DataFrame, panel: DataFrame, k: int) -> DataFrame:
    """Per fund, with or without weeks that count: n, y, yy, b (F'y) and g (F'F by rows), with one aggregate for each pair of factors."""
    known = F.col("y").isNotNull() & ~F.isnan("y")
    rows = funds.select("fund", "week", F.when(known, F.col("y").cast("double")).alias("y")).join(F.broadcast(panel), "week", "left")
    rows = rows.select("fund", F.when(F.col("f").isNotNull(), F.col("y")).alias("y"), F.when(F.col("y").isNotNull(), F.col("f")).alias("f"))
    f = [F.col("f")[i] for i in range(k)]
    cells = [F.sum(f[i] * f[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    one = rows.groupBy("fund").agg(
        F.count("y").alias("n"), F.sum("y").alias("y"), F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(f[i] * F.col("y")).alias(f"b{i}") for i in range(k)], *cells
    )
    g = F.array(*[F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    return one.select("fund", "n", "y", "yy", F.array(*[f"b{i}" for i in range(k)]).alias("b"), g.alias("g"))


def _descended(k: int, strength: float, steps: int):
    """A function on Arrow batches (n, b, g, prior, ...) that adds w after coordinate descent, all funds of a batch at once."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index
            n = batch.column(at("n")).to_numpy(zero_copy_only=False)
            b, prior = (np.array(batch.column(at(c)).flatten()).reshape(-1, k) for c in ("b", "prior"))
            g, w = np.array(batch.column(at("g")).flatten().flatten()).reshape(-1, k, k), prior.copy()
            long = np.flatnonzero(n >= 2)
            ridge, b, g, p, x = strength / n[long], b[long], g[long], prior[long], w[long]
            if (np.diagonal(g, axis1=1, axis2=2) + ridge[:, None] == 0).any():
                raise ZeroDivisionError("without a ridge a factor is 0")
            for step in range(steps):
                j = step % k
                dot = np.zeros(len(x))
                for i in range(k):
                    dot = dot + g[:, j, i] * x[:, i]
                x[:, j] = np.maximum(0.0, (b[:, j] + ridge * p[:, j] - dot + g[:, j, j] * x[:, j]) / (g[:, j, j] + ridge))
            w[long] = x
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*batch.schema.names, "w"])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fit(funds: DataFrame, factors: DataFrame, priors: DataFrame, names: list[str], strength: float = 6.0, blend: bool = True, sweeps: int = 200) -> DataFrame:
    """(fund, factor, w, r2, n): weights w >= 0 that minimise |y - F w|^2 + (strength / n) |w - prior|^2.

    The ridge makes the minimum unique; projected coordinate descent goes round the factors `sweeps` times.
    With blend, weights mix with the prior by r2 and n; weights of at most 1e-4 are left out. Funds with fewer
    than two weeks have their whole prior and an r2 of 0; a constant fund's r2 is measured against 1, as is usual here.
    """
    k = len(names)
    panel = factor_panel(factors, names)
    prior = priors.groupBy("fund").agg(*[F.coalesce(F.sum(F.when(F.col("factor") == n, F.col("w"))), F.lit(0.0)).alias(f"p{i}") for i, n in enumerate(names)])
    prior = prior.select("fund", F.array(*[f"p{i}" for i in range(k)]).alias("prior"))
    nothing = F.array(*[F.lit(0.0)] * k)
    # What has no week that counts has nothing to sum; the descent skips it, but takes whole arrays.
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    summed = _sums(funds, panel, k).select("fund", "n", "y", "yy", F.transform("b", zero).alias("b"), F.transform("g", lambda r: F.transform(r, zero)).alias("g"))
    rows = summed.join(prior, "fund", "left").withColumn("prior", F.coalesce("prior", nothing))
    # A table of one row a fund, so that no later column repeats the descent.
    rows = settled(rows.mapInArrow(_descended(k, strength, sweeps * k), StructType([*rows.schema.fields, StructField("w", rows.schema["b"].dataType)])), "basket-weights")
    error = F.col("yy") - 2 * _dot(F.col("w"), F.col("b")) + _dot(F.col("w"), F.transform("g", lambda g: _dot(g, F.col("w"))))
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    # Sums of squares leave a trace where a fund is constant.
    total = F.when(spread > 1e-13 * F.col("yy"), spread).otherwise(1.0)
    rows = rows.withColumn("r2", F.when(F.col("n") >= 2, 1 - error / total).otherwise(0.0))
    if blend:
        c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r2"))) * (F.col("n") / (F.col("n") + 6.0))
        rows = rows.withColumn("w", F.when(F.col("n") >= 2, F.zip_with("w", "prior", lambda a, p: c * a + (1 - c) * p)).otherwise(F.col("prior")))
    named = rows.where("n >= 2").select("fund", F.posexplode("w").alias("i", "w"), "r2", "n").where(F.col("w") > LEAST_WEIGHT)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    short = rows.where("n < 2").select("fund", "r2", "n").join(priors.select("fund", "factor", "w"), "fund")
    return named.select("fund", name.alias("factor"), "w", "r2", "n").unionByName(short)


def trained_priors(categories: DataFrame, factors: DataFrame, names: list[str], base: DataFrame | None = None, strength: float = 1.0) -> DataFrame:
    """(fund, factor, w) that sum to 1: priors fitted to (fund, week, y), a category a fund; the base where nothing fits.

    Without a base, all factors count the same.
    """
    if base is None:
        even = F.explode(F.array(*map(F.lit, names))).alias("factor")
        base = categories.select("fund").distinct().select("fund", even, F.lit(1.0 / len(names)).alias("w"))
    found = fit(categories, factors, base, names, strength, blend=False)
    whole = found.groupBy("fund").agg(F.sum("w").alias("all"))
    own = found.join(whole, "fund").select("fund", "factor", (F.col("w") / F.col("all")).alias("w"))
    return own.unionByName(base.join(whole, "fund", "left_anti").select("fund", "factor", "w"))
