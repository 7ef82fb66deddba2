"""Risk of many panels at once, as relations over (panel, symbol, week, r), keyed by panel and symbol pair.

A panel is a contract's menu. Weeks in which a symbol of the panel has no return are left out, as are null
returns; panels under `least` full weeks give nothing. Nothing is gathered per panel but what has one row a
symbol (the edges of its tree, the order of its leaves): pairs stay rows. Dealing a panel's symbols into
blocks keeps a panel with many symbols from meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled


def full_weeks(returns: DataFrame, least: int = 8) -> DataFrame:
    """Rows of the weeks in which all symbols of the panel have a return, of panels with `least` such weeks."""
    known = returns.where("r is not null and not isnan(r)").select("panel", "symbol", "week", "r")
    size = known.groupBy("panel").agg(F.count_distinct("symbol").alias("all"))
    week = known.groupBy("panel", "week").agg(F.count("*").alias("n")).join(size, "panel").where(F.col("n") == F.col("all"))
    enough = week.groupBy("panel").agg(F.count("*").alias("weeks")).where(F.col("weeks") >= least).select("panel")
    return known.join(week.select("panel", "week").join(enough, "panel"), ["panel", "week"], "left_semi")


def centred(returns: DataFrame) -> DataFrame:
    mean = returns.groupBy("panel", "symbol").agg(F.avg("r").alias("mean"))
    return returns.join(mean, ["panel", "symbol"]).select("panel", "symbol", "week", (F.col("r") - F.col("mean")).alias("r"))


def pair_sums(returns: DataFrame, block: int = 256) -> DataFrame:
    """(panel, x, y, n, sxy, sxxyy) with x <= y: sums of products and of their squares over centred returns."""
    blocks = F.greatest(F.lit(1), F.ceil(F.count_distinct("symbol") / block)).cast("int")
    rows = centred(returns)
    rows = rows.join(returns.groupBy("panel").agg(blocks.alias("blocks")), "panel").withColumn(
        "at", F.pmod(F.xxhash64("symbol"), F.col("blocks")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = rows.select("panel", "week", F.col("symbol").alias("x"), F.col("r").alias("rx"), F.col("at").alias("i"), every.alias("j"))
    b = rows.select("panel", "week", F.col("symbol").alias("y"), F.col("r").alias("ry"), every.alias("i"), F.col("at").alias("j"))
    p = F.col("rx") * F.col("ry")
    return a.join(b, ["panel", "week", "i", "j"]).where("x <= y").groupBy("panel", "x", "y").agg(
        F.count("*").alias("n"), F.sum(p).alias("sxy"), F.sum(p * p).alias("sxxyy")
    )


def moments(returns: DataFrame) -> DataFrame:
    """(panel, x, y, cov, corr) with x <= y, sample covariance; correlation with a constant series is null."""
    sums = settled(pair_sums(returns), "panel-sums")
    own = sums.where("x = y").select("panel", F.col("x").alias("s"), F.col("sxy").alias("ss"))
    left, right = (own.select("panel", F.col("s").alias(c), F.col("ss").alias(f"s{c}{c}")) for c in ("x", "y"))
    scale = F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))
    return sums.join(left, ["panel", "x"]).join(right, ["panel", "y"]).select(
        "panel", "x", "y", (F.col("sxy") / (F.col("n") - 1)).alias("cov"), F.try_divide(F.col("sxy"), F.nullif(scale, F.lit(0.0))).alias("corr")
    )


def shrunk_covariance(returns: DataFrame, least: int = 8) -> DataFrame:
    """(panel, x, y, cov, shrinkage) with x <= y: Ledoit and Wolf's estimate, of divisor n, from sums over pairs.

    With S the covariance, m its mean variance and d = |S - m I|^2, the shrinkage is the share of d that noise
    explains, sum(mean(x_i^2 x_j^2) - s_ij^2) / n, at most 1; it is 0 where S is a multiple of I.
    """
    pair = settled(pair_sums(settled(full_weeks(returns, least), "panel-weeks")), "panel-sums")
    twice = F.when(F.col("x") == F.col("y"), 1.0).otherwise(2.0)
    s = F.col("sxy") / F.col("n")
    whole = pair.groupBy("panel").agg(
        F.max("n").alias("weeks"), F.sum(F.when(F.col("x") == F.col("y"), s)).alias("trace"), F.sum(F.when(F.col("x") == F.col("y"), 1)).alias("k"),
        F.sum(twice * s * s).alias("squares"), F.sum(twice * F.col("sxxyy") / F.col("n")).alias("fourth"),
    )
    m = F.col("trace") / F.col("k")
    spread = F.col("squares") - F.col("k") * m * m
    noise = F.greatest(F.lit(0.0), F.col("fourth") - F.col("squares")) / F.col("weeks")
    # Rounding leaves a trace of spread where there is none.
    share = F.when(spread > 1e-14 * F.col("squares"), F.least(F.lit(1.0), noise / spread)).otherwise(0.0)
    whole = whole.select("panel", m.alias("m"), share.alias("shrinkage"))
    on = F.when(F.col("x") == F.col("y"), F.col("shrinkage") * F.col("m")).otherwise(0.0)
    return pair.join(whole, "panel").select("panel", "x", "y", ((1 - F.col("shrinkage")) * s + on).alias("cov"), "shrinkage")


def spanning_trees(edges: DataFrame) -> DataFrame:
    """(panel, d, x, y): the edges of each panel's minimum spanning tree, from (panel, x, y, d), by Boruvka's rounds.

    In a round every tree picks its least edge in the order (d, x, y), trees hang on the one picked, roots are
    found by doubling pointers, and only edges between different trees go on. The number of trees halves at
    least, so there are log2(symbols) rounds for the largest panel, and all panels share them.
    """
    left = settled(edges.select("panel", "x", "y", "d", F.col("x").alias("a"), F.col("y").alias("b")), "tree-edges")
    picked = None
    while not left.isEmpty():
        ends = left.select("panel", F.explode(F.array(F.struct(F.col("a").alias("tree"), F.col("b").alias("up")), F.struct(F.col("b").alias("tree"), F.col("a").alias("up")))).alias("t"), "d", "x", "y")
        best = settled(
            ends.groupBy("panel", "t.tree").agg(F.min(F.struct("d", "x", "y", "t.up")).alias("e")).select("panel", "tree", "e.d", "e.x", "e.y", "e.up"), "tree-best"
        )
        found = best.select("panel", "d", "x", "y").distinct()
        picked = found if picked is None else picked.unionByName(found)
        # Only pairs that pick the same edge hang on each other; the smaller name is their root.
        other = best.select("panel", F.col("tree").alias("up"), F.col("up").alias("upper"))
        parent = settled(
            best.join(other, ["panel", "up"]).select("panel", "tree", F.when((F.col("upper") == F.col("tree")) & (F.col("tree") < F.col("up")), F.col("tree")).otherwise(F.col("up")).alias("up")),
            "tree-parents",
        )
        while True:
            upper = parent.select("panel", F.col("tree").alias("up"), F.col("up").alias("upper"))
            jumped = settled(parent.join(upper, ["panel", "up"]).select("panel", "tree", F.col("upper").alias("up"), (F.col("up") != F.col("upper")).alias("moved")), "tree-parents")
            parent = jumped.select("panel", "tree", "up")
            if jumped.where("moved").isEmpty():
                break
        roots = {c: parent.select("panel", F.col("tree").alias(c), F.col("up").alias(f"root_{c}")) for c in ("a", "b")}
        left = settled(
            left.join(roots["a"], ["panel", "a"]).join(roots["b"], ["panel", "b"]).where("root_a <> root_b")
            .select("panel", "x", "y", "d", F.col("root_a").alias("a"), F.col("root_b").alias("b")),
            "tree-edges",
        )
    return edges.select("panel", "d", "x", "y").limit(0) if picked is None else picked


def leaf_order(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(panel, symbol, at, size): leaves of single linkage, from (panel, x, y, d) and (panel, symbol).

    The tree's edges in order are the merges; of two clusters the older goes left, single symbols by name.
    A panel's edges, one less than its symbols, are folded in one row.
    """
    tree = spanning_trees(edges).groupBy("panel").agg(F.sort_array(F.collect_list(F.struct("d", "x", "y"))).alias("merges"))
    names = symbols.groupBy("panel").agg(F.sort_array(F.collect_set("symbol")).alias("names"))
    kind = "array<struct<id:int,leaves:array<string>>>"
    start = F.transform("names", lambda s, i: F.struct(i.alias("id"), F.array(s).alias("leaves"))).cast(kind)

    def merged(state, e):
        def holder(s):
            return F.filter(state, lambda g: F.array_contains(g["leaves"], s))[0]

        a, b = holder(e["x"]), holder(e["y"])
        rest = F.filter(state, lambda g: (g["id"] != a["id"]) & (g["id"] != b["id"]))
        leaves = F.when(a["id"] < b["id"], F.concat(a["leaves"], b["leaves"])).otherwise(F.concat(b["leaves"], a["leaves"]))
        new = F.struct((F.array_max(F.transform(state, lambda g: g["id"])) + 1).alias("id"), leaves.alias("leaves"))
        return F.concat(rest, F.array(new)).cast(kind)

    merges = F.coalesce("merges", F.array().cast("array<struct<d:double,x:string,y:string>>"))
    one = names.join(tree, "panel", "left").select("panel", F.size("names").alias("size"), F.aggregate(merges, start, merged)[0]["leaves"].alias("leaves"))
    return one.select("panel", "size", F.posexplode("leaves").alias("at", "symbol")).select("panel", "symbol", "at", "size")


def bisections(leaves: DataFrame) -> DataFrame:
    """(panel, symbol, level, low, up, first): the halves that hold a leaf, with where they and the halved part begin.

    Which half holds a leaf follows from its place and the number of leaves alone, so all levels come at once.
    """
    state = "struct<low:int,size:int,path:array<struct<level:int,low:int,up:int,first:boolean>>>"
    start = F.struct(F.lit(0).alias("low"), F.col("size"), F.array().cast("array<struct<level:int,low:int,up:int,first:boolean>>").alias("path")).cast(state)

    def step(s, level):
        half = F.floor(s["size"] / 2).cast("int")
        first = F.col("at") < s["low"] + half
        low = F.when(first, s["low"]).otherwise(s["low"] + half)
        part = F.struct(level.alias("level"), low.alias("low"), s["low"].alias("up"), first.alias("first"))
        halved = F.struct(low.alias("low"), F.when(first, half).otherwise(s["size"] - half).alias("size"), F.concat(s["path"], F.array(part)).alias("path"))
        return F.when(s["size"] < 2, s).otherwise(halved).cast(state)

    path = F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step)["path"]
    return leaves.select("panel", "symbol", F.explode(path).alias("p")).select("panel", "symbol", "p.level", "p.low", "p.up", "p.first")


def risk_parity(returns: DataFrame, cap: float | None = None, least: int = 8) -> DataFrame:
    """(panel, symbol, w): hierarchical risk parity, the halves of the leaf order sharing by inverse cluster variance.

    Distances are sqrt((1 - corr) / 2). A cluster's variance is that of its inverse-variance weights. Halves of
    which neither varies share equally; constant series get no weight and no row; one symbol gets all. With a
    cap, weights are cut to it and divided by their sum, once.
    """
    pair = settled(moments(settled(full_weeks(returns, least), "panel-weeks")), "panel-moments")
    inverse = pair.where("x = y and cov > 0").select("panel", F.col("x").alias("symbol"), (1 / F.col("cov")).alias("iv"))
    distance = F.sqrt(F.greatest(F.lit(0.0), 0.5 * (1 - F.col("corr"))))
    leaves = settled(leaf_order(pair.where("x < y and corr is not null").select("panel", "x", "y", distance.alias("d")), inverse), "panel-leaves")
    parts = settled(bisections(leaves).join(inverse, ["panel", "symbol"]), "panel-parts")
    place = ["panel", "level", "low"]
    left = parts.select(*place, F.col("symbol").alias("x"), F.col("iv").alias("ix"))
    right = parts.select(*place, F.col("symbol").alias("y"), F.col("iv").alias("iy"))
    twice = F.when(F.col("x") == F.col("y"), 1.0).otherwise(2.0)
    risk = (
        pair.join(left, ["panel", "x"]).join(right, [*place, "y"]).groupBy(*place)
        .agg(F.sum(twice * F.col("ix") * F.col("cov") * F.col("iy")).alias("top"), F.sum(F.when(F.col("x") == F.col("y"), F.col("ix"))).alias("whole"))
        .select(*place, (F.col("top") / F.col("whole") / F.col("whole")).alias("v"))
    )
    halved = parts.select(*place, "up", "first").distinct().join(risk, place)
    split = halved.groupBy("panel", "level", "up").agg(F.max(F.when(F.col("first"), F.col("v"))).alias("v1"), F.max(F.when(~F.col("first"), F.col("v"))).alias("v2"))
    share = F.coalesce(F.try_divide(F.col("v1"), F.nullif(F.col("v1") + F.col("v2"), F.lit(0.0))), F.lit(0.5))
    factor = F.when(F.col("first"), 1 - F.col("share")).otherwise(F.col("share"))
    part = parts.join(split.select("panel", "level", "up", share.alias("share")), ["panel", "level", "up"]).groupBy("panel", "symbol").agg(F.product(factor).alias("w"))
    w = leaves.join(part, ["panel", "symbol"], "left").select("panel", "symbol", F.coalesce("w", F.lit(1.0)).alias("w"))
    if cap:
        w = w.withColumn("w", F.least("w", F.lit(cap)))
    return w.join(w.groupBy("panel").agg(F.sum("w").alias("all")), "panel").select("panel", "symbol", (F.col("w") / F.col("all")).alias("w"))
