"""Registered queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import currency as M, series as S
from ..sources.panel import prices, table, ticks

PRICES = "p as (select o_orderpriority symbol, o_orderdate::date date, sum(o_totalprice::decimal(18,2))::double / count(*) price from orders group by 1, 2)"
TICKS = "p as (select 'S' || l_suppkey symbol, l_shipdate::date date, sum(l_extendedprice::decimal(18,2))::double / count(*) price from lineitem group by 1, 2)"
WEEKS = "k as (select symbol, date + ((12 - isodow(date)) % 7)::int as week, max_by(price, date) price from p group by 1, 2)"
RETURNS = "q as (select symbol, week, lag(week) over w before, price / lag(price) over w - 1 r from k window w as (partition by symbol order by week)), r as (select symbol, week, r from q where r is not null)"
EQ = "e as (select *, exp(sum(ln(1 + r)) over (partition by symbol order by week)) equity from r), d as (select *, 1 - equity / max(equity) over (partition by symbol order by week) dd from e)"
BASE = f"with {PRICES}, {WEEKS}, {RETURNS}"


def _r(df, *cols):
    return df.select(*[c for c in df.columns if c not in cols], *[F.round(c, 6).alias(c) for c in cols])


def _returns(s, d):
    return S.weekly_returns(prices(s, d))


def metrics(s, d):
    return S.summary(_returns(s, d))


def fx_as_of(s, d):
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("C"), F.col("n_regionkey")).alias("ccy"))
    li = table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")).join(F.broadcast(n), "k")
    o = table(s, d, "orders").join(li, "o_custkey")
    day = F.col("o_orderdate").cast("date")
    fx = o.where("o_orderstatus = 'O'").groupBy("ccy", day.alias("date")).agg((F.max("o_totalprice") / 1000).alias("rate"))
    px = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("symbol"), "ccy", day.alias("date"), F.col("o_totalprice").alias("price"))
    return M.as_of(px, fx)


def candidates(s, d):
    top = S.top_per_class(table(s, d, "part"), 4, "p_brand", F.col("p_retailprice"), F.col("p_partkey"))
    return top.select("p_brand", "p_partkey", "rank")


def merged(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ord"))
    old = o.where("ord % 3 <> 0").groupBy("symbol", "date").agg(F.max_by("price", "ord").alias("price"), F.max("ord").alias("ord"))
    return S.upsert(old, o.where("ord % 3 = 0"), ["symbol", "date"], F.col("ord"))


def proxy(s, d):
    r = S.weekly_returns(ticks(s, d))
    return _r(S.regression(r, r.groupBy("week").agg(F.avg("r").alias("p"))), "beta", "alpha")


QUERIES = {
    "prices_weekly_returns": lambda s, d: _r(_returns(s, d), "r"),
    "ticks_neighbour_returns": lambda s, d: _r(S.weekly_returns(ticks(s, d), over_gaps=False), "r"),
    "history_depth": lambda s, d: S.history_depth(ticks(s, d)),
    "min_history": lambda s, d: S.min_history(ticks(s, d), 60).groupBy("symbol").agg(F.count("*").alias("n")),
    "common_window": lambda s, d: _r(S.common_window(prices(s, d)).select("symbol", "date", "price"), "price"),
    "drawdown_curve": lambda s, d: _r(S.drawdowns(_returns(s, d)).select("symbol", "week", "dd"), "dd"),
    "metrics_summary": metrics,
    "covariance": lambda s, d: _r(S.covariance(_returns(s, d)).drop("corr"), "cov"),
    "regression": proxy,
    "unsmoothed_returns": lambda s, d: _r(S.unsmoothed(_returns(s, d)), "r"),
    "walk_forward_folds": lambda s, d: S.walk_forward(_returns(s, d)).groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.min("week").alias("lo"), F.max("week").alias("hi")),
    "fx_as_of": fx_as_of,
    "top_candidates": candidates,
    "upsert_prices": merged,
}
ORACLE_SQL = {
    "prices_weekly_returns": f"{BASE} select symbol, week, round(r, 6) r from r",
    "ticks_neighbour_returns": f"with {TICKS}, {WEEKS}, {RETURNS} select symbol, week, round(r, 6) r from q where r is not null and week - before = 7",
    "history_depth": f"with {TICKS} select symbol, count(*) points, min(date) \"start\", max(date) \"end\", round((max(date) - min(date)) / 365.25, 1) as years from p group by 1",
    "min_history": f"with {TICKS} select symbol, count(*) n from p group by 1 having count(*) >= 60",
    "common_window": f"with {PRICES} select symbol, date, round(price, 6) price from p where date in (select date from p group by 1 having count(*) = (select count(distinct symbol) from p))",
    "drawdown_curve": f"{BASE}, {EQ} select symbol, week, round(dd, 6) dd from d",
    "metrics_summary": f"""{BASE}, {EQ}, c as (select symbol, quantile_cont(dd, 0.95) cut from d group by 1),
m as (select symbol, pow(max_by(equity, week), 52.0 / count(*)) - 1 cagr, stddev_samp(r) * sqrt(52) vol, max(dd) max_dd, avg(dd) filter (dd >= cut) cdar from d join c using (symbol) group by 1)
select symbol, round(cagr, 4) cagr, round(vol, 4) vol, round(cagr / nullif(vol, 0), 3) sharpe, round(max_dd, 4) max_dd, round(cdar, 4) cdar, round(case when max_dd > 1e-9 then cagr / max_dd end, 3) calmar from m""",
    "covariance": f"{BASE} select a.symbol x, b.symbol y, round(covar_samp(a.r, b.r), 6) cov from r a join r b using (week) where a.symbol <= b.symbol group by 1, 2",
    "regression": f"""with {TICKS}, {WEEKS}, {RETURNS}, f as (select week, avg(r) p from r group by 1),
j as (select symbol, count(*) n, covar_samp(r, p) c, var_pop(p) v, avg(r) mr, avg(p) mp from r join f using (week) group by 1)
select symbol, n, round(case when n >= 8 and v > 0 then c / v else 1 end, 6) beta, round(case when n >= 8 and v > 0 then mr - c / v * mp else 0 end, 6) alpha from j""",
    "unsmoothed_returns": f"""{BASE}, l as (select *, lag(r) over (partition by symbol order by week) b from r),
f as (select symbol, case when count(*) >= 4 then coalesce(greatest(0, least(0.9, covar_pop(r, b) / nullif(stddev_pop(r) filter (b is not null) * stddev_pop(b), 0))), 0) else 0 end phi from l group by 1)
select symbol, week, round(coalesce((r - phi * b) / (1 - phi), r), 6) r from l join f using (symbol)""",
    "walk_forward_folds": f"""{BASE}, i as (select *, row_number() over (partition by symbol order by week) - 1 i, count(*) over (partition by symbol) t from r),
f as (select symbol, week, i, k.f fold from i, range(0, 1000) k(f) where t > 260 and k.f * 52 + 261 <= t and i >= k.f * 52 and i < k.f * 52 + 312)
select symbol, fold, case when i < fold * 52 + 260 then 'train' else 'test' end as role, count(*) n, min(week) lo, max(week) hi from f group by 1, 2, 3""",
    "fx_as_of": """with o as (select o_orderkey::varchar symbol, 'C' || n_regionkey ccy, o_orderdate::date date, o_totalprice price, o_orderstatus st from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
f as (select ccy, date, max(price) / 1000 rate from o where st = 'O' group by 1, 2)
select symbol, o.date, o.ccy, price * coalesce(a.rate, (select min_by(rate, f.date) from f where f.ccy = o.ccy and f.date >= o.date)) eur
from o asof left join f a on a.ccy = o.ccy and o.date >= a.date where st <> 'O'""",
    "top_candidates": "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) rank from part qualify rank <= 4",
    "upsert_prices": """with o as (select o_custkey symbol, o_orderdate::date date, o_totalprice price, o_orderkey ord from orders),
n as (select symbol, date, max_by(price, ord) price, max(ord) ord from o where ord % 3 = 0 group by 1, 2),
x as (select symbol, date, max_by(price, ord) price, max(ord) ord from o where ord % 3 <> 0 group by 1, 2)
select * from x where (symbol, date) not in (select (symbol, date) from n) union all select * from n""",
}
