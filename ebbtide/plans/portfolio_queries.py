"""Registered queries of allocation, simulation, backfill and reports, with their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import after_fee, canonical_currency
from ..operators import allocate, backfill, reports, series as S, simulate
from ..sources.panel import prices, table, ticks
from .queries import BASE, EQ, RETURNS, TICKS, WEEKS, _r

SPLIT = "date '1995-01-01'"


def _fund_and_proxy(s, d):
    r = S.weekly_returns(ticks(s, d)).withColumn("proxy", F.expr("cast(substr(symbol, 2) as long) % 5"))
    return r.where(f"week >= {SPLIT}").select("symbol", "proxy", "week", "r"), r.groupBy("proxy", "week").agg(F.avg("r").alias("p"))


def fits(s, d):
    return _r(backfill.fitted(*_fund_and_proxy(s, d)), "beta", "alpha", "resid", "r2")


def splices(s, d):
    return _r(backfill.spliced(*_fund_and_proxy(s, d), annual_fee=0.008), "r")


def _panel(s, d):
    return S.weekly_returns(prices(s, d)).select(F.lit("all").alias("panel"), "symbol", "week", "r")


def portfolios(s, d):
    w = prices(s, d).select("symbol").distinct().select("symbol", F.explode(F.array(F.lit("equal"), F.lit("short_name"))).alias("portfolio"))
    w = w.withColumn("w", F.when(F.col("portfolio") == "equal", 0.2).otherwise(1.0 / F.length("symbol")))
    return _r(S.portfolio_returns(S.weekly_returns(prices(s, d)), w), "r")


def currencies(s, d):
    o = table(s, d, "orders")
    raw = F.element_at(F.array(*map(F.lit, (" gbx", "usd", "GBP0", "eur ", "pence"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    code, factor = canonical_currency(raw)
    return o.groupBy(code.alias("ccy"), factor.alias("factor")).agg(F.count("*").alias("n"))


def fees(s, d):
    r = S.weekly_returns(prices(s, d))
    return _r(r.select("symbol", "week", after_fee(F.col("r"), 0.012).alias("r")), "r")


def catalogue(s, d):
    return reports.first_wins(table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], F.col("o_orderkey"))


def current(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return reports.versions(o, "o_custkey", F.col("o_orderkey"))


def curves(s, d):
    return _r(reports.downsample(S.drawdowns(S.weekly_returns(prices(s, d))).select("symbol", "week", "dd")), "dd")


def screening(s, d):
    return reports.screening_score(S.summary(S.weekly_returns(ticks(s, d))))


def transition(s, d):
    o = table(s, d, "lineitem").groupBy(F.col("l_linenumber").alias("point"), F.col("l_returnflag").alias("asset")).agg(F.count("*").cast("double").alias("w"))
    return _r(reports.stacked(o), "lo", "hi")


QUERIES = {
    "backfill_fit": fits,
    "backfill_splice": splices,
    "weights_min_cdar": lambda s, d: allocate.weights(_panel(s, d), "min_cdar"),
    "weights_min_variance": lambda s, d: allocate.weights(_panel(s, d), "min_variance"),
    "frontier": lambda s, d: allocate.frontier(_panel(s, d), 14),
    "bootstrap_projection": lambda s, d: simulate.project(S.weekly_returns(prices(s, d)), 520, 2000),
    "portfolio_returns": portfolios,
    "canonical_currency": currencies,
    "returns_after_fee": fees,
    "catalogue_first_wins": catalogue,
    "current_versions": current,
    "drawdown_downsampled": curves,
    "screening_score": screening,
    "allocation_transition": transition,
    "panel_meta": lambda s, d: reports.panel_meta(S.weekly_returns(ticks(s, d))),
}
FIT = f"""with {TICKS}, {WEEKS}, {RETURNS}, g as (select *, substr(symbol, 2)::bigint % 5 proxy from r),
x as (select proxy, week, avg(r) p from g group by 1, 2), u as (select * from g where week >= {SPLIT}),
k0 as (select symbol, proxy, min(week) as start, count(*) points from u group by 1, 2), j0 as (select symbol, count(*) n, covar_samp(r, p) c, var_pop(p) v, var_pop(r) vr, covar_pop(r, p) cp, avg(r) mr, avg(p) mp from u join x using (proxy, week) group by 1), m as (select symbol, proxy, start, points, coalesce(n, 0) n, c, v, vr, cp, mr, mp from k0 left join j0 using (symbol)),
b as (select *, coalesce(n >= 8 and v > 0, false) ok, case when n >= 8 and v > 0 then c / v else 1 end beta from m),
e as (select *, case when ok then mr - beta * mp else 0 end alpha, greatest(0, vr - 2 * beta * cp + beta * beta * v) sq from b),
f as (select *, case when ok then sqrt(sq) else coalesce(sqrt(vr), 0) end resid, case when ok and vr > 0 then 1 - sq / vr else 0 end r2 from e)"""
ORACLE_SQL = {
    "backfill_fit": f"""{FIT}, g2 as (select *, greatest(0, least(1, r2)) * n / (n + 6) c2 from f)
select symbol, proxy, start, points, n, round(beta, 6) beta, round(alpha, 6) alpha, round(resid, 6) resid, round(r2, 6) r2, round(100 * c2)::int confidence, case when c2 > 0.5 then 'data' when c2 > 0.2 then 'mixed' else 'prior' end as level from g2""",
    "backfill_splice": f"""{FIT} select symbol, week, round(case when points < 8 then p - (pow(1.008, 1 / 52.0) - 1) else alpha + beta * p end, 6) r, false as "real" from x join f using (proxy) where points < 8 or week < start
union all select symbol, week, round(r, 6), true from u where symbol in (select symbol from f where points >= 8)""",
    "bootstrap_projection": f"""{BASE}, i as (select symbol, row_number() over (partition by symbol order by week) - 1 i, r from r), t as (select symbol, count(*) t from i group by 1),
s as (select symbol, t, sim, step, md5(symbol || '|' || sim || '|' || step || '|7') h from t, range(2000) a(sim), range(520) b(step)),
hx as (select *, ('0x' || substr(h, 1, 8))::bigint a, ('0x' || substr(h, 9, 8))::bigint b from s),
l as (select symbol, sim, step, t, last_value(case when step = 0 or a * 26 < 4294967296 then b % t - step end ignore nulls) over (partition by symbol, sim order by step) as pt from hx),
pk as (select l.symbol, sim, step, r from l join i on i.symbol = l.symbol and i.i = (((pt + step) % t) + t) % t),
e as (select *, exp(sum(ln(1 + r)) over (partition by symbol, sim order by step)) eq from pk),
d as (select *, 1 - eq / max(eq) over (partition by symbol, sim order by step) dd from e),
z as (select symbol, sim, max_by(eq, step) m, max(dd) x, pow(max_by(eq, step), 0.1) - 1 g from d group by 1, 2)
select symbol, {", ".join(f"round(quantile_cont({c}, {q}), 6) {n}_p{round(q * 100)}" for c, n, qs in (("m", "multiple", (0.05, 0.5, 0.95)), ("g", "rate", (0.05, 0.5, 0.95)), ("x", "mdd", (0.5, 0.95, 0.99))) for q in qs)},
round(avg((m < 1)::int), 6) loss from z group by 1""",
    "portfolio_returns": f"""{BASE}, w as (select distinct symbol, portfolio, case portfolio when 'equal' then 0.2::double else 1.0::double / length(symbol) end w from p, (values ('equal'), ('short_name')) n(portfolio)),
h as (select portfolio, week, sum(r * w) r from r join w using (symbol) group by 1, 2)
select portfolio, week, round(coalesce(r, 0), 6) r from (select distinct portfolio from w) cross join (select distinct week from r) left join h using (portfolio, week)""",
    "canonical_currency": """with c as (select upper(trim([' gbx', 'usd', 'GBP0', 'eur ', 'pence'][(o_orderkey % 5 + 1)::int])) c from orders)
select case when c in ('GBX', 'GBP0', 'PENCE') then 'GBP' else c end ccy, case when c in ('GBX', 'GBP0', 'PENCE') then 0.01::double else 1.0::double end factor, count(*) n from c group by 1, 2""",
    "returns_after_fee": f"{BASE} select symbol, week, round((1 + r) * (1 - (pow(1.012, 1 / 52.0) - 1)) - 1, 6) r from r",
    "catalogue_first_wins": "select o_custkey, o_orderpriority, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1",
    "current_versions": "select o_custkey, o_orderkey, o_totalprice, (row_number() over w)::int as version, row_number() over w = count(*) over (partition by o_custkey) as is_current from orders window w as (partition by o_custkey order by o_orderkey)",
    "drawdown_downsampled": f"{BASE}, {EQ}, n as (select symbol, week, dd, row_number() over (partition by symbol order by week) - 1 i, greatest(1, count(*) over (partition by symbol) // 320) s from d) select symbol, week, round(dd, 6) dd from n where i % s = 0",
    "allocation_transition": """with o as (select l_linenumber point, l_returnflag asset, count(*)::double w from lineitem group by 1, 2), s as (select *, w / sum(w) over (partition by point) sh from o),
h as (select *, sum(sh) over (partition by point order by asset) hi from s) select point, asset, round(hi - sh, 6) lo, round(hi, 6) hi from h""",
    "panel_meta": f"with {TICKS}, {WEEKS}, {RETURNS} select count(distinct symbol) n_assets, count(distinct week) n_weeks, min(week) as start, max(week) as \"end\", round((max(week) - min(week)) / 365.25, 1) as years from r",
}
