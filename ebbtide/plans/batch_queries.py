"""Registered queries of batches, journals, comparisons and paged reads, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import comparison, contracts, journal, loader, reports, series as S
from ..sources import paged
from ..sources.panel import table, ticks
from ..sources.shared import shared_folder
from .queries import EQ, RETURNS, TICKS, WEEKS, _r


def _number(column="symbol"):
    return F.substring(column, 2, 20).cast("long")


def contract_batch(s, d):
    """A contract a customer, three of whose suppliers are its menu; some weights and prices are not what they should be."""
    c = table(s, d, "customer").select(F.col("c_custkey").alias("contract"))
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    lines = c.where("contract % 11 <> 0").select("contract", k.alias("k")).where("contract % 5 <> 0 or k = 0")
    weight = F.when((F.col("contract") % 7 == 0) & (F.col("k") == 1), "n/a").otherwise((F.col("k") + 1).cast("string"))
    menu = lines.select("contract", F.concat(F.lit("S"), ((F.col("contract") * (F.col("k") + 1) + F.col("k")) % 97).cast("string")).alias("symbol"), weight.alias("weight"))
    px = ticks(s, d).withColumn("n", _number())
    price = F.when((F.col("n") % 10 == 3) & (F.dayofmonth("date") == 1), "-1").otherwise(F.col("price").cast("string"))
    out = contracts.measured(c, menu, px.select("symbol", "date", price.alias("price")))
    return out.select("contract", "ok", "error", "funds", F.round("cagr", 3).alias("cagr"), F.round("vol", 3).alias("vol"), F.round("max_dd", 3).alias("max_dd"))


def _results(s, d):
    """(fund, result, note, hypothesis): nested results of each supplier's series."""
    m = S.summary(S.weekly_returns(ticks(s, d))).withColumn("fund", _number())
    part = F.struct("cagr", F.col("max_dd").alias("max_drawdown"), "calmar", "sharpe")
    meta = F.struct(F.when(F.col("fund") % 3 > 0, F.concat(F.lit("ticks "), F.col("fund").cast("string"))).alias("source"), F.lit(6.5).alias("years"))
    result = F.to_json(
        F.struct(
            meta.alias("meta"), F.struct(F.struct(part.alias("in_sample")).alias("profil_equilibre")).alias("portefeuilles"),
            F.struct(F.struct(F.struct("cagr", F.lit(0.5).alias("max_drawdown")).alias("oos"), F.struct(F.lit(1.25).alias("ratio_realise_sur_promesse")).alias("honnetete")).alias("min_cdar")).alias("walk_forward"),
        )
    )
    return m.select("fund", result.alias("result"), F.concat(F.lit("run "), F.col("fund").cast("string")).alias("note"), F.lit(None).cast("string").alias("hypothesis"))


def journal_runs(s, d):
    """Even suppliers are journalled, then odd ones: what the journal holds."""
    path, rows = f"{shared_folder(s)}/journal-{uuid.uuid4().hex}", _results(s, d)
    journal.append(s, path, rows.where("fund % 2 = 0"), ["fund"])
    journal.append(s, path, rows.where("fund % 2 = 1"), ["fund"])
    return journal.load(s, path).select("id", "source", "note", "hypothesis", "years", "profil_equilibre_cagr", "profil_equilibre_calmar", "oos_min_cdar_maxdd", "oos_min_cdar_ratio", "hrp_cagr")


def journal_index(s, d):
    path = f"{shared_folder(s)}/journal-{uuid.uuid4().hex}"
    journal.append(s, path, _results(s, d), ["fund"])
    return journal.ranked(journal.load(s, path)).select("place", "id", "source", "cagr", "maxdd", "calmar", "bench", "note")


def _lines(s, d):
    """(profile, asset, ord, w, source): shares of part types in the quantities of ship years."""
    li, part = table(s, d, "lineitem"), table(s, d, "part")
    q = li.join(part, li.l_partkey == part.p_partkey).groupBy(F.concat(F.lit("y"), F.year("l_shipdate") % 3).alias("profile"), F.col("p_type").alias("asset"))
    q = q.agg(F.sum("l_quantity").alias("q"), F.min("l_orderkey").alias("ord"))
    whole = q.groupBy("profile").agg(F.sum("q").alias("all"))
    source = F.when(F.col("asset") == "PROMO", "réel (marché)").when(F.col("asset") == "SMALL", "reconstruit").when(F.col("asset") != "LARGE", "modélisé")
    return q.join(whole, "profile").select("profile", "asset", "ord", (F.col("q") / F.col("all")).alias("w"), source.alias("source"))


def shortlisted(s, d):
    """Suppliers' series, named by nation and region, as candidates."""
    px = ticks(s, d)
    m = S.summary(S.weekly_returns(px)).join(px.groupBy("symbol").agg(F.min("date").alias("start")), "symbol").withColumn("n", _number())
    sup, nation = table(s, d, "supplier"), table(s, d, "nation")
    named = m.join(sup, m.n == sup.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat_ws(" ", F.initcap("n_name"), F.lit("- Fonds"), (F.col("n") % 4).cast("string"))
    return reports.shortlist(named.select("symbol", name.alias("name"), F.concat(F.lit("c"), "n_regionkey").alias("classe"), "start", F.col("calmar").alias("score")), "1995-01-20", 14, 4)


def paged_orders(s, d):
    """Urgent orders by pages of 1000 rows."""
    plain = table(s, d, "orders")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    path = f"{d}/orders.parquet"
    rows = paged.read_pages(s, path if "://" in path else f"file://{path}", schema, equal={"o_orderpriority": "1-URGENT"})
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


def _menu(s, d):
    """Pairs of suppliers as menus; currencies by ISIN where the catalogue has them, else by venue."""
    n = F.col("s_suppkey")
    menu = table(s, d, "supplier").select(
        F.floor(n / 2).alias("panel"), F.concat(F.lit(" s"), n).alias("isin"), F.lit(None).cast("string").alias("code"),
        F.when(n % 3 == 0, "LSE").when(n % 3 == 1, "US").alias("exchange"), F.col("s_name").alias("name"), F.lit("c").alias("classe"), n.alias("ord"),
    )
    listed = table(s, d, "supplier").where("s_suppkey % 4 = 0").select(
        F.lit("XETRA").alias("exchange"), F.concat(F.lit("S"), n).alias("isin"), F.lit("").alias("code"), F.when(n % 8 == 0, "sek").otherwise("GBX").alias("currency"), n.alias("ord")
    )
    day = F.col("o_orderdate").cast("date").alias("date")
    ccy = F.element_at(F.array(*map(F.lit, ("USD", "GBP", "SEK"))), (F.col("o_custkey") % 3 + 1).cast("int")).alias("ccy")
    fx = table(s, d, "orders").groupBy(ccy, day).agg((F.max("o_totalprice") / 100000).alias("rate"))
    px = ticks(s, d).withColumn("symbol", F.concat("symbol", F.lit(".EUFUND")))
    return loader.kept_lines(menu, px, listed), px, fx


def euro_panel(s, d):
    lines, px, fx = _menu(s, d)
    return _r(loader.euro_panel(lines, px, fx, 0.006), "r")


QUERIES = {
    "euro_panel": euro_panel,
    "euro_panel_lines": lambda s, d: _menu(s, d)[0].select("panel", "key", "symbol", "isin", "name", "ccy", "points"),
    "contract_batch": contract_batch,
    "journal_runs": journal_runs,
    "journal_index": journal_index,
    "asset_order": lambda s, d: comparison.asset_order(_lines(s, d)),
    "allocation_matrix": lambda s, d: _r(comparison.allocation_matrix(_lines(s, d), ["y0", "y1", "y2"]), "y0", "y1", "y2", "top"),
    "provenance": lambda s, d: _r(comparison.provenance(_lines(s, d)).select("profile", "asset", "w", "kind"), "w"),
    "kept_last": lambda s, d: comparison.keep_last(table(s, d, "orders").select(F.concat(F.lit(" c"), F.col("o_custkey")).alias("id"), "o_orderkey"), "id", "o_orderkey"),
    "venue_choice": lambda s, d: comparison.venue_choice(
        table(s, d, "part").select(F.col("p_name").alias("query"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 3 == 0, "etf").otherwise(F.col("p_type")).alias("type"), F.when(F.col("p_partkey") % 4 == 0, "PA").otherwise("US").alias("exchange"))
    ),
    "shortlist": shortlisted,
    "paged_orders": paged_orders,
}
LINES = """ln as (select 'y' || (year(l_shipdate) % 3) profile, p_type asset, min(l_orderkey) ord, sum(l_quantity) q from lineitem join part on p_partkey = l_partkey group by 1, 2),
sh as (select profile, asset, ord, q / sum(q) over (partition by profile) w from ln)"""
SUMMARY = f"""{TICKS}, {WEEKS}, {RETURNS}, {EQ},
sm as (select symbol, substr(symbol, 2)::bigint fund, round(pow(max_by(equity, week), 52.0 / count(*)) - 1, 4) cagr, round(max(dd), 4) max_dd,
  round(case when max(dd) > 1e-9 then (pow(max_by(equity, week), 52.0 / count(*)) - 1) / max(dd) end, 3) calmar from d group by 1)"""
MENU = f"""{TICKS.replace("p as", "p0 as", 1)}, pt as (select symbol, count(*) points from p0 group by 1 having count(*) >= 60),
ml as (select s_suppkey // 2 panel, 'S' || s_suppkey as key, s_name as name, points,
  case when s_suppkey % 8 = 0 then 'SEK' when s_suppkey % 4 = 0 then 'GBX' when s_suppkey % 3 = 0 then 'GBP' when s_suppkey % 3 = 1 then 'USD' else 'EUR' end ccy from supplier join pt on symbol = 'S' || s_suppkey)"""
ORACLE_SQL = {
    "euro_panel_lines": f"with {MENU} select panel, key, key || '.EUFUND' as symbol, key isin, name, ccy, points from ml",
    "euro_panel": f"""with {MENU}, x as (select ['USD', 'GBP', 'SEK'][o_custkey % 3 + 1] ccy, o_orderdate::date date, max(o_totalprice) / 100000 rate from orders group by 1, 2),
x0 as (select ccy, min_by(rate, date) r0 from x group by 1), p1 as (select panel, key, date, price * case when ccy = 'GBX' then 0.01 else 1 end price, case when ccy = 'GBX' then 'GBP' else ccy end ccy from p0 join ml on key = symbol),
eu as (select panel, key, p1.date, price * case when p1.ccy = 'EUR' then 1 else coalesce(x.rate, r0) end price from p1 asof left join x on x.ccy = p1.ccy and p1.date >= x.date left join x0 on x0.ccy = p1.ccy),
fd as (select panel, date from eu group by 1, 2 having count(distinct key) = (select count(*) from ml where ml.panel = eu.panel)),
p as (select panel || '|' || key symbol, date, price from eu join fd using (panel, date)), {WEEKS}, {RETURNS}
select split_part(symbol, '|', 1)::bigint panel, split_part(symbol, '|', 2) as key, week, round((1 + r) * (1 - (pow(1.006, 1 / 52.0) - 1)) - 1, 6) r from r""",
    "contract_batch": f"""with {TICKS.replace("p as", "p0 as", 1)}, ct as (select distinct c_custkey contract from customer),
mn as (select contract, 'S' || ((contract * (k + 1) + k) % 97) symbol, case when contract % 7 = 0 and k = 1 then null else k + 1 end w from ct, range(3) r(k) where contract % 11 <> 0 and (contract % 5 <> 0 or k = 0)),
p1 as (select symbol, date, case when substr(symbol, 2)::bigint % 10 = 3 and day(date) = 1 then -1 else price end price from p0),
sn as (select symbol, bool_or(price <= 0) bad from p1 group by 1),
st as (select contract, count(*) lines, bool_or(w is null) bw, count(bad) funds, bool_or(coalesce(bad, false)) bp from mn left join sn using (symbol) group by 1),
ev as (select contract, coalesce(funds, 0) funds, case when lines is null then 'no menu' when bw then 'bad weight' when funds < 2 then 'too few funds' when bp then 'bad price' end error from ct left join st using (contract)),
hd as (select mn.* from mn join ev using (contract) where error is null and symbol in (select symbol from sn)),
p as (select * from p1 where symbol in (select symbol from hd) and price > 0), {WEEKS}, {RETURNS.replace("r as (", "rr as (")},
r as (select contract symbol, week, sum(w / total * rr.r) r from (select *, sum(w) over (partition by contract) total from hd) h join rr on rr.symbol = h.symbol group by 1, 2), {EQ},
m as (select symbol contract, count(*) n, pow(max_by(equity, week), 52.0 / count(*)) - 1 cagr, stddev_samp(r) * sqrt(52) vol, max(dd) max_dd from d group by 1),
z as (select contract, funds, coalesce(error, case when coalesce(n, 0) < 8 then 'too few weeks' end) error, cagr, vol, max_dd from ev left join m using (contract))
select contract, error is null ok, error, funds, {", ".join(f"round(case when error is null then round({c}, 4) end, 3) {c}" for c in ("cagr", "vol", "max_dd"))} from z""",
    "journal_runs": f"""with {SUMMARY} select row_number() over (order by fund % 2, fund) id, case when fund % 3 > 0 then 'ticks ' || fund else '?' end source, 'run ' || fund note, '' hypothesis, 6.5::double as "years",
cagr profil_equilibre_cagr, calmar profil_equilibre_calmar, 0.5::double oos_min_cdar_maxdd, 1.25::double oos_min_cdar_ratio, null::double hrp_cagr from sm""",
    "journal_index": f"""with {SUMMARY}, j as (select row_number() over (order by fund) id, * from sm),
f as (select *, row_number() over (order by coalesce(nullif(calmar, 0), -1) desc, id) place from j)
select place, id, case when fund % 3 > 0 then 'ticks ' || fund else '?' end source, coalesce(printf('%+.1f%%', round(cagr * 100, 1)), '—') cagr, coalesce(printf('%+.1f%%', round(max_dd * 100, 1)), '—') maxdd, calmar, '—' bench, 'run ' || fund note from f""",
    "asset_order": f"with {LINES} select asset, row_number() over (order by min(ord), asset) - 1 place from sh group by 1",
    "allocation_matrix": f"""with {LINES}, m as (select asset, {", ".join(f"coalesce(sum(w) filter (profile = '{p}'), 0) {p}" for p in ("y0", "y1", "y2"))} from sh group by 1)
select asset, round(y0, 6) y0, round(y1, 6) y1, round(y2, 6) y2, round(greatest(y0, y1, y2), 6) top from m where greatest(y0, y1, y2) > 0.0005""",
    "provenance": f"with {LINES} select profile, asset, round(w, 6) w, case asset when 'PROMO' then 'real' when 'SMALL' then 'rebuilt' when 'LARGE' then null else 'modelled' end kind from sh",
    "kept_last": "select 'C' || o_custkey id, max(o_orderkey) o_orderkey from orders group by 1",
    "venue_choice": """with h as (select p_name as query, p_partkey ord, case when p_size % 3 = 0 then 'etf' else p_type end as "type", case when p_partkey % 4 = 0 then 'PA' else 'US' end exchange from part)
select * from h qualify row_number() over (partition by query order by case when "type" <> 'etf' then 2 when exchange = 'PA' then 0 else 1 end, ord) = 1""",
    "shortlist": f"""with {SUMMARY}, b as (select symbol, min(date) as start from p group by 1),
c as (select sm.symbol, upper(n_name[1]) || lower(n_name[2:]) || ' - Fonds ' || (fund % 4) as name, 'c' || n_regionkey classe, calmar score from sm join b using (symbol) join supplier on s_suppkey = fund join nation on n_nationkey = s_nationkey
  where start <= date '1995-01-20' and calmar is not null),
o as (select * from c qualify row_number() over (partition by left(upper(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '', 'g')), 14) order by score desc, symbol) = 1)
select classe, row_number() over (partition by classe order by score desc, symbol) as rank, symbol, name, score from o qualify rank <= 4""",
    "paged_orders": "select o_orderkey, o_custkey, o_totalprice from orders where o_orderpriority = '1-URGENT'",
}
