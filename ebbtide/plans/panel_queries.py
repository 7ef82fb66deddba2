"""Registered queries of many panels at once, of stored series and of keyed state, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import baskets, panel_risk, series as S
from ..sources.panel import prices, table, ticks
from ..sources.shared import shared_folder
from ..sources.store import SeriesStore, VersionedPrices
from ..streaming.running import replay
from .queries import PRICES, RETURNS, TICKS, WEEKS, _r

FACTORS = ["WORLD", "EUROPE", "BONDS", "RE", "GOLD"]
CATEGORIES = list(baskets.CATEGORY_PRIORS)


def panels(s, d):
    """(panel, symbol, week, r): weekly returns of part types, in one panel a supplier's nation."""
    li, part, sup = (table(s, d, t) for t in ("lineitem", "part", "supplier"))
    rows = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey)
    day = F.col("l_shipdate").cast("date").alias("date")
    price = (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("price")
    p = rows.groupBy(F.concat_ws("|", "s_nationkey", "p_type").alias("symbol"), day).agg(price)
    pair = F.split("symbol", r"\|")
    return S.weekly_returns(p).select(pair[0].alias("panel"), pair[1].alias("symbol"), "week", "r")


def hrp(s, d):
    return _r(panel_risk.risk_parity(panels(s, d)), "w")


def hrp_capped(s, d):
    return _r(panel_risk.risk_parity(panels(s, d), cap=0.2), "w")


def shrunk(s, d):
    return panel_risk.shrunk_covariance(panels(s, d)).select("panel", "x", "y", F.round("cov", 6).alias("cov"), F.round("shrinkage", 6).alias("shrinkage"))


def _factors(s, d):
    name = F.element_at(F.array(*map(F.lit, FACTORS)), F.substring("symbol", 1, 1).cast("int"))
    return S.weekly_returns(prices(s, d)).select(name.alias("factor"), "week", F.col("r").alias("f"))


def _categories(s):
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CATEGORIES) for x in (c, i)])
    return baskets.category_priors(s).withColumn("i", order[F.col("category")])


def _funds(s, d):
    return S.weekly_returns(ticks(s, d)).select(F.substring("symbol", 2, 20).cast("long").alias("fund"), "week", F.col("r").alias("y"))


def basket_fit(s, d):
    funds = _funds(s, d)
    # Priors of suppliers without returns are of no fund.
    keys = table(s, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("fund")).distinct()
    own = keys.withColumn("i", F.col("fund") % len(CATEGORIES)).join(_categories(s), "i").select("fund", "factor", "w")
    return _r(baskets.fit(funds, _factors(s, d), own, FACTORS), "w", "r2")


def trained(s, d):
    name = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("fund") % len(CATEGORIES) + 1).cast("int"))
    of = _funds(s, d).groupBy(name.alias("fund"), "week").agg(F.avg("y").alias("y"))
    return _r(baskets.trained_priors(of, _factors(s, d), FACTORS), "w")


def running(s, d):
    """Events that arrive up to three days late, in three batches."""
    e = table(s, d, "events")
    rows = e.select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), "value")
    arrival = F.floor((F.dayofmonth("at") - 1 + F.pmod(F.xxhash64("id"), F.lit(4))) / 12)
    out = replay([rows.where(arrival == k) for k in range(3)], f"{shared_folder(s)}/running-{uuid.uuid4().hex}", "5 days")
    return _r(out.select("symbol", "id", "value", "peak", "dd"), "dd")


def _days(s, d):
    return ticks(s, d).withColumn("n", F.substring("symbol", 2, 20).cast("long"))


def stored(s, d):
    """Even suppliers are stored, then every third is asked for and fetched where it is missing: the manifest after it."""
    store, days = SeriesStore(s, f"{shared_folder(s)}/store-{uuid.uuid4().hex}"), _days(s, d)
    store.write(days.where("n % 2 = 0"), "first", "2024-01-01")
    wanted = table(s, d, "lineitem").where("l_suppkey % 3 = 0").select(F.concat(F.lit("s"), "l_suppkey").alias("symbol")).distinct()
    store.get(wanted, lambda missing: days.join(missing, "symbol", "left_semi"), "second", "2024-02-01")
    return store.manifest()


def merged(s, d):
    """Half of the days, then corrections of the year 1997: rows, by month, and the merge that wrote them last."""
    table_, days = VersionedPrices(s, f"{shared_folder(s)}/merge-{uuid.uuid4().hex}"), _days(s, d)
    table_.merge(days.where("n % 2 = 0").withColumn("ord", F.lit(1)), 1)
    table_.merge(days.where("n % 3 = 0 and year(date) = 1997").select("symbol", "date", (F.col("price") * 2).alias("price"), F.lit(2).alias("ord")), 2)
    month = table_.read().groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.round(F.max("price"), 6).alias("top"))
    return month.join(table_.months(), "month").select("month", "at", "rows", "last", "top")


QUERIES = {
    "running_drawdown": running,
    "stored_series": stored,
    "merged_months": merged,
    "weights_hrp": hrp,
    "weights_hrp_capped": hrp_capped,
    "shrunk_covariance": shrunk,
    "basket_fit": basket_fit,
    "trained_priors": trained,
}
PANELS = f"""p as (select s_nationkey || '|' || p_type symbol, l_shipdate::date date, sum(l_extendedprice::decimal(18,2))::double / count(*) price
from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2), {WEEKS}, {RETURNS},
pr as (select split_part(symbol, '|', 1) panel, split_part(symbol, '|', 2) symbol, week, r from r),
sz as (select panel, count(distinct symbol) n from pr group by 1), fw as (select panel, week from pr join sz using (panel) group by 1, 2, sz.n having count(*) = sz.n),
z as (select pr.* from pr join fw using (panel, week) where panel in (select panel from fw group by 1 having count(*) >= 8))"""
HRP = f"""with recursive {PANELS},
m as (select a.panel, a.symbol x, b.symbol y, covar_samp(a.r, b.r) cov, corr(a.r, b.r) corr from z a join z b using (panel, week) group by 1, 2, 3),
iv as (select panel, x symbol, 1 / cov iv, row_number() over (partition by panel order by x) - 1 id, count(*) over (partition by panel) size from m where x = y and cov > 0),
e as (select panel, x, y, row_number() over (partition by panel order by sqrt(greatest(0, (1 - corr) / 2)), x, y) k from m where x < y),
kr as (select panel, 0::bigint k, list({{'id': id, 'leaves': [symbol]}} order by id) c, size::bigint nxt from iv group by panel, size
  union all select panel, k, case when a.id = b.id then c else list_append(list_filter(c, lambda g: g.id <> a.id and g.id <> b.id),
    {{'id': nxt, 'leaves': case when a.id < b.id then list_concat(a.leaves, b.leaves) else list_concat(b.leaves, a.leaves) end}}) end, nxt + (a.id <> b.id)::bigint
  from (select kr.panel, e.k, c, nxt, list_filter(c, lambda g: list_contains(g.leaves, e.x))[1] a, list_filter(c, lambda g: list_contains(g.leaves, e.y))[1] b
    from kr join e on e.panel = kr.panel and e.k = kr.k + 1)),
lf as (select panel, unnest(c[1].leaves) symbol, generate_subscripts(c[1].leaves, 1) - 1 pos, len(c[1].leaves) size from kr qualify row_number() over (partition by panel order by k desc) = 1),
lv as (select * from lf),
rg as (select distinct panel, 0 lev, 0::bigint low, size::bigint size, 0::bigint up, true first from lv
  union all select panel, lev + 1, case when h = 0 then low else low + size // 2 end, case when h = 0 then size // 2 else size - size // 2 end, low, h = 0
  from rg, range(2) t(h) where size >= 2),
pt as (select rg.panel, lev, low, up, first, lv.symbol, iv.iv from rg join lv on lv.panel = rg.panel and pos >= low and pos < low + rg.size join iv on iv.panel = rg.panel and iv.symbol = lv.symbol where lev > 0),
rk as (select a.panel, a.lev, a.low, sum(a.iv * cov * b.iv) / pow(sum(a.iv) filter (x = y), 2) v from pt a join pt b on b.panel = a.panel and b.lev = a.lev and b.low = a.low
  join m on m.panel = a.panel and m.x = a.symbol and m.y = b.symbol group by 1, 2, 3),
sp as (select panel, lev, up, max(v) filter (first) v1, max(v) filter (not first) v2 from (select distinct panel, lev, low, up, first from pt) join rk using (panel, lev, low) group by 1, 2, 3),
wt as (select panel, symbol, product(case when first then 1 - v1 / (v1 + v2) else v1 / (v1 + v2) end) w from pt join sp using (panel, lev, up) group by 1, 2),
al as (select panel, symbol, coalesce(w, 1) w from lv left join wt using (panel, symbol))"""
FIT = f"""with recursive {PRICES}, {WEEKS}, {RETURNS}, fa as (select ['WORLD', 'EUROPE', 'BONDS', 'RE', 'GOLD'][left(symbol, 1)::int] factor, week, r f from r),
fp as (select week, list(f order by list_position({FACTORS!r}, factor)) f from fa group by 1 having count(*) = {len(FACTORS)}),
{TICKS.replace("p as", "tp as", 1)}, {WEEKS.replace("k as", "tk as", 1).replace("from p", "from tp")}, {RETURNS.replace("q as", "tq as").replace("r as (", "tr as (").replace("from k", "from tk").replace("from q", "from tq")},
fu as (select substr(symbol, 2)::bigint fund, week, r y from tr)"""
DESCENT = """j as (select fund, week, y, f from fu join fp using (week)),
cells as (select fund, i, k, sum(f[i] * f[k]) g from j, range(1, 6) a(i), range(1, 6) b(k) group by 1, 2, 3),
gr as (select fund, i, list(g order by k) g from cells group by 1, 2),
ga as (select fund, list(g order by i) g from gr group by 1),
bs as (select fund, i, sum(f[i] * y) b from j, range(1, 6) a(i) group by 1, 2), ba as (select fund, list(b order by i) b from bs group by 1),
mo as (select fund, count(*) n, sum(y) y, sum(y * y) yy from j group by 1),
st as (select fu.fund, coalesce(n, 0) n, y, yy, g, b, prior, {strength}::double / n lam from (select distinct fund from fu) fu left join mo using (fund) left join ga using (fund) left join ba using (fund) join pa using (fund)),
cd as (select fund, 0 step, prior w from st where n >= 2
  union all select fund, step + 1, list_transform(w, lambda x, i: case when i = c then greatest(0, (b[c] + lam * prior[c] - list_dot_product(g[c], w) + g[c][c] * w[c]) / (g[c][c] + lam)) else x end)
  from (select cd.*, step % 5 + 1 c, g, b, prior, lam from cd join st using (fund) where step < 1000)),
ft as (select st.*, w, case when yy - y * y / n > 1e-13 * yy then yy - y * y / n else 1 end total,
  yy - 2 * list_dot_product(w, b) + list_dot_product(w, list_transform(g, lambda r: list_dot_product(r, w))) error from cd join st using (fund) where step = 1000)"""
VALUES = ", ".join(f"({i}, '{c}', '{f}', {w}::double)" for i, c in enumerate(CATEGORIES) for f, w in baskets.CATEGORY_PRIORS[c].items())
ORACLE_SQL = {
    "running_drawdown": """select 'U' || user_id symbol, event_id id, value, max(value) over w peak, round(1 - value / max(value) over w, 6) dd
from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "stored_series": f"""with {TICKS}, u as (select *, substr(symbol, 2)::bigint n from p)
select symbol, count(*) points, min(date) as start, max(date) as "end", case when n % 2 = 0 then 'first' else 'second' end source,
case when n % 2 = 0 then date '2024-01-01' else date '2024-02-01' end fetched_on from u where n % 2 = 0 or n % 3 = 0 group by symbol, n""",
    "merged_months": f"""with {TICKS}, u as (select *, substr(symbol, 2)::bigint n from p),
m as (select symbol, date, price * case when n % 3 = 0 and year(date) = 1997 then 2 else 1 end price, n % 3 = 0 and year(date) = 1997 late from u
where n % 2 = 0 or (n % 3 = 0 and year(date) = 1997))
select strftime(date, '%Y-%m') as month, case when bool_or(late) then 2 else 1 end::bigint as at, count(*) as rows, max(date) as last, round(max(price), 6) top from m group by 1""",
    "weights_hrp": f"{HRP} select panel, symbol, round(w / sum(w) over (partition by panel), 6) w from al",
    "weights_hrp_capped": f"{HRP}, cp as (select panel, symbol, least(w, 0.2) w from al) select panel, symbol, round(w / sum(w) over (partition by panel), 6) w from cp",
    "shrunk_covariance": f"""with {PANELS}, c as (select panel, symbol, week, r - avg(r) over (partition by panel, symbol) r from z),
m as (select a.panel, a.symbol x, b.symbol y, count(*) n, sum(a.r * b.r) / count(*) s, sum(pow(a.r * b.r, 2)) / count(*) q from c a join c b using (panel, week) group by 1, 2, 3),
w as (select panel, max(n) n, avg(s) filter (x = y) mu, sum(s * s) ss, sum(q) q, sum(s * s) - count(*) filter (x = y) * pow(avg(s) filter (x = y), 2) spread from m group by 1),
sk as (select panel, mu, case when spread > 1e-14 * ss then least(1, greatest(0, q - ss) / n / spread) else 0 end k from w)
select panel, x, y, round((1 - k) * s + case when x = y then k * mu else 0 end, 6) cov, round(k, 6) shrinkage from m join sk using (panel) where x <= y""",
    "basket_fit": f"""{FIT}, pv(i, category, factor, w) as (values {VALUES}),
own as (select fund, factor, w from (select distinct fund from fu) join pv on i = fund % {len(CATEGORIES)}),
pa as (select fund, [{", ".join(f"coalesce(sum(w) filter (factor = '{f}'), 0)" for f in FACTORS)}] prior from own group by 1), {DESCENT.replace("{strength}", "6")},
bl as (select *, greatest(0, least(1, 1 - error / total)) * (n / (n + 6.0)) c from ft)
select fund, {FACTORS!r}[i] factor, round(c * w[i] + (1 - c) * prior[i], 6) w, round(1 - error / total, 6) r2, n from bl, range(1, 6) a(i) where c * w[i] + (1 - c) * prior[i] > 1e-4
union all select fund, factor, w, 0, n from st join own using (fund) where n < 2""",
    "trained_priors": f"""{FIT.replace("fu as (", "f0 as (")}, fu as (select {CATEGORIES!r}[fund % {len(CATEGORIES)} + 1] fund, week, avg(y) y from f0 group by 1, 2),
pa as (select distinct fund, [0.2::double, 0.2, 0.2, 0.2, 0.2] prior from fu), {DESCENT.replace("{strength}", "1")},
kp as (select fund, i, w[i] w from ft, range(1, 6) a(i) where w[i] > 1e-4)
select fund, {FACTORS!r}[i] factor, round(w / sum(w) over (partition by fund), 6) w from kp
union all select fund, {FACTORS!r}[i], 0.2 from pa, range(1, 6) a(i) where fund not in (select fund from kp)""",
}
