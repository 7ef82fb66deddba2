"""Registered queries of candidates, currencies, compositions, evaluation and histories, with their SQL.

Their inputs are derived from the given tables: rows of `part`, `customer` and `orders` stand for
instruments, catalogue rows and report lines, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import row_key
from ..operators import backfill, candidates as C, composition as K, currency as M, evaluation as V, history as H, reports, series as S
from ..sources.panel import prices, table, ticks
from .queries import BASE, EQ, RETURNS, TICKS, WEEKS, _r

NAMES = (
    "Physical Gold ETC", "Lean Hogs ETC", "Rogers Commodity Index", "Natural Gas fund", "Brent Crude", "MSCI World", "Euro Stoxx 50", "S&P 500 UCITS",
    "Nikkei 225", "Obligations d'Etat", "Marché monétaire", "EPRA Europe", "MSCI India", "Small caps", None, "Silver bullion", "Wheat", "Global bond",
)
CURRENCIES = (" usd", "", "EUR ", None, "gbx", "NaN", "sek")
LABELS = (
    "Répartition par classe d'actifs", "Actions Europe", "Obligations", "Liquidités", "Immobilier", "dont dollar", "Performance", "Répartition sectorielle", "Or", "prose",
)


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _sql_pick(values, index):
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[({index}) % {len(values)} + 1]"


def _catalogue(s, d):
    c = F.col("c_custkey")
    return table(s, d, "customer").select(
        _pick((*M.VENUES, "US"), F.col("c_nationkey")).alias("exchange"), F.concat(F.lit("fr"), c % 400).alias("isin"), F.concat(F.lit("K"), c % 700).alias("code"),
        _pick(CURRENCIES, c).alias("currency"), c.alias("ord"),
    )


def _instruments(s, d):
    p = F.col("p_partkey")
    return table(s, d, "part").select(
        p.alias("id"), F.when(p % 3 > 0, F.concat(F.lit(" FR"), p % 600)).otherwise("").alias("isin"), F.when(p % 4 > 0, F.concat(F.lit("k"), p % 900)).alias("code"),
        _pick(("XETRA", "lse", "US", "SW", "ZZ"), F.col("p_size")).alias("exchange"),
    )


CATALOGUE = f"""cat as (select list_position(['EUFUND', 'XETRA', 'PA', 'LSE'], {_sql_pick((*M.VENUES, "US"), "c_nationkey")}) venue, 'FR' || (c_custkey % 400) isin, 'K' || (c_custkey % 700) code,
  upper(trim({_sql_pick(CURRENCIES, "c_custkey")})) cur, c_custkey ord from customer),
ok as (select * from cat where venue > 0 and cur <> '' and cur <> 'NAN'),
bi as (select isin, first(cur order by venue, ord) c1 from ok group by 1), bc as (select code, first(cur order by venue, ord) c2 from ok group by 1),
ins as (select p_partkey id, case when p_partkey % 3 > 0 then 'FR' || (p_partkey % 600) else '' end isin, case when p_partkey % 4 > 0 then 'K' || (p_partkey % 900) end code,
  {_sql_pick(("XETRA", "LSE", "US", "SW", "ZZ"), "p_size")} exchange from part),
res as (select id, coalesce(c1, c2, case exchange when 'XETRA' then 'EUR' when 'LSE' then 'GBP' when 'US' then 'USD' when 'SW' then 'CHF' else 'EUR' end) ccy from ins left join bi using (isin) left join bc using (code))"""


def _resolved(s, d):
    return M.resolved(_instruments(s, d), _catalogue(s, d)).select("id", "ccy")


def _candidates(s, d):
    p = F.col("p_partkey")
    name = _pick(NAMES, p)
    return table(s, d, "part").select(
        p.alias("ord"), F.concat(F.lit("FR"), p).alias("isin"), name.alias("name"), C.asset_class(name).alias("classe"), C.exotic(name).alias("exotic"),
        _pick(("1.5", "x", None, "7", " 2.25 "), F.col("p_size")).alias("score"), F.when(p % 7 > 0, F.col("p_size").cast("string")).alias("years"),
    )


def _regex(pattern):
    return pattern.replace("'", "''")


SHOWN = ", ".join(f"when regexp_matches(n, '{_regex(p)}') then '{c}'" for c, p in C.CLASSES).replace(", when", " when")
CANDIDATES = f"""nm as (select p_partkey ord, 'FR' || p_partkey isin, {_sql_pick(NAMES, "p_partkey")} as "name", {_sql_pick(("1.5", "x", None, "7", " 2.25 "), "p_size")} score,
  case when p_partkey % 7 > 0 then p_size end as "years" from part),
cand as (select *, lower(coalesce("name", '')) n, case {SHOWN} else '{C.OTHER_CLASS}' end classe,
  not regexp_matches(n, '{_regex(C.GOLD)}') and not regexp_matches(n, '{_regex(C.BROAD)}') and regexp_matches(n, '{_regex(C.SINGLE)}') exotic, coalesce(try_cast(trim(score) as double), 0) s from nm)"""


def _selected(s, d):
    rows = _candidates(s, d).where(~F.col("exotic") & (F.col("classe") != C.CASH_CLASS))
    rows = rows.withColumn("classe", F.when(F.col("ord") % 11 > 0, F.col("classe")))
    return C.selected(rows, 4, 3).select("classe", "isin", "rank", "class_order")


def _menus(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("contract"), F.concat(F.lit(" fr"), F.col("o_orderkey") % 900).alias("isin"), F.col("o_orderkey").alias("ord"))
    return C.of_menus(o, _candidates(s, d).where(~F.col("exotic")).select("isin"))


def _reports(s, d):
    """(doc_id, text): thirty report lines a document, from parts."""
    p, label = F.col("p_partkey"), _pick(LABELS, F.col("p_partkey") + F.floor(F.col("p_partkey") / 30))
    value = F.concat((p * 7 % 45).cast("string"), F.lit(","), (p % 10).cast("string"))
    line = (
        F.when(label.startswith("Répartition"), label)
        .when(label == "prose", F.concat(value, F.lit(" % en actions monde")))
        .when(p % 9 == 0, F.concat(label, F.lit("   +"), value, F.lit(" %")))
        .otherwise(F.concat(F.lit("  "), label, F.lit("   "), value, F.lit(" %   +1,2 %")))
    )
    rows = table(s, d, "part").select(F.floor(p / 30).alias("doc_id"), p.alias("i"), line.alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


LINES = f"""ln as (select p_partkey // 30 doc_id, p_partkey i, {_sql_pick(LABELS, "p_partkey + p_partkey // 30")} lb, (p_partkey * 7 % 45) || ',' || (p_partkey % 10) v from part),
l0 as (select doc_id, i, case when lb like 'Répartition%' then lb when lb = 'prose' then v || ' % en actions monde' when i % 9 = 0 then lb || '   +' || v || ' %' else '  ' || lb || '   ' || v || ' %   +1,2 %' end line from ln),
hd as (select doc_id, min(i) start from l0 where regexp_matches(trim(line), '(?i){_regex(K.ALLOCATION)}') group by 1),
sp as (select doc_id, min(i) stop from l0 join hd using (doc_id) where i > start and i <= start + 60 and regexp_matches(line, '(?i){_regex(K.OTHER)}') and not regexp_matches(trim(line), '(?i){_regex(K.ALLOCATION)}') group by 1),
blk as (select doc_id, i, line from l0 left join hd using (doc_id) left join sp using (doc_id) where start is null or (i > start and i <= start + 60 and i < coalesce(stop, 1000000000) and not regexp_matches(trim(line), '(?i){_regex(K.ALLOCATION)}'))),
fd as (select doc_id, i, regexp_matches(line, '{_regex(K.LABEL_FIRST)}') f, case when f then regexp_extract(line, '{_regex(K.LABEL_FIRST)}', 1) else regexp_extract(line, '{_regex(K.NUMBER_FIRST)}', 2) end raw,
  case when f then regexp_extract(line, '{_regex(K.LABEL_FIRST)}', 2) else regexp_extract(line, '{_regex(K.NUMBER_FIRST)}', 1) end val from blk where regexp_matches(line, '{_regex(K.LABEL_FIRST)}') or regexp_matches(line, '{_regex(K.NUMBER_FIRST)}')),
lb as (select doc_id, i, lower(regexp_replace(trim(raw, ' .:-'), '\\s+', ' ', 'g')) as "label", replace(val, ',', '.')::double val from fd),
comp as (select doc_id, "label", min_by(val, i) / 100 w, min(i) pos from lb where "label" <> '' and val > 0 and val <= 100 and not regexp_matches("label", '{_regex(K.EXCLUDED)}') and regexp_matches("label", '{_regex(K.CLASS_WORDS)}')
  and len(regexp_split_to_array(trim("label"), '\\s+')) <= 4 and length("label") <= 32 and not regexp_matches("label", '{_regex(K.PHRASE)}') group by 1, 2)"""
FACTOR = " ".join(f"when contains(\"label\", '{p}') then '{f}'" for p, f in K.FACTORS)


def _json(s, d):
    """(doc_id, json): a customer's orders as nested parts, some of whose weights are texts, out of bounds or missing."""
    o = F.col("o_orderkey")
    weight = F.when(o % 5 == 0, F.concat(F.lit('"'), (o % 90).cast("string"), F.lit('"'))).when(o % 7 == 0, F.lit("null")).otherwise((o % 130).cast("string"))
    inner = F.concat(F.lit('{"deep": [[{"value": '), (o % 97 / 100).cast("string"), F.lit(', "NAME": " '), F.col("o_orderstatus"), F.lit('"}]]}'))
    part = F.concat(F.lit('{"poids": '), weight, F.lit(', "sub": '), inner, F.lit(', "Libelle": "'), F.col("o_orderpriority"), F.lit('", "label": "x"}'))
    rows = table(s, d, "orders").select("o_custkey", F.struct(o.alias("o"), part.alias("p")).alias("part"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["p"]), ", ")
    body = F.when(F.col("o_custkey") % 6 == 0, F.concat(F.lit("no json ["), all_)).otherwise(F.concat(F.lit('{"fund": ['), all_, F.lit('], "name": "Top", "pct": true}')))
    return rows.groupBy("o_custkey").agg(body.alias("json")).select(F.col("o_custkey").alias("doc_id"), "json")


def _folds(s, d):
    r = S.weekly_returns(prices(s, d))
    folds = S.walk_forward(r)
    names = folds.select("fold", "symbol").distinct()
    even = names.select(F.lit("hrp").alias("method"), "fold", "symbol", F.lit(0.2).alias("w"))
    first = names.select(F.lit("min_cdar").alias("method"), "fold", "symbol", F.when(F.length("symbol") > 5, 0.3).otherwise(0.05).alias("w"))
    return V.fold_returns(folds, even.unionByName(first))


def _calmars(oos):
    m = S.summary(oos.select(F.col("method").alias("symbol"), F.col("i").alias("week"), "r"))
    return m.select(F.col("symbol").alias("method"), "calmar")


FOLDS = f"""{BASE}, i as (select *, row_number() over (partition by symbol order by week) - 1 i, count(*) over (partition by symbol) t from r),
f as (select symbol, week, r, k.f fold, case when i < k.f * 52 + 260 then 'train' else 'test' end as role from i, range(0, 1000) k(f) where t > 260 and k.f * 52 + 261 <= t and i >= k.f * 52 and i < k.f * 52 + 312),
w as (select method, fold, symbol, case when method = 'hrp' then 0.2::double when length(symbol) > 5 then 0.3::double else 0.05::double end w from (select distinct fold, symbol from f), (values ('hrp'), ('min_cdar')) m(method)),
fr as (select method, fold, role, week, sum(r * w) r from f join w using (fold, symbol) group by all),
oos as (select method, row_number() over (partition by method order by fold, week) - 1 i, fold, week, r from fr where role = 'test'),
fe as (select *, exp(sum(ln(1 + r)) over q) eq from fr window q as (partition by method, fold, role order by week)),
fx as (select *, 1 - eq / max(eq) over (partition by method, fold, role order by week) dd from fe),
fc as (select method, fold, quantile_cont(dd, 0.95) cut from fx where role = 'train' group by 1, 2),
fm as (select method, fold, round(avg(dd), 4) insample_cdar from fx join fc using (method, fold) where role = 'train' and dd >= cut group by 1, 2),
ft as (select method, fold, round(case when count(*) >= 4 then max(dd) end, 4) oos_maxdd from fx where role = 'test' group by 1, 2),
fold_m as (select * from fm left join ft using (method, fold)),
hon as (select method, round(avg(insample_cdar), 4) insample_cdar, round(avg(oos_maxdd), 4) oos_maxdd, round(case when avg(insample_cdar) <> 0 then avg(oos_maxdd) / avg(insample_cdar) end, 2) ratio from fold_m group by 1 having avg(insample_cdar) is not null and avg(oos_maxdd) is not null)"""


def _euro(s, d):
    """Weekly returns in euros after an insurance fee: ticks in the currency of a supplier's nation, rates from orders."""
    sup = table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), _pick(("EUR", "usd", "GBX", "sek"), F.col("s_nationkey")).alias("ccy"))
    px = S.min_history(ticks(s, d), 60).join(sup, "symbol")
    day = F.col("o_orderdate").cast("date")
    fx = table(s, d, "orders").groupBy(_pick(("USD", "GBP", "SEK"), F.col("o_custkey")).alias("ccy"), day.alias("date")).agg((F.max("o_totalprice") / 100000).alias("rate"))
    euro = M.as_of(px, fx).where("eur is not null").select("symbol", "date", F.col("eur").alias("price"))
    from ..functions.money import after_fee

    return _r(S.weekly_returns(euro).select("symbol", "week", after_fee(F.col("r"), 0.006).alias("r")), "r")


def _csv(s, d):
    o = F.col("o_orderkey")
    line = F.concat_ws(",", F.col("o_orderdate").cast("date").cast("string"), F.when(o % 13 > 0, o.cast("string")).otherwise("N/D"), F.when(o % 17 > 0, (o % 1000 / 4).cast("string")).otherwise("x"))
    body = F.concat(F.when(F.col("o_custkey") % 10 == 0, F.lit("<html>\n")).otherwise(F.lit("Date,Volume,Close\n")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), line.alias("l")))), lambda x: x["l"]), "\n"))
    return table(s, d, "orders").groupBy("o_custkey").agg(body.alias("body")).select(F.col("o_custkey").alias("symbol"), "body")


def _answers(s, d):
    o = F.col("o_orderkey")
    day = F.struct(F.col("o_orderdate").cast("date").cast("string").alias("date"), F.when(o % 3 > 0, (o % 1000).cast("double")).alias("adjusted_close"), (o % 500).cast("double").alias("close"))
    c = F.col("o_custkey")
    body = F.when(c % 7 == 0, '{"error": "no such symbol"}').when(c % 11 == 0, "[]").otherwise(F.to_json(F.collect_list(day)))
    return table(s, d, "orders").groupBy("o_custkey").agg(body.alias("body")).select(F.col("o_custkey").alias("symbol"), "body")


def _quoted(s, d):
    t = ticks(s, d).withColumn("k", F.expr("cast(substr(symbol, 2) as long)"))
    return t.select(F.concat(F.lit("F"), F.expr("k div 2"), F.lit("."), _pick(("LSE", "US", "PA"), F.col("k"))).alias("symbol"), "date", "price")


def _funds(s, d):
    return table(s, d, "supplier").select(F.concat(F.lit("F"), F.col("s_suppkey")).alias("isin"))


QUOTED = f"{TICKS}, q as (select 'F' || (substr(symbol, 2)::bigint // 2) || '.' || {_sql_pick(('LSE', 'US', 'PA'), 'substr(symbol, 2)::bigint')} symbol, date, price from p), dp as (select symbol, count(*) points from q group by 1 having count(*) >= 100), cs as (select 'F' || s_suppkey isin, symbol, points from supplier join (values ('EUFUND', 1), ('US', 2), ('PA', 3), ('XETRA', 4), ('LSE', 5)) f(suffix, place) on true join dp on symbol = 'F' || s_suppkey || '.' || suffix qualify row_number() over (partition by s_suppkey order by place) = 1)"


def _found(s, d):
    return H.cascade(_funds(s, d), _quoted(s, d))


def _basket(s, d):
    r = S.weekly_returns(ticks(s, d))
    w = r.select("symbol").distinct().select("symbol", (F.expr("cast(substr(symbol, 2) as long)") % 5).alias("fund"), F.lit(0.1).alias("w"))
    return _r(backfill.basket(r, w, 0.0002), "r")


def _points(s, d):
    m = S.summary(S.weekly_returns(ticks(s, d)))
    return C.merged_points(m.select(F.col("symbol").alias("name"), F.round("vol", 1).alias("vol"), F.round("cagr", 1).alias("cagr")).where("cagr is not null"))


def _pick_points(s, d):
    m = S.summary(S.weekly_returns(ticks(s, d))).where("cagr is not null")
    k = F.expr("cast(substr(symbol, 2) as long)")
    return C.frontier_pick(m.select((k % 4).alias("panel"), k.alias("point"), F.round("max_dd", 4).alias("max_dd"), F.round("cagr", 2).alias("cagr")), 0.985)


METRICS = f"""with {TICKS}, {WEEKS}, {RETURNS}, {EQ}, m as (select symbol, round(pow(max_by(equity, week), 52.0 / count(*)) - 1, 4) cagr, round(stddev_samp(r) * sqrt(52), 4) vol, round(max(dd), 4) max_dd from d group by 1)"""


def _keys(s, d):
    i = _instruments(s, d)
    sym = C.price_symbol(F.col("isin"), F.col("code"), F.col("exchange"), F.col("id") % 2 == 0)
    return i.select("id", sym.alias("symbol"), row_key(F.trim("isin"), F.col("code"), sym).alias("key"), C.isin_of(sym).alias("fund_isin"))


def _labels(s, d):
    rows = table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("key"))
    labels = table(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("key"), F.col("s_name").alias("label"))
    return C.labelled(rows, labels)


def _shown(s, d):
    o = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("portfolio"), F.col("l_returnflag").alias("symbol")).agg((F.count("*") / 40001).alias("w"))
    return C.shown_weights(o)


def _benchmark(s, d):
    sup = table(s, d, "supplier")
    return _r(C.benchmark_weights(sup.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("symbol"), F.lit(0.25).alias("w")), sup.where("s_suppkey % 3 <> 1").select(F.col("s_suppkey").alias("symbol"))), "w")


def _dollars(s, d):
    """Priorities' prices, by a rate on every day on which goods were shipped."""
    fx = table(s, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg((F.max("l_extendedprice") / 100000).alias("rate"))
    return _r(M.dollars_to_euros(prices(s, d), fx), "price")


def _leaderboard(s, d):
    m = S.summary(S.weekly_returns(ticks(s, d))).select(F.col("symbol").alias("id"), "calmar")
    return reports.leaderboard(m, F.col("calmar"))


def _extremes(s, d):
    from ..streaming.sync import weekly_extremes

    t = table(s, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_extendedprice").alias("price"))
    return weekly_extremes(t)


def _adaptive(s, d):
    n = S.weekly_returns(ticks(s, d)).groupBy("symbol").agg(F.count("*").alias("n"))
    train, test = V.adaptive_windows(F.col("n"))
    return n.select("symbol", train.cast("long").alias("train"), test.cast("long").alias("test"))


def _merged(s, d):
    sup = table(s, d, "supplier")
    left = sup.where("s_suppkey % 3 < 2").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return H.merged(left, sup.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("new "), "s_name")).alias("value")))


def _grid(s, d):
    m = S.summary(S.weekly_returns(ticks(s, d)))
    return _r(m.select("symbol", F.posexplode(V.grid(F.col("cdar"), F.col("max_dd"), 14)).alias("point", "budget")), "budget")


def _universes(s, d):
    sup = table(s, d, "supplier").select(F.concat(F.lit(" s"), F.col("s_nationkey")).alias("key"), F.array(F.concat(F.lit("u"), F.col("s_suppkey") % 3), F.lit("all")).alias("universe"))
    return H.universe_symbols(sup)


LINK = 'href="/([A-Za-z0-9]+)"'

QUERIES = {
    "catalogue_search": lambda s, d: H.search(table(s, d, "supplier").select(F.col("s_suppkey").alias("isin"), F.col("s_nationkey").alias("code"), F.col("s_name").alias("name")), "supplier 1"),
    "page_identifiers": lambda s, d: H.identifiers(table(s, d, "pages"), LINK),
    "adaptive_windows": _adaptive,
    "merged_maps": _merged,
    "date_union": lambda s, d: H.date_union(prices(s, d), ticks(s, d)),
    "budget_grid": _grid,
    "shown_percentages": lambda s, d: S.summary(S.weekly_returns(ticks(s, d))).select("symbol", V.percent(F.col("max_dd"), 2).alias("shown")),
    "universe_symbols": _universes,
    "active_contracts": lambda s, d: table(s, d, "customer").where("c_acctbal > 0 and c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("contract"), F.col("c_name").alias("name")),
    "currency_resolution": _resolved,
    "foreign_currency_counts": lambda s, d: M.foreign_counts(_resolved(s, d)),
    "candidate_classes": lambda s, d: _candidates(s, d).select("isin", "classe", "exotic"),
    "candidates_selected": _selected,
    "contract_menus": _menus,
    "instrument_keys": _keys,
    "labels_or_keys": _labels,
    "weights_shown": _shown,
    "benchmark_weights": _benchmark,
    "euro_returns": _euro,
    "dollars_to_euros": _dollars,
    "compositions": lambda s, d: _r(K.compositions(_reports(s, d)).drop("pos"), "w"),
    "composition_quality": lambda s, d: K.quality(K.compositions(_reports(s, d))),
    "composition_baskets": lambda s, d: _r(K.basket(K.compositions(_reports(s, d))), "w"),
    "json_compositions": lambda s, d: _r(K.json_weights(_json(s, d)), "w"),
    "oos_returns": lambda s, d: _r(V.out_of_sample(_folds(s, d)), "r"),
    "fold_metrics": lambda s, d: V.fold_metrics(_folds(s, d)),
    "honesty_ratio": lambda s, d: V.honesty(V.fold_metrics(_folds(s, d))),
    "recommended_method": lambda s, d: V.recommended(V.honesty(V.fold_metrics(_folds(s, d))), _calmars(V.out_of_sample(_folds(s, d)))),
    "correlation": lambda s, d: _r(S.covariance(S.weekly_returns(prices(s, d))).drop("cov"), "corr"),
    "mean_returns": lambda s, d: _r(S.means(S.weekly_returns(ticks(s, d))), "mu"),
    "summed_drawdowns": lambda s, d: _r(S.summed_drawdowns(S.weekly_returns(prices(s, d))), "cum", "dd"),
    "binding_start": lambda s, d: H.first_dates(ticks(s, d)),
    "base_100": lambda s, d: _r(H.base_100(S.weekly_returns(prices(s, d))), "level"),
    "csv_prices": lambda s, d: H.from_csv(_csv(s, d)),
    "json_prices": lambda s, d: H.from_answers(_answers(s, d)),
    "source_cascade": _found,
    "coverage": lambda s, d: H.coverage(_funds(s, d), _found(s, d)),
    "last_dates": lambda s, d: H.last_dates(ticks(s, d)),
    "cache_misses": lambda s, d: H.to_fetch(_funds(s, d).withColumnRenamed("isin", "symbol"), _quoted(s, d).select(F.substring_index("symbol", ".", 1).alias("symbol"))),
    "new_days": lambda s, d: H.new_days(ticks(s, d), ticks(s, d).where("date < date '1997-01-01'")),
    "basket_returns": _basket,
    "merged_points": _points,
    "frontier_pick": _pick_points,
    "leaderboard": _leaderboard,
    "weekly_extremes": _extremes,
    "levelled_backfill": lambda s, d: _r(backfill.levelled(_proxies(s, d), table(s, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), (F.col("s_suppkey") % 5).alias("proxy"), F.when(F.col("s_suppkey") % 2 == 0, 0.04).alias("annual")), 0.01), "r"),
}


def _proxies(s, d):
    r = S.weekly_returns(ticks(s, d)).withColumn("proxy", F.expr("cast(substr(symbol, 2) as long) % 5"))
    return r.groupBy("proxy", "week").agg(F.avg("r").alias("p"))


ORACLE_SQL = {
    "catalogue_search": "select s_suppkey isin, s_nationkey code, s_name as \"name\" from supplier where contains(lower(s_name || ' ' || s_nationkey || ' ' || s_suppkey), 'supplier') and contains(lower(s_name || ' ' || s_nationkey || ' ' || s_suppkey), '1') order by isin, code limit 10",
    "page_identifiers": f"select page_id, nullif(regexp_extract(coalesce(html, ''), '{LINK}', 1), '') ident from pages",
    "adaptive_windows": f"with {TICKS}, {WEEKS}, {RETURNS}, n as (select symbol, count(*) n from r group by 1) select symbol, least(260, greatest(104, n // 2))::bigint train, (case when n > 220 then 52 else greatest(20, n // 6) end)::bigint test from n",
    "merged_maps": "select s_suppkey as key, case when s_suppkey % 2 = 0 then case when s_suppkey % 5 > 0 then 'new ' || s_name end else s_name end as value from supplier where s_suppkey % 3 < 2 or s_suppkey % 2 = 0",
    "date_union": "select o_orderdate::date date from orders union select l_shipdate::date from lineitem",
    "budget_grid": f"with {TICKS}, {WEEKS}, {RETURNS}, {EQ}, c as (select symbol, quantile_cont(dd, 0.95) cut from d group by 1), m as (select symbol, round(max(dd), 4) x, round(avg(dd) filter (dd >= cut), 4) c from d join c using (symbol) group by 1) select symbol, k::int as point, round(c + (x - c) * k / 13, 6) budget from m, range(14) g(k)",
    "shown_percentages": f"with {TICKS}, {WEEKS}, {RETURNS}, {EQ}, m as (select symbol, round(max(dd), 4) x from d group by 1) select symbol, coalesce(printf('%.2f %%', 100 * x), '–') shown from m",
    "universe_symbols": "select 'S' || s_nationkey symbol, string_agg(distinct u, ',' order by u) universes from (select s_nationkey, unnest(['u' || (s_suppkey % 3), 'all']) u from supplier) group by 1",
    "active_contracts": "select c_custkey contract, c_name as \"name\" from customer where c_acctbal > 0 and c_mktsegment = 'BUILDING'",
    "currency_resolution": f"with {CATALOGUE} select id, ccy from res",
    "foreign_currency_counts": f"with {CATALOGUE} select ccy, count(*) n from res where ccy <> 'EUR' group by 1",
    "candidate_classes": f"with {CANDIDATES} select isin, classe, exotic from cand",
    "candidates_selected": f"""with {CANDIDATES}, pool as (select ord, isin, s, case when ord % 11 > 0 then classe else '?' end classe from cand where not exotic and classe <> '{C.CASH_CLASS}' and coalesce("years", 0) >= 3),
co as (select classe, min(ord) class_order from pool group by 1) select classe, isin, row_number() over (partition by classe order by s desc, ord) as rank, class_order from pool join co using (classe) qualify rank <= 4""",
    "contract_menus": f"""with {CANDIDATES}, o as (select o_custkey contract, ' fr' || (o_orderkey % 900) isin, o_orderkey ord from orders), h as (select * from o where upper(trim(isin)) in (select isin from cand where not exotic))
select * from h where contract in (select contract from h group by 1 having count(*) >= 5)""",
    "instrument_keys": f"""with ins as (select p_partkey id, case when p_partkey % 3 > 0 then 'FR' || (p_partkey % 600) else '' end isin, case when p_partkey % 4 > 0 then 'k' || (p_partkey % 900) end code, {_sql_pick(("XETRA", "lse", "US", "SW", "ZZ"), "p_size")} exchange from part),
k as (select *, case when id % 2 = 0 then isin || '.EUFUND' else upper(coalesce(code, '')) || '.' || upper(exchange) end symbol from ins)
select id, symbol, coalesce(nullif(isin, ''), nullif(code, ''), symbol) as key, case when id % 2 = 0 then isin end fund_isin from k""",
    "labels_or_keys": "select 'S' || s_suppkey as key, case when s_suppkey % 3 = 0 then s_name else 'S' || s_suppkey end as label from supplier",
    "weights_shown": "select l_suppkey portfolio, l_returnflag symbol, round(count(*) / 40001, 4) w from lineitem group by 1, 2 having count(*) / 40001 > 5e-4",
    "benchmark_weights": "with u as (select s_suppkey symbol, case when s_suppkey % 4 = 0 then 0.25::double else 0 end w from supplier where s_suppkey % 3 <> 1) select symbol, round(case when sum(w) over () > 0 then w / sum(w) over () else 1.0 / count(*) over () end, 6) w from u",
    "euro_returns": f"""with {TICKS.replace("p as", "p0 as", 1)}, sp as (select 'S' || s_suppkey symbol, {_sql_pick(("EUR", "USD", "GBP", "SEK"), "s_nationkey")} ccy, case when s_nationkey % 4 = 2 then 0.01::double else 1 end f from supplier),
p1 as (select symbol, date, ccy, price * f price from p0 join sp using (symbol) where symbol in (select symbol from p0 group by 1 having count(*) >= 60)),
x as (select {_sql_pick(("USD", "GBP", "SEK"), "o_custkey")} ccy, o_orderdate::date date, max(o_totalprice) / 100000 rate from orders group by 1, 2), x0 as (select ccy, min_by(rate, date) r0 from x group by 1),
p as (select symbol, p1.date, price * case when p1.ccy = 'EUR' then 1 else coalesce(x.rate, r0) end price from p1 asof left join x on x.ccy = p1.ccy and p1.date >= x.date left join x0 on x0.ccy = p1.ccy where p1.ccy = 'EUR' or coalesce(x.rate, r0) is not null),
{WEEKS}, {RETURNS} select symbol, week, round((1 + r) * (1 - (pow(1.006, 1 / 52.0) - 1)) - 1, 6) r from r""",
    "dollars_to_euros": """with p as (select o_orderpriority symbol, o_orderdate::date date, sum(o_totalprice::decimal(18,2))::double / count(*) price from orders group by 1, 2),
x as (select l_shipdate::date date, max(l_extendedprice) / 100000 rate from lineitem group by 1),
u as (select symbol, p.date, price, last_value(rate ignore nulls) over (partition by symbol order by p.date) rate from p left join x on x.date = p.date)
select symbol, date, round(price / rate, 6) price from u where rate is not null""",
    "compositions": f'with {LINES} select doc_id, "label", round(w, 6) w from comp',
    "composition_quality": f"with {LINES}, g as (select doc_id, count(*) n, sum(w) s from comp group by 1) select doc_id, n, round(s, 4) total, n >= 2 and s between 0.85 and 1.12 reliable from g",
    "composition_baskets": f'with {LINES}, f as (select doc_id, case {FACTOR} end factor, w from comp), g as (select doc_id, factor, sum(w) w from f where factor is not null group by 1, 2) select doc_id, factor, round(w / sum(w) over (partition by doc_id), 6) w from g',
    "json_compositions": f"""with o as (select o_custkey, o_orderkey o, '{{"poids": ' || case when o % 5 = 0 then '"' || (o % 90) || '"' when o % 7 = 0 then 'null' else (o % 130)::varchar end
  || ', "sub": {{"deep": [[{{"value": ' || (o % 97 / 100.0::double) || ', "NAME": " ' || o_orderstatus || '"}}]]}}, "Libelle": "' || o_orderpriority || '", "label": "x"}}' part from orders),
t as (select o_custkey doc_id, '{{"fund": [' || string_agg(part, ', ' order by o) || '], "name": "Top", "pct": true}}' j from o where o_custkey % 6 <> 0 group by 1),
k as (select doc_id, v.id, v.parent, lower(v.key) key, v.type, v.value from t, json_tree(t.j) v where v.parent is not null),
nm as (select doc_id, parent, value ->> '$' name from k where key in ({", ".join(f"'{x}'" for x in K.NAME_KEYS)}) qualify row_number() over (partition by doc_id, parent order by id) = 1),
wt as (select doc_id, parent, type, value from k where key in ({", ".join(f"'{x}'" for x in K.WEIGHT_KEYS)}) qualify row_number() over (partition by doc_id, parent order by id) = 1),
z as (select doc_id, parent, lower(trim(name)) lb, case when type = 'BOOLEAN' then case when value::varchar = 'true' then 1 else 0 end when type not in ('VARCHAR', 'NULL', 'OBJECT', 'ARRAY') then value::double end w from nm join wt using (doc_id, parent)),
y as (select doc_id, parent, lb, case when w > 1.5 then w / 100 else w end w from z)
select doc_id, lb as "label", round(min_by(w, parent), 6) w from y where w > 0 and w <= 1.001 group by 1, 2""",
    "oos_returns": f"{FOLDS} select method, i, fold, week, round(r, 6) r from oos",
    "fold_metrics": f"{FOLDS} select method, fold, insample_cdar, oos_maxdd from fold_m",
    "honesty_ratio": f"{FOLDS} select method, insample_cdar, oos_maxdd, ratio from hon",
    "recommended_method": f"""{FOLDS}, oe as (select *, exp(sum(ln(1 + r)) over (partition by method order by i)) eq from oos), od as (select *, 1 - eq / max(eq) over (partition by method order by i) dd from oe),
oc as (select method, round(case when max(dd) > 1e-9 then (pow(max_by(eq, i), 52.0 / count(*)) - 1) / max(dd) end, 3) calmar from od group by 1),
z as (select max(ratio) filter (method = 'min_cdar') ratio, (select max(calmar) from oc where method = 'min_cdar') c1, (select max(calmar) from oc where method = 'hrp') c2 from hon),
y as (select (ratio is null or ratio <= 1.4) k, c1 is not null and (c2 is null or c1 >= c2) c from z)
select case when k and c then 'min_cdar' else 'hrp' end as method, case when k and c then 'holds' when not k then 'overfits' else 'less robust' end reason from y""",
    "correlation": f"{BASE} select a.symbol x, b.symbol y, round(corr(a.r, b.r), 6) corr from r a join r b using (week) where a.symbol <= b.symbol group by 1, 2",
    "mean_returns": f"with {TICKS}, {WEEKS}, {RETURNS} select symbol, round(avg(r), 6) mu from r group by 1",
    "summed_drawdowns": f"{BASE}, c as (select symbol, week, sum(r) over (partition by symbol order by week) cum from r) select symbol, week, round(cum, 6) cum, round(greatest(0, max(cum) over (partition by symbol order by week)) - cum, 6) dd from c",
    "binding_start": f"with {TICKS}, f as (select symbol, min(date) as start from p group by 1) select symbol, start, symbol = (select symbol from f order by start desc, symbol limit 1) binding from f",
    "base_100": f"{BASE} select symbol, week, round(100 * exp(sum(ln(1 + r)) over (partition by symbol order by week)), 6) as level from r",
    "csv_prices": "select o_custkey symbol, o_orderdate::date date, max_by((o_orderkey % 1000) / 4, o_orderkey) price from orders where o_custkey % 10 <> 0 and o_orderkey % 17 > 0 group by 1, 2",
    "json_prices": """select o_custkey symbol, true ok, o_orderdate::date date, case when o_orderkey % 3 > 0 then (o_orderkey % 1000)::double else (o_orderkey % 500)::double end price from orders where o_custkey % 7 <> 0 and o_custkey % 11 <> 0
union all select distinct o_custkey, o_custkey % 7 <> 0, null::date, null::double from orders where o_custkey % 7 = 0 or o_custkey % 11 = 0""",
    "source_cascade": f"with {QUOTED} select * from cs",
    "coverage": f"with {QUOTED} select 'F' || s_suppkey isin, symbol, coalesce(points, 0) points, case when symbol is null then 'reconstructed' else 'real' end as method from supplier left join cs on isin = 'F' || s_suppkey",
    "last_dates": f"with {TICKS} select symbol, max(date) as last from p group by 1",
    "cache_misses": f"with {QUOTED} select 'F' || s_suppkey symbol from supplier where 'F' || s_suppkey not in (select split_part(symbol, '.', 1) from q)",
    "new_days": f"with {TICKS}, l as (select symbol, max(date) l from p where date < date '1997-01-01' group by 1) select symbol, date, price from p left join l using (symbol) where l is null or date >= l",
    "basket_returns": f"with {TICKS}, {WEEKS}, {RETURNS} select substr(symbol, 2)::bigint % 5 fund, week, round(sum(r * 0.1) - 0.0002, 6) r from r group by 1, 2",
    "merged_points": f"{METRICS} select round(round(vol, 1), 3) vol, round(round(cagr, 1), 3) cagr, string_agg(symbol, ' + ' order by symbol) names, count(*) n from m where cagr is not null group by 1, 2",
    "frontier_pick": f"{METRICS}, fp as (select substr(symbol, 2)::bigint point, max_dd x, round(cagr, 2) g from m where cagr is not null) select point % 4 panel, first(point order by g desc, point) point from fp where x <= 0.985 group by 1",
    "leaderboard": f"{METRICS.replace('round(max(dd), 4) max_dd', 'round(case when max(dd) > 1e-9 then (pow(max_by(equity, week), 52.0 / count(*)) - 1) / max(dd) end, 3) calmar')} select symbol id, calmar, coalesce(nullif(calmar, 0), -1) score from m",
    "weekly_extremes": "select 'S' || l_suppkey symbol, l_shipdate::date + ((12 - isodow(l_shipdate)) % 7)::int as week, max(l_extendedprice) high, min(l_extendedprice) low, count(*) n from lineitem group by 1, 2",
    "levelled_backfill": f"""with {TICKS}, {WEEKS}, {RETURNS}, x as (select substr(symbol, 2)::bigint % 5 proxy, week, avg(r) p from r group by 1, 2), m as (select proxy, avg(p) mean from x group by 1)
select 'S' || s_suppkey symbol, week, round(p + case when s_suppkey % 2 = 0 then pow(1.04, 1 / 52.0) - 1 - mean else -(pow(1.01, 1 / 52.0) - 1) end, 6) r from x join supplier on s_suppkey % 5 = proxy join m using (proxy)""",
}
