"""Contract batches, journals, comparisons, shortlists, pages and chunks on small cases with known results."""

import datetime as dt
import json
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import comparison, contracts, journal, reports
from ebbtide.sources import paged


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


@pytest.fixture
def top():
    return tempfile.mkdtemp(prefix="spark-batch-", dir="/tmp")


def day(n):
    return dt.date(2020, 1, 3) + dt.timedelta(n)


def batch(spark, bad=()):
    px = [(s, day(7 * i), str(100 + i * k)) for k, s in enumerate(("A", "B", "C")) for i in range(12)] + [("N", day(0), "1"), ("N", day(7), "2"), ("M", day(0), "1")]
    px += [("X", day(7 * i), "oops" if i == 5 else "1") for i in range(12)]
    menu = [("fine", "A", "1"), ("fine", "B", "3"), ("fine", "gone", "5"), ("text", "A", "1"), ("text", "B", "much"), ("few", "A", "1"), ("few", "gone", "1"), ("price", "A", "1"), ("price", "X", "1"), ("short", "N", "1"), ("short", "M", "2")]
    codes = [(c,) for c in ("fine", "text", "few", "price", "short", "none", "fine", None)] + [(b[0],) for b in bad]
    tables = (codes, "contract string"), (menu + list(bad), "contract string, symbol string, weight string"), (px, "symbol string, date date, price string")
    return {r.contract: r for r in contracts.measured(*(spark.createDataFrame(*t) for t in tables)).collect()}


def test_a_bad_contract_harms_no_other(spark):
    got = batch(spark)
    assert {c: r.error for c, r in got.items()} == {"fine": None, "text": "bad weight", "few": "too few funds", "price": "bad price", "short": "too few weeks", "none": "no menu", None: "no menu"}
    assert got["fine"].ok and got["fine"].funds == 2 and got["fine"].cagr > 0 and got["price"].cagr is None
    more = batch(spark, [("worse", "X", "-1"), ("worse", "A", None), ("zero", "A", "0"), ("nan", "B", "NaN")])
    assert all(more[c] == r for c, r in got.items()) and {more[c].error for c in ("worse", "zero", "nan")} == {"bad weight"}


def test_journal_numbers_on(spark, top):
    def results(lo, hi):
        rows = []
        for k in range(lo, hi):
            deep = {"meta": {"source": f"s{k}", "n_assets": k}, "portefeuilles": {"hrp": {"in_sample": {"cagr": k / 100, "calmar": None}}, "profil_equilibre": {"in_sample": {"calmar": [0.5, None, 0][k % 3], "cagr": 0.012}}}, "params": {"a": [1]}}
            rows.append((k, json.dumps(deep) if k % 5 else "no json", f"n{k}" if k % 2 else None, None))
        return spark.createDataFrame(rows, "k int, result string, note string, hypothesis string").repartition(3)

    path = f"{top}/journal"
    assert journal.load(spark, path).count() == 0
    journal.append(spark, path, results(0, 7), ["k"])
    assert [r.id for r in journal.append(spark, path, results(7, 20), ["k"]).orderBy("id").collect()] == list(range(8, 21))
    journal.append(spark, path, results(0, 0), ["k"])
    rows = journal.load(spark, path).orderBy("id").collect()
    assert [(r.id, r.source, r.hrp_cagr, r.n_assets, r.params) for r in rows] == [
        (k + 1, f"s{k}", k / 100, k, '{"a":[1]}') if k % 5 else (k + 1, "?", None, None, None) for k in range(20)
    ]
    assert [r.note for r in rows[:3]] == ["", "n1", ""] and rows[3].profil_equilibre_calmar == 0.5
    ranked = journal.ranked(journal.load(spark, path)).orderBy("place").collect()
    assert [r.place for r in ranked] == list(range(1, 21))
    want = sorted(range(20), key=lambda k: (-(0.5 if k % 5 and k % 3 == 0 else -1), k))
    assert [r.id - 1 for r in ranked] == want and (ranked[0].cagr, ranked[0].maxdd) == ("+1.2%", "—")


def test_percentages_round_doubles_and_keep_the_sign_of_zero(spark, top):
    from ebbtide.operators.series import summary

    xs = [1.0365, 0.6335, -0.0765, -0.5285, 0.012, -0.00003, 0.0, -0.0, None, float("nan"), 2e20]
    got = [r.p for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(journal.percent(F.col("x")).alias("p")).collect()]
    assert got == ["+103.7%", "+63.4%", "-7.7%", "-52.9%", "+1.2%", "-0.0%", "+0.0%", "-0.0%", "—", "—", "+20000000000000000000000.0%"]
    flat = spark.createDataFrame([("a", day(0), 0.1), ("a", day(7), 1 / 1.1 - 1 - 1e-9)], "symbol string, week date, r double")
    assert str(summary(flat).first().cagr) == "-0.0"
    deep = {"portefeuilles": {"profil_equilibre": {"in_sample": {"cagr": -0.0, "max_drawdown": 0.0, "calmar": -0.0}}}}
    journal.append(spark, f"{top}/zero", spark.createDataFrame([(1, json.dumps(deep), None, None)], "k int, result string, note string, hypothesis string"), ["k"])
    row = journal.ranked(journal.load(spark, f"{top}/zero")).first()
    assert (row.cagr, row.maxdd, str(row.calmar)) == ("-0.0%", "+0.0%", "-0.0")


def test_comparisons(spark):
    lines = spark.createDataFrame([("p", "b", 2, 0.6, "réel"), ("p", "a", 1, 0.4, "réel (marché)"), ("q", "b", 9, 0.0004, "reconstruit"), ("q", "c", 3, 1.0, None), ("q", "d", 4, 0.0001, "modélisé"), ("z", "e", 0, 1.0, "")], "profile string, asset string, ord int, w double, source string")
    assert [(r.asset, r.place) for r in comparison.asset_order(lines).orderBy("place").collect()] == [("e", 0), ("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert sorted(map(tuple, comparison.allocation_matrix(lines, ["p", "q"]).collect())) == [("a", 0.4, 0.0, 0.4), ("b", 0.6, 0.0004, 0.6), ("c", 0.0, 1.0, 1.0)]
    assert [r.kind for r in comparison.provenance(lines).orderBy("profile", "ord").collect()] == ["real", "real", None, "modelled", "rebuilt", None]
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.4")), ("b", bytearray(b"<html>")), ("c", bytearray(b"%P")), ("d", None)], "name string, content binary")
    assert [r.name for r in comparison.pdf_only(files).collect()] == ["a"]
    rows = spark.createDataFrame([(" fr1", 1), ("FR1 ", 3), ("FR1", 2), (" ", 9), (None, 9)], "isin string, n int")
    assert [tuple(r) for r in comparison.keep_last(rows, "isin", "n").collect()] == [("FR1", 3)]
    hits = spark.createDataFrame([("a", 1, "fund", "PA"), ("a", 2, "etf", "US"), ("a", 3, "ETF", "PA"), ("b", 1, None, None), ("b", 2, "fund", "PA"), ("c", 1, "fund", "PA"), ("c", 2, "etf", "US")], "query string, ord int, type string, exchange string")
    assert {r.query: r.ord for r in comparison.venue_choice(hits).collect()} == {"a": 3, "b": 1, "c": 2}


def test_sources(spark, top):
    s = comparison.Sources(gone=lambda: spark.read.parquet(f"{top}/gone"), empty=lambda: spark.range(0), full=lambda: spark.range(3))
    assert s.get("gone,empty,full").count() == 3
    with pytest.raises(LookupError, match="empty"):
        s.get("gone,empty")
    with pytest.raises(KeyError):
        s.get("other")


def test_shortlist_equals_plain_python(spark):
    import random

    rng = random.Random(1)
    names = ["Alpha World", "ALPHA-WORLD (C)", "Alpha World Equity D", "Beta", "beta", "Gamma Fund Europe A", "Gamma Fund Europe B", "Δelta 1", "", None, "--"]
    rows = [(f"s{k:03d}", rng.choice(names) if k % 3 else f"Fund {k} {'x' * 12}", rng.choice(["eq", "bd", "monétaire", None]), day(-5000 if rng.random() < 0.8 else 0), rng.choice([None, float("nan"), round(rng.random(), 1)])) for k in range(200)]
    best = {}
    for s, n, c, start, score in rows:
        share = "".join(ch for ch in n or "" if ch.isalnum()).upper()[:12]
        if share and start <= dt.date(2008, 9, 1) and score is not None and score == score and c != "monétaire":
            best[share] = min(best.get(share, (9, "")), (-score, s, n, c))
    want = []
    for c in {b[3] for b in best.values()}:
        want += [(c, i + 1, s, n, -x) for i, (x, s, n, _) in enumerate(sorted(b for b in best.values() if b[3] == c)[:3])]
    df = spark.createDataFrame(rows, "symbol string, name string, classe string, start date, score double")
    assert sorted(map(tuple, reports.shortlist(df, per_class=3).collect()), key=str) == sorted(want, key=str)


def test_pages(spark, top):
    plain = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.concat(F.lit("s"), F.col("id") % 3).alias("symbol"))
    plain.repartition(2).write.option("parquet.block.size", 1024).parquet(f"{top}/t")
    rows = paged.read_pages(spark, f"file://{top}/t", "id bigint, k bigint, symbol string", 90)
    assert rows.rdd.getNumPartitions() == 12 and sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))
    some = paged.read_pages(spark, f"file://{top}/t", "id bigint, k bigint, symbol string", 10, {"symbol": "s1", "k": 3}).where("id > 500")
    assert some.rdd.getNumPartitions() == 5  # of the 48 rows that the source lets pass
    assert sorted(r.id for r in some.collect()) == [i for i in range(501, 1000) if i % 3 == 1 and i % 7 == 3]
    assert rows.where("symbol = 'none'").count() == 0 and rows.select("k").distinct().count() == 7


def test_chunks_are_written_once(spark, top):
    rows = spark.range(2500).select("id", F.concat(F.lit("é"), "id").alias("s")).repartition(2)
    paged.write_chunks(rows, f"file://{top}/c", 800)
    files = sorted(p.name for p in Path(f"{top}/c").glob("*.json"))
    assert max(len(Path(f"{top}/c", f).read_text().splitlines()) for f in files) == 800
    # What another attempt of a task leaves behind is in no list.
    Path(f"{top}/c", files[0].rsplit("-", 1)[0] + "-ffffffff.json").write_bytes(Path(f"{top}/c", files[0]).read_bytes())
    read = lambda: sorted(map(tuple, paged.read_chunks(spark, f"file://{top}/c", "id long, s string").collect()))
    assert read() == [(i, f"é{i}") for i in range(2500)]
    broken = rows.select(F.when(F.col("id") == 2400, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"), "s")
    with pytest.raises(Exception, match="no"):
        paged.write_chunks(broken, f"file://{top}/c", 800)
    assert len(read()) == 2500
    paged.write_chunks(rows.limit(5), f"file://{top}/c", 800)
    assert len(read()) == 2505


def test_equal_menus_are_measured_once(spark, monkeypatch):
    px = [(s, day(7 * i), str(100 + (i * k) % 7)) for k, s in enumerate(("A", "B", "C"), 1) for i in range(12)]
    menu = [(f"c{c:02d}", s, w) for c in range(30) for s, w in (("A", "1"), ("B", "2") if c % 2 else ("C", "3"))]
    tables = ([(f"c{c:02d}",) for c in range(30)], "contract string"), (menu, "contract string, symbol string, weight string"), (px, "symbol string, date date, price string")
    series, plain = [], contracts.drawdowns
    monkeypatch.setattr(contracts, "drawdowns", lambda r: series.append(r.select("symbol").distinct().count()) or plain(r))
    run = lambda: sorted(map(tuple, contracts.measured(*(spark.createDataFrame(*t) for t in tables)).collect()))
    few = run()
    monkeypatch.setattr(contracts, "FEW_SYMBOLS", 0)
    assert few == run() and series == [2, 2]
    assert all(r[1] and r[3:] == few[int(r[0][1:]) % 2][3:] for r in few)


def test_euro_panel_reads_prices_once(spark, top):
    from ebbtide.operators import loader

    px = [(s, day(i), float(1 + i + k)) for k, s in enumerate("abc") for i in range(30) if (i + k) % 5]
    spark.createDataFrame(px, "symbol string, date date, price double").write.parquet(f"{top}/px")
    lines = spark.createDataFrame([(1, "A", "a", "EUR"), (1, "B", "b", "EUR"), (2, "A", "a", "EUR"), (3, "C", "c", "XXX"), (None, "A", "a", "EUR")], "panel long, key string, symbol string, ccy string")
    fx = spark.createDataFrame([("USD", day(0), 2.0)], "ccy string, date date, rate double")
    out = loader.euro_panel(lines, spark.read.parquet(f"{top}/px"), fx)
    assert out._jdf.queryExecution().executedPlan().toString().count(f"{top}/px") == 1
    rows = {(r.panel, r.key) for r in out.collect()}
    assert rows == {(1, "A"), (1, "B"), (2, "A")}
