"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of 13 consecutive words (shorter items: one window). A window lies in a
document only if all its shingles do, so one necessary prefix token is enough: the window's rarest
shingle, by exact counts over all documents. One scan keeps the few places of documents that hold any
benchmark shingle, each with the words around it; places join on the rarest shingles; length and
positional bounds drop those where the window cannot fit; the rest are verified word by word over
item-sized windows. Covered words are summed along a document's sorted hits; documents themselves
never move, and are told apart by doc_id and text hash.

Null texts have no words: such documents are clean, such items have no windows. Very long texts are
scanned whole. Items with equal windows all count; equal shares of hits decide alike. Repeated rows give
repeated results; null doc_ids are kept; null item_ids are ignored; empty tables give clean or no
rows; extra columns are not read. No Python runs on rows. Windows are broadcast only up to
`broadcast_windows` of them (a count that is checked), and joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, load, own_columns, written

# As in the contract, but for texts whose A-Z are not yet lower-cased.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHINGLE, HEAD = 3, 0


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), SEPARATOR), lambda w: w != "")


def shingle_hashes(ws: Column, k: int) -> Column:
    """One hash per place of k consecutive words; places past the end hash nulls and match no window.

    Words are hashed in full lower case, which is equal wherever lower case of A-Z alone is.
    """
    return F.transform(ws, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(ws, i + F.lit(d)) for d in range(1, k)]))


def lowered(ws: Column) -> Column:
    return F.transform(ws, F.lower)


def items_of(bench: DataFrame) -> DataFrame:
    return bench.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), words(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("w")).where(F.size("w") > 0)


def windows(bench: DataFrame, size: int) -> DataFrame:
    """(item, win): every window of every item once."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    return items_of(bench).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win")).distinct()


def row_key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th")]


def hits(docs: DataFrame, bench: DataFrame, size: int = 13, broadcast_windows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th, start, len, item), (doc_id, th, n_words)): verified windows of the items in each different
    (doc_id, text), and every row's number of words, from the same scan."""
    each = written(windows(bench, size).select("item", F.xxhash64("win").alias("win_id"), "win"), "decon-items")
    wins = written(each.select("win_id", "win").distinct().withColumn("k", F.least(F.lit(SHINGLE), F.size("win"))), "decon-windows")
    kinds = [r.k for r in wins.select("k").distinct().collect()] or [SHINGLE]  # at most SHINGLE values
    small = wins.count() <= broadcast_windows
    hint = F.broadcast if small else (lambda df: df)
    tokens = wins.where("false").select("win_id", F.lit(0).alias("j"), F.lit(0).cast("long").alias("token"))
    for k in kinds:
        last = F.size("win") - k + 1
        tokens = tokens.unionByName(
            wins.where(F.col("k") == k).select("win_id", F.posexplode(F.slice(shingle_hashes(lowered(F.col("win")), k), F.lit(1), last)).alias("j", "token"))
        )
    split = docs.select(*row_key(), words(F.col("text")).alias("words")).withColumn("low", lowered(F.col("words")))
    # Place -1 of every row, with a token of its own, brings its number of words.
    wanted = tokens.select("token").union(docs.sparkSession.range(1).select(F.lit(HEAD).cast("long").alias("token"))).distinct()
    around = F.slice("words", F.greatest(F.col("pos") - size + 2, F.lit(1)), 2 * size)
    shape = "doc_id long, th long, pos int, n int, before int, around array<string>, token long"
    seen = docs.sparkSession.createDataFrame([], shape)
    for k in kinds:
        hashed = shingle_hashes(F.col("low"), k)
        if k == kinds[0]:
            hashed = F.concat(F.array(F.lit(HEAD).cast("long")), hashed)
        places = split.select("doc_id", "th", "words", F.posexplode(hashed).alias("pos", "token"))
        if k == kinds[0]:
            places = places.withColumn("pos", F.col("pos") - 1)
        held = places.join(hint(wanted), "token", "left_semi").where((F.col("pos") >= 0) == (F.col("token") != HEAD))
        seen = seen.unionByName(
            held.select("doc_id", "th", "pos", F.size("words").alias("n"), F.least(F.col("pos"), F.lit(size - 1)).alias("before"), around.alias("around"), "token")
        )
    seen = written(seen, "decon-places")
    counted = seen.where("pos < 0").select("doc_id", "th", F.col("n").alias("n_words"))
    seen = seen.where("pos >= 0")
    df = seen.groupBy("token").agg(F.count("*").alias("df"))
    rarest = (
        tokens.join(df, "token", "left")
        .groupBy("win_id")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "j")).alias("t"))
        .join(wins, "win_id")
        .select("win_id", "win", F.size("win").alias("len"), "t.token", "t.j")
    )
    start = F.col("pos") - F.col("j")
    own = F.transform(F.slice("around", F.col("before") - F.col("j") + 1, F.col("len")), lambda w: ascii_lower(w))
    found = (
        seen.join(hint(rarest), "token")
        .where((start >= 0) & (start + F.col("len") <= F.col("n")))
        .where(own == F.col("win"))
        .select("doc_id", "th", start.alias("start"), "len", "win_id", "win")
    )
    # The window's words, not only their hash, tell items apart.
    return found.join(hint(each), ["win_id", "win"]).select("doc_id", "th", "start", "len", "item").distinct(), counted


def figures(found: DataFrame) -> DataFrame:
    """(doc_id, th, n_hit, items) of every row key with hits; a document's sorted hits are streamed."""
    w = Window.partitionBy("doc_id", "th").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    spans = found.select("doc_id", "th", "start", "len").distinct()
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(w), F.lit(0))))
    covered = spans.withColumn("fresh", fresh).groupBy("doc_id", "th").agg(F.sum("fresh").alias("n_hit"))
    items = found.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = F.col("c.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("c.th") == F.col("i.th"))
    return covered.alias("c").join(items.alias("i"), same).select("c.doc_id", "c.th", "n_hit", "items")


def judged(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """Contract figures per document; a document is contaminated from one hit word in twenty."""
    found, counted = hits(docs, bench, **params)
    found = written(figures(found), "decon-found")
    none = F.array().cast("array<string>")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("d.th").eqNullSafe(F.col("f.th"))
    return counted.alias("d").join(found.alias("f"), same, "left").select(
        "d.doc_id", "d.th", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")
    ).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "th",
    )


def clean(docs: DataFrame, bench: DataFrame, **params) -> DataFrame:
    """The documents that are not contaminated, with all their own columns; equal rows are judged alike."""
    bad = written(judged(docs, bench, **params).where("contaminated").select("doc_id", "th").distinct(), "decon-bad")
    keyed = docs.select(F.struct(*own_columns(docs)).alias("_own"), *row_key())
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("d.th").eqNullSafe(F.col("b.th"))
    return keyed.alias("d").join(bad.alias("b"), same, "left_anti").select("d._own.*")


def query(spark, sf_dir):
    return judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("th")


ORACLE_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w, row_number() over () as key from documents),
i as (select item_id::varchar item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where item_id is not null),
win as (select distinct item, w[s:s + 12] win from (select item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) s from i where len(w) > 0)),
size as (select distinct len(win) n from win),
pos as (select key, s, w[s:s + n - 1] win from (select key, w, n, unnest(range(1, len(w) - n + 2)) s from d, size where len(w) >= n)),
hit as (select key, s, len(pos.win) n, item from pos join win on pos.win = win.win),
cover as (select key, count(distinct p) n_hit from (select key, unnest(range(s, s + n)) p from hit) group by 1),
its as (select key, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct key, item from hit) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join cover using (key) left join its using (key)
"""
