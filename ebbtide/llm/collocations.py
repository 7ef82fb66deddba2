"""Collocations: counted phrases of two to four words, scored by their weakest cut.

Texts are cut into pieces at `[.,;:!?\\x0A-\\x0D]` and into words `[^\\x20\\x09]+`, A-Z lower-cased. A task
numbers the words of its documents and cuts them into shards of about `shard_words` words, at piece ends.
Words that reach `least` in all shards together are kept; the others end a piece, as no candidate holds
them. Every shard then gets a bidirectional FM-index over its word ids: the order-4 Burrows-Wheeler
transform of the sequence and of its reverse, with sorted places of each id as rank structure. Phrases are
intervals in both. All intervals of a level are extended at once: words to the right into pairs, pairs to
the left into triples, triples to the right into fours; each step gives the extensions' counts and both
new intervals. A triple or four is formed only if all its pairs reach `least` in all shards; which do is
sent back to the shards that hold them. Counts are summed across shards by Spark.

Nothing is estimated or capped: a phrase's count needs only that its parts reach `least`, which follows if
it does. A task holds one shard. Scores use whole numbers of 38 digits. Of the phrases that contain a
candidate, the one with most occurrences is one word longer, so one step decides the dropping.

Null text is empty; null lang is `und`, and joins a lang of that name; empty or very long texts, ties
(equal scores go by count, then phrase), repeated rows (each counts) and empty tables are fine; other
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop, load, ship, tidy, trim, written

DEPTH = 4
SHARD_WORDS = 1 << 22
LOCAL = 28  # bits of a word's number within a shard
END = 255  # a byte that UTF-8 never has marks piece ends
TABLE = bytearray(range(256))
TABLE[65:91] = TABLE[97:123]
TABLE[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    TABLE[_c] = END
TABLE = bytes(TABLE)
MARK = bytes([END])
SHARDS = "shard long, ids binary, lang string, word string, local int, n long"
PAIRS = "shard long, w1 long, w2 long, n long, ahead binary, back binary, words binary"
LONGER = "w1 long, w2 long, w3 long, w4 long, n long"


def packed(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of runs of equal values."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return first, np.diff(np.r_[first, len(keys)])


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0."""
    order = np.argsort(keys, kind="stable")
    first, size = runs(keys[order])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(np.arange(len(first)), size)
    return out


def transform(ids: np.ndarray) -> np.ndarray:
    """The id before each place, places sorted by the DEPTH ids from there on; 0 ends a context."""
    wide = int(ids.max()) + 1
    after = np.r_[ids[1:], 0].astype(np.int64)
    pair = ranks(np.where(ids > 0, ids.astype(np.int64) * wide + after, 0))
    later = np.where((ids > 0) & (after > 0), np.r_[pair[2:], 0, 0][: len(ids)], 0)
    order = np.argsort(pair * (len(ids) + 1) + later, kind="stable")
    return ids[order - 1]


class Side:
    """One direction: the transform and, for rank queries, every id's places in order."""

    def __init__(self, bwt: np.ndarray):
        self.bwt, n = bwt, len(bwt)
        order = np.argsort(bwt, kind="stable")
        self.places = bwt[order].astype(np.int64) * n + order

    def start(self, word: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Where the interval of a word before an interval that begins at `low` begins."""
        return np.searchsorted(self.places, word.astype(np.int64) * len(self.bwt) + low)


class Phrases:
    """Intervals of phrases of one length: begins in both directions, and counts."""

    def __init__(self, low: np.ndarray, back: np.ndarray, size: np.ndarray):
        self.low, self.back, self.size = low, back, size

    def take(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.low[keep], self.back[keep], self.size[keep])

    def flipped(self) -> Phrases:
        return Phrases(self.back, self.low, self.size)


class FmIndex:
    """A bidirectional index of word ids; 0 separates pieces, and the sequence begins and ends with it."""

    def __init__(self, ahead: np.ndarray, back: np.ndarray):
        self.ahead, self.back = Side(ahead), Side(back)

    @classmethod
    def of(cls, ids: np.ndarray) -> FmIndex:
        return cls(transform(ids), transform(ids[::-1]))

    def words(self, n: int) -> Phrases:
        """Intervals of the ids 1 to n."""
        size = np.bincount(self.ahead.bwt, minlength=n + 1)
        low = np.cumsum(size) - size
        return Phrases(low[1:], low[1:], size[1:])

    def left(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        """(phrase's place, word before it, the longer phrases) for every left extension."""
        return self._extended(self.ahead, phrases)

    def right(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        """As left(), for the word after it."""
        of, word, longer = self._extended(self.back, phrases.flipped())
        return of, word, longer.flipped()

    @staticmethod
    def _extended(side: Side, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, Phrases]:
        total = int(phrases.size.sum())
        of = np.repeat(np.arange(len(phrases.size)), phrases.size)
        begin = np.cumsum(phrases.size) - phrases.size
        rows = np.arange(total) + np.repeat(phrases.low - begin, phrases.size)
        wide = int(side.bwt.max()) + 1
        keys = of * wide + side.bwt[rows]
        keys.sort()
        first, size = runs(keys)
        of, word = np.divmod(keys[first], wide)
        # In the other direction the extensions of a phrase lie in its interval, ordered by word, piece ends first.
        back = phrases.back[of] + first - begin[of]
        keep = word > 0
        of, word = of[keep], word[keep]
        return of, word, Phrases(side.start(word, phrases.low[of]), back[keep], size[keep])


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows of word ids (shard, ids) and of vocabularies (shard, lang, word, local, n)."""

    def run(batches):
        from pyspark import TaskContext

        number = count(TaskContext.get().partitionId() << 12)
        fresh = count(1)
        known: dict[str, dict[bytes, int]] = {}
        held, filled = [], 0

        def vocabulary(lang):
            if lang not in known:
                known[lang] = defaultdict(fresh.__next__)
                known[lang][MARK] = 0
            return known[lang]

        def rows(names, values, n):
            cols = dict(zip(names, values))
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in SHARD], schema=SHARD)

        def flush():
            nonlocal held, filled, fresh
            ids = np.concatenate(held)
            if ids.max(initial=0) >> LOCAL:
                raise ValueError(f"over 2^{LOCAL} different words between two ends of a piece")
            tables = [(lang, [w for w in d if w != MARK], np.array([i for w, i in d.items() if w != MARK], np.int64)) for lang, d in known.items()]
            at = 0
            while at < len(ids):
                end = min(len(ids), at + shard_words)
                while end < len(ids) and ids[end]:
                    end += 1
                part, shard = ids[at:end], next(number)
                at = end
                yield rows(["shard", "ids"], [pa.array([shard]), pa.array([packed(part)], pa.binary())], 1)
                n = np.bincount(part, minlength=int(ids.max()) + 1)
                for lang, words, local in tables:
                    there = np.flatnonzero(n[local]) if len(local) else []
                    for s in range(0, len(there), 1 << 16):
                        k = there[s : s + (1 << 16)]
                        word = pa.array([words[i] for i in k], pa.binary()).cast(pa.string())
                        yield rows(
                            ["shard", "lang", "word", "local", "n"],
                            [pa.array([shard] * len(k)), pa.array([lang] * len(k)), word, pa.array(local[k].astype(np.int32)), pa.array(n[local[k]])], len(k),
                        )
            known.clear()
            fresh = count(1)
            held, filled = [], 0

        for b in batches:
            for s in range(0, b.num_rows, 256):
                by: dict[str, list[bytes]] = {}
                for lang, text in zip(*(c.to_pylist() for c in b.slice(s, 256).columns)):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    words = MARK.join([*texts, b""]).translate(TABLE).replace(MARK, b" " + MARK + b" ").split()
                    held.append(np.fromiter(map(vocabulary(lang).__getitem__, words), np.int32, len(words)))
                    filled += len(words)
                if filled >= shard_words:
                    yield from flush()
        if filled:
            yield from flush()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return texts.mapInArrow(tidy(run), SHARDS)


SHARD = pa.schema(
    [("shard", pa.int64()), ("ids", pa.binary()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64())]
)
PAIR = pa.schema([*((c, pa.int64()) for c in ("shard", "w1", "w2", "n")), *((c, pa.binary()) for c in ("ahead", "back", "words"))])
LONG = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "w3", "w4", "n")])


def only(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The sequence with the ids `known` numbered from 1, in their order, all others as piece ends, which stand once."""
    number = np.zeros(max(int(ids.max()), int(known.max())) + 1, np.int32)
    number[known] = np.arange(1, len(known) + 1)
    ids = np.r_[0, number[ids], 0]
    return ids[np.r_[True, (ids[1:] > 0) | (ids[:-1] > 0)]].astype(np.int32)


def pairs(sequences: DataFrame, frequent: DataFrame) -> DataFrame:
    """Every shard's index and its counts of pairs of frequent words, from (shard, ids) and (shard, local, id)."""

    def run(ours, words):
        if not ours.num_rows or not words.num_rows:
            return PAIR.empty_table()
        local, name = (words[c].to_numpy() for c in ("local", "id"))
        order = np.argsort(name)
        local, name = local[order], name[order]
        ids = only(unpacked(ours["ids"][0].as_py(), np.int32), local)
        index = FmIndex.of(ids)
        of, word, found = index.right(index.words(len(name)))
        shard, n = ours["shard"][0].as_py(), len(of)
        whole = [pa.array([x], pa.binary()) for x in (packed(index.ahead.bwt), packed(index.back.bwt), packed(name))]
        numbers = pa.nulls(1, pa.int64())
        out = pa.concat_tables(
            [
                pa.Table.from_arrays([pa.array([shard]), numbers, numbers, numbers, *whole], schema=PAIR),
                pa.Table.from_arrays(
                    [pa.array(np.full(n, shard)), *(pa.array(a) for a in (name[of], name[word - 1], found.size)), *[pa.nulls(n, pa.binary())] * 3], schema=PAIR
                ),
            ]
        )
        trim()
        return out

    return sequences.groupBy("shard").cogroup(frequent.withColumnRenamed("shard", "held_by").groupBy("held_by")).applyInArrow(run, PAIRS)


def longer(indexes: DataFrame, frequent: DataFrame) -> DataFrame:
    """Every shard's counts of phrases of three and four words all of whose pairs are frequent."""

    def run(ours, known):
        if not ours.num_rows or not known.num_rows:
            return LONG.empty_table()
        index = FmIndex(*(unpacked(ours[c][0].as_py(), np.int32) for c in ("ahead", "back")))
        name = unpacked(ours["words"][0].as_py(), np.int64)
        wide = len(name) + 1
        number = lambda c: np.searchsorted(name, known[c].to_numpy()) + 1
        allowed = np.sort(number("w1") * wide + number("w2"))

        def frequent_pair(a, b):
            k = a * wide + b
            return allowed[np.minimum(np.searchsorted(allowed, k), len(allowed) - 1)] == k

        a, b, two = index.right(index.words(len(name)))
        a = a + 1
        keep = frequent_pair(a, b)
        a, b, two = a[keep], b[keep], two.take(keep)
        of, word, three = index.left(two)
        keep = frequent_pair(word, a[of])
        of, word, three = of[keep], word[keep], three.take(keep)
        w1, w2, w3 = word, a[of], b[of]
        of, word, four = index.right(three)
        keep = frequent_pair(w3[of], word)
        of, word, four = of[keep], word[keep], four.take(keep)
        named = lambda *cols: [pa.array(name[c - 1]) for c in cols]
        out = pa.concat_tables(
            [
                pa.Table.from_arrays([*named(w1, w2, w3), pa.nulls(len(w1), pa.int64()), pa.array(three.size)], schema=LONG),
                pa.Table.from_arrays([*named(w1[of], w2[of], w3[of], word), pa.array(four.size)], schema=LONG),
            ]
        )
        trim()
        return out

    return indexes.groupBy("shard").cogroup(frequent.withColumnRenamed("shard", "held_by").groupBy("held_by")).applyInArrow(run, LONGER)


def frequent_words(vocabulary: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, a) of the words that reach `least`, and (shard, local, id) where they are.

    A word's id is the first shard that has it and its number there, so common words have small ids.
    """
    everywhere = Window.partitionBy("lang", "word")
    first = F.min(F.struct("shard", "local")).over(everywhere)
    there = vocabulary.select("shard", "lang", "word", "local", F.sum("n").over(everywhere).alias("a"), first.alias("first")).where(F.col("a") >= least)
    id_ = F.shiftleft("first.shard", LOCAL) + F.col("first.local")
    there = written(there.select("shard", "lang", "word", "local", "a", id_.alias("id"), (F.col("first.shard") == F.col("shard")).alias("first")), "phrases-words-there", compression="zstd")
    return written(there.where("first").select("id", "lang", "word", "a"), "phrases-words", compression="zstd"), there.select("shard", "local", "id")


def summed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows dealt by first word and a sixteenth of the second ones, and keys that this serves.

    A shard's rows come sorted by first word and so stay in runs, which moves in half the bytes.
    """
    dealt = rows.withColumn("deal", F.pmod("w2", F.lit(16))).repartition("w1", "deal")
    return dealt, ["w1", "deal", *keys[1:]]


def counts(docs: DataFrame, least: int = 30, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): (id, lang, word, a), (w array of ids, a) of two to four words, (lang, n)."""
    ship(docs.sparkSession)
    numbered = written(shards(docs, shard_words), "phrases-shards", compression="zstd")
    vocabulary = numbered.where("ids is null").select("shard", "lang", "word", "local", "n")
    totals = written(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    words, local = frequent_words(vocabulary, least)
    found = pairs(numbered.where("ids is not null").select("shard", "ids"), local)
    kind = F.when(F.col("n").isNull(), "index").otherwise("pairs")
    found = written(found.withColumn("kind", kind), "phrases-pairs", by="kind", compression="zstd")
    drop(numbered)
    drop(local)
    dealt, keys = summed(found.where("kind = 'pairs'").select("shard", "w1", "w2", "n"), ["w1", "w2"])
    everywhere = Window.partitionBy(*keys)
    two = written(
        dealt.select("shard", "w1", "w2", F.sum("n").over(everywhere).alias("a"), (F.min("shard").over(everywhere) == F.col("shard")).alias("first"))
        .where(F.col("a") >= least),
        "phrases-frequent", compression="zstd",
    )
    drop(found, "kind=pairs")
    more = longer(found.where("kind = 'index'").select("shard", "ahead", "back", "words"), two.select("shard", "w1", "w2"))
    dealt, keys = summed(more, ["w1", "w2", "w3", "w4"])
    more = dealt.groupBy(*keys).agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    w4 = F.array("w1", "w2", "w3", "w4")
    phrases = two.where("first").select(F.array("w1", "w2").alias("w"), "a").unionByName(
        more.select(F.when(F.col("w4").isNull(), F.array("w1", "w2", "w3")).otherwise(w4).alias("w"), "a")
    )
    phrases = written(phrases, "phrases-counted")
    drop(found)
    drop(two)
    return words, phrases, totals


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, k) of all candidates that no longer one stands for."""
    part = words.select(F.array("id").alias("part"), F.col("a").alias("f")).unionByName(phrases.select(F.col("w").alias("part"), F.col("a").alias("f")))
    cuts = phrases.select("w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    first, rest = F.slice("w", 1, F.col("k")), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))
    cuts = cuts.select("w", "a", "k", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(part.select(F.col("part").alias("first"), F.col("f").alias("l")), "first").join(part.select(F.col("part").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr("(cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(20,0)) + r)")
    best = cuts.groupBy("w", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    size = F.size("w")
    inner = F.explode(F.array(F.slice("w", 1, size - 1), F.slice("w", 2, size - 1)))
    above = phrases.where(size > 2).select(inner.alias("w"), F.col("a").alias("longer")).groupBy("w").agg(F.max("longer").alias("longer"))
    wide = lambda c, k: F.col(c).cast("decimal(38,0)") * k
    kept = best.join(above, "w", "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", 80)))
    spelled = (
        kept.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "lang", "word"), "id").groupBy("w")
        .agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelling"))
        .select("w", "lang", F.array_join(F.col("spelling.word"), " ").alias("phrase"))
    )
    return kept.join(spelled, "w").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "cut.k")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each lang's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    words, phrases, totals = counts(docs, least, shard_words)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(words, phrases).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark, sf_dir):
    return collocations(load(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as p
  from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as ws from pieces),
grams as (select lang, ws[i:i + m - 1] as g from w, unnest(range(1, 5)) as u(m), unnest(range(1, len(ws) - m + 2)) as v(i)),
f as (select lang, g, count(*) as a from grams group by 1, 2 having len(g) = 1 or count(*) >= 30),
n as (select lang, sum(a) as n from f where len(g) = 1 group by 1),
c as (select * from f where len(g) > 1 and a >= 30),
inside as (
  select lang, g[i:i + m - 1] as g, max(a) as longer from c, unnest(range(2, len(c.g))) as u(m), unnest(range(1, len(c.g) - m + 2)) as v(i) group by 1, 2),
cut as (
  select c.lang, c.g, c.a, k, x.a as l, y.a as r, (2000000::hugeint * c.a) // (x.a::hugeint + y.a) as score
  from c, unnest(range(1, len(c.g))) as u(k) join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
low as (select * from cut qualify row_number() over (partition by lang, g order by score, k) = 1),
best as (
  select low.lang, array_to_string(low.g, ' ') as phrase, a, l, r, score from low left join inside on inside.lang = low.lang and inside.g = low.g
  where longer is null or 100 * longer < 80 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from best join n using (lang) qualify rank <= 2000
"""
