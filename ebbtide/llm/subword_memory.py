"""How words go on and end, from counts of all training words.

A word is the ids of its encoding after a space. An index tells an id that opens a word (id + IDS) from
one inside it. After each id a word ends or goes on: both chances, and the chance of each next id, come
from counts after the last two indices within the word, which fall back to the last one and that to
all, with absolute discounting, so that every context's chances sum to one. All counts are kept.
With `out` = 1 a word's own occurrence is left out of all counts, as training needs.

`step_values` gives the chances of every step of any word by joins and sums over all counts, so none is
dropped and no table of contexts is shipped; what is bounded by the vocabulary of ids is broadcast.
`Memory` is the same for counts that fit one process.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDS, END = 50257, 50256
ANY, ENDS, SYMBOLS = IDS, IDS + 1, IDS + 2
OPENERS, INSIDE = -1, -2
DISCOUNT, FLOOR = 0.75, 0.01


def word_pairs(first: np.ndarray, size: np.ndarray, ids: np.ndarray):
    """For words given by ids[first : first + size]: (word of each id, its index, index two before within the word or -1)."""
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(ids)) - np.repeat(first, size)
    index = ids.astype(np.int64) + np.where(place == 0, IDS, 0)
    before = np.where(place > 0, np.concatenate([[0], index[:-1]]), -1)
    return word, index, before


def long_context(before: np.ndarray, index: np.ndarray) -> np.ndarray:
    return (before + 1) * 2 * IDS + index


def steps(size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Key of each id's place in its word: the index before, its index, and the id or end that follows."""
    word, index, before = word_pairs(np.cumsum(size) - size, size, ids)
    last = np.append(word[1:] != word[:-1], True)[: len(ids)]
    return long_context(before, index) * SYMBOLS + np.where(last, ENDS, np.append(ids[1:], 0)[: len(ids)])


def ids_of(keys: np.ndarray) -> np.ndarray:
    """The ids whose places have these keys."""
    return keys // SYMBOLS % (2 * IDS) % IDS


def single_counts(step: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all ids as openers and inside words, from (key, n) of all steps: at most two rows an id."""
    context = F.expr(f"key div {SYMBOLS}")
    inner = (context >= 2 * IDS).alias("inner")
    got = step.select((context % IDS).cast("int").alias("id"), inner, "n").where("n > 0").groupBy("id", "inner").agg(F.sum("n").alias("n")).toPandas()
    return tuple(np.bincount(got["id"][got["inner"] == k].to_numpy(np.int64), got["n"][got["inner"] == k].to_numpy(np.float64), IDS) for k in (False, True))


def step_values(step: DataFrame, inside: np.ndarray) -> DataFrame:
    """(key, go, go_out, log_step) of distinct steps (key, n): the chance of the id that follows, also with one
    occurrence of the step left out, and log10 of the chance to end or to go on; n is 0 for steps not in training.
    """
    spark = step.sparkSession
    all_ = Window.partitionBy("context")
    sums = lambda n, c, w: (
        F.sum(n).over(w).alias(f"n{c}"), F.sum(F.when(F.col("follow") == ENDS, F.col(n)).otherwise(0)).over(w).alias(f"stop{c}"),
        F.count(F.when((F.col(n) > 0) & (F.col("follow") < IDS), 1)).over(w).alias(f"kinds{c}"),
    )
    rows = step.select("key", F.col("n").alias("c2"), F.expr(f"key div {SYMBOLS}").alias("context"), (F.col("key") % SYMBOLS).alias("follow"))
    rows = rows.select("key", "c2", "follow", (F.col("context") % (2 * IDS)).alias("index"), (F.col("context") >= 2 * IDS).alias("deep"), *sums("c2", 2, all_))
    short = rows.groupBy("index", "follow").agg(F.sum("c2").alias("c1"))
    short = short.select("index", "follow", "c1", *sums("c1", 1, Window.partitionBy("index")))
    share = spark.createDataFrame([(i, float(x)) for i, x in enumerate(inside)], "follow long, share double")
    joined = rows.join(short, ["index", "follow"]).join(F.broadcast(share), "follow", "left")
    last, zero = F.col("follow") == ENDS, F.lit(0)

    def after(level: int, end, go, out: int):
        n, stop, kinds, c = (F.col(f"{x}{level}") for x in ("n", "stop", "kinds", "c"))
        some = (F.lit(True) if level == 1 else F.col("deep")) & (n > out)
        n, stop = F.greatest(n - out, zero), F.greatest(stop - F.when(last, out).otherwise(0), zero)
        going = F.greatest(n - stop, zero)
        own = F.when(c > out, c - out - DISCOUNT).otherwise(0.0)
        lost = DISCOUNT * (kinds - F.when((c > 0) & (c <= out), 1).otherwise(0))
        return (
            F.when(some, (stop + 2 * end) / (n + 2)).otherwise(end),
            F.when(some & (going > 0), (own + lost * go) / F.greatest(going, F.lit(1))).otherwise(go),
        )

    for level in (1, 2):
        before = (F.lit(0.4), F.col("share"), F.lit(0.4), F.col("share")) if level == 1 else tuple(F.col(x) for x in ("end", "go", "end_out", "go_out"))
        end, go = after(level, *before[:2], 0)
        end_out, go_out = after(level, *before[2:], 1)
        joined = joined.withColumns({"end": end, "go": go, "end_out": end_out, "go_out": go_out})
    least = lambda x: F.greatest(F.col(x), F.lit(1e-12)).cast("float").alias(x)
    return joined.select("key", least("go"), least("go_out"), F.log10(F.when(last, F.col("end")).otherwise(1 - F.col("end"))).alias("log_step"))


def entries(size: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of all contexts with what follows; a key is context * SYMBOLS + symbol, shifted by two contexts."""
    first = np.cumsum(size) - size
    word, index, before = word_pairs(first, size, ids)
    weight = n[word]
    last = np.append(word[1:] != word[:-1], True)
    follows = np.where(last, ENDS, np.append(ids[1:], 0).astype(np.int64))
    deep = before >= 0
    keys, counts = [], []
    for context, symbol, some in (
        (index, follows, None), (index, np.full(len(index), ANY), None),
        (long_context(before, index), follows, deep), (long_context(before, index), np.full(len(index), ANY), deep),
        (np.full(len(index), OPENERS), ids.astype(np.int64), ~deep), (np.full(len(index), INSIDE), ids.astype(np.int64), deep),
    ):
        k = (context + 2) * SYMBOLS + symbol
        keys.append(k if some is None else k[some])
        counts.append(weight if some is None else weight[some])
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    uniq, at = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(at, counts, len(uniq)).astype(np.int64)


class Memory:
    """Counts that fit one process."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int):
        """`ends` texts end, each by the opener END."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        context, symbol = keys // SYMBOLS - 2, keys % SYMBOLS
        self.open, self.inside = (self._share(symbol[context == c], counts[context == c], e) for c, e in ((OPENERS, ends), (INSIDE, 0)))
        self.raw = [np.bincount(symbol[context == c], counts[context == c], IDS) for c in (OPENERS, INSIDE)]
        self.raw[0][END] += ends
        follow = (context >= 0) & (symbol < IDS)
        self.keys, self.counts = keys[follow], counts[follow]
        # One row a context: all its counts, those of words that end there, and counts and kinds of kept entries.
        kept = context >= 0
        self.context, at = np.unique(context[kept], return_inverse=True)
        sums = lambda chosen: np.bincount(at[chosen[kept]], counts[kept & chosen], len(self.context))
        self.row = np.stack([sums(symbol == ANY), sums(symbol == ENDS), sums(symbol < IDS), np.bincount(at[(symbol < IDS)[kept]], minlength=len(self.context))], 1)

    @staticmethod
    def _share(ids, counts, ends):
        c = np.full(IDS, FLOOR)
        c[ids] += counts
        c[END] += ends
        return c / c.sum()

    def _count(self, context, symbol):
        if not len(self.keys):
            return np.zeros(len(context))
        k = (context + 2) * SYMBOLS + symbol
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.counts[at], 0)

    def _row(self, context):
        if not len(self.context):
            return np.zeros((4, len(context)))
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return (self.row[at] * (self.context[at] == context)[:, None]).T

    def chances(self, size: np.ndarray, ids: np.ndarray, out: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(chance of each id among those that could stand there, log10 chance of each word to go on and end where it does)."""
        first = np.cumsum(size) - size
        word, index, before = word_pairs(first, size, ids)
        last = np.append(word[1:] != word[:-1], True)[: len(ids)]
        follow = np.append(ids[1:], 0)[: len(ids)].astype(np.int64)
        end, go = np.full(len(ids), 0.4), self.inside[np.where(last, 0, follow)]
        for context, some in ((index, np.ones(len(ids), bool)), (long_context(before, index), before >= 0)):
            n, stop, held, kinds = self._row(context)
            c = np.zeros(len(ids))
            goes = np.flatnonzero(~last)
            c[goes] = self._count(context[goes], follow[goes])
            some = some & (n > out)
            held = held - out * (c > 0) * ~last
            n, stop = n - out, stop - out * last
            # A context that is kept may have lost its rare ends; then the shorter context's share stands in.
            end = np.where(some, (np.maximum(stop, 0) + 2 * end) / (np.maximum(n, 0) + 2), end)
            going = np.maximum(n - np.maximum(stop, 0), 0)
            going = np.maximum(going, held)
            use = some & (going > 0)
            own = np.where(c > out, c - out - DISCOUNT, 0)
            # With the place left out, a kind that has only it is gone.
            kinds = kinds - ((c > 0) & (c <= out))
            lost = going - held + DISCOUNT * kinds
            go = np.where(use, (np.maximum(own, 0) + lost * go) / np.maximum(going, 1), go)
        known = self.open[ids]
        inner = np.flatnonzero(~last)
        known[inner + 1] = go[inner]
        step = np.log10(np.where(last, end, 1 - end))
        return np.maximum(known, 1e-12).astype(np.float32), np.bincount(word, step, len(size))
