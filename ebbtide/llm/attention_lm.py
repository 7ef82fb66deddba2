"""Language-model scores by a causal self-attention model, trained in numpy on subword ids.

A text is its lower-cased words, each the ids of its encoding after a space, then one end. Words are
counted first, over all training texts. Their counts give a memory of how words go on and end
(subword_memory); the attention network (attention_net) predicts every id from overlapping windows of
the ids before it, as a mixture of learned components and that memory. The chance of a text is the
product over its ids and its words' ends, a true distribution over texts.

Training texts are dealt by hash into units of nearly equal size, whose number follows the corpus. The
units form a few rounds; in each round every unit is trained from the same weights, each of its windows
once, and the mean of all units' weights begins the next round. So the result does not depend on how
the input is split, and every window of every training text trains exactly once. Scoring then takes
all windows in masked batches; each id is scored in one window.

Each word's count and the memory's chances of its ids are computed once, by joins over exact counts of
all contexts. Texts become numbers of words once, for training and scoring: the most frequent words, at
most `head`, are broadcast; what is known of all others comes to each text by a join on the word.

Null or empty texts are one end token; very long texts are cut into windows like others; null doc_ids
train; repeated rows repeat and get equal scores; without training rows the network is at its start
values; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import os
import zlib
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_net as net
from .common import drop, load, parts, tidy, written
from .subword_memory import END, IDS, INSIDE, OPENERS, SYMBOLS, Memory, ids_of, single_counts, step_values, steps
from .tokenids import encoder, tokenizer_path

BATCH = 128
COLUMNS = [f"v{i}" for i in range(net.K)]
TRAINS = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) != 1"


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def words_of(text: str | None) -> list[bytes]:
    """On UTF-8 bytes, lower() changes A-Z alone and split() parts at x20 and x09-x0D alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def encoded(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, ids)."""
    size, ids = encoder(path).spaced([w.decode("utf-8", "replace") for w in words])
    return size, ids.astype(np.int64)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, words per text), the same as words_of()."""
    whole_texts = texts.take(pa.array(np.arange(len(texts))))  # a slice of an array is not lowered right by pyarrow 23
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(whole_texts.cast(pa.large_string()), "")))
    some = pc.not_equal(trimmed, "")
    n = np.zeros(len(trimmed), np.int64)
    parts = pc.ascii_split_whitespace(trimmed.filter(some))
    n[some.to_numpy(zero_copy_only=False)] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return parts.flatten(), n


def slices(b: pa.RecordBatch, column: int, size: int = 1 << 20):
    """A batch in pieces whose texts hold about `size` bytes or are one."""
    at = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield b.slice(i, j - i)
        i = j


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, m): every word of all texts with its number in training texts and in all."""

    def run(batches):
        held, rows = [], 0

        def together():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum"), ("m", "sum")]).select(["word", "n_sum", "m_sum"]).rename_columns(["word", "n", "m"])

        for big in batches:
            for b in slices(big, 0):
                words, k = split(b.column(0))
                found = words.dictionary_encode()
                index, trains = found.indices.to_numpy(), np.repeat(b.column(1).to_numpy(zero_copy_only=False), k)
                n, m = (np.bincount(i, minlength=len(found.dictionary)) for i in (index[trains], index))
                held.append(pa.table([found.dictionary, pa.array(n), pa.array(m)], ["word", "n", "m"]))
                rows += len(n)
                if rows > 800_000:
                    held = [together()]
                    rows = held[0].num_rows
                    if rows > 400_000:
                        yield from as_bytes(held.pop())
                        rows = 0
        if held:
            yield from as_bytes(together())

    counted = texts.select("text", F.expr(TRAINS).alias("trains")).mapInArrow(tidy(run), "word binary, n long, m long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def as_bytes(counts: pa.Table) -> list[pa.RecordBatch]:
    return counts.cast(pa.schema([("word", pa.binary()), ("n", pa.int64()), ("m", pa.int64())])).to_batches(max_chunksize=10_000)


def learn_memory(counts: DataFrame, path: str, ends: int) -> tuple[DataFrame, Memory]:
    """((word, m, v) of all words, v as in packed(); memory of single ids alone), from exact counts of every context."""

    def place(batches):
        for big in batches:
            for i in range(0, big.num_rows, 4096):
                b = big.slice(i, 4096)
                size, ids = encoded(path, b.column(0).to_pylist())
                keys = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(steps(size, ids)))
                yield pa.RecordBatch.from_arrays([*b.columns, keys], ["word", "n", "m", "keys"])

    placed = written(counts.mapInArrow(tidy(place), "word binary, n long, m long, keys array<long>"), "lm-placed", compression="zstd")
    step = written(placed.select(F.explode("keys").alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")), "lm-steps", compression="zstd")
    alone = single_counts(step)
    keys = np.concatenate([(c + 2) * SYMBOLS + np.flatnonzero(n) for c, n in zip((OPENERS, INSIDE), alone)])
    memory = Memory(keys, np.concatenate([n[n > 0] for n in alone]), ends)
    values = written(step_values(step, memory.inside), "lm-values", compression="zstd")
    drop(step)
    place_of = placed.select("word", "n", "m", F.posexplode("keys").alias("pos", "key"))
    each = place_of.join(values, "key").groupBy("word").agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("pos", "key", "go", "go_out", "log_step"))).alias("x")
    )

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(packed(b.column(1).to_numpy(), *(lists(b.column(i)) for i in range(3, 7))), pa.binary())], ["word", "m", "v"]
            )

    flat = each.select("word", "n", "m", *(F.col(f"x.{c}").alias(c) for c in ("key", "go", "go_out", "log_step")))
    words = written(flat.mapInArrow(tidy(pack), "word binary, m long, v binary"), "lm-words", compression="zstd")
    drop(placed)
    drop(values)
    return words, memory


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, number in each list); null lists are empty."""
    return column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def packed(n: np.ndarray, keys, go, go_out, log_step) -> list[bytes]:
    """Each word as bytes: count and log10 chance to go on and end (8 bytes each), chances of its ids after the first
    (4 each), the same with one occurrence left out, ids (2 each)."""
    key, size = keys
    cut = np.append(0, np.cumsum(size)).tolist()
    chain = np.add.reduceat(log_step[0], cut[:-1]) if len(n) else np.zeros(0)
    head, ids = np.stack([n.astype(np.int64), chain.astype(np.float64).view(np.int64)], 1), ids_of(key).astype(np.uint16)
    a, b = (x[0].astype(np.float32) for x in (go, go_out))
    return [h.tobytes() + a[s : e - 1].tobytes() + b[s : e - 1].tobytes() + ids[s:e].tobytes() for h, s, e in zip(head, cut[:-1], cut[1:])]


class Table:
    """Words from their bytes, by number: size, indices, the memory's chances, log10 chance to go on and end, count."""

    def __init__(self, v: pa.BinaryArray, memory: Memory, out: int):
        self.memory = memory
        cut = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64)
        self.size = (np.diff(cut) - 8) // 10
        at, buf = cut[:-1] - cut[0], np.frombuffer(v.buffers()[2] or b"", np.uint8)[cut[0] : cut[-1]]
        take = lambda start, n, kind: buf[(np.repeat(start, n * kind.itemsize) + span(n * kind.itemsize))].view(kind)
        one = np.ones(len(v), np.int64)
        self.count, self.chain = take(at, one, np.dtype("<i8")), take(at + 8, one, np.dtype("<f8"))
        go = take(at + 16 + out * 4 * (self.size - 1), self.size - 1, np.dtype("<f4"))
        ids = take(at + 16 + 8 * (self.size - 1), self.size, np.dtype("<u2")).astype(np.int32)
        self.first = np.cumsum(self.size) - self.size
        self.index, self.known = ids.copy(), np.empty(len(ids), np.float32)
        self.index[self.first] += IDS
        opens = np.zeros(len(ids), bool)
        opens[self.first] = True
        self.known[opens], self.known[~opens] = np.maximum(memory.open[ids[opens]], 1e-12), go

        self.room: dict[str, np.ndarray] = {}

    def joined(self, more: "Table") -> "Table":
        """This table with more words after it, in room that the next call takes again."""
        out = object.__new__(Table)
        out.memory = self.memory
        for x in ("first", "size", "index", "known", "chain", "count"):
            own, new = getattr(self, x), getattr(more, x)
            n, room = len(own), self.room.get(x, ())
            if len(room) < n + len(new):
                room = self.room[x] = np.concatenate([own, np.empty(2 * len(new), own.dtype)])
            room[n : n + len(new)] = new + len(self.index) if x == "first" else new
            setattr(out, x, room[: n + len(new)])
        return out

    def ids(self, number: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return ids_and_chances(self, number, n)


TABLES: dict[int, tuple] = {}


def frequent_table(frequent: pa.BinaryArray, memory: Memory, out: int) -> Table:
    """The table of the shipped words, made once a worker: a broadcast value is the same object in all its tasks."""
    if out not in TABLES or TABLES[out][0] is not frequent:
        TABLES[out] = frequent, Table(frequent, memory, out)
    return TABLES[out][1]


def span(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, joined."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def coded(texts: DataFrame, words: DataFrame, head: int, units: int, parts: int) -> tuple[list[DataFrame], pa.BinaryArray]:
    """(tables of (doc_id, th, held_out, unit, numbers, at, v), `parts` of the training rows and one of those held out; bytes of the most frequent words, `head` at most).

    A number from 0 is one of the frequent words, which are shipped; -1 - i is the text's word number i of all others,
    whose bytes come by a join: v[j] is that of number at[j]. The joins go one table at a time, so that the files they
    shuffle are a part of all.
    """
    often = words.groupBy("m").count().toPandas().sort_values("m", ascending=False)  # under sqrt(2 * words) rows
    fits = often["m"][often["count"].cumsum() <= head]
    least = int(fits.iloc[-1]) if len(fits) else 1 << 62
    top = words.where(F.col("m") >= least).select("word", "v").toArrow()  # at most `head` words
    frequent = texts.sparkSession.sparkContext.broadcast(whole(top["word"]))

    def run(batches):
        find = {w: i for i, w in enumerate(frequent.value.to_pylist())}.get
        for big in batches:
            for b in slices(big, 5):
                flat, n = split(b.column(5))
                found = flat.dictionary_encode()
                index, distinct = found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.large_binary())
                number = np.fromiter(map(find, distinct.to_pylist(), repeat(-1)), np.int32, len(distinct))[index]
                # Other words are numbered within their text.
                own = np.flatnonzero(number < 0)
                text = np.repeat(np.arange(len(n)), n)[own]
                pair, at = np.unique(text * max(1, len(distinct)) + index[own], return_inverse=True)
                k = np.bincount(pair // max(1, len(distinct)), minlength=len(n))
                number[own] = -1 - (at - (np.cumsum(k) - k)[text])
                rest = distinct.take(pa.array(pair % max(1, len(distinct)))).cast(pa.binary())
                cuts = [pa.array(np.append(0, np.cumsum(x)).astype(np.int32)) for x in (n, k)]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:5], pa.array([held_out(d) for d in b.column(1).to_pylist()], pa.bool_()),
                     pa.ListArray.from_arrays(cuts[0], pa.array(number)), pa.ListArray.from_arrays(cuts[1], rest)],
                    ["key", "doc_id", "th", "unit", "part", "held_out", "numbers", "rest"],
                )

    th = F.xxhash64("text")
    unit = F.pmod(F.when(F.col("doc_id").isNull(), th).otherwise(F.xxhash64("doc_id")), F.lit(units))
    narrow = texts.select(
        F.monotonically_increasing_id().alias("key"), "doc_id", th.alias("th"), unit.alias("unit"),
        F.when(F.expr(TRAINS), unit % parts).otherwise(parts).cast("int").alias("part"), "text",
    )
    schema = "key long, doc_id long, th long, unit long, part int, held_out boolean, numbers array<int>, rest array<binary>"
    docs = written(narrow.mapInArrow(tidy(run), schema), "lm-docs", by="part", compression="zstd")
    asked = docs.select("part", "key", F.posexplode("rest").alias("r", "word"))
    rare = asked.join(words.where(F.col("m") < least).select("word", "v"), "word").select("part", "key", "r", "v")
    found = written(rare, "lm-found", by="part", compression="zstd")
    drop(words)
    tables = []
    for p in reversed(range(parts + 1)):
        mine = F.col("part") == p
        given = found.where(mine).groupBy("key").agg(F.collect_list(F.struct("r", "v")).alias("x")).select("key", F.col("x.r").alias("at"), F.col("x.v").alias("v"))
        full = docs.where(mine).select("key", "doc_id", "th", "unit", "held_out", "numbers").join(given, "key", "left").drop("key")
        tables.append(written(full, "lm-coded", compression="zstd"))
        drop(docs, f"/part={p}")
        drop(found, f"/part={p}")
    return tables[::-1], whole(top["v"])


def whole(column: pa.ChunkedArray) -> pa.BinaryArray:
    return pa.concat_arrays([pa.array([], pa.binary()), *column.chunks])


def numbered(b: pa.RecordBatch, table: Table, out: int) -> tuple[Table, np.ndarray, np.ndarray]:
    """(frequent words and those of a batch that begins with (numbers, at, v), number of every word, words per text)."""
    (number, n), (at, k) = lists(b.column(0)), lists(b.column(1))
    size, start = len(table.size), np.cumsum(k) - k
    slot = np.empty(len(at), np.int64)
    slot[np.repeat(start, k) + at] = np.arange(len(at))
    number, own = number.astype(np.int64), number < 0
    number[own] = size + slot[(np.repeat(start, n) - 1 - number)[own]]
    return table.joined(Table(b.column(2).flatten(), table.memory, out)) if len(at) else table, number, n


class Words(dict):
    """Words of texts numbered as they are met, from a memory in one process: the small version of Table."""

    def __init__(self, path: str, memory: Memory, out: int):
        self.path, self.memory, self.out = path, memory, out
        self.size, self.first, self.index, self.known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of every word, words per text)."""
        each = [words_of(t) for t in texts]
        new = list({w for ws in each for w in ws} - self.keys())
        size, ids = encoded(self.path, new)
        first = np.cumsum(size) - size
        index = ids.astype(np.int32)
        index[first] += IDS
        self.first, self.size = np.append(self.first, len(self.index) + first), np.append(self.size, size)
        self.index, self.known = np.append(self.index, index), np.append(self.known, self.memory.chances(size, ids, self.out)[0])
        self.update(zip(new, range(len(self), len(self) + len(new))))
        return np.array([self[w] for ws in each for w in ws], np.int64), np.array(list(map(len, each)), np.int64)

    def ids(self, number: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        return ids_and_chances(self, number, n)


def ids_and_chances(table, number: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(indices, memory's chances) of each text, with the end, of a table of words."""
    size = table.size[number]
    at = np.cumsum(size, dtype=np.int64)
    place = np.repeat(table.first[number] - (at - size), size) + np.arange(at[-1] if len(at) else 0)
    index, known = table.index[place], table.known[place]
    cut = np.concatenate([[0], at])[np.concatenate([[0], np.cumsum(n)])]
    last, share = np.array([END + IDS], np.int32), np.array([table.memory.open[END]], np.float32)
    both = [(np.append(index[a:b], last), np.append(known[a:b], share)) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
    return [x for x, _ in both], [y for _, y in both]


def start(memory: Memory):
    share = np.concatenate([memory.raw[1], memory.raw[0]]) + 0.01
    return net.start(share / share.sum())


def train(spark: SparkSession, dealt: list[DataFrame], frequent: pa.BinaryArray, memory: Memory, units: int):
    """(S, parameters) after all rounds, each of which has a table."""
    s, w = start(memory)
    steps, rounds = 0, len(dealt)
    shared = spark.sparkContext.broadcast((frequent, memory))
    for mine in dealt:
        ship = spark.sparkContext.broadcast((s, w))
        at = steps

        def run(batches):
            os.environ.setdefault("OMP_NUM_THREADS", "1")
            words = frequent_table(*shared.value, 1)
            s0, w0 = ship.value
            total, rest, done, small, places = np.zeros(s0.shape), 0.0, 0, {k: np.zeros(v.shape) for k, v in w0.items()}, 0
            ids, known, unit = [], [], None

            def close():
                nonlocal rest, done, places
                chances = np.concatenate(known)
                rows, new, other, params, n = net.train_unit(s0, w0, ids, END + IDS, lambda _: chances, at=at)
                total[rows] += new - s0[rows] * other
                rest, done, places = rest + other, done + 1, places + n
                for k in small:
                    small[k] += params[k]
                ids.clear()
                known.clear()

            for big in batches:
                for i in range(0, big.num_rows, BATCH):
                    b = big.slice(i, BATCH)
                    table, number, n = numbered(b, words, 1)
                    for u, x, y in zip(b.column(3).to_pylist(), *table.ids(number, n)):
                        if u != unit and ids:
                            close()
                        unit = u
                        ids.append(x)
                        known.append(y)
            if ids:
                close()
            if done:
                rows = np.flatnonzero(total.any(1))
                flat = np.concatenate([small[k].ravel() for k in net.SHAPES])
                flat = np.append(flat, np.zeros(-len(flat) % net.K)).reshape(-1, net.K)
                head = np.zeros((1, net.K))
                head[0, :3] = rest, done, places
                keys = np.concatenate([rows, [-1], -2 - np.arange(len(flat))])
                values = np.concatenate([total[rows], head, flat])
                yield pa.RecordBatch.from_arrays([pa.array(keys)] + [pa.array(np.ascontiguousarray(c)) for c in values.T], ["key", *COLUMNS])

        k = max(1, min(parts(spark), -(-units // rounds)))
        sorted_units = mine.repartition(k, "unit").sortWithinPartitions("unit", "doc_id", "th").select("numbers", "at", "v", "unit")
        sums = sorted_units.mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in COLUMNS))
        got = sums.groupBy("key").agg(*[F.sum(c).alias(c) for c in COLUMNS]).toPandas()  # one row an index at most
        if not len(got):
            continue
        keys, values = got["key"].to_numpy(np.int64), got[COLUMNS].to_numpy()
        rest, done, places = values[keys == -1][0, :3]
        s = s.astype(np.float64) * (rest / done)
        s[keys[keys >= 0]] += values[keys >= 0] / done
        s = np.maximum(s, 1e-30).astype(np.float32)
        flat = values[keys < -1][np.argsort(-keys[keys < -1])].ravel() / done
        a = 0
        for name, shape in net.SHAPES.items():
            size = int(np.prod(shape))
            w[name] = flat[a : a + size].reshape(shape).astype(np.float32)
            a += size
        steps += int(places / done / net.STRIDE / 128)
    return s, w


def score(docs: DataFrame, path: str, head: int = 1 << 18, unit_words: int = 100_000, rounds: int = 4) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = written(word_counts(texts), "lm-counts", compression="zstd")
    ends = texts.where(TRAINS).count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    total, kinds = n_words + ends, distinct + (ends > 0)
    base = math.log10(total + 0.5 * (kinds + 1))
    words, memory = learn_memory(counts, path, ends)
    drop(counts)
    units = max(rounds, 1, -(-n_words // unit_words))
    tables, frequent = coded(texts, words, head, units, max(1, rounds))
    s, w = train(spark, tables[:rounds], frequent, memory, units)
    docs = reduce(DataFrame.unionAll, tables)
    model = spark.sparkContext.broadcast((frequent, memory, s, w))

    def run(batches):
        os.environ.setdefault("OMP_NUM_THREADS", "1")
        frequent, memory, s, w = model.value
        words, scorer = frequent_table(frequent, memory, 0), net.Scorer(s, w)
        for big in batches:
            for i in range(0, big.num_rows, BATCH):
                b = big.slice(i, BATCH)
                table, number, n = numbered(b, words, 0)
                own = text_scores(scorer, *table.ids(number, n))
                text, c = np.repeat(np.arange(len(n)), n), table.count[number]
                sc = np.bincount(text, table.chain[number], len(n)) + own
                part = np.bincount(text, np.log10(c + 0.5) - base, len(n)) + math.log10(ends + 0.5) - base
                k = np.bincount(text, c > 0, len(n)).astype(np.int64) + (ends > 0)
                yield pa.RecordBatch.from_arrays(
                    [b.column(3), b.column(4), pa.array(n + 1), pa.array(k), pa.array(np.full(len(n), total)), pa.array(part), pa.array(sc)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select("numbers", "at", "v", "doc_id", "held_out").mapInArrow(
        tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def text_scores(scorer: net.Scorer, ids: list[np.ndarray], known: list[np.ndarray], chunk: int = 128) -> np.ndarray:
    """Sum of the log10 chances of each text's ids; the windows of all texts run together."""
    x, y, mask = net.many_windows(ids, END + IDS)
    k = np.zeros(mask.shape, np.float32)
    k[mask] = np.concatenate(known)
    lp = [np.log10(scorer.chances(x[i : i + chunk], y[i : i + chunk], k[i : i + chunk])[mask[i : i + chunk]] + 1e-30) for i in range(0, len(x), chunk)]
    return np.add.reduceat(np.concatenate(lp).astype(np.float64), np.cumsum([0, *map(len, ids[:-1])]))


def query(spark, sf_dir):
    return score(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
