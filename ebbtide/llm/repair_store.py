"""Token ids in Re-Pair compressed shards, with random access.

Rows are range-partitioned by doc_id; a partition writes its documents in ascending doc_id order as
shards, each the ids of successive documents up to `shard_tokens`, and each with a grammar of its own:
rules (left, right pairs of ids), the expansion length of every rule, the compressed sequence and the
documents' lengths. Shard files are Parquet rows with binary payloads, so Spark's commit protocol
covers lost executors. Frequent pairs are replaced, the most frequent of those that could overlap
first, until no pair occurs `least` times. Reading expands only the symbols that cover the wanted
documents, found through the stored expansion lengths.

Null or empty texts hold the end id alone; null doc_ids sort first; rows with equal doc_ids keep any
order; repeated rows are stored as often as they occur; a text longer than a shard makes one large
shard; an empty table gives no shards and no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, parts, tidy, written
from .tokenids import encoder, tokenizer_path

SHARD = (
    "part int, shard long, part_start long, n_tokens long, first_symbol long, "
    "doc_ids array<long>, doc_lengths array<long>, rules binary, expansions binary, sequence binary"
)
RULE_BASE = 1 << 20


def re_pair(seq: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, expansion lengths, sequence): rule i is nonterminal RULE_BASE + i.

    Symbols are a linked list. A pair that is rare when it is counted stays rare: its younger symbol
    was made in one round, and all its places with it. So each round sorts the live places alone, which
    are those of frequent pairs not yet replaced and those next to a replacement.
    """
    n = len(seq)
    if n and seq.max() < 1 << 22:
        known = np.flatnonzero(np.bincount(seq))
        number = np.zeros(int(seq.max()) + 1, np.int64)
        number[known] = np.arange(len(known))
        sym = number[seq]
    else:
        known, sym = np.unique(seq, return_inverse=True)
    sym = np.append(sym, -1).astype(np.int32)  # a sentinel ends the list
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    live = _perhaps_frequent(sym, least)
    marked = np.zeros(n, bool)
    rules, top = [], len(known)
    while len(live):
        live, pair = _sorted_pairs(sym, after, live, top)
        uniq, first, count = _runs(pair)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        left, right = uniq[often] >> 32, uniq[often] & 0xFFFFFFFF
        now = _compatible(left, right, np.lexsort((uniq[often], -count[often])))
        spread = lambda chosen: np.repeat(first[chosen] - np.cumsum(count[chosen]) + count[chosen], count[chosen]) + np.arange(count[chosen].sum())
        pos = live[spread(often[now])]
        made = np.repeat(np.arange(now.sum()), count[often[now]])
        twins = np.repeat((left == right)[now], count[often[now]])
        keep = ~twins
        if twins.any():
            keep[np.flatnonzero(twins)[_apart(pos[twins], after)]] = True
        pos, made = pos[keep], made[keep]
        gone = after[pos]
        nxt = after[gone]
        sym[pos] = top + made
        sym[gone] = -1
        after[pos] = nxt
        before[nxt] = pos
        rules.append(np.stack([left[now], right[now]], 1))
        top += int(now.sum())
        prev = before[pos]
        marked[live[spread(often[~now])]] = True
        marked[pos] = True
        marked[prev[prev >= 0]] = True
        live = np.flatnonzero(marked)
        marked[live] = False
        live = live[(sym[live] >= 0) & (sym[after[live]] >= 0)]
    name = np.concatenate([known.astype(np.int64), RULE_BASE + np.arange(top - len(known))])
    flat = name[np.concatenate(rules)] if rules else np.empty((0, 2), np.int64)
    size = np.ones(top, np.int64)
    at = len(known)
    for r in rules:
        size[at : at + len(r)] = size[r].sum(1)
        at += len(r)
    return flat.astype(np.uint32), size[len(known) :], name[sym[sym >= 0]].astype(np.uint32)


def _perhaps_frequent(sym: np.ndarray, least: int) -> np.ndarray:
    """Places of a whole sequence whose pair may occur `least` times, by counts of hashed pairs."""
    pair = sym[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + sym[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77)
    bucket = (pair >> np.uint32(12)).astype(np.int32)
    return np.flatnonzero(np.bincount(bucket, minlength=1 << 20)[bucket] >= least)


def _sorted_pairs(sym, after, live, top: int, bits: int = 21) -> tuple[np.ndarray, np.ndarray]:
    """Live places ordered by (pair, place), and their pairs; small numbers sort as one word each."""
    a, b = sym[live].astype(np.int64), sym[after[live]].astype(np.int64)
    if max(len(sym), top) < 1 << bits:
        key = np.sort((a << (2 * bits)) | (b << bits) | live)
        mask = (1 << bits) - 1
        return key & mask, ((key >> (2 * bits)) << 32) | ((key >> bits) & mask)
    pair = (a << 32) | b
    order = np.argsort(pair, kind="stable")
    return live[order], pair[order]


def _compatible(left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Pairs taken in rank order that cannot overlap: no symbol ends one of them and begins another."""
    now, begins, finishes = np.zeros(len(rank), bool), set(), set()
    for i, a, b in zip(rank.tolist(), left[rank].tolist(), right[rank].tolist()):
        if a not in finishes and b not in begins and (a != b or a not in begins and a not in finishes):
            if a == b:
                # Overlaps only itself, which _apart settles.
                finishes.add(a)
                begins.add(a)
            else:
                begins.add(a)
                finishes.add(b)
            now[i] = True
    return now


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[cut], cut, np.diff(np.append(cut, len(ordered)))


def _apart(pos: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of runs of overlapping places (ascending within a pair) the numbers of every second one."""
    start = np.append(True, after[pos[:-1]] != pos[1:])
    head = np.maximum.accumulate(np.where(start, np.arange(len(pos)), 0))
    return np.flatnonzero((np.arange(len(pos)) - head) % 2 == 0)


def _length(symbols: np.ndarray, known: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    rule = symbols >= RULE_BASE
    out[rule] = known[symbols[rule] - RULE_BASE]
    return out


def symbol_ends(seq: np.ndarray, expansions: np.ndarray) -> np.ndarray:
    """Number of ids up to the end of each symbol of a shard's sequence."""
    return np.cumsum(_length(seq.astype(np.int64), expansions))


class Shard:
    """A shard opened for reading: rules expand once, when the first range that needs them is read."""

    def __init__(self, rules: np.ndarray, expansions: np.ndarray, seq: np.ndarray):
        self.rules, self.expansions, self.seq = rules, expansions, seq
        self.ends = symbol_ends(seq, expansions)
        self.flat = None

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop), expanding only the symbols that cover the range."""
        if self.flat is None:
            self.flat = expand(self.rules, RULE_BASE + np.arange(len(self.rules)))
            self.first = np.cumsum(self.expansions) - self.expansions
        a = int(np.searchsorted(self.ends, start, "right"))
        b = int(np.searchsorted(self.ends, stop, "left")) + 1
        base = int(self.ends[a - 1]) if a else 0
        seq = self.seq[a:b].astype(np.int64)
        rule = seq >= RULE_BASE
        at = len(self.flat) + np.arange(len(seq))
        at[rule] = self.first[seq[rule] - RULE_BASE]
        size = np.diff(self.ends[a:b], prepend=base)
        at -= np.cumsum(size) - size
        out = np.concatenate([self.flat, self.seq[a:b]])[np.repeat(at, size) + np.arange(size.sum())]
        return out[start - base : stop - base]


def decode_range(rules, expansions, seq, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a shard."""
    return Shard(rules, expansions, seq).range(start, stop)


def expand(rules: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Undo all rules, one level of every nonterminal at a time."""
    seq = seq.astype(np.int64)
    while len(seq):
        rule = seq >= RULE_BASE
        if not rule.any():
            break
        pos = np.cumsum(1 + rule) - 1
        out = np.empty(int(pos[-1]) + 1, np.int64)
        pair = rules[seq[rule] - RULE_BASE]
        out[pos[~rule]] = seq[~rule]
        out[pos[rule] - 1], out[pos[rule]] = pair[:, 0], pair[:, 1]
        seq = out
    return seq.astype(np.uint32)


def write_shards(docs: DataFrame, path: str, end_id: int = 2, shard_tokens: int = 1 << 20) -> DataFrame:
    """Write docs (doc_id, text) as shards to the shared folder; returns the shard table."""

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        ids, lengths, held, filled, done, shard = [], [], [], 0, 0, 0

        def flush():
            rules, sizes, seq = re_pair(np.concatenate(held))
            n = int(sum(lengths))
            return pa.RecordBatch.from_pylist(
                [
                    dict(
                        part=part, shard=shard, part_start=done, n_tokens=n, first_symbol=RULE_BASE, doc_ids=ids,
                        doc_lengths=lengths, rules=rules.tobytes(), expansions=sizes.tobytes(), sequence=seq.tobytes(),
                    )
                ],
                schema=SCHEMA,
            ), n

        for big in batches:
            for s in range(0, big.num_rows, 64):
                b = big.slice(s, 64)
                flat, size = enc.closed(b.column(1).to_pylist(), end_id)
                for doc, a in zip(b.column(0).to_pylist(), np.split(flat, np.cumsum(size)[:-1])):
                    ids.append(doc)
                    lengths.append(len(a))
                    held.append(a)
                    filled += len(a)
                    if filled >= shard_tokens:
                        out, n = flush()
                        yield out
                        ids, lengths, held, filled, done, shard = [], [], [], 0, done + n, shard + 1
        if ids:
            yield flush()[0]

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = narrow.repartitionByRange(parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return written(ranged.mapInArrow(tidy(run), SHARD), "repair")


SCHEMA = pa.schema(
    [
        ("part", pa.int32()), ("shard", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()),
        ("first_symbol", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
        ("rules", pa.binary()), ("expansions", pa.binary()), ("sequence", pa.binary()),
    ]
)


def read_shards(shards: DataFrame, range_tokens: int = 1 << 16) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document from the shard files alone.

    A partition's first id follows from the partitions' totals: one small row a partition, summed in
    order. A shard is decoded range by range, each some documents of `range_tokens` ids together.
    """
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    first = totals.select(
        "part",
        (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"),
    )
    based = shards.join(F.broadcast(first), "part").withColumn("shard_start", F.col("base") + F.col("part_start"))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                start, docs, lens, rules, sizes, seq = (b.column(i)[r] for i in range(6))
                rules = np.frombuffer(rules.as_py(), np.uint32).reshape(-1, 2)
                sizes, seq = np.frombuffer(sizes.as_py(), np.int64), np.frombuffer(seq.as_py(), np.uint32)
                shard = Shard(rules, sizes, seq)
                n = lens.values.to_numpy()
                ends = np.cumsum(n)
                crc, at = [], 0
                while at < len(n):
                    lo = int(ends[at] - n[at])
                    to = max(at + 1, int(np.searchsorted(ends, lo + range_tokens, "right")))
                    ids = shard.range(lo, int(ends[to - 1])).astype("<u4")
                    crc += [zlib.crc32(ids[e - k - lo : e - lo]) for e, k in zip(ends[at:to].tolist(), n[at:to].tolist())]
                    at = to
                yield pa.RecordBatch.from_arrays(
                    [docs.values, pa.array(ends - n + start.as_py()), pa.array(n), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return based.select("shard_start", "doc_ids", "doc_lengths", "rules", "expansions", "sequence").mapInArrow(
        tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def query(spark, sf_dir):
    return read_shards(write_shards(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))
