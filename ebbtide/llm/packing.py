"""Vector bin packing of token pieces into sequences.

A document's ids are a prompt, which bears no loss, and loss-bearing ids after it. Pieces go to the open
sequence with the largest dot product between what the sequence has left and what the piece needs,
under simultaneous limits on tokens, segments and loss-bearing tokens. A document over `max_tokens` is
cut first: full sequences that take prompt and loss-bearing ids in the proportion it has left of them,
so that neither runs out first, and one piece or two for the rest. If no open sequence can take a piece
whole, the piece is cut to fill the one it can fill with the least, which is then closed. At a
partition's end the open sequences are poured together, again by cutting, so padding stays with the
last few sequences of a partition. Packing needs no shuffle and holds `open_bins` sequences a task.

Null or empty texts hold the end id alone, which bears loss; very long texts are cut as said; equal
documents and ties of the dot product go in the order they come; repeated rows are packed as often as
they occur; an empty table gives no rows; other columns are not read by pack().
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, tidy
from .tokenids import encoder, tokenizer_path


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    loss: int

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        """The first n ids, and the rest; loss-bearing ids are the last `loss` of a piece."""
        rest = len(self.ids) - n
        tail = min(self.loss, rest)
        return (
            Piece(self.doc, self.start, self.ids[:n], self.doc_tokens, self.loss - tail),
            Piece(self.doc, self.start + n, self.ids[n:], self.doc_tokens, tail),
        )


class Packer:
    """Open sequences of one partition, at most `open_bins` at a time."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, open_bins: int):
        self.cap = np.array([max_tokens, max_segments, max_loss], np.int64)
        self.weight = 1.0 / self.cap**2
        self.room = np.empty((open_bins, 3), np.int64)
        self.bins: list[list[Piece]] = []

    def _close(self, i: int) -> list[Piece]:
        """Take sequence i out; the last one moves into its place."""
        n = len(self.bins) - 1
        self.room[i] = self.room[n]
        self.bins[i], self.bins[n] = self.bins[n], self.bins[i]
        return self.bins.pop()

    def _put(self, i: int, p: Piece):
        self.bins[i].append(p)
        self.room[i] -= (len(p.ids), 1, p.loss)
        if self.room[i].min() <= 0 and (self.room[i, 0] <= 0 or self.room[i, 1] <= 0):
            yield self._close(i)

    def add(self, p: Piece):
        """Place a document; yields the sequences this closes."""
        most, segments, most_loss = self.cap.tolist()
        ids, prompt = p.ids, len(p.ids) - p.loss
        lead, tail = 0, prompt  # next prompt id and next loss-bearing id
        while prompt - lead + len(ids) - tail > most and segments > 1:
            free, left = prompt - lead, len(ids) - tail
            loss = min(most_loss, max(most - free, round(most * left / (free + left))))
            plain = min(free, most - loss)
            if plain + loss < most:
                break
            yield [q for q in (self._part(p, lead, plain), self._part(p, tail, loss)) if len(q.ids)]
            lead, tail = lead + plain, tail + loss
        if lead == 0 and tail == prompt:
            yield from self._add(p)
        else:
            for q in (self._part(p, lead, prompt - lead), self._part(p, tail, len(ids) - tail)):
                yield from self._add(q)

    @staticmethod
    def _part(p: Piece, at: int, n: int) -> Piece:
        first_loss = len(p.ids) - p.loss
        return Piece(p.doc, p.start + at, p.ids[at : at + n], p.doc_tokens, max(0, at + n - max(at, first_loss)))

    def _add(self, p: Piece):
        while len(p.ids):
            k = len(self.bins)
            room = self.room[:k]
            need = np.array([len(p.ids), 1, p.loss])
            fits = (room >= need).all(1)
            if fits.any():
                i = int(np.argmax(np.where(fits, room @ (need * self.weight), -1.0)))
                yield from self._put(i, p)
                return
            # What each open sequence could take of the piece's beginning.
            plain = len(p.ids) - p.loss
            takes = np.minimum(np.minimum(room[:, 0], len(p.ids)), plain + room[:, 2])
            fills = (takes == room[:, 0]) & (takes > 0)
            if k < len(self.room) and (len(p.ids) <= self.cap[0] and p.loss <= self.cap[2]):
                self.room[k] = self.cap
                self.bins.append([])
                yield from self._put(k, p)
                return
            if fills.any():
                i = int(np.argmin(np.where(fills, takes, self.cap[0] + 1)))
                head, p = p.cut(int(takes[i]))
                yield from self._put(i, head)
                continue
            if k < len(self.room):
                head, p = p.cut(int(min(len(p.ids), self.cap[0], plain + self.cap[2])))
                self.room[k] = self.cap
                self.bins.append([])
                yield from self._put(k, head)
                continue
            yield self._close(int(np.argmin(room[:, 0])))

    def finish(self):
        """Pour the open sequences together, cutting pieces at each sequence's end."""
        now, room = [], self.cap.copy()
        # Prompts and loss-bearing pieces alternate as their shares do, so that no limit binds early.
        for p in self._blended([p for b in self.bins for p in b]):
            while len(p.ids):
                n = int(min(room[0], len(p.ids), len(p.ids) - p.loss + room[2]))
                if n <= 0 or room[1] < 1:
                    yield now
                    now, room = [], self.cap.copy()
                    continue
                head, p = p.cut(n)
                now.append(head)
                room -= (len(head.ids), 1, head.loss)
        if now:
            yield now
        self.bins = []

    @staticmethod
    def _blended(pieces: list[Piece]) -> list[Piece]:
        heavy = sorted((p for p in pieces if 4 * p.loss > 3 * len(p.ids)), key=lambda p: -len(p.ids))
        light = sorted((p for p in pieces if 4 * p.loss <= 3 * len(p.ids)), key=lambda p: -len(p.ids))
        total, loss = sum(len(p.ids) for p in pieces), sum(p.loss for p in pieces)
        out, seen, borne = [], 0, 0
        while heavy or light:
            p = (light if not heavy or (light and borne * total > loss * seen) else heavy).pop(0)
            out.append(p)
            seen, borne = seen + len(p.ids), borne + p.loss
        return out


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    max_tokens: int = 1024,
    max_segments: int = 32,
    max_loss_tokens: int = 896,
    open_bins: int = 64,
    with_ids: bool = True,
    prompt_share: float = 0.25,
) -> DataFrame:
    """One row a piece: its document, range, place in a sequence and (with_ids) its ids.

    An optional column `loss_from` gives the number of leading ids that bear no loss (prompts of
    instruction data); without it, or where it is null, the first `prompt_share` of a document's ids is
    its prompt. sequence_id is (partition << 32) + a counter.
    """
    has_loss = "loss_from" in docs.columns
    loss_from = (F.col("loss_from") if has_loss else F.lit(None)).cast("long")
    schema = COLUMNS + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        enc, packer = encoder(path), Packer(max_tokens, max_segments, max_loss_tokens, open_bins)
        seq = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(sequence):
            nonlocal seq
            at = 0
            for p in sequence:
                raw = p.ids.astype("<u4")
                row = (p.doc, p.start, len(raw), zlib.crc32(raw.tobytes()), p.doc_tokens, seq, at)
                rows.append(row + ((raw.astype(np.int32),) if with_ids else ()))
                at += len(raw)
            seq += 1

        def batch():
            cols = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for big in batches:
            for at in range(0, big.num_rows, 64):
                docs, texts, skips = (c.to_pylist() for c in big.slice(at, 64).columns)
                flat, size = enc.closed(texts, end_id)
                for doc, skip, ids in zip(docs, skips, np.split(flat, np.cumsum(size)[:-1])):
                    prompt = int(len(ids) * prompt_share) if skip is None else max(0, skip)
                    for s in packer.add(Piece(doc, 0, ids, len(ids), max(0, len(ids) - prompt))):
                        emit(s)
                if len(rows) > 4000:
                    yield batch()
        for s in packer.finish():
            emit(s)
        if rows:
            yield batch()

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), loss_from.alias("loss_from"))
    return narrow.mapInArrow(tidy(run), schema)


def query(spark, sf_dir):
    """Documents carry no masks: the first quarter of each one's ids counts as its prompt."""
    return pack(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)
