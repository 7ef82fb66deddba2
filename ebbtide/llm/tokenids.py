"""Exact token ids and counts through a bounded memo of white-space chunks.

Byte-pair merges never cross a pre-token, and a pre-token never crosses the places where a text is cut
here: before a single space that a visible character follows, and around runs of line feeds between
visible characters. Each distinct chunk is encoded once per task, by tiktoken from the tokenizers file's
own merges if it holds only common letters and else by the tokenizers library; a text's ids are gathered
from one flat array of all chunks' ids. Texts cut otherwise by other white space, or that hold the
string of a special token, go whole to the tokenizers library.
"""

from __future__ import annotations

import gc
import json
import os
import re
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import regex

# The public tokenizers' pre-tokenisation patterns.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

# Separators that Python's split() takes for white space and the tokenizer does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
MEMO_LIMIT, MEMO_KEPT = 500_000, 150_000
NEW = -2  # a chunk not met before


# Characters that every regex library puts into the same classes.
SURE = re.compile("[\x20-\x7e\xc0-\u024f]*").fullmatch


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@contextmanager
def no_collection():
    """Keep the garbage collector from walking through the many short lists made meanwhile."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranked(path: str):
    """The same byte-level BPE for the tiktoken library, about five times faster on single chunks.

    None unless the file's ids follow the order of its merges, as ranks must.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, table = model["vocab"], byte_symbols()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ids = [vocab["".join(p)] for p in pairs]
    if any(a >= b for a, b in zip(ids, ids[1:])) or (ids and min(ids) < 256):
        return None
    ranks = {bytes(table[c] for c in v): i for v, i in vocab.items()}
    return tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str) -> "Encoder":
    return Encoder(path)


@lru_cache(maxsize=2)
def counter(path: str) -> "Counter":
    return Counter(path)


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    A chunk's key is the chunk itself if a space precedes it, a line feed and the chunk if none does, and
    n spaces for n line feeds; no chunk after a space starts with white space, so the three never meet.
    """

    def __init__(self, path: str):
        self.tok = library(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranked = ranked(path)
        names = [] if self.ranked is None else self.ranked.token_byte_values()
        self.opens = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.opens[[self.ranked.encode_single_token(b) for b in names if b[:1] == b" "]] = True
        self.memo: dict[str, int] = {"": -1, "\n": -1}
        self.flat = np.empty(1 << 20, np.uint32)
        self.first = np.empty(0, np.int32)
        self.size = np.empty(0, np.int32)
        self.used = 0

    def _learn(self, keys: set[str]) -> None:
        """Encode new chunks; -1 marks chunks that must not be encoded alone."""
        memo = self.memo
        new = [k for k in keys if k[0] > " " and not k[0].isspace()]
        size, flat = self.spaced(new)
        text = []
        for k in keys.difference(new):
            if k[0] == " " or k[0] == "\n" and not k[1].isspace():
                new.append(k)
                text.append("\n" * len(k) if k[0] == " " else k[1:])
            else:
                memo[k] = -1
        if text:
            ids = self._encoded(text)
            size = np.append(size, list(map(len, ids)))
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
        first, end = len(self.first), self.used + int(size.sum())
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : end] = flat
        self.first = np.concatenate([self.first, (self.used + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.used = end
        memo.update(zip(new, range(first, first + len(new))))

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        if self.ranked is None:
            return [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]
        one = self.ranked._core_bpe.encode_ordinary
        if SURE("".join(chunks)):
            return list(map(one, chunks))
        rest = [i for i, s in enumerate(chunks) if not SURE(s)]
        for i, enc in zip(rest, self.tok.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            chunks[i] = enc.ids
        return [one(s) if type(s) is str else s for s in chunks]

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word after a space, ids); no word is empty or holds a space.

        Words of common letters go through as one text, which is cut before the ids that begin with a space.
        """
        sure = None if self.ranked is None else np.ones(len(words), bool)
        if sure is not None and not SURE("".join(words)):
            sure = np.fromiter((SURE(w) is not None for w in words), bool, len(words))
        if sure is None or not sure.any():
            ids = self._encoded([" " + w for w in words])
            return np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32)
        rest = [] if sure.all() else self._encoded([" " + words[i] for i in np.flatnonzero(~sure)])
        text = " " + " ".join(words if not rest else [words[i] for i in np.flatnonzero(sure)])
        plain = self.ranked.encode_to_numpy(text, disallowed_special=())
        size = np.empty(len(words), np.int64)
        size[sure] = np.diff(np.append(np.flatnonzero(self.opens[plain]), len(plain)))
        if not rest:
            return size, plain
        size[~sure] = list(map(len, rest))
        ids, among = np.empty(int(size.sum()), np.uint32), np.repeat(sure, size)
        ids[among], ids[~among] = plain, np.fromiter(chain.from_iterable(rest), np.uint32)
        return size, ids

    @staticmethod
    def _keys(text: str) -> list[str]:
        if "\n" not in text:
            keys = text.split(" ")
            keys[0] = "\n" + keys[0]
            return keys
        keys, run = [], 0
        lines = text.split("\n")
        for line in lines[:-1]:
            if line or not keys:
                keys += Encoder._line(line, run)
                run = 1
            else:
                run += 1
        if lines[-1]:
            return keys + Encoder._line(lines[-1], run)
        return [*keys, " " * run]

    @staticmethod
    def _line(line: str, run: int) -> list[str]:
        """A line's keys after those of the run of line feeds before it: all but the last of a run are one pre-token."""
        keys = line.split(" ")
        keys[0] = "\n" + keys[0]
        if run:
            keys.insert(0, " ")
            if run > 1:
                keys.insert(0, " " * (run - 1))
        return keys

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all whole texts in order, number of ids per text); null counts as empty."""
        if len(self.memo) > MEMO_LIMIT:
            # The chunks met first are the frequent ones.
            self.memo = {k: i for k, i in islice(self.memo.items(), 2 * MEMO_KEPT) if i < MEMO_KEPT}
            self.first, self.size = self.first[:MEMO_KEPT], self.size[:MEMO_KEPT]
            self.used = int(self.first[-1] + self.size[-1])
        keys, ends, whole = [], [], {}
        for n, t in enumerate(texts):
            if t:
                if any(s in t for s in self.special):
                    whole[n] = t
                else:
                    keys += self._keys(t)
            ends.append(len(keys))
        at = np.fromiter(map(self.memo.get, keys, repeat(NEW)), np.int32, len(keys))
        new = np.flatnonzero(at == NEW)
        if len(new):
            fresh = [keys[i] for i in new.tolist()]
            with no_collection():
                self._learn(set(fresh))
            at[new] = list(map(self.memo.__getitem__, fresh))
        ends = np.array(ends, np.int64)
        for n in np.unique(np.searchsorted(ends, np.flatnonzero(at < 0), "right")).tolist():
            whole[n] = texts[n]
        if not len(self.size):
            at, size, first = at[:0], at[:0], at[:0]
            ends *= 0
        else:
            size, first = np.where(at < 0, 0, self.size[at]), self.first[at]
        sums = np.concatenate([[0], np.cumsum(size)])
        places = np.repeat((first - sums[:-1]).astype(np.int32), size)
        places += np.arange(sums[-1], dtype=np.int32)
        ids = self.flat[places]
        cuts = sums[np.concatenate([[0], ends])]
        if not whole:
            return ids, np.diff(cuts)
        each = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for n, t in whole.items():
            each[n] = np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
        return np.concatenate(each), np.array([len(a) for a in each], np.int64)

    def ids(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def closed(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As many(), with end_id after every text."""
        ids, size = self.many(texts)
        out = np.full(len(ids) + len(size), end_id, np.uint32)
        ends = np.cumsum(size + 1) - 1
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body] = ids
        return out, size + 1


def prove_whole(path: str) -> list[str]:
    """The vocabulary strings that encode alone as exactly one token; proven once, on the driver.

    The list is bounded by the vocabulary of the tokenizer.
    """
    tok, table, end, names = library(path), byte_symbols(), "</w>", set()
    for v in tok.get_vocab(with_added_tokens=False):
        if v.endswith(end):
            try:
                names.add(bytes(table[c] for c in v[: -len(end)]).decode("utf-8"))
            except (KeyError, UnicodeDecodeError):
                continue
    alone = sorted(names - {""})
    return [s for s, enc in zip(alone, tok.encode_batch_fast(alone, add_special_tokens=False)) if len(enc.ids) == 1]


class Counter:
    """Token counts by a word-level BPE file: proven pre-tokens count one, only the rest are merged."""

    def __init__(self, path: str):
        self.tok = library(path)
        self.find = regex.compile(WORD_PATTERN).findall
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.proven: frozenset[str] = frozenset()
        self.memo: dict[str, int] = {}

    def trust(self, proven: list[str]) -> "Counter":
        if not self.proven:
            self.proven = frozenset(proven)
            self.memo = dict.fromkeys(proven, 1)
        return self

    def _learn(self, chunks: set[str]) -> None:
        parts, rest, memo = {}, set(), self.memo
        for c in chunks:
            # Case and composition of other characters are the library's business: such chunks go to it whole.
            parts[c] = pieces = self.find(c.lower()) if c.isascii() else [c]
            rest.update(p for p in pieces if p not in memo)
        new = list(rest)
        memo.update(zip(new, (len(e.ids) for e in self.tok.encode_batch_fast(new, add_special_tokens=False))))
        memo.update((c, sum(map(memo.__getitem__, pieces))) for c, pieces in parts.items())

    def many(self, texts: list[str | None]) -> list[int]:
        """Token counts of whole texts; null counts as empty."""
        if len(self.memo) > len(self.proven) + MEMO_LIMIT:
            self.memo = dict(islice(self.memo.items(), len(self.proven) + MEMO_KEPT))
        chunks, ends, whole = [], [0], {}
        for n, t in enumerate(texts):
            if t:
                if SEPARATORS.search(t) or any(s in t for s in self.special):
                    whole[n] = len(self.tok.encode(t, add_special_tokens=False).ids)
                else:
                    chunks += t.split()
            ends.append(len(chunks))
        found = list(map(self.memo.get, chunks))
        if None in found:
            new = [i for i, f in enumerate(found) if f is None]
            with no_collection():
                self._learn({chunks[i] for i in new})
            for i in new:
                found[i] = self.memo[chunks[i]]
        sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64))])
        out = np.diff(sums[ends]).tolist()
        for n, k in whole.items():
            out[n] = k
        return out

    def count(self, text: str | None) -> int:
        return self.many([text])[0]


@lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, others follow from 256."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
