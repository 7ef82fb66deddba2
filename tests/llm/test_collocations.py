"""Collocations against plain counting, and the bidirectional index against a scan."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from ebbtide.llm import collocations

DOCS = "doc_id long, text string, lang string, word string, n long, ids binary"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def sample(seed=1, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "É", "d\x1cd", "漢", "x-y", " ", "w8"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", " ; "]
    texts = ["".join(rng.choice(words[: rng.choice([3, 9])]) + rng.choice(ends) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts += [None, "", " \t ", "...", "a", "a a a a a a a a", "b cc b cc b cc b", " ".join(rng.choices(words, k=3000)), texts[0], texts[0]]
    return [(i, t, rng.choice(["en", "de", None, "und", ""]), "clash", 3, None) for i, t in enumerate(texts)]


def plain(rows, least, top):
    f = Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, tuple(ws[i : i + m])) for m in range(1, 5) for i in range(len(ws) - m + 1))
    n = Counter()
    for (lang, g), a in f.items():
        n[lang] += a * (len(g) == 1)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, g), a in cand.items():
        if any(lg == lang and len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for (lg, h), b in cand.items()):
            continue
        score, k, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top])
    )


@pytest.mark.parametrize("seed,least,top,size", [(1, 3, 2000, 1 << 21), (2, 3, 15, 100), (3, 2, 2000, 37), (4, 30, 2000, 500), (5, 10**6, 5, 50)])
def test_phrases_equal_plain_counting(spark, seed, least, top, size):
    rows = sample(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, least, top, size).collect())
    assert got == plain(rows, least, top) and (got or least > 30)


def test_sql_on_edge_cases(spark):
    rows = [r for k in range(8) for r in sample(6)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "word", "n", "ids"]))
    want = sorted(con.sql(collocations.ORACLE_SQL).fetchall())
    assert want == plain(rows, 30, 2000)
    got = collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, 1, None)], DOCS)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_index_extends_both_ways(seed):
    rng = np.random.default_rng(seed)
    ids = collocations.only(rng.integers(0, 6, 400).astype(np.int32), np.array([1, 2, 4, 5]))
    index = collocations.FmIndex.of(ids)
    level, phrases = [(w,) for w in range(1, 5)], index.words(4)
    for side in rng.permutation(["left", "right", "left"]):
        of, word, phrases = getattr(index, side)(phrases)
        level = [(int(w), *level[k]) if side == "left" else (*level[k], int(w)) for k, w in zip(of, word)]
        m = len(level[0])
        want = Counter(tuple(int(x) for x in ids[i : i + m]) for i in range(len(ids) - m + 1))
        assert dict(zip(level, phrases.size.tolist())) == {g: n for g, n in want.items() if 0 not in g}
        # Intervals are those of the sorted suffixes of the sequence, and of its reverse.
        for seq, low, turn in ((ids, phrases.low, 1), (ids[::-1], phrases.back, -1)):
            ordered = sorted(tuple((list(seq[i : i + 4]) + [0] * 4)[:4]) for i in range(len(seq)))
            cut = [[*s[: s.index(0)], 0, 0, 0, 0][:4] if 0 in s else list(s) for s in ordered]
            starts = {g: sum(tuple(c[:m]) < g[::turn] for c in cut) for g in level}
            assert starts == dict(zip(level, low.tolist()))
