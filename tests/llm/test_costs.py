"""Steps that were made cheaper: the same results as the plain way, by fewer calls or in parts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

from ebbtide.llm import attention_lm, tokenids

BYTE = tokenids.tokenizer_path("byte_bpe_50k.json")
LETTERS = "aBÉß \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 中'.,s1\U0001f600\x00İ"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(n)
    return [None, "", " ", "\n\x0b"] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_words_by_arrow_are_the_plain_ones():
    """Also of slices of an array, which pyarrow does not lower right as they are."""
    texts = odd_texts(800)
    for column in (pa.array(texts), pa.array(["É" * 7, *texts])[1:], pa.array(texts)[:0]):
        got, n = attention_lm.split(column)
        want = [attention_lm.words_of(t) for t in column.to_pylist()]
        assert n.tolist() == list(map(len, want)) and [w.encode() for w in got.to_pylist()] == [w for ws in want for w in ws]


def test_counts_and_numbers_of_sliced_batches(spark, monkeypatch):
    """Counts over batches cut many times equal a plain count."""
    from collections import Counter

    slices = attention_lm.slices
    monkeypatch.setattr(attention_lm, "slices", lambda b, column: slices(b, column, 200))
    texts = odd_texts(300)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    all_, train = Counter(), Counter()
    for i, t in enumerate(texts):
        all_.update(attention_lm.words_of(t))
        if not attention_lm.held_out(i):
            train.update(attention_lm.words_of(t))
    got = {bytes(r.word): (r.n, r.m) for r in attention_lm.word_counts(df).collect()}
    assert got == {w: (train[w], m) for w, m in all_.items()}


def test_new_words_are_encoded_by_one_call():
    enc, calls = tokenids.Encoder(BYTE), []
    whole, one = enc.ranked.encode_to_numpy, enc._encoded
    enc.ranked.encode_to_numpy = lambda *a, **k: (calls.append(1), whole(*a, **k))[1]
    enc._encoded = lambda chunks: (calls.extend(chunks), one(chunks))[1]
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdeÉ'.,s1") for _ in range(rng.randint(1, 12))) for _ in range(500)})
    for some, most in ((words, 1), ([*words, "中文", "a\xa0b"], 3)):
        calls.clear()
        size, ids = enc.spaced(some)
        want = [e.ids for e in enc.tok.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]
        assert size.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
        assert len(calls) == most
    text = "x " + " ".join(words)
    calls.clear()
    assert enc.ids(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 2  # all words after a space, and the first one


def test_texts_are_joined_with_their_words_in_parts(spark):
    """Each round's rows and those held out are tables of their own, so that joins shuffle one part at a time."""
    texts = ["the cat sat", "rare words here " * 3, None, "the the", "dog"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = attention_lm.word_counts(df).cache()
    words, memory = attention_lm.learn_memory(counts, BYTE, df.where(attention_lm.TRAINS).count())
    tables, frequent = attention_lm.coded(df, words, 2, 8, 4)
    assert len(tables) == 5 and len(frequent) <= 2
    seen = []
    for p, table in enumerate(tables):
        for r in table.collect():
            assert r.held_out == (p == 4) == attention_lm.held_out(r.doc_id) and (r.held_out or r.unit % 4 == p)
            plain = attention_lm.words_of(texts[r.doc_id])
            other = {-1 - i for i in r.numbers if i < 0}
            assert len(r.numbers) == len(plain) and set(r.at or []) == other and len(r.v or []) == len(other)
            assert len({*zip(plain, r.numbers)}) == len(set(plain)) == len(set(r.numbers))
            seen.append(r.doc_id)
    assert sorted(seen) == list(range(len(texts)))
