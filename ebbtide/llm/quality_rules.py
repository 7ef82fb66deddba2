"""Quality rules: base word rules, then a hashed n-gram likelihood ratio.

Word uni- and bigrams hash to a fixed number of buckets (2^18, a documented width: tables of that size are
summed by shuffle and shipped). Two multinomials are counted: the trusted target (documents labelled
quality 1) and the raw corpus (all documents). A document's score is its mean log ratio per n-gram, with
the target smoothed towards the raw corpus by 2^14 n-grams. A document passes when its score reaches the threshold, which
is the value that best separates labelled good from bad rows while losing at most `lose` of the good ones,
each good one scored without its own counts.
The labelled sample is at most `max_labels` rows, the smallest by hash; corpus counts and verdicts cover
every row and every whole text.

Null or empty texts have no words and fail; very long texts are read whole, in blocks; without labels the
ratio keeps all; repeated rows get equal verdicts; ties with the threshold are kept; an empty table gives
no rows; columns of any name pass through keep_good().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, tidy
from .wordhash import mixed, word_hashes

BITS = 18
BUCKETS, PRIOR = 1 << BITS, 1 << 14
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
BATCH = 128
TWO, THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text, as they are written."""
    h, k = word_hashes(texts, lower=False)
    return np.split(h, np.cumsum(k)[:-1]) if len(k) else []


def ngram_buckets(h: np.ndarray) -> np.ndarray:
    both = np.concatenate([h, mixed(h[:-1] * TWO + h[1:])])
    return (both >> np.uint64(64 - BITS)).astype(np.int64)


def base_figures(text: str, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """The base rules' counts for one whole text with the hashes of its words."""
    n = len(h)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += VISIBLE.search(line) is not None
        else:
            seen.add(line)
    repeat = 0
    if n >= 4:
        three = mixed(mixed(h[:-2] * TWO + h[1:-1]) * THREE + h[2:])
        order = np.argsort(three)
        same = three[order[1:]] == three[order[:-1]]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        for d in range(3):
            hit[d : n - 2 + d] |= again
        repeat = int(hit.sum())
    return n, len(text) - sum(map(text.count, SEPARATORS)), sum(map(text.count, SYMBOLS)), dup, repeat


def _labelled(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """docs (text) with the label of the bounded sample, null elsewhere; the sample is small enough to broadcast."""
    sample = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labels)
    )
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.join(F.broadcast(sample), "doc_id", "left")


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 200_000, lose: float = 0.01) -> tuple[np.ndarray, float]:
    """(log ratio per bucket, threshold)."""

    def count(batches):
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for big in batches:
            for i in range(0, big.num_rows, BATCH):
                b = big.slice(i, BATCH)
                hashes, quality = words_of(b.column(0)), b.column(1).to_pylist()
                for into, some in ((raw, hashes), (good, [h for h, q in zip(hashes, quality) if q == 1])):
                    if some:
                        into += np.bincount(np.concatenate([ngram_buckets(h) for h in some]), minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    rows = _labelled(docs, labels, max_labels)
    counted = (
        rows.select("text", "quality")
        .mapInArrow(tidy(count), "bucket long, raw long, good long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toPandas()
    )  # at most BUCKETS rows
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counted["bucket"].to_numpy(np.int64)
    raw[at], good[at] = counted["raw"], counted["good"]
    if not good.sum():
        return np.zeros(BUCKETS), -np.inf
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    p_good = (good + PRIOR * p_raw) / (good.sum() + PRIOR)
    ratio = np.log(p_good) - np.log(p_raw)
    shared = docs.sparkSession.sparkContext.broadcast((good, p_raw, ratio))

    def sample_scores(batches):
        good, p_raw, ratio = shared.value
        for big in batches:
            for i in range(0, big.num_rows, BATCH):
                b = big.slice(i, BATCH)
                quality = b.column(1).to_pylist()
                score = [_left_out(h, good, p_raw) if q == 1 else float(ratio[ngram_buckets(h)].mean()) if len(h) else None for h, q in zip(words_of(b.column(0)), quality)]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(score, pa.float64())], ["quality", "score"])

    scored = rows.where("quality is not null").select("text", "quality").mapInArrow(tidy(sample_scores), "quality int, score double").where("score is not null")
    hist = scored.groupBy("quality", F.round("score", 4).alias("s")).count().collect()  # a bounded sample's histogram
    return ratio, _threshold([(r.s, r.quality, r["count"]) for r in hist], lose)


def _left_out(h: np.ndarray, good: np.ndarray, p_raw: np.ndarray) -> float | None:
    """A target document's score without its own counts, as documents without a label are scored."""
    if not len(h):
        return None
    at, n = np.unique(ngram_buckets(h), return_counts=True)
    ratio = np.log((good[at] - n + PRIOR * p_raw[at]) / (good.sum() - n.sum() + PRIOR)) - np.log(p_raw[at])
    return float((ratio * n).sum() / n.sum())


def _threshold(hist, lose: float) -> float:
    good, bad = sum(n for _, q, n in hist if q == 1), sum(n for _, q, n in hist if q != 1)
    if not good or not bad:
        return -np.inf
    below_good = below_bad = 0
    best, cut = 0.0, -np.inf
    values = sorted({s for s, _, _ in hist})
    for a, b in zip(values, values[1:]):
        below_good += sum(n for s, q, n in hist if s == a and q == 1)
        below_bad += sum(n for s, q, n in hist if s == a and q != 1)
        if below_good > lose * good:
            break
        if below_bad / bad - below_good / good > best:
            best, cut = below_bad / bad - below_good / good, (a + b) / 2
    return cut


def _score(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """rows' own columns but text, the base figures and the score."""
    keep = [n for n in rows.columns if n != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        ratio = shared.value
        for big in batches:
            for i in range(0, big.num_rows, BATCH):
                b = big.slice(i, BATCH)
                texts = b.column("text")
                out = [(*base_figures(t or "", h), float(ratio[ngram_buckets(h)].mean()) if len(h) else 0.0) for t, h in zip(texts.to_pylist(), words_of(texts))]
                cols = list(zip(*out)) if out else [[]] * 6
                extra = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(n) for n in keep] + extra, keep + ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]
                )

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(tidy(run), f"{kept}, {BASE}, score double")


def quality_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row per document: figures, score, base_failed and kept. No shuffle of texts."""
    ratio, cut = fit(docs, labels, **params)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _score(rows, ratio).select(
        "*", failed.alias("base_failed"), (~failed & (F.col("score") >= F.lit(float(cut)))).alias("kept")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that pass, with all their own columns, decided row by row in one map."""
    ratio, cut = fit(docs, labels, **params)
    shared, place = docs.sparkSession.sparkContext.broadcast(ratio), docs.columns.index("text")

    def run(batches):
        ratio = shared.value
        for big in batches:
            for i in range(0, big.num_rows, BATCH):
                b = big.slice(i, BATCH)
                texts, mask = b.column(place), []
                for t, h in zip(texts.to_pylist(), words_of(texts)):
                    n = len(h)
                    passed = n >= 50 and float(ratio[ngram_buckets(h)].mean()) >= cut
                    mask.append(passed and 100 * base_figures(t or "", h)[4] <= 50 * n)
                yield b.filter(pa.array(mask, pa.bool_()))

    # Columns pass through under plain names, as names may hold points.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)


def query(spark, sf_dir):
    return quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
