"""Operators against brute force on a small table with nulls, empty, long, tied and repeated rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession

import corpus_pipeline
from ebbtide.llm import (
    attention_lm, attention_net, chat_collapse, decontaminate, html_wrappers, ngram_join, packing, quality_rules, repair_store, sharding, subword_memory, token_counts,
)
from ebbtide.llm.tokenids import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, n int"
BYTE = tokenizer_path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def sample():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 300))) for _ in range(30)]
    near = [b.replace("w1 ", "x1 ", 1) for b in base[:10]]
    texts = [None, "", "  \n ", "one two", "ONE two", *base, *near, base[0], " ".join(rng.choices(words, k=9000)), "é ß 漢字 <|endoftext|> \x85\x1c İ"]
    rows = [(i, t, "en", "s", len(t or ""), 1.0, None, 2) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, base[3], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS).repartition(3)


def tokens(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


def test_counts(docs):
    got = sorted(map(tuple, token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json")).collect()), key=str)
    want = []
    for r in sample():
        n = len(tokens("word_bpe_49k.json", r[1]))
        want.append((r[0], len((r[1] or "").encode()), n, n > 2048))
    assert got == sorted(want, key=str)


def test_store(docs):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in repair_store.read_shards(repair_store.write_shards(docs, BYTE, shard_tokens=900)).collect())
    at = 0
    by_id = {}
    for r in sample():
        a = np.array(tokens("byte_bpe_50k.json", r[1]) + [2], "<u4")
        by_id.setdefault(r[0], []).append((len(a), zlib.crc32(a.tobytes())))
    for start, doc, n, crc in got:
        assert start == at and (n, crc) in by_id[doc]
        at += n
    assert [g[1] for g in got] == sorted((r[0] for r in sample()), key=lambda x: (x is not None, x))


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "a\n", "\n\n", "a\n\nb\n\n\nc", "a \nb", "a\n b", "a\t b", "a\r\nb", "\x1c a\x1cb", "x\x85y", "x\u3000y", "don't it's", "İ Σ ς", "<|endoftext|> q", "漢字 ab", ""])
def test_chunks_equal_the_library(text):
    from ebbtide.llm import tokenids

    assert tokenids.encoder(BYTE).many([text, "x", text])[0].tolist() == [*tokens("byte_bpe_50k.json", text), *tokens("byte_bpe_50k.json", "x"), *tokens("byte_bpe_50k.json", text)]
    path = tokenizer_path("word_bpe_49k.json")
    assert tokenids.counter(path).trust(tokenids.prove_whole(path)).count(text) == len(tokens("word_bpe_49k.json", text))


@pytest.mark.parametrize("seed", range(6))
def test_grammar_round_trip(seed):
    seq = np.random.default_rng(seed).integers(0, 1 + seed * 20, 4000).astype(np.uint32)
    rules, size, out = repair_store.re_pair(seq)
    assert (repair_store.expand(rules, out) == seq).all() and len(out) <= len(seq)
    assert (repair_store.decode_range(rules, size, out, 1000, 1100) == seq[1000:1100]).all()
    pairs, n = np.unique(np.stack([out[:-1], out[1:]]), axis=1, return_counts=True)
    # No pair is frequent any more; of overlapping twins every second place counts.
    assert (n < np.where(pairs[0] == pairs[1], 32, 16)).all()
    assert repair_store.re_pair(seq[:0])[2].size == 0


@pytest.mark.parametrize("limits", [dict(max_tokens=1024, max_segments=32, max_loss_tokens=896), dict(max_tokens=64, max_segments=3, max_loss_tokens=52)])
def test_packing(spark, limits):
    """Tiling, starts, checksums, all three limits, gapless offsets and little padding, against the library's ids."""
    docs = spark.createDataFrame(sample(), DOCS).coalesce(1)
    rows = packing.pack(docs, BYTE, **limits).collect()
    want = sorted((r[0] is None, r[0] or 0, tuple(tokens("byte_bpe_50k.json", r[1]) + [0])) for r in sample())
    by, seqs = {}, {}
    for r in rows:
        by.setdefault((r.doc_id is None, r.doc_id or 0), []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    for key in {w[:2] for w in want}:
        whole = [w[2] for w in want if w[:2] == key]
        held = sorted((r.start, r.length, tuple(r.ids)) for r in by[key])
        assert all({r.doc_tokens for r in by[key]} == {len(w)} for w in whole)
        places = sorted(i for start, n, _ in held for i in range(start, start + n))
        assert places == sorted(i for w in whole for i in range(len(w)))
        assert all(ids == whole[0][start : start + n] for start, n, ids in held)
    padding = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        loss = sum(max(0, r.start + r.length - max(r.start, int(r.doc_tokens * 0.25))) for r in s)
        assert at <= limits["max_tokens"] and len(s) <= limits["max_segments"] and loss <= limits["max_loss_tokens"]
        padding += limits["max_tokens"] - at
    assert any(len(s) == limits["max_segments"] for s in seqs.values()) or limits["max_segments"] == 32
    assert padding <= 3 * limits["max_tokens"] + (0.1 if limits["max_segments"] == 3 else 0) * sum(len(w[2]) for w in want)
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs, shards=5).collect()
    assert len(rows) == len(sample())
    total = sum(r["size"] for r in rows)
    for s in range(5):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
        assert abs(sum(r["size"] for r in rows if r.shard == s) - total / 5) <= max(r["size"] for r in rows)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_sharding_groups(spark):
    """Equal texts share a shard unless they alone exceed one; repeated rows of one key are divided, too."""
    rng = random.Random(2)
    rows = [(i, "t%d " % rng.randrange(10**9) * rng.randint(1, 40)) for i in range(3000)]
    rows += [(10_000 + i, "copy %d " % (i % 60) * 30) for i in range(600)] + [(7, "same row " * 9)] * 1500 + [(None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df, shards=8, range_rows=300).collect()
    total, where, size, slots = sum(r["size"] for r in got), {}, {}, {}
    for r in got:
        where.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        size[r.text_crc32, r["size"]] = size.get((r.text_crc32, r["size"]), 0) + r["size"]
        slots.setdefault(r.shard, []).append((r.slot, r["size"]))
    assert len(got) == len(rows) and all(len(where[k]) == 1 for k in where if size[k] <= total / 8)
    assert sorted(slots) == list(range(8)) and all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    assert all(abs(sum(b for _, b in v) - total / 8) < 0.02 * total / 8 for v in slots.values())


def brute_figures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + d for i, x in enumerate(tri) if tri.count(x) > 1 for d in range(3)} if len(w) < 2000 else None
    lines = (t or "").split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i] and re.search(r"[^\x20\x09-\x0D]", x))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, None if hit is None else len(hit)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    text = {r[0]: r[1] for r in sample()}
    for r in rows:
        want = brute_figures(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4]
        assert want[4] is None or r.n_repeat_words == want[4]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_verdicts(spark):
    """Scores, threshold and verdicts against a plain count of n-grams; labelled rows that were not fitted are told apart."""
    import math
    from collections import Counter

    rng = random.Random(11)
    good, bad = ["g%d" % i for i in range(300)], ["b%d" % i for i in range(300)]
    texts, truth = [], []
    for i in range(160):
        own, other = (good, bad) if i % 2 else (bad, good)
        texts.append(" ".join(rng.choices(own, k=80) + rng.choices(other, k=25)))
        truth.append(i % 2)
    df = spark.createDataFrame([(i, t, "a.b") for i, t in enumerate(texts)], "doc_id long, text string, `x.y` string").repartition(3)
    labels = spark.createDataFrame([(i, truth[i], 0) for i in range(80)], "doc_id long, quality int, toxic int")
    grams = lambda t: [w for w in t.split()] + list(zip(t.split(), t.split()[1:]))
    raw, trusted = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i < 80 and truth[i]:
            trusted.update(grams(t))
    m, q, n, r = quality_rules.BUCKETS, quality_rules.PRIOR, sum(raw.values()), sum(trusted.values())
    p_raw = {g: (c + 0.5) / (n + 0.5 * m) for g, c in raw.items()}
    ratio = {g: math.log((trusted[g] + q * p_raw[g]) / (r + q)) - math.log(p_raw[g]) for g in raw}
    want = [sum(ratio[g] for g in grams(t)) / len(grams(t)) for t in texts]
    got = {x.doc_id: x for x in quality_rules.quality_rules(df, labels).collect()}
    # Few of these n-grams share a bucket of 2^18.
    assert np.mean([abs(got[i].score - want[i]) for i in range(160)]) < 0.03
    _, cut = quality_rules.fit(df, labels)
    assert all(got[i].kept == (not got[i].base_failed and got[i].score >= cut) for i in range(160))
    held = [got[i].kept == bool(truth[i]) for i in range(80, 160)]
    assert sum(held) / len(held) >= 0.95
    kept = quality_rules.keep_good(df, labels)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(i for i in range(160) if got[i].kept)


def test_chat(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "b", "x"), (2, 0, "u", "a"), (2, 1, "b", "x"), (2, 2, "u", None), (3, 0, "u", "a"), (4, 0, "u", "z"), (5, 0, "u", "z"), (6, 0, None, ""), (None, 0, "u", "a"), (2, 1, "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.n_turns, r.rendered) for r in chat_collapse.collapse(df).collect())
    assert got == [(2, 0, 3, "<|u|>\na\n"), (2, 1, 3, "<|b|>\nx\n"), (2, 2, 3, "<|u|>\n\n"), (4, 0, 1, "<|u|>\nz\n"), (6, 0, 1, "<|unknown|>\n\n")]
    assert chat_collapse.collapse(df.limit(0)).count() == 0


def test_chat_nulls(spark):
    """A null is no value: neither an equal text in the other column nor the character zero."""
    rows = [(1, 0, None, "a"), (1, 0, "a", None), (2, 0, "u", None), (3, 0, "u", "\0"), (3, 1, None, None), (4, 0, None, None), (5, 0, "unknown", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.turn, r.role, r.n_turns) for r in chat_collapse.collapse(df).collect())
    assert got == [(1, 0, "a", 2), (1, 0, "unknown", 2), (2, 0, "u", 1), (3, 0, "u", 2), (3, 1, "unknown", 2), (4, 0, "unknown", 1), (5, 0, "unknown", 1)]


def sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_join(docs):
    rows = sample()
    s = [sets(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                a, b = comp[i], comp[j]
                comp = [b if c == a else c for c in comp]
    low = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((rows[i][0], len(s[i]), low[comp[i]]) for i in range(len(rows))), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(docs).collect()), key=str)
    assert got == want
    assert ngram_join.near_groups(docs.limit(0)).count() == 0


def test_second_round_moves_no_hopeless_pairs(spark):
    """Sets of 100 that share one shingle of their prefixes of 21 cannot link; those that share 15 may."""
    member = [(5, 1, 100, 0, 1), (5, 2, 100, 0, 2)] + [(9 + t, k, 100, t, k) for k in (3, 4) for t in range(15)]
    got = ngram_join.open_pairs(
        spark.createDataFrame(member, "token long, id long, n int, pos int, comp long"),
        spark.createDataFrame([(bytearray([k]), k, 90 + k) for k in (1, 2, 3, 4)], "cls binary, rid long, last long"),
    )
    assert [tuple(r) for r in got.collect()] == [(3, 4)]


def test_second_round_makes_few_rows_for_a_group(spark):
    """60 sets that share 15 shingles first meet once a pair, not 15 times; 60 that share only late ones never do."""
    early = [(t, k, 180, t, k) for k in range(60) for t in range(15)]
    late = [(100 + t, 100 + k, 180, 25 + t, 100 + k) for k in range(60) for t in range(10)]
    member = spark.createDataFrame(early + late, "token long, id long, n int, pos int, comp long")
    assert ngram_join.meetings(member).count() == 60 * 59 // 2 == ngram_join.met_pairs(member).count()


def test_second_round_keeps_every_link(spark):
    rng = np.random.default_rng(3)
    kept = []
    for size in (3, 12, 60, 400, 1500):
        base = rng.integers(1, 1 << 62, size, dtype=np.uint64)
        for _ in range(14):
            x = base.copy()
            new = rng.random(size) < rng.choice([0.03, 0.08, 0.11, 0.14, 0.3])
            x[new] = rng.integers(1, 1 << 62, int(new.sum()), dtype=np.uint64)
            kept.append(np.unique(x[: size - rng.integers(0, size // 8 + 1)]))
    prefix = [x[: len(x) - (4 * len(x) + 4) // 5 + 1].view(np.int64).tolist() for x in kept]
    member = [(t, i, len(kept[i]), pos, i) for i, p in enumerate(prefix) for pos, t in enumerate(p)]
    got = ngram_join.open_pairs(
        spark.createDataFrame(member, "token long, id long, n int, pos int, comp long"),
        spark.createDataFrame([(bytearray([i]), i, p[-1]) for i, p in enumerate(prefix)], "cls binary, rid long, last long"),
        spark.createDataFrame([(i, len(x), ngram_join.bitmap(x).tolist()) for i, x in enumerate(kept)], "id long, n long, bits array<long>"),
    )
    shared = lambda i, j: len(np.intersect1d(kept[i], kept[j]))
    linked = {(i, j) for j in range(len(kept)) for i in range(j) if 100 * shared(i, j) >= 80 * (len(kept[i]) + len(kept[j]) - shared(i, j))}
    got = {tuple(r) for r in got.collect()}
    assert linked <= got and len(linked) > 60 and len(got) < 5 * 91 // 2  # of 91 pairs a family


@pytest.mark.parametrize("blocks", [{}, dict(shingles_a_block=900, classes_a_block=4)])
def test_join_link_counts(spark, blocks):
    rng = random.Random(5)
    texts = []
    for size, copies in ((120, 25), (40, 12), (300, 6), (3, 4)):
        words = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(w + [f"t{i}" for i in range(rng.randint(0, size // 6))]))
    texts += [texts[0], texts[0].upper(), None, ""]
    s = [frozenset(sets(t)) for t in texts]
    kinds = {x for x in s if x}
    want = {i: sum(y != x and 100 * len(x & y) >= 80 * len(x | y) for y in kinds) for i, x in enumerate(s)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_links for r in ngram_join.near_groups(df, **blocks).collect()}
    assert got == want and max(want.values()) > 8


def test_decontaminate(spark, docs):
    long = sample()[6][1].split()
    bench = spark.createDataFrame([(1, " ".join(long[5:25])), (2, None), (3, ""), (4, "ONE, two"), (None, "w1"), (10, "one two")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.judged(docs, bench).collect()}
    assert (got[3].n_hit, got[3].n_items, got[3].contaminated) == (2, 2, True) and got[4].n_hit == 2
    assert got[6].n_hit == 20 and got[6].n_items == 1 and got[0].n_words == 0 and not got[0].contaminated
    assert decontaminate.judged(docs, bench.limit(0)).where("contaminated").count() == 0


def test_html(spark):
    page = "<html><body><nav>menu</nav><div class='ad'>x</div><article><h1>A &amp; b</h1><p>one\n two<p>three<div class='comments'>no</div></article><footer>f</footer>"
    rows = [(1, "http://h/a", page), (2, "http://h/b", None), (3, None, ""), (4, "http://g/", "<p>only</p>"), (1, "http://h/a", page)]
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A & b\n\none two\n\nthree", 2: "", 3: "", 4: "only"}


def test_html_content_element(spark):
    top = "<body><a class='skip-to-content'>Skip to content</a><h1 class='post'>T</h1><div class='author post'>by me</div>"
    skip = [top + f"<div class='content post'><p>long text number {i} of the page</p><div class='ad'>buy</div><div>kept {i}</div></div><div class='comments'>no</div>" for i in range(3)]
    role = [f"<body><div class='box'>menu</div><div role='main'><p>role text {i}</p><div class='share'>x</div></div>" for i in range(2)]
    nested = ["<body><article><p>whole<article class='comment'>reply</article><p>text</article><article class='comment'>late</article>"]
    named = ["<body><p>aside</p><article class='has-sidebar'><p>still here</article>", "<body><p>a longer text of the page</p><article class='comment'>reply</article>"]
    pages = [(n, f"http://{h}/{i}", p) for h, k, ps in (("a", 0, skip), ("b", 10, role), ("c", 20, nested), ("d", 30, named)) for i, p in enumerate(ps) for n in [k + i]]
    got = {r.page_id: r.text for r in html_wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = {i: f"long text number {i} of the page\n\nkept {i}" for i in range(3)} | {10 + i: f"role text {i}" for i in range(2)}
    assert got == want | {20: "whole\n\ntext", 30: "still here", 31: "a longer text of the page"}


def test_html_wrapper_decides(spark):
    """A sign-up text in no telling element is template on a host; a paragraph that copies share is not."""
    def page(i, top="Subscribe text of the site"):
        return f"<html><body><div><p>{top}</p></div><div class='x{i}'><h1>Title {i}</h1><p>Paragraph {i} about item {i * 7}</p><p>shared end</p></div></body></html>"

    many = [(i, "http://h/%d" % i, page(i).replace("shared end", "shared end" if i < 2 else "own end %d" % i)) for i in range(6)]
    copies = [(100 + i, "http://c/%d" % i, page(1)) for i in range(6)]
    df = spark.createDataFrame([*many, *copies], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_wrappers.extract(df).collect()}
    assert all("Subscribe" not in got[i] and f"Title {i}\n\nParagraph {i} about item {i * 7}" in got[i] for i in range(6))
    assert got[0].endswith("shared end") and got[3].endswith("own end 3")
    # Copies of one page show no template: all of it stays.
    assert all(got[100 + i] == got[100] and got[100].startswith("Subscribe") for i in range(6))
    (one,) = html_wrappers.wrappers(df.where("page_id < 100")).collect()
    assert one.expression == 'html(body(div(p(")) div(h1(#) p(#)+)))' and one.pages == 6 and len(one.template) == 1
    assert html_wrappers.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("html,want", [
    ("<article><p class='notice'>x<p>Real one<p>Real two</article>", "Real one\n\nReal two"),
    ("<article><ul><li class='ad'>x<li>Real item</ul><p>After</article>", "Real item\n\nAfter"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p>b</article>", "Title\n\nb"),
    ("<article><p title=it's>hello</p><p>w</article>", "hello\n\nw"),
    ("<article>A<b>bold <i>it</b> x</i><p>q</article>", "Abold it x\n\nq"),
    ("<div>" * 300 + "deep" + "</div>" * 300, "deep"),
    ("&lt;b&gt; &amp;amp; caf&eacute;", "<b> &amp; café"),
])
def test_html_pages(html, want):
    assert html_wrappers.main_text(html, None, frozenset()) == want


@pytest.mark.parametrize("bad", ["<a ", "<a b=\"", "<!", "<!--", "<p x='", "<script ", "<b>", "</p>", "<td>"])
def test_html_is_linear(bad):
    import time

    took = []
    for n in (50_000, 200_000):
        t = time.process_time()
        html_wrappers.blocks(bad * n if bad not in ("<b>", "<td>") else bad * (n // 100) + "x")
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0] + 1


def test_scores(docs):
    """Base figures against a plain count; equal scores under another partitioning; repeated rows alike."""
    rows = attention_lm.score(docs, BYTE).collect()
    assert len(rows) == len(sample()) and all(r.score < 0 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows if r.doc_id is not None)
    counts = {}
    for r in sample():
        if not attention_lm.held_out(r[0]):
            for w in [*attention_lm.words_of(r[1]), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in sample()}
    for r in rows:
        ws = [*attention_lm.words_of(text[r.doc_id]), None]
        assert r.train_tokens == n and r.n_tokens == len(ws) and r.n_known == sum(w in counts for w in ws)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
    one = {r.doc_id: r.score for r in rows}
    assert sum(r.doc_id == 7 for r in rows) == 3 and all(abs(r.score - one[7]) < 1e-9 for r in rows if r.doc_id == 7)
    again = {r.doc_id: r.score for r in attention_lm.score(docs.repartition(1), BYTE).collect()}
    assert all(again[d] == pytest.approx(one[d], rel=1e-5) for d in one)
    assert attention_lm.score(docs.limit(0), BYTE).count() == 0


def word_memory():
    from collections import Counter

    rng = random.Random(9)
    words = Counter(rng.choices(["the", "theory", "theoretical", "abacus", "zzyzx", "xqj", "cat", "cats"], weights=[9, 4, 3, 2, 1, 1, 5, 5], k=400))
    ws = [w.encode() for w in words]
    size, ids = attention_lm.encoded(BYTE, ws)
    keys, n = subword_memory.entries(size, ids, np.array([words[w.decode()] for w in ws]))
    return subword_memory.Memory(keys, n, 20), ws


def test_word_memory_is_a_distribution():
    """After any beginning of a word, ending and all ways of going on have chances that sum to one; so have openers."""
    memory, _ = word_memory()
    assert memory.open.sum() == pytest.approx(1) and memory.inside.sum() == pytest.approx(1)
    for word in (b"theoretical", b"abacus", b"never-seen"):
        size, ids = attention_lm.encoded(BYTE, [word])
        for k in range(1, len(ids)):
            every = np.arange(subword_memory.IDS)
            many = np.concatenate([np.repeat(ids[None, :k], len(every), 0), every[:, None]], 1).ravel()
            known, _ = memory.chances(np.full(len(every), k + 1), many)
            assert known.reshape(len(every), k + 1)[:, k].astype(np.float64).sum() == pytest.approx(1, abs=2e-3)
        whole, chain = memory.chances(np.array([len(ids)]), ids)
        # Of two words of equal ids the chance to end at the last is what the chance to go on lacks.
        steps = [memory.chances(np.array([k]), ids[:k])[1][0] for k in range(1, len(ids) + 1)]
        assert chain[0] == pytest.approx(steps[-1]) and all(0 < 10**x < 1 for x in steps)
    frequent, chain = memory.chances(*attention_lm.encoded(BYTE, [b"the"]))
    assert frequent[0] > 0.1 and 10 ** chain[0] > 0.3


def test_memory_by_joins_keeps_every_count(spark):
    """Chances of all words, among them words seen once and never, equal those from all counts in one process."""
    rng = random.Random(4)
    words = {"".join(rng.choices("abcdeinorst", k=rng.randint(1, 12))).encode(): rng.choice([1, 1, 1, 2, 5, 900]) for _ in range(300)}
    unseen = [b"theoretical", b"abacist", b"ontsetrin", b"zq"]
    counts = spark.createDataFrame([(bytearray(w), n, n) for w, n in words.items()] + [(bytearray(w), 0, 3) for w in unseen], "word binary, n long, m long")
    got, memory = attention_lm.learn_memory(counts, BYTE, 20)
    rows = got.collect()
    assert {bytes(r.word) for r in rows} == words.keys() | set(unseen)
    size, ids = attention_lm.encoded(BYTE, list(words))
    keys, n = subword_memory.entries(size, ids, np.array(list(words.values())))
    whole = subword_memory.Memory(keys, n, 20)
    assert (n == 1).sum() > 300 and memory.open == pytest.approx(whole.open) and memory.inside == pytest.approx(whole.inside)
    for out in (0, 1):
        mine = [r for r in rows if out == 0 or bytes(r.word) in words]
        table = attention_lm.Table(pa.array([bytes(r.v) for r in mine], pa.binary()), memory, out)
        size, ids = attention_lm.encoded(BYTE, [bytes(r.word) for r in mine])
        known, chain = whole.chances(size, ids, out)
        assert table.size.tolist() == size.tolist() and (table.index % subword_memory.IDS).tolist() == ids.tolist()
        assert table.known == pytest.approx(known, rel=1e-5)
        assert table.count.tolist() == [words.get(bytes(r.word), 0) for r in mine]
        assert out or table.chain == pytest.approx(chain)


@pytest.mark.parametrize("head", [0, 3])
def test_scores_do_not_depend_on_what_is_shipped(spark, head):
    rng = random.Random(2)
    ws = ["".join(rng.choices("aeinort", k=rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choices(ws, weights=range(1, 61), k=rng.randint(0, 40))) for _ in range(60)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r for r in attention_lm.score(df, BYTE, unit_words=400).collect()}
    for r in attention_lm.score(df, BYTE, head=head, unit_words=400).collect():
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (w.n_tokens, w.n_known) and r.base_score == pytest.approx(w.base_score) and r.score == pytest.approx(w.score, rel=1e-5)


def trained_net():
    memory, ws = word_memory()
    rng = random.Random(1)
    words = attention_lm.Words(BYTE, memory, 0)
    ids, known = words.ids(*words.many([" ".join(w.decode() for w in rng.choices(ws, k=k)) for k in (0, 1, 9, 60, 25, 24, 7)]))
    s, w = attention_lm.start(memory)
    end = subword_memory.END + subword_memory.IDS
    rows, new, rest, w, places = attention_net.train_unit(s, w, ids, end, lambda _: np.concatenate(known), batch=2)
    assert places == sum(map(len, ids))  # every id trains once
    s = s * np.float32(rest)
    s[rows] = new
    assert s.sum() == pytest.approx(1, rel=1e-3)
    return s, w, ids, known, end


def test_windows_take_every_id_once():
    for n in (1, 5, 23, 24, 25, 48, 100):
        ids = np.arange(1000, 1000 + n)
        x, y, mask = attention_net.windows(ids, 7)
        assert (y[mask] == ids).all()
        flat = [7, *ids]
        for i, (row, at) in enumerate(zip(x, range(0, n, attention_net.STRIDE))):
            last = row[attention_net.CONTEXT - attention_net.STRIDE :]
            want = flat[at : at + attention_net.STRIDE]
            assert last[: min(len(want), mask[i].sum())].tolist() == want[: mask[i].sum()]


def test_batched_scores_equal_one_place_at_a_time():
    s, w, ids, known, end = trained_net()
    got = attention_lm.text_scores(attention_net.Scorer(s, w), ids, known, chunk=3)
    K, C, S = attention_net.K, attention_net.CONTEXT, attention_net.STRIDE
    feature = lambda i: (s[i] / s[i].sum() - 1 / K) * np.sqrt(K)
    half = len(s) // 2
    total = [s[:half].sum(0), s[half:].sum(0)]
    for t, (text, chance) in enumerate(zip(ids, known)):
        seq, lp = [end, *text.tolist()], 0.0
        for n, (y, p0) in enumerate(zip(text.tolist(), chance)):
            first = n // S * S - (C - S)  # the window's first place
            q = feature(seq[n]) @ w["Q"]
            score, value = [], []
            for j in range(first, n + 1):
                f = feature(seq[j]) if j >= 0 else np.zeros(K)
                score.append(q @ (f @ w["Kk"]) + w["near"][n - j])
                value.append(f @ w["V"])
            a = np.exp(np.array(score))
            z = feature(seq[n]) @ w["W1"] + (a / a.sum()) @ np.array(value) @ w["W2"] + w["b"]
            z[K] += w["own"][int(y >= half)]
            z = np.exp(z) / np.exp(z).sum()
            lp += np.log10(z[:K] @ (s[y] / total[int(y >= half)]) + z[K] * p0)
        assert got[t] == pytest.approx(lp, rel=1e-4)
    # What can follow sums to one: indices of one kind, and the memory's chances of them.
    scorer, x = attention_net.Scorer(s, w), np.array([[end] * C])
    kv = scorer.kv[x]
    for kind in (0, 1):
        z, norm, *_ = attention_net.attend(w, scorer.last[x[:, C - S :]], scorer.q[x[:, C - S :]], kv[..., :8], kv[..., 8:], np.full((1, S), kind))
        assert (z.sum(-1) / norm).ravel() == pytest.approx(1)
    assert all((s[k] / total[i]).sum(0) == pytest.approx(1, rel=1e-3) for i, k in enumerate((slice(0, half), slice(half, None))))


def test_network_gradients():
    s, w, ids, known, end = trained_net()
    s, w = s.astype(np.float64), {k: v.astype(np.float64) for k, v in w.items()}
    x, y, mask = attention_net.many_windows(ids, end)
    p = np.zeros(mask.shape)
    p[mask] = np.concatenate(known)
    loss = lambda: np.log(attention_net.Scorer(s, w).chances(x, y, p)[mask]).sum() / mask.sum()
    g, posterior, targets = attention_net.gradients(s, w, x, y, p, mask, attention_net.kinds(s))
    assert (targets == y[mask]).all() and (posterior.sum(1) <= 1 + 1e-6).all()
    rng = np.random.default_rng(0)
    for k in w:
        at = tuple(rng.integers(0, n) for n in w[k].shape) if k != "near" else (1,)
        w[k][at] += 1e-4
        up = loss()
        w[k][at] -= 2e-4
        down = loss()
        w[k][at] += 1e-4
        assert g[k][at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5)


def test_training_helps(spark):
    """Held-out texts of two kinds of words score better after training than at the start."""
    rng = random.Random(3)
    kinds = [["alpha", "beta", "gamma", "delta"], ["rot", "gelb", "blau", "grau"]]
    texts = [" ".join(rng.choices(kinds[i % 2], k=60)) for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = {r.doc_id: r for r in attention_lm.score(df, BYTE, rounds=0).collect()}
    after = {r.doc_id: r for r in attention_lm.score(df, BYTE, unit_words=2000).collect()}
    held = [d for d in after if after[d].held_out]
    assert sum(after[d].score for d in held) > sum(before[d].score for d in held)
    assert sum(after[d].score for d in held) > sum(after[d].base_score for d in held)


@pytest.mark.parametrize("name", ["op7_chat_formatting", "op9_decontamination"])
def test_sql_of_operators(spark, name):
    import duckdb

    from ebbtide.llm import entries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want, got = con.sql(entries.ORACLE_SQL[name]).df(), entries.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    assert token_counts.token_counts(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert repair_store.read_shards(repair_store.write_shards(none, BYTE)).count() == 0
    assert decontaminate.judged(none, bench).count() == 0 and decontaminate.judged(docs, bench).count() == len(sample())


def test_long_texts(spark):
    """One text of a megabyte and one word of two go through the operators whole."""
    long, word = "lorem ipsum dolor sit amet " * 40_000, "x" * 2_000_000
    df = spark.createDataFrame([(1, long), (2, word + " y")], "doc_id long, text string")
    assert {r.doc_id: r.n_shingles for r in ngram_join.near_groups(df).collect()} == {1: 5, 2: 1}
    counts = {r.doc_id: r for r in decontaminate.judged(df, spark.createDataFrame([(1, "ipsum dolor sit")], "item_id long, text string")).collect()}
    assert counts[1].n_words == 200_000 and counts[1].n_hit == 120_000 and counts[1].contaminated and counts[2].n_words == 2
    sizes = {r.doc_id: r.n_tokens for r in repair_store.read_shards(repair_store.write_shards(df, BYTE, shard_tokens=1000)).collect()}
    assert sizes[1] == len(tokens("byte_bpe_50k.json", long)) + 1 and sizes[2] > 1000


FIELDS = ["doc_id long", "text string", "lang string", "source string", "n_chars long", "`_cls` int", "`a.b` string", "id int", "th int", "comp string"]


def corpus():
    """Documents for the pipeline: good and bad ones, copies, edited copies, benchmark passages, nulls and repeated rows."""
    rng = random.Random(4)
    words = ["w%d" % i for i in range(3000)]
    item = " ".join("q%d" % i for i in range(30))
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 200))) for _ in range(60)]
    texts += [" ".join(t.split()[:-1] + ["edit%d" % i]) for i, t in enumerate(texts[:15])] + texts[20:25]
    texts += [t + " " + item for t in texts[30:35]] + [t + " q1 q2 q3" for t in texts[35:38]]
    texts += [" ".join(rng.choices(["bad%d" % i for i in range(300)], k=100)) for _ in range(20)]
    texts += [None, "", "too short", "again " * 200, " ".join(rng.choices(words, k=5000))]
    rows = [(i, t, "en", "s", 1, 7, "x", 3, None, "c") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[40], None, None, None, None, None, None, None, None)], item


def test_pipeline(spark, tmp_path):
    """Every stage's decisions against brute force on its own input, with clashing and dotted column names."""
    rows, item = corpus()
    docs = spark.createDataFrame(rows, ", ".join(FIELDS)).repartition(3)
    names = docs.columns
    good = [i for i, r in enumerate(rows[:-3]) if i < 60 and i % 3]
    bad = [i for i, r in enumerate(rows[:-3]) if (r[1] or "").startswith("bad")][:10]
    spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda r: (str(r[0]), str(r[1]))
    kept = None
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = sorted(map(tuple, docs.collect()), key=key)
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == names
        kept = sorted(map(tuple, docs.collect()), key=key)
        if name == "quality_rules":
            ratio, cut = quality_rules.fit(spark.createDataFrame(before, ", ".join(FIELDS)), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            want = []
            for r in before:
                n, *_, repeat = brute_figures(r[1]) if len((r[1] or "").split()) < 2000 else (5000, 0)
                import pyarrow as pa

                h = quality_rules.words_of(pa.array([r[1]], pa.string()))[0]
                if n >= 50 and 100 * repeat <= 50 * n and ratio[quality_rules.ngram_buckets(h)].mean() >= cut:
                    want.append(r)
            assert kept == want and not any((r[1] or "").startswith("bad") for r in kept) and len(kept) > 70
        elif name == "ngram_jaccard_join":
            s = [sets(r[1]) for r in before]
            comp = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    both = len(s[i] & s[j])
                    if s[i] and 100 * both >= 80 * (len(s[i]) + len(s[j]) - both):
                        a, b = comp[i], comp[j]
                        comp = [b if c == a else c for c in comp]
            groups = {}
            for c, r in zip(comp, before):
                groups.setdefault(c, []).append(r)
            # One of each group stays: the smallest doc_id, nulls first.
            best = {c: min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for c, g in groups.items()}
            assert kept == sorted(best.values(), key=key) and len(kept) < len(before) - 15
        else:
            def hit(t):
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
                q = item.split()
                wins = {tuple(q[i : i + 13]) for i in range(len(q) - 12)}
                covered = {i + d for i in range(len(w) - 12) if tuple(w[i : i + 13]) in wins for d in range(13)}
                return bool(covered) and 20 * len(covered) >= len(w)

            assert kept == [r for r in before if not hit(r[1])] and len(kept) < len(before)
    packed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(tokens("byte_bpe_50k.json", r[1])) + 1 for r in kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
