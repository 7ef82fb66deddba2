"""N-gram Jaccard join at 0.8 on distinct 5-word shingles, and its connected groups.

Equal shingle sets are one class. Hashed counts of all shingles give every shingle a place in one
global order, rare ones first; any order is right, rarity only saves work. Classes join on the
shingles of their prefixes. Two sets that overlap by `o` have their first common shingle at a place of
at most n - o in each, which bounds length and position; each pair that passes is checked once by a
suffix filter and the exact intersection. A bitmap of each set, toggled by its shingles, bounds the
shingles that only one of a pair has, and in the second round all that the prefixes share bounds a
pair, so texts move for few pairs but links.

To avoid all pairs within a large group, the first round pairs each class only with the hub of each of
its prefix shingles, the class that shares the most prefix shingles; the second pairs all classes that
share a prefix shingle and are not yet in one component, so no link between components is lost. There a
shingle that is not a pair's first common one is left out where the shingles just before it tell. Links
within a component are then counted exactly: a component that fits one block is one unit of work, a
larger one is dealt by length level and hash into blocks, each pair of near blocks is one unit, and the
counts per class are summed, not written as pairs. This counting is quadratic in a large component.

Texts are hashed whole, in blocks of bounded size. Null, empty or wordless texts have no shingles, link
with nothing and are their own component. Null doc_ids take part and do not name a component unless it
has no other id. Ties between hubs go to the smaller class. Repeated rows give repeated rows; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, load, own_columns, tidy, written
from .wordhash import mixed, word_hashes

WORDS = 5
BLOCK_SHINGLES, BLOCK_CLASSES = 200_000, 2048
MULT = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(WORDS)]
BATCH = 256
BITS = 512  # of a set's bitmap
RECENT = 3  # shingles before one in its prefix


def every_shingle(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes with repeats, number per text); a text of fewer words than five has one, without words none."""
    h, k = word_hashes(texts)
    start = np.cumsum(k) - k
    n = np.where(k >= WORDS, k - WORDS + 1, np.minimum(k, 1))
    out = np.empty(int(n.sum()), np.uint64)
    first = np.cumsum(n) - n
    long = k >= WORDS
    if long.any():
        at = np.repeat(start[long] - first[long], n[long])
        place = np.repeat(long, n)
        at = at + np.flatnonzero(place)
        s = np.full(len(at), WORDS, np.uint64)
        for i in range(WORDS):
            s += h[at + i] * MULT[i]
        out[place] = s
    for t in np.flatnonzero((k > 0) & ~long):
        s = np.uint64(k[t])
        with np.errstate(over="ignore"):
            for i in range(k[t]):
                s = s + h[start[t] + i] * MULT[i]
        out[first[t]] = s
    return mixed(out), n


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Distinct shingle hashes of each whole text, ascending."""
    h, n = every_shingle(texts)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []


def frequency_table(docs: DataFrame, bits: int = 18) -> np.ndarray:
    """Rarity level (0 rare to 255) of each of 2^bits hash buckets, counted over all documents.

    The table has one size for every corpus, as it is shipped to all tasks: shingles that are more than a
    2^bits-th of all stand out of their bucket, and those are the ones that must not be in prefixes.
    """

    def count(batches):
        c = np.zeros(1 << bits, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                h, _ = every_shingle(b.column(0).slice(i, BATCH))
                c += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=len(c))
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at])], ["bucket", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2^bits rows
    c = np.zeros(1 << bits)
    c[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy()
    mean = max(c.mean(), 1.0)
    return np.clip(np.round(16 * np.log2(np.maximum(c, 1) / mean)) + 64, 0, 255).astype(np.uint8)


def bitmap(x: np.ndarray) -> np.ndarray:
    """A set's bitmap: each shingle toggles one bit, so two bitmaps differ in no more bits than their sets in shingles."""
    return np.packbits((np.bincount((x & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def text_hash(text):
    return F.xxhash64(text.cast("string"))


def signatures(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """(rid, doc_id, th, n_shingles, cls, pre, bits): set's 128-bit name, its prefix of n - ceil(0.8 n) + 1 shingles, its bitmap.

    A class's prefix and bitmap are given by the first of its copies that a task meets, so that large groups
    of copies add few; copies met by other tasks repeat them, which changes no result.
    """
    shift, table = np.uint64(64 - int(len(level)).bit_length() + 1), level

    def run(batches):
        met = set()
        for b in batches:
            for s in range(0, b.num_rows, BATCH):
                part = b.slice(s, BATCH)
                h, k = every_shingle(part.column(3))
                # Shingles as single numbers in the global order: rarity level, then hash.
                h = (table[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h & np.uint64((1 << 56) - 1))
                n, keys, pre, bits = [], [], [], []
                for x in np.split(h, np.cumsum(k)[:-1]):
                    x = np.unique(x)
                    n.append(len(x))
                    key = xxhash.xxh3_128_digest(x) if len(x) else None
                    fresh = key is not None and key not in met
                    pre.append(x[: len(x) - (4 * len(x) + 4) // 5 + 1].view(np.int64) if fresh else None)
                    bits.append(bitmap(x) if fresh else None)
                    keys.append(key)
                    met.add(key)
                if len(met) > 200_000:
                    met.clear()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (pre, bits))],
                    ["rid", "doc_id", "th", "n_shingles", "cls", "pre", "bits"],
                )

    text = F.col("text").cast("string")
    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("th"), text)
    return narrow.mapInArrow(tidy(run), "rid long, doc_id long, th long, n_shingles long, cls binary, pre array<long>, bits array<long>")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """(token, id, n, pos): prefix shingles of two or more classes; a class's id is its smallest row id.

    The window runs through a sorted token, so a frequent one is streamed, not gathered.
    """
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("rid").alias("id"), F.first("n_shingles").cast("int").alias("n"), F.first("pre", ignorenulls=True).alias("pre")
    )
    tokens = classes.select("id", "n", F.posexplode("pre").alias("pos", "token"))
    w = Window.partitionBy("token").orderBy("id")
    return tokens.select("token", "id", "n", "pos", F.lag("id").over(w).alias("l"), F.lead("id").over(w).alias("r")).where("l is not null or r is not null").drop("l", "r")


def overlap(n1, n2):
    """Least overlap of two linked sets: ceil(4 (n1 + n2) / 9)."""
    return F.ceil((n1 + n2) * 4 / F.lit(9))


def bounds(a: str, b: str):
    """Length and positional bounds of a pair at its first common shingle."""
    n1, n2, i, j = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    length = 5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)
    most = 9 * F.least(n1 - i, n2 - j)
    return length & (most >= 4 * (n1 + n2))


def suffix_allows(x: np.ndarray, y: np.ndarray, need: int, depth: int = 3) -> bool:
    """Suffix filter: splitting at middle shingles bounds the overlap from above."""

    def most(a, b, d):
        if d == 0 or not len(a) or not len(b):
            return min(len(a), len(b))
        w = b[len(b) // 2]
        cut = int(np.searchsorted(a, w))
        same = int(cut < len(a) and a[cut] == w)
        return most(a[:cut], b[: len(b) // 2], d - 1) + same + most(a[cut + same :], b[len(b) // 2 + 1 :], d - 1)

    return most(x, y, depth) >= need


def texts_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text): one copy's text of each wanted class.

    Texts are found by doc_id and text hash. A bitmap of the wanted keys, of fixed size, keeps most
    others out of the shuffle; the join decides.
    """
    cls = rows.where("cls is not null").groupBy("cls").agg(F.min(F.struct("rid", "doc_id", "th")).alias("r"))
    rep = written(cls.select("r.*").join(wanted.select(F.col("id").alias("rid")).distinct(), "rid", "left_semi"), "join-reps", compression="zstd")
    key = F.xxhash64("doc_id", "th")
    cells = rep.select(F.pmod(key, F.lit(1 << 23)).alias("k")).groupBy(F.floor(F.col("k") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k % 32 as int))")).alias("v"))
    held = cells.toPandas()  # at most 2^18 rows
    bitmap = np.zeros(1 << 18, np.uint32)
    bitmap[held["w"].to_numpy(np.int64)] = held["v"].to_numpy(np.int64).astype(np.uint32)

    def run(batches):
        for b in batches:
            k = b.column(3).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array((bitmap[k >> 5] >> (k & 31).astype(np.uint32)) & 1 == 1)).select(["doc_id", "th", "text"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.col("text").cast("string").alias("text"))
    some = some.where("text is not null").select("doc_id", "th", "text", F.pmod(key, F.lit(1 << 23)).alias("k")).mapInArrow(tidy(run), "doc_id long, th long, text string")
    found = some.alias("s").join(rep.alias("r"), F.col("s.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("s.th") == F.col("r.th")))
    return found.select(F.col("r.rid").alias("id"), "s.text").dropDuplicates(["id"])


def linked_texts(u: np.ndarray, v: np.ndarray) -> bool:
    need = -(-4 * (len(u) + len(v)) // 9)
    if not suffix_allows(u, v, need):
        return False
    both = len(np.intersect1d(u, v, assume_unique=True))
    return 100 * both >= 80 * (len(u) + len(v) - both)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose exact Jaccard is at least 0.8."""

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, BATCH):
                part = b.slice(s, BATCH)
                keep = [linked_texts(u, v) for u, v in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3)))]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): smallest class of each linked class's component, by hooking and contraction."""
    maps, live = [], edges
    while True:
        both = live.select("a", "b").union(live.select("b", "a"))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p")), "cc-up")
        if up.isEmpty():
            break
        for _ in range(2):
            q = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            up = written(up.join(q, "p").select("v", F.col("pp").alias("p")), "cc-jump")
        maps.append(up)
        a, b = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        live = written(
            live.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "cc-live",
        )
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("comp")).limit(0)
    comp = maps[-1].select("v", F.col("p").alias("comp"))
    for up in reversed(maps[:-1]):
        later = comp.select(F.col("v").alias("p"), "comp")
        comp = up.join(later, "p", "left").select("v", F.coalesce("comp", "p").alias("comp"))
    return written(comp.select(F.col("v").alias("id"), "comp"), "cc-comp")


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of x with every set of y."""
    if len(x) * len(y) <= 32:
        return np.array([[len(np.intersect1d(u, v, assume_unique=True)) for v in y] for u in x])
    tokens, ids = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cut = sum(map(len, x))
    places = [np.repeat(np.arange(len(sets)), [len(v) for v in sets]) for sets in (x, y)]
    counts = [np.bincount(i, minlength=len(tokens)) for i in (ids[:cut], ids[cut:])]
    pairs = counts[0] * counts[1]
    out = np.zeros(len(x) * len(y), np.int64)
    often = pairs * 64 > len(out)

    def listed(keep):
        for i, place in zip((ids[:cut], ids[cut:]), places):
            at = np.flatnonzero(keep[i])
            at = at[np.argsort(i[at], kind="stable")]
            yield i[at], place[at]

    # Shingles of few sets: every pair of their sets is counted by itself, a bounded number at a time.
    rare = np.flatnonzero((pairs > 0) & ~often)
    for some in np.split(rare, np.flatnonzero(np.diff(np.cumsum(pairs[rare]) >> 21)) + 1):
        keep = np.zeros(len(tokens), bool)
        keep[some] = True
        (i, row), (j, col) = listed(keep)
        n = counts[1][i]
        start = np.searchsorted(j, i)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        out += np.bincount(np.repeat(row, n) * len(y) + col[at], minlength=len(out))
    # Shingles of many sets: products of 0-1 matrices.
    number = np.cumsum(often) - 1
    for s in range(0, int(often.sum()), 1024):
        sides = []
        for (i, place), height in zip(listed(often & (number >= s) & (number < s + 1024)), (len(x), len(y))):
            m = np.zeros((height, 1024), np.float32)
            m[place, number[i] - s] = 1
            sides.append(m)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64).ravel()
    return out.reshape(len(x), len(y))


def link_counts(x: list[np.ndarray], y: list[np.ndarray] | None, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set of x into y and of each of y into x; without y, within x."""
    other = x if y is None else y
    to_x, to_y = np.zeros(len(x), np.int64), np.zeros(len(other), np.int64)
    size = np.array([len(v) for v in other])
    for s in range(0, len(x), rows):
        part = x[s : s + rows]
        both = shared_counts(part, other)
        hit = 100 * both >= 80 * (np.array([len(u) for u in part])[:, None] + size - both)
        to_x[s : s + rows] = hit.sum(1)
        to_y += hit.sum(0)
    return (to_x - 1, to_y - 1) if y is None else (to_x, to_y)


def degrees(comp: DataFrame, rows: DataFrame, texts: DataFrame, shingles_a_block: int, classes_a_block: int) -> DataFrame:
    """(id, n_links): exact number of links of each class of a component.

    Lengths of linked sets differ by a factor of 1.25 at most, hence by one level of a factor 1.3 at most.
    """
    size = rows.where("cls is not null").groupBy("cls").agg(F.min("rid").alias("id"), F.first("n_shingles").alias("n")).drop("cls")
    member = comp.join(size, "id").withColumn("level", F.floor(F.log("n") / F.log(F.lit(1.3))).cast("int"))
    blocks = lambda s, k: F.greatest(F.ceil(F.sum(s) / shingles_a_block), F.ceil(F.sum(k) / classes_a_block)).cast("int")
    levels = member.groupBy("comp", "level").agg(F.sum("n").alias("s"), F.count("*").alias("k"))
    whole = levels.groupBy("comp").agg(blocks("s", "k").alias("all"), F.min("level").alias("low"))
    # A component that fits one block has one level, 0, of one block.
    level = F.when(F.col("all") == 1, 0).otherwise(F.col("level")).alias("level")
    levels = written(levels.join(whole, "comp").select("comp", level, "s", "k").groupBy("comp", "level").agg(blocks("s", "k").alias("blocks")), "join-levels")
    cells = (
        member.join(whole, "comp").select("id", "comp", level).join(levels, ["comp", "level"])
        .select("id", "comp", "level", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "blocks")
    )
    above = levels.select("comp", (F.col("level") - 1).alias("level"), F.col("blocks").alias("up"))
    below = levels.select("comp", (F.col("level") + 1).alias("level"), F.col("blocks").alias("down"))
    near = cells.join(above, ["comp", "level"], "left").join(below, ["comp", "level"], "left")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda l, b, m, c: F.struct(l.alias("l"), b.alias("b"), m.alias("m"), c.alias("c"))
    own, at = F.col("level"), F.col("block")
    units = F.concat(
        F.transform(upto(F.col("blocks")), lambda c: unit(own, F.least(at, c), own, F.greatest(at, c))),
        F.transform(upto(F.col("up")), lambda c: unit(own, at, own + 1, c)),
        F.transform(upto(F.col("down")), lambda c: unit(own - 1, c, own, at)),
    )
    dealt = near.select("id", "comp", "level", "block", F.explode(units).alias("u"))
    side = (F.col("level") == F.col("u.m")) & (F.col("block") == F.col("u.c")) & ((F.col("u.l") != F.col("u.m")) | (F.col("u.b") != F.col("u.c")))

    def run(table: pa.Table) -> pa.Table:
        ids, right = table["id"].to_numpy(), table["side"].to_numpy()
        sets = shingle_sets(table["text"].combine_chunks())
        x, y = ([s for s, r in zip(sets, right) if r == want] for want in (False, True))
        # A pair of different cells has both sides; a unit of one cell alone has only the left one.
        if y:
            to_x, to_y = link_counts(x, y) if x else (np.zeros(0, np.int64), np.zeros(len(y), np.int64))
            n = np.zeros(len(ids), np.int64)
            n[~right], n[right] = to_x, to_y
        else:
            crossed = bool(table["crossed"][0].as_py())
            n = np.zeros(len(ids), np.int64) if crossed else link_counts(x, None)[0]
        return pa.table({"id": ids, "n": n})

    flat = dealt.select("id", "comp", "u", side.alias("side"), ((F.col("u.l") != F.col("u.m")) | (F.col("u.b") != F.col("u.c"))).alias("crossed"))
    return (
        flat.join(texts, "id").groupBy("comp", "u").applyInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))
    )


def open_tokens(pre: DataFrame, comp: DataFrame) -> DataFrame:
    """Shared prefix rows whose shingle still lies in two or more components, with the component."""
    member = pre.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = member.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return member.join(several, "token")


def centred(pre: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the hub of a shingle: the class that shares the most prefix shingles.

    An edited copy's rarest shingles are its own, the original's are shared by all its copies, so
    the hub of a group of edited copies is its original, and links with most of them.
    """
    weight = pre.groupBy("id").agg(F.count("*").alias("k"))
    head = Window.partitionBy("token").orderBy(F.desc("k"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pre.join(weight, "id").select(F.struct("id", "n", "pos").alias("x"), "token", "k", "id")
    pairs = rows.select("x", F.first("x").over(head).alias("y")).where("x.id <> y.id").where(bounds("x", "y"))
    a, b = F.col("x.id"), F.col("y.id")
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def marks(signed: DataFrame) -> DataFrame:
    """(id, n, bits) of every class."""
    own = signed.where("cls is not null").groupBy("cls").agg(F.min("rid").alias("id"), F.first("n_shingles").alias("n"), F.first("bits", ignorenulls=True).alias("bits"))
    return own.drop("cls")


def alike(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs whose bitmaps differ in no more bits than linked sets in shingles, a ninth of both sizes."""
    one, two = (marked.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in ("a", "b"))
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, k: s + k)
    return pairs.join(one, "a").join(two, "b").where(9 * differ <= F.col("n_a") + F.col("n_b")).select(*pairs.columns)


def meetings(member: DataFrame) -> DataFrame:
    """(x, y): rows of classes of different components that pass the bounds at a shingle of both prefixes, few for a pair.

    The smaller set, x, has the first common shingle in the first ninth of its shingles. Rows whose last
    few shingles meet have an earlier one in common, at which the pair is found.
    """
    before = F.collect_list("token").over(Window.partitionBy("id").orderBy("pos").rowsBetween(-RECENT, -1))
    row = member.withColumn("before", before)
    x, y = row.where("9 * pos <= n").alias("x"), row.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    return (
        x.join(y, F.col("x.token") == F.col("y.token"))
        .where(smaller & (F.col("x.comp") != F.col("y.comp")) & bounds("x", "y"))
        .where(~F.arrays_overlap("x.before", "y.before"))
    )


def met_pairs(member: DataFrame) -> DataFrame:
    """(a, b, n1, n2): each pair that meets, with its sizes, a below b."""
    swap = F.col("x.id") > F.col("y.id")
    pick = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c))
    return meetings(member).select(pick("x.id", "y.id").alias("a"), pick("y.id", "x.id").alias("b"), pick("x.n", "y.n").alias("n1"), pick("y.n", "x.n").alias("n2")).distinct()


def open_pairs(member: DataFrame, rows: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of classes of different components that may link, by bitmaps and by all shingles their prefixes share.

    The set whose prefix ends first has no other shingle of that prefix in common with the other, so their
    overlap is at most what the prefixes share and what follows that prefix.
    """
    pairs = written(met_pairs(member), "join-met")
    if marked is not None:
        pairs = written(alike(pairs, marked), "join-alike")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # Prefixes are in the order of unsigned numbers.
    ends = rows.where("cls is not null").groupBy("cls").agg(F.min("rid").alias("id"), F.first("last", ignorenulls=True).bitwiseXOR(F.lit(-(1 << 63))).alias("last"))
    prefix = member.join(wanted, "id", "left_semi").groupBy("id").agg(F.collect_list("token").alias("tokens")).join(ends.drop("cls"), "id")
    one, two = (prefix.toDF(k, f"tokens_{k}", f"l{i}") for i, k in ((1, "a"), (2, "b")))
    met = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("tokens_a", "tokens_b")))
    enough = lambda n: F.col("both") + F.expr(f"(4 * {n} + 4) div 5 - 1") >= overlap(F.col("n1"), F.col("n2"))
    return met.where(((F.col("l1") > F.col("l2")) | enough("n1")) & ((F.col("l2") > F.col("l1")) | enough("n2"))).select("a", "b")


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(rows with class, id to component of linked classes, tables of the texts of all classes met in pairs)."""
    signed = written(signatures(docs, frequency_table(docs)), "join-sets", compression="zstd")
    pre = written(shared_prefixes(signed), "join-shared", compression="zstd")
    rows = written(signed.withColumn("last", F.try_element_at("pre", F.lit(-1))).drop("pre", "bits"), "join-rows", compression="zstd")
    marked = written(marks(signed), "join-marks", compression="zstd")
    drop(signed)
    hub = written(alike(centred(pre), marked), "join-hub")
    ids = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id"))
    texts = [written(texts_of(docs, rows, ids(hub)), "join-texts", compression="zstd")]
    links = written(verified(hub, texts[0]), "join-links")
    comp = components(links)
    member = written(open_tokens(pre, comp), "join-open", compression="zstd")
    drop(pre)
    rest = open_pairs(member, rows, marked).join(hub, ["a", "b"], "left_anti")
    rest = written(rest, "join-rest")
    drop(member)
    drop(marked)
    if not rest.isEmpty():
        new = ids(rest).distinct().join(texts[0].select("id"), "id", "left_anti")
        texts.append(written(texts_of(docs, rows, new), "join-texts", compression="zstd"))
        more = written(verified(rest, texts[0].union(texts[1])), "join-more")
        if not more.isEmpty():
            comp = components(links.union(more))
    return rows, comp, texts


def classed(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with the id and the component of their class; null for wordless texts."""
    names = rows.where("cls is not null").groupBy("cls").agg(F.min("rid").alias("id")).join(comp, "id", "left")
    return rows.join(names.select("cls", "id", F.coalesce("comp", "id").alias("comp")), "cls", "left")


def near_groups(docs: DataFrame, shingles_a_block: int = BLOCK_SHINGLES, classes_a_block: int = BLOCK_CLASSES) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per document; n_links counts links between different sets."""
    rows, comp, texts = linked(docs)
    named = written(classed(rows, comp), "join-named")
    first = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    met = texts[0] if len(texts) == 1 else texts[0].union(texts[1])
    degree = degrees(comp, rows, met, shingles_a_block, classes_a_block)
    return (
        named.join(first, "comp", "left")
        .join(degree, "id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the smallest doc_id, with all its columns; wordless documents all stay.

    Rows are told apart by doc_id and text; of rows equal in both one stays, too.
    """
    rows, comp, texts = linked(docs)
    named = classed(rows, comp).where("comp is not null")
    group = named.groupBy("comp").agg(F.min(F.struct("doc_id", "th")).alias("k"))
    distinct = named.groupBy("comp", "doc_id", "th").agg(F.count("*").alias("copies"))
    chosen = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("th") == F.col("k.th"))
    judged = written(
        distinct.join(group, "comp").select("doc_id", "th", "copies", chosen.alias("chosen")).where("not chosen or copies > 1"), "join-judged"
    )
    for t in texts:
        drop(t)
    same = F.col("d._id").eqNullSafe(F.col("j.doc_id")) & (F.col("d._th") == F.col("j.th"))
    keyed = docs.select(F.struct(*own_columns(docs)).alias("_own"), F.col("doc_id").cast("long").alias("_id"), text_hash(F.col("text")).alias("_th")).alias("d")
    kept = keyed.join(judged.alias("j"), same, "left_anti")
    again = judged.where("chosen")
    if not again.isEmpty():
        kept = kept.union(keyed.join(again.alias("j"), same, "left_semi").dropDuplicates(["_id", "_th"]))
    return kept.select("_own.*")


def query(spark, sf_dir):
    return near_groups(load(spark, sf_dir, "documents"))
