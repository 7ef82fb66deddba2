"""Conversation repair and WARC bundles against brute force, SQL and exact round trips."""

import hashlib
import io
import random

import duckdb
import pandas as pd
import pytest
import zstandard
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import chat_collapse, chat_repair, warc_bundles

TURNS = "conv_id long, turn long, role string, text string, gone boolean, fault string, audit string"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def slow_repair(rows):
    """Every item by dynamic programming over (cost, audit), then the text; rows are (role, text, fault)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}

    def closed(items):
        for _ in range(3):
            for (q, r), to in step.items():
                if r != "s" and q in items:
                    c, a, out = items[q]
                    items[to] = min(items.get(to, (10**9, "", [])), (c + 3, a + "I", [*out, names[r] + ":"]))
        return items

    items = closed({0: (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for q, (c, a, out) in items.items():
            found = [(q, (c + 4, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                for (p, r), to in step.items():
                    if p == q and role[:1] == r:
                        found.append((to, (c + more, a + "K", [*out, f"{role}:{text}"])))
                    if p == q and r != "s":
                        found.append((to, (c + 3 + more, a + "R", [*out, f"{names[r]}:{text}"])))
            for to, v in found:
                after[to] = min(after.get(to, v), v)
        items = closed(after)
    c, a, out = min(items[q] for q in (0, 3) if q in items)
    return c, a, out


def slow(turns):
    space = " \t\n\x0b\x0c\r"
    want = {}
    for conv in {t[0] for t in turns}:
        rows = sorted(((t[1] is not None, t[1] or 0, t[2] if t[2] is not None else " ", t[3] if t[3] is not None else " ", t[1]) for t in turns if t[0] == conv and not t[4]))
        seen, marked, turnset = set(), [], []
        for *_, role, text, turn in rows:
            bare = text.strip(space)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
            if turn is not None:
                turnset.append(turn)
        c, a, out = slow_repair(marked)
        pairs = [x[0][:1] + y[0][:1] for x, y in zip(marked, marked[1:])]
        count = lambda f: sum(m[2] == f for m in marked)
        gaps = max(turnset) - min(turnset) + 1 - len(set(turnset)) if turnset else 0
        want[conv] = (
            gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), c, a,
            hashlib.sha256("\n".join(out).encode()).hexdigest(), len(rows),
        )
    return want


def random_turns(seed, n=300, convs=40):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "unknown", "tool", "", None, "s"]
    texts = ["Yes.", "No!", "why", "a b?", "", " \t", None, "Yes.", "tail. \n", "é", "x" * 30 + "."]
    rows = [
        (rng.choice([None, *range(convs)]), rng.choice([None, *range(9)]), rng.choice(roles[: rng.choice([3, 10])]), rng.choice(texts), rng.random() < 0.05, "z", "z")
        for _ in range(n)
    ]
    rows += rows[:10]
    rows += [(900, i, "xyz", f"t{i}.", False, None, None) for i in range(41)]  # derivations that never meet
    rows += [(901, i, ("user", "assistant")[i % 2], f"t{i}" + "." * (i % 7 > 0), False, None, None) for i in range(60)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 256), (3, 1), (4, 2), (5, 7)])
def test_repair_is_the_lightest(spark, seed, block):
    turns = random_turns(seed)
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in chat_repair.lightest(df, block=block).collect()}
    assert got == slow(turns)


def test_repair_of_rows(spark):
    turns = random_turns(6)
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    summary = {r.conv_id: r for r in chat_repair.lightest(df).collect()}
    rows = {}
    for r in chat_repair.repaired(df).orderBy("conv_id", "place").collect():
        rows.setdefault(r.conv_id, []).append(r)
    for conv, s in summary.items():
        mine = rows.get(conv, [])
        assert [r.place for r in mine] == list(range(len(mine))) and "".join(r.edit for r in mine) == s.audit
        text = "\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == s.repaired_sha256


def test_repair_of_damage_equals_its_sql(spark):
    turns = [t[:4] for t in random_turns(7, n=500, convs=60)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r.asDict()[c] for c in sorted(r.asDict())) for r in chat_repair.lightest(chat_repair.damaged(df)).collect()), key=str)
    con = duckdb.connect()
    pandas = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", pandas)
    out = con.sql(chat_repair.ORACLE_SQL)
    names = sorted(out.columns)
    want = sorted((tuple(r) for r in out.select(*names).fetchall()), key=str)
    assert got == want and {"D", "I", "K", "R"} <= set("".join(r[names.index("audit")] for r in want))


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_repair.lightest(none).count() == 0 and chat_repair.repaired(none).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "a.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert [tuple(r) for r in chat_repair.lightest(gone).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest(), 0)]


PAGES = "page_id long, url string, html string, size long, row string, digest string"


def random_pages():
    rng = random.Random(8)
    long = ["<p>" + "".join(rng.choices("abc é漢\r\n", k=n)) for n in (100, 120, 5000, 200_000)]
    texts = [None, "", "short", "x" * 99, "x" * 100, "\r\n\r\n" * 40, *long]
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "", "https://a.example/é x?q=1\r\nX: y", "https://b.example/"]), rng.choice(texts), 1, None, "") for _ in range(300)]
    return [*rows, rows[3], rows[3], rows[7]]


@pytest.fixture(scope="module")
def bundles(spark):
    return warc_bundles.write(spark.createDataFrame(random_pages(), PAGES).repartition(3), frame_bytes=20_000, bundle_bytes=4_000)


def test_archives_hold_every_page(spark, bundles):
    got = [tuple(r) for r in warc_bundles.read(bundles).collect()]
    pages = random_pages()
    size = lambda h: len((h or "").encode())
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    assert sorted((g[:3] for g in got), key=str) == sorted(((p[0], size(p[2]), digest(p[2])) for p in pages), key=str)
    for d in {g[2] for g in got}:
        group = [g for g in got if g[2] == d]
        known = [g[0] for g in group if g[0] is not None]
        if group[0][1] < 100:
            assert {g[3:] for g in group} == {("response", None)}
        else:
            (lead,) = [g for g in group if g[3] == "response"]
            assert lead[0] == (min(known) if known else None) and lead[4] is None
            assert all(g[4] == lead[0] for g in group if g[3] == "revisit")


def test_bundles_are_seekable(spark, bundles):
    at = {}
    for r in bundles.collect():
        data = bytes(r.data)
        table = warc_bundles.seek_table(data)
        frames = [warc_bundles.frame(data, e) for e in table]
        # Any Zstandard reader gets the same stream; it skips the table.
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert plain == b"".join(frames)
        for e in r.entries:
            head, _, end = warc_bundles.parse(frames[e.frame], e.offset)
            assert end - e.offset == e.length and head["WARC-Record-ID"] == f"<{e.record_id}>"
            at[e.record_id] = head
    assert len(at) == len(random_pages()) and bundles.count() > 3
    for head in at.values():
        if head["WARC-Type"] == "revisit":
            assert at[head["WARC-Refers-To"][1:-1]]["WARC-Type"] == "response"


def test_single_records(spark, bundles):
    index = warc_bundles.index(bundles)
    wanted = index.where(F.crc32("record_id") % 9 == 0).select("record_id")
    got = {r.record_id: r.payload for r in warc_bundles.fetch(bundles, wanted.union(wanted)).collect()}
    assert set(got) == {r.record_id for r in wanted.collect()} and got
    page = {r.record_id: r.page_id for r in index.collect()}
    texts = {}
    for p in random_pages():
        texts.setdefault(p[0], set()).add((p[2] or "").encode())
    assert all(v is None or bytes(v) in texts[page[k]] for k, v in got.items()) and any(v for v in got.values())


def test_damage_is_noticed(bundles):
    data = bytearray(bundles.first().data)
    table = warc_bundles.seek_table(bytes(data))
    data[table[0][0] + table[0][1] // 2] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc_bundles.frame(bytes(data), table[0])
    with pytest.raises(ValueError):
        warc_bundles.seek_table(bytes(data[:-1]))


def test_files(spark, bundles, tmp_path):
    warc_bundles.export(bundles, f"file://{tmp_path}/out")
    warc_bundles.export(bundles, f"file://{tmp_path}/out")
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert files == {f"{r.bundle}.warc.zst": bytes(r.data) for r in bundles.collect()}


def test_no_pages(spark):
    assert warc_bundles.read(warc_bundles.write(spark.createDataFrame([], PAGES))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_collapse_equals_its_sql_on_ties(spark, seed):
    rng = random.Random(seed)
    base = [(rng.choice([0, 0, 1, 1, 2, None]), rng.choice(["u", "a", None, ""]), rng.choice(["a", "b", "1:a", None])) for _ in range(7)]
    turns = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "b"), (2, 1, "b", "x"), (3, 0, "u", "b"), (4, -5000, "u", "a"), (5, -5000, "u", "a"), (5, 9000, "u", "a")]
    for conv in range(10, 90):
        own = rng.sample(base, rng.randrange(1, 6))
        turns += [(rng.choice([conv, conv, None]), *t) for t in own + own[:1]]
    got = sorted((tuple(r.asDict()[c] for c in ("conv_id", "n_turns", "rendered", "role", "turn")) for r in chat_collapse.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)).collect()), key=str)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = sorted(con.sql(chat_collapse.ORACLE_SQL).select("conv_id", "n_turns", "rendered", "role", "turn").fetchall(), key=str)
    assert got == want and got
