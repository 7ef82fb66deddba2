"""Structure repair of logged conversations by Knuth's lightest-derivation agenda.

A conversation's rows, in order, are repaired into role initials `(s?(ua)+)?`. An item (i, q) says that
the first i rows are consumed and the output stands in state q (start, after s, after u, after a). Every
edit is a deduction with a superior function: it adds its cost and appends its initial, so a conclusion
is never lighter than its premise in the order (cost, audit). The agenda pops the lightest item; a popped
item is final; the goal is the first popped accepting item of all rows. Edits: Keep costs 0, Rerole to
user or assistant 3, Delete 4 (the only edit of blank and duplicate rows), Insert of an empty user or
assistant row 3; a truncated row that stays adds 3. Ties go to the ASCII-least audit. Given an audit the
output is unique, as every state but the start admits one role.

Two derivations of one item consume the same rows, so an audit is never a proper prefix of another of
equal cost and appending keeps their order. A long conversation is deduced in blocks of `block` rows: all
derivations pass through the at most four items at a block's end, which become the next block's axioms.
Items over SLACK above the lightest of these are left out; a lighter one reaches whatever they do for at
most 7 more. Of earlier blocks a task keeps audits and a running SHA-256 for each of these items, not
rows, so its memory is bounded by one block and the audits. The SHA-256 of a whole conversation is
sequential by nature; it is why a conversation is streamed through one task, off a sort that spills.

Rows are ordered by turn (null first), role and text, so repeated rows are neighbours and ties are told
apart. Null role or text counts as one space; rows of a null conv_id are one conversation; an initial
other than s, u, a (an empty role has none) cannot be kept; an empty table gives no rows; other columns
are not read. Duplicates are told by role and text themselves, not by hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import os

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, parts, ship, tidy, written

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MADE = {q: (r, to) for (q, r), to in STEP.items() if r != "s"}  # the user or assistant row a state admits
NAME = {"u": "user", "a": "assistant"}
ACCEPTING = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SLACK = 8
LEGAL = ("su", "ua", "au")
FAULTS = ("", "blank", "duplicate", "truncated")
SPACE = r"[\x20\x09-\x0D]"
SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, n_rows long"
)


def agenda(rows: list[tuple[str, int]], axioms: list[tuple[int, str, int]], goal: bool) -> list[tuple[int, str, int, int]]:
    """Lightest derivations over rows of (initial, fault) from axioms of (cost, audit, state).

    Returns (cost, audit, state, axiom's state) of the goal, or of every item at the end of the rows.
    """
    n, final, out = len(rows), set(), []
    heap = [(cost, audit, 0, q, q) for cost, audit, q in axioms]
    heapq.heapify(heap)
    while heap:
        cost, audit, i, q, origin = heapq.heappop(heap)
        if out and cost > out[0][0] + SLACK:
            break
        if (i, q) in final:
            continue
        final.add((i, q))
        made, to = MADE[q]
        if i == n:
            if not goal:
                out.append((cost, audit, q, origin))
            elif q in ACCEPTING:
                return [(cost, audit, q, origin)]
        else:
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, q, origin))
            if fault not in (1, 2):
                extra = TRUNCATED if fault == 3 else 0
                if (q, initial) in STEP:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, STEP[q, initial], origin))
                heapq.heappush(heap, (cost + REROLE + extra, audit + "R", i + 1, to, origin))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, to, origin))
    return out


def replay(edits: str, q: int, rows: list[tuple[str, str]]):
    """(edit, row number or None, role or None, text) of every edit, from state q over rows of (role, text)."""
    i = 0
    for e in edits:
        made, to = MADE[q]
        if e == "I":
            yield e, None, NAME[made], ""
        else:
            role, text = rows[i]
            if e == "D":
                yield e, i, None, text
                i += 1
                continue
            if e == "K":
                to = STEP[q, role[:1]]
            yield e, i, role if e == "K" else NAME[made], text
            i += 1
        q = to


class Conversation:
    """Streams one conversation's rows; holds a block of them and the items at the last block's end."""

    def __init__(self, block: int, block_chars: int):
        self.block, self.block_chars = block, block_chars
        self.rows: list[tuple[str, str]] = []
        self.marks: list[tuple[str, int]] = []
        self.chars = self.n = self.illegal = self.distinct = 0
        self.faults = [0, 0, 0, 0]
        self.first = self.last = self.before = None
        self.settled: list[str] = []
        # state: (cost, audit after the settled part, hash of the output, whether it has a line)
        self.ends = {0: (0, "", hashlib.sha256(), False)}

    def add(self, turn, role: str, text: str, fault: int) -> None:
        if len(self.rows) >= self.block or self.chars > self.block_chars:
            self.close(False)
        initial = role[:1]
        if self.n and self.before + initial not in LEGAL:
            self.illegal += 1
        if turn is not None:
            # Turns come in order.
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        self.before = initial
        self.n += 1
        self.faults[fault] += 1
        self.rows.append((role, text))
        self.marks.append((initial, fault))
        self.chars += len(text)

    def close(self, goal: bool) -> None:
        found = agenda(self.marks, [(c, a, q) for q, (c, a, _, _) in self.ends.items()], goal)
        ends = {}
        for cost, audit, q, origin in found:
            _, tail, digest, begun = self.ends[origin]
            digest = digest.copy()
            for _, _, role, text in replay(audit[len(tail) :], origin, self.rows):
                if role is not None:
                    digest.update(f"{chr(10) * begun}{role}:{text}".encode("utf-8", "surrogatepass"))
                    begun = True
            ends[q] = (cost, audit, digest, begun)
        shared = os.path.commonprefix([a for _, a, _, _ in ends.values()])
        self.settled.append(shared)
        self.ends = {q: (c, a[len(shared) :], d, b) for q, (c, a, d, b) in ends.items()}
        self.rows, self.marks, self.chars = [], [], 0

    def summary(self) -> tuple:
        self.close(True)
        ((cost, tail, digest, _),) = self.ends.values()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return gaps, *self.faults[1:], self.illegal, cost, "".join(self.settled) + tail, digest.hexdigest(), self.n


def marked(turns: DataFrame) -> DataFrame:
    """Rows with their first fault (1 blank, 2 duplicate, 3 truncated, else 0), a conversation's rows together.

    A null `gone` column counts as false; rows with it true keep their conversation in the result, and no more.
    """
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        gone.alias("gone"),
    ).repartition(parts(turns.sparkSession), "conv_id")
    same = Window.partitionBy("conv_id", "gone", F.xxhash64("role", "text"), "role", "text").orderBy(F.col("turn").asc_nulls_first())
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = (
        F.when(F.col("gone"), 0).when(blank, 1).when(F.row_number().over(same) > 1, 2)
        .when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), 3).otherwise(0)
    )
    return rows.withColumn("fault", fault)


def streamed(rows: DataFrame) -> DataFrame:
    return rows.sortWithinPartitions("conv_id", "gone", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == 2)


def lightest(turns: DataFrame, block: int = 256, block_chars: int = 1 << 22) -> DataFrame:
    """Per conversation: faults, cost and audit of its lightest repair, and the SHA-256 of the repaired text."""
    ship(turns.sparkSession)

    def run(batches):
        now, conv, out = None, None, []

        def flushed():
            cols = list(zip(*out)) or [[]] * 10
            kinds = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in SUMMARY.split(", ")])

        for b in batches:
            for s in range(0, b.num_rows, 512):
                for conv_id, gone, turn, role, text, fault in zip(*(c.to_pylist() for c in b.slice(s, 512).columns)):
                    if conv is None or conv_id != now:
                        if conv is not None:
                            out.append((now, *conv.summary()))
                        now, conv = conv_id, Conversation(block, block_chars)
                    if not gone:
                        conv.add(turn, role, text, fault)
                if len(out) >= 512:
                    yield flushed()
        if conv is not None:
            out.append((now, *conv.summary()))
        yield flushed()

    return streamed(marked(turns)).select("conv_id", "gone", "turn", "role", "text", "fault").mapInArrow(tidy(run), SUMMARY)


def repaired(turns: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """The repaired conversations, a row an edit: (conv_id, place, edit, turn, role, text); deleted rows have no role.

    An audit travels once, as the row before its conversation's others, and is replayed over the sorted rows.
    """
    ship(turns.sparkSession)
    audits = written(lightest(turns), "chat-audits") if audits is None else audits
    n = parts(turns.sparkSession)
    head = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = marked(turns).where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    both = head.unionByName(rows).repartition(n, "conv_id").sortWithinPartitions(
        "conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text"
    )

    def run(batches):
        audit, at, q, place, now = "", 0, 0, 0, None
        for b in batches:
            out = []

            def step(edit, turn, role, text):
                nonlocal q, place
                if edit != "D":
                    q = STEP[q, role[:1]]
                out.append((now, place, edit, turn, role, text))
                place += 1

            def inserts():
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    step("I", None, NAME[MADE[q][0]], "")
                    at += 1

            for s in range(0, b.num_rows, 512):
                for conv_id, kind, turn, role, text in zip(*(c.to_pylist() for c in b.slice(s, 512).columns)):
                    if not kind:
                        now, audit, at, q, place = conv_id, text, 0, 0, 0
                    else:
                        edit = audit[at]
                        at += 1
                        step(edit, turn, {"K": role, "D": None}.get(edit, NAME[MADE[q][0]]), text)
                    inserts()
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)], ["conv_id", "place", "edit", "turn", "role", "text"]
            )

    return both.mapInArrow(tidy(run), "conv_id long, place long, edit string, turn long, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """Deterministic damage by crc32 of `conv_id:turn` modulo 20; dropped rows stay as `gone`."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    k = F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    hurt = turns.select(
        "conv_id", "turn", k.alias("k"), F.when(k == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    times = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.select("conv_id", "turn", "role", "text", (F.col("k") == 0).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def query(spark, sf_dir):
    return lightest(damaged(load(spark, sf_dir, "conversations")))


def _plus(value: str, cost: str, edit: str) -> str:
    return f"(lpad(cast(cast(left({value}, 9) as bigint) + {cost} as varchar), 9, '0') || substr({value}, 10) || '{edit}')"


def _kept(value: str, initial: str) -> str:
    return f"case when not del and ini = '{initial}' then {_plus(value, 'extra', 'K')} end"


def _reroled(value: str) -> str:
    return f"case when not del then {_plus(value, '3 + extra', 'R')} end"


# The items of a row number are four texts, each a cost of nine digits and an audit, so that their order is that of texts.
ORACLE_SQL = rf"""
with recursive src as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
crc as (
  select *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(key) + 1), lambda i: cast(ascii(key[i]) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
      lambda x, i: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))), 4294967295) % 20 as k from src),
hurt as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text
  from crc, unnest(range(case when k = 3 then 2 else 1 end)) where k <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from hurt),
placed as (select *, row_number() over (partition by conv_id, role, text order by i) as again from ordered),
faulty as (
  select *, left(role, 1) as ini, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when again > 1 then 2
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault from placed),
marked as (
  select *, fault in (1, 2) as del, case when fault = 3 then 3 else 0 end as extra,
    lag(ini) over (partition by conv_id order by i) || ini as pair from faulty),
base as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
    count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n_rows from marked group by 1),
items as (
  select conv_id, 0 as i, '000000000' as s0, cast(null as varchar) as s1, '000000003I' as s2, '000000006II' as s3 from base
  union all
  select conv_id, i, w0, w1, x2, least(w3, {_plus('x2', '3', 'I')}) from (
    select *, least(w2, {_plus('w0', '3', 'I')}, {_plus('w1', '3', 'I')}, {_plus('w3', '3', 'I')}) as x2 from (
      select m.conv_id, m.i, {_plus('s0', '4', 'D')} as w0, least({_plus('s1', '4', 'D')}, {_kept('s0', 's')}) as w1,
        least({_plus('s2', '4', 'D')}, {', '.join(f"{_kept(s, 'u')}, {_reroled(s)}" for s in ('s0', 's1', 's3'))}) as w2,
        least({_plus('s3', '4', 'D')}, {_kept('s2', 'a')}, {_reroled('s2')}) as w3
      from items join marked m on m.conv_id is not distinct from items.conv_id and m.i = items.i + 1))),
best as (
  select b.*, cast(left(least(s0, s3), 9) as bigint) as cost, substr(least(s0, s3), 10) as audit
  from base b join items t on t.conv_id is not distinct from b.conv_id and t.i = b.n_rows),
letters as (
  select conv_id, p, audit[p] as e, len(replace(audit[1:p], 'I', '')) as i from best, unnest(range(1, len(audit) + 1)) as u(p)),
output as (
  select l.conv_id, p, e, role, text, e = 'K' and ini = 's' as sys
  from letters l left join marked m on l.e <> 'I' and m.i = l.i and m.conv_id is not distinct from l.conv_id where e <> 'D'),
turned as (
  select *, count(*) filter (not coalesce(sys, false)) over (partition by conv_id order by p) as j from output),
text as (
  select conv_id, string_agg(case when e = 'K' then role when j % 2 = 1 then 'user' else 'assistant' end || ':'
    || case when e = 'I' then '' else text end, chr(10) order by p) as whole from turned group by 1)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit,
  sha256(coalesce(whole, '')) as repaired_sha256, coalesce(n_rows, 0) as n_rows
from (select distinct conv_id from conversations) c left join best b on b.conv_id is not distinct from c.conv_id
left join text t on t.conv_id is not distinct from c.conv_id
"""
