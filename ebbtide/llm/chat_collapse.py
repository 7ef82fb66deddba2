"""Cumulative-snapshot collapse of logged conversations.

A turn's hash covers its number, role and text, with flags for nulls. The running xor of a conversation's turn hashes is
the hash of each of its prefixes (two independent 64-bit hashes). A conversation whose whole hash is
a proper prefix hash of a longer one is a snapshot and goes by anti-join; of identical conversations
the smallest conv_id stays. Turns of the rest are rendered in place, one row a turn, so no
conversation is gathered. Turns move as hashes; texts move once, in the last join.

Very long conversations are split into blocks of turn numbers before the running xor; within one the sort
spills. Exact repeats of a turn row count once. Rows that share a turn number but differ are all kept,
ordered by a digest of role and text, and a prefix may end between them. Null role renders as `unknown`,
null text as empty; rows with a null conv_id or turn are dropped as belonging to no conversation. An empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, written

BLOCK = 4096


def told_apart(*first):
    """Columns of role and text for a hash; hashes skip nulls, so a flag tells null from any value."""
    pair = [c for name in ("role", "text") for c in (F.col(name).isNull(), F.coalesce(F.col(name), F.lit("")))]
    return [*first, *pair]


def tie_order():
    """A digest of role and text by which rows of one turn number are ordered, so that no text is moved for it."""
    role = F.coalesce(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role")), F.lit("-"))
    return F.md5(F.concat(role, F.coalesce(F.concat(F.lit(":"), F.col("text")), F.lit("-"))).cast("binary"))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, a, b, block): the different rows of every conversation."""
    return (
        turns.where("conv_id is not null and turn is not null")
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            tie_order().alias("tie"),
            F.xxhash64(*told_apart(F.col("turn"))).alias("a"),
            F.xxhash64(*reversed(told_apart(F.lit("second"), F.col("turn")))).alias("b"),
        )
        .groupBy("conv_id", "turn", "tie", "a", "b")
        .agg(F.lit(1).alias("n"))
        .withColumn("block", F.floor(F.col("turn") / BLOCK))
    )


def prefixes(hashed: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, n): hash and length of the prefix up to each row."""
    blocks = hashed.groupBy("conv_id", "block").agg(
        F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n")
    )
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(
        "conv_id", "block",
        F.coalesce(F.bit_xor("a").over(past), F.lit(0)).alias("a0"),
        F.coalesce(F.bit_xor("b").over(past), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n0"),
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("turn", "tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = hashed.select(
        "conv_id", "block", "turn",
        F.bit_xor("a").over(upto).alias("a1"), F.bit_xor("b").over(upto).alias("b1"), F.sum("n").over(upto).alias("n1"),
    )
    return inside.join(before, ["conv_id", "block"]).select(
        "conv_id", "turn",
        F.col("a0").bitwiseXOR(F.col("a1")).alias("a"),
        F.col("b0").bitwiseXOR(F.col("b1")).alias("b"),
        (F.col("n0") + F.col("n1")).alias("n"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one extends."""
    pre = written(prefixes(turn_hashes(turns)), "chat-prefixes")
    whole = pre.groupBy("conv_id").agg(F.max(F.struct("n", "a", "b")).alias("w")).select("conv_id", "w.n", "w.a", "w.b")
    proper = pre.join(whole.select("conv_id", F.col("n").alias("all")), "conv_id").where("n < all")
    distinct = whole.groupBy("a", "b", "n").agg(F.min("conv_id").alias("conv_id"))
    return distinct.join(proper.select("a", "b", "n").distinct(), ["a", "b", "n"], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns")
    )


def collapse(turns: DataFrame) -> DataFrame:
    """Rendered turns of maximal conversations: conv_id, turn, role, n_turns, rendered."""
    once = turns.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    role = F.coalesce("role", F.lit("unknown"))
    rendered = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    same = F.struct(F.xxhash64(*told_apart()), F.xxhash64(*reversed(told_apart())))
    return (
        once.join(maximal(turns), "conv_id")
        .withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "turn", same).orderBy(F.lit(1))))
        .where("k = 1")
        .select("conv_id", "turn", role.alias("role"), "n_turns", rendered.alias("rendered"))
    )


def query(spark, sf_dir):
    return collapse(load(spark, sf_dir, "conversations"))


ORACLE_SQL = r"""
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
c as (select conv_id, list({'turn': turn, 'role': role, 'text': text}
  order by turn, md5(coalesce(length(role) || ':' || role, '-') || coalesce(':' || text, '-'))) l from t group by 1),
d as (select min(conv_id) conv_id, l from c group by l),
p as (select distinct l[1:k.n] l from d, unnest(range(1, len(l))) as k(n)),
m as (select conv_id, len(l) n_turns from d where l not in (select l from p))
select conv_id, turn, coalesce(role, 'unknown') as role, n_turns,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) as rendered
from t join m using (conv_id)
"""
