"""Chat formatting after the collapse of cumulative snapshots.

Logs often hold a conversation several times, each time with a few more turns. Every conversation gets rolling hashes
of its turn prefixes: a hash of place, role and text of each turn, summed up to the turn. A conversation whose whole
hash equals a proper prefix hash of another is dropped by an anti-join; of equal conversations the smallest id stays.
The rest is rendered turn by turn.

A conversation is never brought together in one row or task before it is rendered: turns are numbered in blocks of
``BLOCK`` turn numbers, whose counts and sums are carried on, so one conversation with a third of all turns only
makes more blocks; the rendered text comes in parts of ``PART`` turns.

Defined results: turns are ordered by number, then role, then text, nulls first; rows that repeat a turn exactly are
one turn; null role or text counts as empty; a null conversation id is an id of its own, smaller than all others. An
empty table gives an empty table. Only the four columns are read, so others cannot clash. Texts may be of any length.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logcase.plans.sizing import materialize

BLOCK = 1024
PART = 1024
ROLE_MARK, END_MARK = "<|{}|>\n", "<|end|>\n"


def _hash(*parts: Column) -> list[Column]:
    """Two 64-bit hashes, that are summed (without overflow) to 128 bits of a prefix hash."""
    return [F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)]


def _turns(conversations: DataFrame) -> DataFrame:
    """The distinct turns with their place (from 1) and the hashes of the prefix that ends with them."""
    c = conversations
    turns = c.select(c["conv_id"].alias("conv"), c["turn"].cast("bigint").alias("turn"), F.coalesce(c["role"].cast("string"), F.lit("")).alias("role"),
                     F.coalesce(c["text"].cast("string"), F.lit("")).alias("text")).distinct()
    turns = materialize(turns.withColumn("block", F.floor(F.col("turn") / BLOCK)), "turns")
    # A struct of a null is no null: joins and groups then treat the null id like any other.
    turns = turns.withColumn("c", F.struct("conv")).withColumn("b", F.struct("block"))
    inside = Window.partitionBy("c", "b").orderBy("turn", "role", "text")
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    numbered = turns.withColumn("rank", F.row_number().over(inside))
    counts = turns.groupBy("c", "b").agg(F.count("*").alias("n"))
    offsets = counts.select("c", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = numbered.join(offsets, ["c", "b"]).withColumn("place", F.col("rank") + F.col("offset"))
    placed = placed.select("c", "b", "place", "role", "text", *_hash(F.col("place"), F.col("role"), F.col("text")))
    sums = placed.groupBy("c", "b").agg(F.sum("h1").alias("s1"), F.sum("h2").alias("s2"))
    carried = sums.select("c", "b", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0).cast("decimal(38,0)")).alias(f"c{i}") for i in (1, 2)])
    running = Window.partitionBy("c", "b").orderBy("place")
    rolled = placed.join(carried, ["c", "b"])
    return rolled.select("c", "place", "role", "text", *[(F.sum(f"h{i}").over(running) + F.col(f"c{i}")).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)])


def maximal(turns: DataFrame) -> DataFrame:
    """(c, n_turns, n_logged) of the conversations that no other one continues; ``n_logged`` counts equal ones."""
    key = ["place", "p1", "p2"]
    ends = turns.groupBy("c").agg(F.max("place").alias("place")).join(turns.select("c", *key), ["c", "place"])
    whole = ends.groupBy(*key).agg(F.min("c").alias("c"), F.count("*").alias("n_logged"))
    longest = turns.join(ends.select("c", F.col("place").alias("n_turns")), "c").where(F.col("place") < F.col("n_turns"))
    proper = longest.groupBy(*key).agg(F.lit(1).alias("_"))
    return whole.join(proper, key, "left_anti").select("c", F.col("place").alias("n_turns"), "n_logged")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.format_string(ROLE_MARK.replace("{}", "%s"), role), text, F.lit("\n" + END_MARK))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Per part of each maximal conversation: conv_id, part (from 0), n_turns and n_logged of the whole, text."""
    turns = materialize(_turns(conversations), "turn-prefixes")
    kept = turns.join(maximal(turns), "c").withColumn("part", F.floor((F.col("place") - 1) / PART))
    parts = kept.groupBy("c", "part").agg(
        F.first("n_turns").alias("n_turns"), F.first("n_logged").alias("n_logged"),
        F.array_sort(F.collect_list(F.struct("place", render(F.col("role"), F.col("text")).alias("t")))).alias("turns"))
    return parts.select(F.col("c.conv").alias("conv_id"), "part", F.col("n_turns").cast("bigint").alias("n_turns"), "n_logged",
                        F.array_join(F.transform("turns", lambda t: t["t"]), "").alias("text"))
