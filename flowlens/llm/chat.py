"""Chat formatting of maximal conversations (cumulative-snapshot collapse).

Chat logs store a conversation again after every turn, so most logged
conversations are prefixes of longer ones.  A rolling hash of turn prefixes
(a running sum of per-turn hashes, which carry the turn's number) names every
prefix; a conversation whose whole hash is a proper prefix hash of another is
dropped by an anti-join, equal conversations keep the smallest id, and only
what remains is rendered.

DataFrame expressions only.  Turns are range-partitioned by conversation and
place, and running sums go by partition, so a conversation of any length is
summed in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from flowlens.operators._small import materialize

#: Characters of a role and of a text that the range partitioning looks at.
HEAD = 64
#: Stands for a missing turn number; such turns come first.
UNNUMBERED = -(1 << 63)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_HASH = ("a", "b", "c", "d")


def turn_hash() -> list[Column]:
    """Four summands of a 128-bit hash of (number, role, text); nulls differ
    from empty strings.  32-bit parts cannot overflow a sum."""
    parts = []
    for seed in (11, 12):
        h = F.xxhash64(F.lit(seed), "turn_no", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
        parts += [F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return [p.alias(n) for p, n in zip(parts, _HASH, strict=True)]


def distinct_turns(log: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The log's distinct turns under fixed names; a row without an id is keyed
    by itself, a turn without a number comes first."""
    lone = F.sha2(F.to_json(F.struct(F.col(turn_col), F.col(role_col), F.col(text_col))), 256)
    return log.select(
        F.col(id_col).alias("conv"), F.when(F.col(id_col).isNull(), lone).alias("lone"),
        F.coalesce(F.col(turn_col).cast("bigint"), F.lit(UNNUMBERED)).alias("turn_no"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).distinct()


def in_order(turns: DataFrame) -> DataFrame:
    """The turns with their ``place`` in the order of conversation, number,
    role and text (nulls first), and the ``part`` of the order they stand in.

    The ranges are chosen by the heads of role and text, as a sample of whole
    texts would be large; rows of one conversation and number that agree in
    those heads share a part, inside which whole texts decide."""
    role_head = F.left("role", F.lit(HEAD))
    # a longer role may differ behind its head, where the text does not count yet
    text_head = F.when(F.length("role") >= HEAD, F.lit(None)).otherwise(F.left("text", F.lit(HEAD)))
    ranged = turns.withColumn("role_head", role_head).withColumn("text_head", text_head).repartitionByRange(
        "conv", "lone", "turn_no", "role_head", "text_head")
    return ranged.sortWithinPartitions("conv", "lone", "turn_no", "role", "text").select(
        "conv", "lone", "turn_no", "role", "text", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("place"))


def _same(a: str, b: str, columns: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def rolling(placed: DataFrame) -> DataFrame:
    """(conv, lone, place, a, b, c, d, n, whole) of every turn: the hash and
    number of the turns up to it, and the conversation's number of turns."""
    key = ("conv", "lone")
    hashed = materialize(placed.select(*key, "part", "place", *turn_hash()), "chat-hashes")
    sums = [F.sum(c).alias(c) for c in _HASH]
    parts = hashed.groupBy(*key, "part").agg(*sums, F.count(F.lit(1)).alias("n"))
    all_parts = W.Window.partitionBy(*key)
    ahead = all_parts.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = parts.select(*key, "part", F.sum("n").over(all_parts).alias("whole"), *(
        F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}0") for c in (*_HASH, "n")))
    inside = W.Window.partitionBy(*key, "part").orderBy("place").rowsBetween(
        W.Window.unboundedPreceding, W.Window.currentRow)
    running = hashed.withColumn("n", F.lit(1)).select(*key, "part", "place", *(
        F.sum(c).over(inside).alias(c) for c in (*_HASH, "n")))
    return running.alias("r").join(starts.alias("s"), _same("r", "s", (*key, "part"))).select(
        *(F.col(f"r.{k}").alias(k) for k in key), "place",
        *((F.col(c) + F.col(f"{c}0")).alias(c) for c in (*_HASH, "n")), "whole")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, lone, whole) of the conversations that are no proper prefix of
    another; ``whole`` counts their turns.  Of equal ones the smallest id."""
    wholes = prefixes.where("n = whole").groupBy(*_HASH, "n").agg(F.min(F.struct("conv", "lone")).alias("one"))
    proper = prefixes.where("n < whole").select(*_HASH, "n").distinct()
    return wholes.join(proper, [*_HASH, "n"], "left_anti").select(
        "one.conv", "one.lone", F.col("n").alias("whole"))


def segment() -> Column:
    """One rendered turn.  A marker inside a text is broken up; a null role
    reads ``unknown``, a null text is empty."""
    safe = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def format_chats(log: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", chunk_turns: int | None = None) -> DataFrame:
    """Rendered maximal conversations: (id, chunk, turns, conversation_turns, rendered).

    A conversation is one row (chunk 0), its turns in order of number, role and
    text, nulls first.  With ``chunk_turns`` it comes in rows of so many turns
    instead, ``chunk`` counting them from 0: the way for conversations that
    exceed what a row can hold (2 GB).  Joined in the order of ``chunk``, the
    rows are the same text.

    Repeated rows of the log count once.  A row without an id is a conversation
    of its own; a turn without a number comes first.  A prefix may end at any
    turn, among several rows of one number (or among rows without one) too.  A
    very long text is rendered whole, in its row.  An empty log gives an empty
    table.
    """
    key = ("conv", "lone")
    turns = materialize(in_order(distinct_turns(log, id_col, turn_col, role_col, text_col)), "chat")
    prefixes = materialize(rolling(turns), "chat-prefixes")
    kept = maximal(prefixes)
    rows = turns.alias("t").join(kept.alias("k"), _same("t", "k", key)).select("t.*", "k.whole")
    rows = rows.withColumn("chunk", F.lit(0).cast("bigint"))
    if chunk_turns:
        numbered = prefixes.select("place", F.floor((F.col("n") - 1) / F.lit(chunk_turns)).cast("bigint").alias("chunk"))
        rows = rows.drop("chunk").join(numbered, "place")
    gathered = rows.groupBy(*key, "chunk", "whole").agg(
        F.sort_array(F.collect_list(F.struct("place", segment().alias("segment")))).alias("all"))
    id_type = log.schema[id_col].dataType
    return gathered.select(
        F.col("conv").cast(id_type).alias(id_col), "chunk",
        F.size("all").cast("bigint").alias("turns"), F.col("whole").alias("conversation_turns"),
        F.array_join(F.col("all.segment"), "").alias("rendered"))
