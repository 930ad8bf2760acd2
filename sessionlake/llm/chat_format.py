"""Chat formatting of logged conversations.

A log that is written after every turn holds the same conversation many times, each snapshot
a prefix of the next. Every turn gets the hash of all turns up to and with it. Conversations
with the same last hash are copies, of which the smallest id stays; one whose last hash is the
hash of an inner turn of another is a prefix of it and goes. What remains is rendered.

The hash of a prefix is the sum of the hashes of its turns, each hashed with its position, held
twice with different seeds. A sum can be had in parts: turns are dealt into stretches of
``STRETCH`` turn numbers and summed per stretch, the stretches are summed up per conversation,
and then only a stretch goes through a window. So no task takes all turns of a long conversation
before it is rendered, and a rendered conversation is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import text_of
from sessionlake.session import freeze

STRETCH = 1000
SEEDS = (1, 2)
#: Sums of 64-bit hashes.
SUM = "decimal(38,0)"
#: Before the role, between role and text, after the text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def ordered(turns: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct turns with ``position`` in their conversation, from zero, and ``n_turns``.

    A turn that is logged twice with the same role and text counts once. Different turns of
    one number follow each other by role and text; a null number comes first. A null text is
    empty. A null id is an id.
    """
    rows = turns.select(
        F.col(id).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), text_of(text).alias("text")
    ).distinct()
    # In a struct a null equals a null, in grouping and joining alike.
    rows = rows.withColumn("key", F.struct("conv", F.floor(F.col("turn") / STRETCH).alias("stretch")))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key.conv")
    before = whole.orderBy("key.stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "key", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("n_turns")
    )
    within = F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "text"))
    return (
        rows.withColumn("within", within)
        .join(starts, "key")
        .select("key", "conv", "role", "text", (F.col("start") + F.col("within") - 1).alias("position"), "n_turns")
    )


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """Ordered turns with ``prefix``, the hash of the conversation up to and with the turn."""
    hashed = turns.select(
        "*",
        *(F.xxhash64(F.lit(s), "position", F.col("role").isNull(), "role", "text").cast(SUM).alias(f"t{s}") for s in SEEDS),
    )
    sums = hashed.groupBy("key").agg(*(F.sum(f"t{s}").cast(SUM).alias(f"t{s}") for s in SEEDS))
    before = Window.partitionBy("key.conv").orderBy("key.stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "key", *(F.coalesce(F.sum(f"t{s}").over(before), F.lit(0)).cast(SUM).alias(f"b{s}") for s in SEEDS)
    )
    within = Window.partitionBy("key").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    prefix = F.struct(*((F.col(f"b{s}") + F.col(f"w{s}")).cast(SUM).alias(f"h{s}") for s in SEEDS))
    return (
        hashed.select("*", *(F.sum(f"t{s}").over(within).alias(f"w{s}") for s in SEEDS))
        .join(starts, "key")
        .select("conv", "position", "n_turns", "role", "text", prefix.alias("prefix"))
    )


def maximal(hashed: DataFrame) -> DataFrame:
    """``conv``, ``n_turns`` and ``copies`` of the conversations that no other one repeats or continues.

    Both sides of the anti-join are distinct before it, so a conversation or a first turn that
    a third of the log shares is one row there.
    """
    last = F.col("position") == F.col("n_turns") - 1
    ends = hashed.where(last).groupBy("prefix", "n_turns").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    inner = hashed.where(~last).select("prefix", (F.col("position") + 1).alias("n_turns")).distinct()
    return ends.join(inner, ["prefix", "n_turns"], "left_anti").select("conv", "n_turns", "copies")


def format_chats(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per maximal conversation: its id, ``n_turns``, ``copies`` and the rendered ``chat``.

    ``copies`` counts the conversations with the same turns. A null role is rendered as an
    empty one, but is not equal to it. An empty table gives an empty result; a conversation
    whose only turn is empty is a conversation.
    """
    hashed = freeze(with_prefix_hashes(freeze(ordered(turns, id, turn, role, text))))
    kept = maximal(hashed).withColumnRenamed("conv", "_conv")
    before, between, after = map(F.lit, TEMPLATE)
    piece = F.concat(before, F.coalesce("role", F.lit("")), between, "text", after)
    return (
        hashed.drop("n_turns")
        .join(kept, F.col("conv").eqNullSafe(F.col("_conv")))
        .groupBy("conv", "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("position", piece.alias("piece")))).alias("pieces"))
        .select(F.col("conv").alias(id), "n_turns", "copies", F.array_join("pieces.piece", "").alias("chat"))
    )
