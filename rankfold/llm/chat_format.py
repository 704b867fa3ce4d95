"""Chat formatting with cumulative-snapshot collapse.

Chat logs often store a conversation again after each turn.  Every turn gets two 64-bit hashes of its place, role and
text; their running XOR along a conversation is the hash of each turn prefix, linear in the number of turns.  A
conversation whose whole hash (with its length) is a proper turn prefix of a longer one is a snapshot and goes by an
anti-join; of conversations with the same turns the smallest id stays.  What is left is rendered.

Both sides of the anti-join hold distinct hashes, so a first turn or a whole conversation that a third of all rows
share is one row there; distinct and grouping combine before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, k (place from 1), n (turns in all), a and b (hashes of the first k turns)."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.withColumn("k", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return placed.select(
        "conv_id",
        "k",
        F.count("*").over(Window.partitionBy("conv_id")).alias("n"),
        F.bit_xor(F.xxhash64("k", "role", "text")).over(upto).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("second"), "text", "role", "k")).over(upto).alias("b"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_copies of each conversation that is no proper prefix of another one."""
    prefixes = prefix_hashes(turns)
    whole = prefixes.where("k = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.where("k < n").select(F.col("k").cast("long").alias("n"), "a", "b").distinct()
    return whole.join(proper, ["n", "a", "b"], "left_anti").select("conv_id", "n_copies")


def format_chats(conversations: DataFrame, template: tuple[str, str, str] = DEFAULT_TEMPLATE) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_copies (conversations with the same turns), chat.

    Turns go by ``turn``, ties by role and text; a null turn comes first.  A null role is rendered as ``unknown`` and a
    null text as empty, and they compare so too.  Repeated rows are turns of their own.  Rows without conv_id belong to
    no conversation and are left out.  One conversation is sorted and rendered in one task, so its turns must fit there;
    a text may be as long as memory allows.  An empty table gives an empty result; other columns are ignored.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kept = maximal_conversations(turns)
    before, between, after = (F.lit(x) for x in template)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(before, t["role"], between, t["text"], after)), "")
    # a null turn sorts last in array_sort; -inf as its key keeps it first
    keyed = turns.withColumn("turn", F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at")))
    rendered = keyed.join(kept, "conv_id").groupBy("conv_id", "n_copies").agg(F.count("*").alias("n_turns"), shown.alias("chat"))
    return rendered.select("conv_id", "n_turns", "n_copies", "chat")
