"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions alone.

Loggers often store a conversation anew after each turn, so one conversation appears as many
prefixes of itself. Every conversation gets a rolling hash for each of its turn prefixes. A conversation whose
whole hash is a strict prefix hash of another is a snapshot of it and goes, by an anti-join; of equal conversations
the smallest id stays. What remains is rendered with a chat template.

The rolling hash is the exclusive or of two 64-bit hashes of each turn salted with its place, so it is extended by a turn
in constant time and the shuffle for it carries hashes, not texts. With the number of turns it is the key of a
prefix. Prefix keys are made distinct with map-side aggregation before the join: an opening turn that a third of
the corpus shares is one row of it. Texts are shuffled once, for the conversations that stay and a few whose id falls
into a hash bucket with one of those. A conversation is rendered in one row, so its turns have to meet in one task; rows with
a null id are one conversation and meet likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, with_keys

#: Role of a turn that has none, and the marks around a turn.
NO_ROLE, OPEN, NAMED, CLOSE = "unknown", "<|", "|>\n", "<|end|>\n"


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    clean = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(NO_ROLE)).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return clean.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit("turn"), "role")})


def prefix_keys(turns: DataFrame) -> DataFrame:
    """conv_id, place (turns in the prefix), p1, p2 (its rolling hash) and n_turns, a row for each turn."""
    inside = Window.partitionBy("conv_id").orderBy("turn", "h1", "h2")
    rolling = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.select("conv_id", "turn", "h1", "h2", F.row_number().over(inside).cast("long").alias("place"))
    salted = placed.withColumns({"s1": F.xxhash64("place", "h1", "h2"), "s2": F.xxhash64("h2", "place", "h1")})
    hashed = salted.select("conv_id", "place", F.bit_xor("s1").over(rolling).alias("p1"), F.bit_xor("s2").over(rolling).alias("p2"))
    return hashed.withColumn("n_turns", F.max("place").over(Window.partitionBy("conv_id")))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_equal of each conversation that is no strict prefix of another."""
    keys = prefix_keys(turns)
    whole = keys.filter("place = n_turns").groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    strict = keys.filter("place < n_turns").select("place", "p1", "p2").distinct()
    return whole.join(strict, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, n_turns, n_equal and rendered, a row for each maximal conversation.

    n_equal counts the conversations equal to it, itself included. Turns are ordered by their number, a null first;
    ties by the hashes of role and text, so the order doesn't hang on how rows are stored. Repeated rows are turns of
    their own. A null role is ``unknown``, a null text is empty; rows with a null conversation id form one
    conversation, which keeps the null. An empty table gives an empty result; other columns are ignored.
    """
    said = _turns(turns, conv_col, turn_col, role_col, text_col)
    names = ["absent", "id"]
    named = lambda rows: rows.withColumns({"absent": F.isnull("conv_id"), "id": F.coalesce("conv_id", F.lit(0))})
    kept = named(Workspace(turns.sparkSession, "chats").keep(maximal_conversations(said), "kept")).drop("conv_id")
    line = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(NAMED), t["text"], F.lit("\n" + CLOSE))
    chosen = with_keys(named(said), kept, names).join(kept, names)
    turn = F.struct("turn", "h1", "h2", "role", "text")
    collected = chosen.groupBy(*names, "n_turns", "n_equal").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("said"))
    return collected.select("conv_id", "n_turns", "n_equal", F.array_join(F.transform("said", line), "").alias("rendered"))
