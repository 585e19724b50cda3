"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The turns of both conversations of a pair come together in one shuffle on the
pair. Their longest common prefix of turns (same role and text) is rendered
once as the prompt; the rest of either conversation is its completion, with a
mask that leaves loss only on the assistant's content. Masks are run lengths of
characters, ``length:flag`` joined by commas, flag 1 where the loss counts.

Turns are ordered by turn, then role, then text; null turns come first, and
null roles and texts count as empty. Repeated turns are kept. Turns without a
conversation id belong to no pair. A conversation without a partner gives a
row whose other side is null and whose prompt is empty. If one conversation
starts with the whole other one, the other's completion is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn.getField("role"), F.lit(MIDDLE))


def render(turns: Column) -> Column:
    """The turns in the template, as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t.getField("text"), F.lit(CLOSE))), "")


def mask(turns: Column) -> Column:
    """Run lengths of the rendered turns: heads are masked; an assistant's text and end count."""
    flag = lambda t: F.when(t.getField("role") == "assistant", "1").otherwise("0")
    body = lambda t: F.length(t.getField("text")) + len(CLOSE)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.length(_head(t)), F.lit(":0,"), body(t), F.lit(":"), flag(t))), ",")


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: pair_id, prompt, prompt_turns, chosen, rejected, chosen_mask, rejected_mask, chosen_turns, rejected_turns.

    ``pair``: the id that both conversations share; ``chosen``: whether a turn is of the chosen one. Null in either: the turn is left out.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("__chosen"), one.alias("__turn")).where("pair_id is not null and __chosen is not null")
    side = lambda wanted: F.array_sort(F.collect_list(F.when(F.col("__chosen") == wanted, F.col("__turn"))))
    sides = rows.groupBy("pair_id").agg(side(True).alias("a"), side(False).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n), lambda x, y: (x.getField("role") == y.getField("role")) & (x.getField("text") == y.getField("text")))
    other = F.array_position(same, False)
    sides = sides.withColumn("k", F.when(other == 0, n).otherwise(other - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("k") + 1, F.greatest(F.size(c) - F.col("k"), F.lit(0)))
    there = lambda c, value: F.when(F.size(c) > 0, value)
    return sides.select(
        "pair_id", render(F.slice("a", F.lit(1), F.col("k"))).alias("prompt"), F.col("k").cast("long").alias("prompt_turns"),
        there("a", render(rest("a"))).alias("chosen"), there("b", render(rest("b"))).alias("rejected"),
        there("a", mask(rest("a"))).alias("chosen_mask"), there("b", mask(rest("b"))).alias("rejected_mask"),
        F.size("a").cast("long").alias("chosen_turns"), F.size("b").cast("long").alias("rejected_turns"),
    )
