"""Preference formatting of conversation pairs.

The longest common prefix of turns (same role and text) of the chosen and the rejected conversation is
rendered once as the prompt; the remaining turns of each are its completion.  Masks are
run lengths over the completion's code points: ``length:1`` runs (content and end mark of assistant
turns) are trained on, ``length:0`` runs (role headers and other turns) are not.

Cases: a null role or text counts as empty; turns of equal number are ordered by role and text; repeated
turns stay; pairs of which one side has no turn, and rows with a null conversation id, give no row; equal
conversations give a full prompt and empty completions; an empty table gives no rows; further columns are
ignored.  A conversation is one value in one row, so it must fit a task's memory as any value must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rendering.
HEAD, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(AFTER_ROLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def mask_runs(turns: Column) -> Column:
    """``length:trained`` for the header and the content of each turn, joined by commas."""
    run = lambda t: F.concat(F.length(_header(t)), F.lit(":0,"), F.length(F.concat(t["text"], F.lit(END))), F.when(t["role"] == "assistant", ":1").otherwise(":0"))
    return F.array_join(F.transform(turns, run), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading equal turns; ``zip_with`` pads the shorter side with nulls, which equal no turn."""
    first_unequal = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(first_unequal > 0, first_unequal - 1).otherwise(F.size(a)).cast("int")


def preference_pairs(turns: DataFrame, pair_id: Column, is_chosen: Column) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` → one row per pair; one shuffle, by pair."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    said = turns.where(F.col("conv_id").isNotNull()).select(pair_id.alias("pair_id"), is_chosen.alias("chosen"), "conv_id", turn.alias("t"))
    side = lambda chosen: F.sort_array(F.collect_list(F.when(F.col("chosen") == chosen, F.col("t"))))
    both = said.groupBy("pair_id").agg(
        side(True).alias("c"), side(False).alias("r"), F.min(F.when(F.col("chosen"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("chosen"), F.col("conv_id"))).alias("rejected_id")
    )
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = both.where((F.size("c") > 0) & (F.size("r") > 0)).withColumns({"c": plain("c"), "r": plain("r")})
    both = both.withColumn("n_prompt_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    both = both.withColumns({"p": F.slice("c", F.lit(1), F.col("n_prompt_turns")), "c": rest("c"), "r": rest("r")})
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"),
        mask_runs(F.col("c")).alias("chosen_mask"), mask_runs(F.col("r")).alias("rejected_mask"),
    )


def neighbours(conv_id: Column) -> tuple[Column, Column]:
    """Pairing for tables without preference labels: conversation 2k is chosen, 2k + 1 rejected."""
    odd = F.pmod(conv_id, F.lit(2))
    return ((conv_id - odd) / 2).cast("long"), odd == 0
