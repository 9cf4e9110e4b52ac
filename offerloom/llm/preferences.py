"""Preference formatting: one prompt and two masked completions from two conversations.

A pair names a chosen and a rejected conversation.  Turns are taken in the order of
their numbers (then of role and text, so repeated rows have a place too).  The
longest common prefix of turns, equal in role and text, is rendered once as the
prompt.  What follows in either conversation is its completion, and its mask lists
the stretches to train on: the text and end mark of assistant turns, as
``start:end`` in code points of the completion, end exclusive, joined by commas.

A null role is written as ``unknown``, a null text as an empty one, and both equal
their like; a null turn number comes last.  Conversations without an id are left
out.  A pair whose conversation has no turns, or that lacks one side, gets an empty
completion for it.  Only the four columns named are read.

Everything is a DataFrame expression.  A conversation's turns meet in one row, as
the rendered text itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import numbered, stored
from offerloom.plans.joins import lookup_join

END = "<|end|>\n"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def ordered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(conv, turns)``: the turns of each conversation in order, as ``(role, text)``."""
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).isNull().alias("last"),
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("entry"),
    )
    listed = rows.groupBy("conv").agg(F.sort_array(F.collect_list("entry")).alias("turns"))
    return listed.select("conv", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns are equal from the start."""
    size = F.least(F.size(a), F.size(b))
    differing = F.filter(F.sequence(F.lit(1), size + 1), lambda i: (i > size) | ~F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)))
    return F.array_min(differing) - 1


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """Stretches of the rendered turns that an assistant wrote."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(header(turn["role"]))
        end = start + F.length(turn["text"]) + len(END)
        part = F.concat_ws(":", start.cast("string"), end.cast("string"))
        parts = F.when(turn["role"] == "assistant", F.concat(state["parts"], F.array(part))).otherwise(state["parts"])
        return F.struct(end.alias("at"), parts.alias("parts"))

    return F.aggregate(turns, begin, step, lambda s: F.array_join(s["parts"], ","))


def neighbours(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(pair_id, chosen_id, rejected_id)``: conversations in the order of their opening
    text and id, two by two, so that two answers to one prompt meet.

    The opening is the text of the first turn; the order is that of its MD5.  A
    common opening is split by the range sort like any other key.  The last of an odd
    number has no rejected side.
    """
    first = F.min(
        F.struct(
            F.col(turn_col).isNull().alias("last"),
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
    )
    rows = turns.filter(F.col(conv_col).isNotNull())
    openings = rows.groupBy(F.col(conv_col).alias("conv")).agg(F.md5(first["text"].cast("binary")).alias("opening"))
    placed = numbered(openings, [F.col("opening"), F.col("conv")], "place")
    pair = F.floor(F.col("place") / 2).cast("long").alias("pair_id")
    return placed.groupBy(pair).agg(
        F.min(F.when(F.col("place") % 2 == 0, F.col("conv"))).alias("chosen_id"),
        F.min(F.when(F.col("place") % 2 == 1, F.col("conv"))).alias("rejected_id"),
    )


def prompts(turns: Column) -> Column:
    """Digests of the role and text of all turns up to each user turn, the longest first."""
    begin = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, turn: Column) -> Column:
        whole = F.concat_ws(":", state["at"], F.length(turn["role"]).cast("string"), turn["role"], turn["text"])
        at = F.sha2(whole.cast("binary"), 256)
        found = F.when(turn["role"] == "user", F.concat(F.array(at), state["found"])).otherwise(state["found"])
        return F.struct(at.alias("at"), found.alias("found"))

    return F.aggregate(turns, begin, step, lambda s: s["found"])


def prompt_pairs(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``(pair_id, chosen_id, rejected_id)``: conversations that share a prompt, two by two.

    Those with all turns up to the last user turn in common meet first, in the order of
    their ids; what is left of an odd number goes on to the user turn before.  What shares
    no prompt has no rejected side.  A pair has the id of its chosen conversation.
    """
    conversations = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    left = stored(conversations.select("conv", prompts(F.col("turns")).alias("prompts")), "prompts")
    alone = F.lit(None).cast(left.schema["conv"].dataType)
    found = []
    while True:
        found.append(left.filter(F.size("prompts") == 0).select(F.col("conv").alias("chosen_id"), alone.alias("rejected_id")))
        asked = left.filter(F.size("prompts") > 0).withColumn("prompt", F.get("prompts", F.lit(0)))
        if asked.isEmpty():
            break
        placed = numbered(asked, [F.col("prompt"), F.col("conv")], "place")
        groups = placed.groupBy("prompt").agg(F.min("place").alias("first"), F.count("*").alias("n"))
        placed = lookup_join(placed, groups, ["prompt"]).withColumn("i", F.col("place") - F.col("first"))
        odd = (F.col("n") % 2 == 1) & (F.col("i") == F.col("n") - 1)
        side = lambda k: F.min(F.when(F.col("i") % 2 == k, F.col("conv")))
        both = placed.filter(~odd).groupBy(F.col("place") - F.col("i") % 2).agg(side(0).alias("chosen_id"), side(1).alias("rejected_id"))
        found.append(stored(both.select("chosen_id", "rejected_id"), "pairs"))
        left = stored(placed.filter(odd).select("conv", F.slice("prompts", F.lit(2), F.size("prompts")).alias("prompts")), "prompts")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(F.col("chosen_id").alias("pair_id"), "chosen_id", "rejected_id")


def format_preferences(
    pairs: DataFrame,
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(pair_id, chosen_id, rejected_id, n_prefix, prompt, chosen, chosen_mask, rejected,
    rejected_mask)`` for each row of ``pairs (pair_id, chosen_id, rejected_id)``."""
    conversations = ordered_turns(turns, conv_col, turn_col, role_col, text_col)
    chosen = conversations.select(F.col("conv").alias("chosen_id"), F.col("turns").alias("a"))
    rejected = conversations.select(F.col("conv").alias("rejected_id"), F.col("turns").alias("b"))
    rows = pairs.select("pair_id", "chosen_id", "rejected_id").join(chosen, "chosen_id", "left").join(rejected, "rejected_id", "left")
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = rows.select("pair_id", "chosen_id", "rejected_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    rows = rows.withColumn("n_prefix", common_prefix(F.col("a"), F.col("b")))
    rest = {c: F.slice(F.col(c), F.col("n_prefix") + 1, F.size(c)) for c in "ab"}
    return rows.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_prefix",
        rendered(F.slice("a", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        rendered(rest["a"]).alias("chosen"),
        mask(rest["a"]).alias("chosen_mask"),
        rendered(rest["b"]).alias("rejected"),
        mask(rest["b"]).alias("rejected_mask"),
    )
