"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common prefix of turns of the chosen and the rejected conversation is rendered once, as the prompt. What follows
it in each is a completion, with the character spans to be trained on: the assistant's texts and their ends.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm import store

#: How a turn is written: its head, its text, its end.
HEAD, END = "<|{}|>\n", "<|end|>\n"


def _head(turn: Column) -> Column:
    before, after = HEAD.split("{}")
    return F.concat(F.lit(before), F.coalesce(turn["role"], F.lit("unknown")), F.lit(after))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


_SPANS = "array<struct<start:int,stop:int>>"


def _spans_from(turns: Column, start: Column) -> Column:
    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + F.char_length(_head(turn))
        stop = first + F.char_length(_body(turn))
        own = F.when(turn["role"] == "assistant", F.array(F.struct(first.alias("start"), stop.alias("stop")))).otherwise(F.array().cast(_SPANS))
        return F.struct(stop.alias("at"), F.concat(state["spans"], own).alias("spans"))

    return F.aggregate(turns, F.struct(start.alias("at"), F.array().cast(_SPANS).alias("spans")), step)["spans"]


def trained_spans(turns: Column) -> Column:
    """Starts and stops, in characters of the rendered turns, of what the assistant says.

    A fold copies the list that it has at each turn; so turns are taken in about sqrt(n) runs of sqrt(n), whose starts come first, and no list that is copied is longer.
    """
    length = F.greatest(F.ceil(F.sqrt(F.size(turns))).cast("int"), F.lit(1))
    last = F.greatest(F.ceil(F.size(turns) / length).cast("int") - 1, F.lit(0))
    runs = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(turns, k * length + 1, length))
    size = lambda run: F.aggregate(run, F.lit(0), lambda n, t: n + F.char_length(_head(t)) + F.char_length(_body(t)))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(runs, begin, lambda s, run: F.struct((s["at"] + size(run)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")))["starts"]
    return F.flatten(F.zip_with(runs, starts, _spans_from))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns from the first on are equal, in role and text; nulls equal nulls."""
    n = F.least(F.size(chosen), F.size(rejected))
    equal = F.transform(F.slice(chosen, 1, n), lambda t, i: t.eqNullSafe(F.get(rejected, i)))
    at = F.array_position(equal, False)
    return F.when(at == 0, n).otherwise(at - 1).cast("int")


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """The columns of pairs but chosen and rejected, then prompt_turns, prompt, chosen, rejected and their spans.

    pairs has chosen and rejected, arrays of (role, text) in the order of turns. Null arrays are empty, a null role is
    written unknown, a null text is empty. Equal conversations are all prompt, with two empty completions; if nothing is
    common, the prompt is empty. Columns that clash, in any case of letters, are replaced; other names may have any characters; repeated rows stay; an empty table gives an empty table.
    """
    new = ("prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")
    rest = [c for c in pairs.columns if c.lower() not in new]
    carried = [F.col(f"carried_{i}") for i in range(len(rest))]  # under names of our own, so that none clashes
    turns = "array<struct<role:string,text:string>>"
    some = pairs.select(*(store.column(c).alias(f"carried_{i}") for i, c in enumerate(rest)), *(F.coalesce(F.col(c).cast(turns), F.array().cast(turns)).alias(c) for c in ("chosen", "rejected")))
    some = some.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    after = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    some = some.select(*carried, "prompt_turns", F.slice("chosen", 1, F.col("prompt_turns")).alias("shared"), after("chosen").alias("left_chosen"), after("rejected").alias("left_rejected"))
    made = [render(F.col(f"left_{c}")).alias(c) for c in ("chosen", "rejected")] + [trained_spans(F.col(f"left_{c}")).alias(f"{c}_spans") for c in ("chosen", "rejected")]
    return some.select(*(c.alias(name) for c, name in zip(carried, rest, strict=True)), "prompt_turns", render(F.col("shared")).alias("prompt"), *made)


def stale_answers(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation, and the same with every answer after the first replaced by the one before.

    conversations has conv_id, turn, role and text. Turns are in the order of turn, role and text, nulls
    first; rows without conv_id are one conversation. Repeated rows are turns of their own.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    before = F.lag(F.struct("text")).over(Window.partitionBy("conv_id", "role").orderBy("turn", "text"))
    rows = rows.withColumn("before", F.when(F.col("role") == "assistant", before))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", F.when(F.col("before").isNotNull(), F.col("before.text")).otherwise(F.col("text")).alias("stale"))))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    as_turns = lambda field: F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t[field].alias("text")))
    return grouped.select("conv_id", as_turns("text").alias("chosen"), as_turns("stale").alias("rejected"))
