"""Operator 2: preference formatting of paired conversations, in DataFrame functions only.

A pair holds a chosen and a rejected conversation.  Their longest common prefix of turns is
rendered once as the prompt; what follows on either side is rendered as that side's completion,
with the character spans of the assistant's own words as its loss mask (role marks and other
speakers' turns are not learned from).  The last turn of either side always belongs to its
completion, so that two equal conversations still give one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, HEAD_END, TAIL = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"


def conversation_turns(rows: DataFrame) -> DataFrame:
    """conv_id and its ordered ``turns`` array<struct<role, text>> from one row per turn.

    Repeated rows count once, turns with the same number follow by role and text, a null role or
    text is empty, a turn without number comes first, rows without conv_id belong to no
    conversation.
    """
    clean = (rows.filter("conv_id is not null")
             .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct())
    listed = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    return listed.select("conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) from plain conversations, one pair per conversation with a reply.

    Chosen: the turns up to the last assistant turn.  Rejected: the same turns, with that reply
    replaced by the assistant's reply before it (an empty one if there is none).
    """
    turns = F.col("turns")
    replies = F.filter(F.transform(turns, lambda t, i: F.struct((i + 1).alias("i"), t["role"].alias("role"), t["text"].alias("text"))),
                       lambda t: t["role"] == LEARNED)
    last = F.try_element_at("_r", F.lit(-1))["i"]
    before = F.coalesce(F.try_element_at("_r", F.lit(-2))["text"], F.lit(""))
    return (conversations.withColumn("_r", replies).filter(F.size("_r") > 0)
            .select(F.col("conv_id").alias("pair_id"), F.slice(turns, F.lit(1), last).alias("chosen"),
                    F.concat(F.slice(turns, F.lit(1), last - 1),
                             F.array(F.struct(F.lit(LEARNED).alias("role"), before.alias("text")))).alias("rejected")))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(HEAD_END), turn["text"], F.lit(TAIL))


def _spans(turns: Column) -> Column:
    """Character spans [start, end) of the learned texts in the rendered turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, turn):
        begin = acc["at"] + len(HEAD) + F.length(turn["role"]) + len(HEAD_END)
        end = begin + F.length(turn["text"])
        grown = F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct((end + len(TAIL)).alias("at"), F.when(turn["role"] == LEARNED, grown).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    ``pairs`` has pair_id and two arrays of (role, text) turns.  A pair with an empty or null side
    gives no row.  Texts are kept whole; nothing is cut or capped.
    """
    full = pairs.filter((F.size("chosen") > 0) & (F.size("rejected") > 0))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", F.lit(1), shorter), F.slice("rejected", F.lit(1), shorter), lambda a, b: a.eqNullSafe(b))
    first_difference = F.array_position(same, False).cast("int")
    common = F.when(first_difference == 0, shorter).otherwise(first_difference - 1)
    cut = full.withColumn("prompt_turns", F.least(common, shorter - 1))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("prompt_turns") + 1, F.size(side))

    prompt = F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("prompt_turns")), _render), "")
    return cut.select("pair_id", "prompt_turns", prompt.alias("prompt"),
                      F.array_join(F.transform(rest("chosen"), _render), "").alias("chosen"),
                      F.array_join(F.transform(rest("rejected"), _render), "").alias("rejected"),
                      _spans(rest("chosen")).alias("chosen_spans"), _spans(rest("rejected")).alias("rejected_spans"))
