"""Preference formatting: one rendered prompt, two masked completions.

A chosen and a rejected conversation share a prefix of turns. It is rendered once as the prompt;
what follows in either is a completion with the spans of characters that are trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered, before and after its text.
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct(turn, role, text)>) in turn order, then by role and text.

    Null roles and texts count as empty, a null turn number is before all others; a null conv_id
    is a conversation of its own name. Repeated rows are turns of their own.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text")))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns with the same role and text."""
    n = F.least(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x["role"] != y["role"]) | (x["text"] != y["text"]))
    at = F.array_position(differ, True)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(n)


def render(turns: Column) -> Column:
    head, tail = HEAD.split("{role}"), TAIL
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(head[0]), t["role"], F.lit(head[1]), t["text"], F.lit(tail))), "")


def trained_spans(turns: Column) -> Column:
    """[start, end) in characters of the trained turns' text and closing mark within ``render(turns)``."""
    around = len(HEAD.replace("{role}", ""))
    lengths = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), (F.char_length(t["role"]) + around).alias("head"), (F.char_length(t["text"]) + len(TAIL)).alias("body")))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, t: F.struct(
        (acc["at"] + t["head"] + t["body"]).alias("at"),
        F.when(t["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["head"]).alias("start"), (acc["at"] + t["head"] + t["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return F.aggregate(lengths, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """prompt, completions and masks of rows (pairing, chosen_id, chosen, rejected_id, rejected).

    If one conversation is a prefix of the other, or both are the same, the shorter completion is
    empty and has no spans; ``distinct_pair`` says whether the two differ at all.
    """
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    out = pairs.withColumn("n_prompt_turns", common_prefix(F.col("chosen"), F.col("rejected")))
    out = out.withColumn("chosen_rest", rest("chosen")).withColumn("rejected_rest", rest("rejected"))
    return out.select(
        "pairing", "chosen_id", "rejected_id", "n_prompt_turns", render(F.slice(F.col("chosen"), F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        render(F.col("chosen_rest")).alias("chosen_completion"), trained_spans(F.col("chosen_rest")).alias("chosen_mask"),
        render(F.col("rejected_rest")).alias("rejected_completion"), trained_spans(F.col("rejected_rest")).alias("rejected_mask"),
        ((F.size("chosen_rest") + F.size("rejected_rest")) > 0).alias("distinct_pair"),
    )


def pairs_by_first_turn(turns: DataFrame) -> DataFrame:
    """Pairs of conversations that begin with the same turn: the one with the most trained turns, then the
    smallest conv_id, null last, is chosen, and every other is rejected against it. n conversations make n - 1 pairs.

    Conversations whose first turns are null or empty count as begun alike. An empty table gives no
    pairs, repeated rows are turns of their own, other columns are ignored, whatever their names.
    """
    convs = conversations(turns.select("conv_id", "turn", "role", "text"))
    trained = F.size(F.filter("turns", lambda t: t["role"] == TRAINED_ROLE))
    convs = convs.select("conv_id", "turns", trained.alias("n_trained"), F.struct(F.col("turns")[0]["role"], F.col("turns")[0]["text"]).alias("opening"))
    # The chosen one of each opening is found with partial aggregates; a hot opening sends one row per task.
    best = convs.groupBy("opening").agg(F.max_by(F.struct("conv_id", "turns"), F.struct(F.col("n_trained"), F.col("conv_id").isNotNull(), -F.col("conv_id"))).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = convs.join(best.select("opening", F.col("best.conv_id").alias("chosen_id"), F.col("best.turns").alias("chosen")), "opening")
    return met.where(~F.col("conv_id").eqNullSafe(F.col("chosen_id"))).select("chosen_id", "chosen", F.col("conv_id").alias("rejected_id"), F.col("turns").alias("rejected"))


def pairs_by_swap(turns: DataFrame) -> DataFrame:
    """Each conversation is chosen over itself with another's answer: its last trained turn gets the text of
    the last trained turn of conversation conv_id + 1, and what follows is left out.

    Without such a conversation, the turn is left out too. Conversations without a trained turn make no pair.
    """
    convs = conversations(turns.select("conv_id", "turn", "role", "text"))
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), TRAINED_ROLE) + 1
    convs = convs.where(F.exists("turns", lambda t: t["role"] == TRAINED_ROLE)).withColumn("last", last.cast("int"))
    answer = convs.select((F.col("conv_id") - 1).alias("conv_id"), F.element_at("turns", F.col("last"))["text"].alias("answer"))
    own = F.element_at("turns", F.col("last"))
    swapped = F.array(F.struct(own["turn"].alias("turn"), own["role"].alias("role"), F.col("answer").alias("text")))
    head = F.slice("turns", F.lit(1), F.col("last") - 1)
    rejected = F.when(F.col("answer").isNull(), head).otherwise(F.concat(head, swapped))
    return convs.join(answer, "conv_id", "left").select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"), F.col("conv_id").alias("rejected_id"), rejected.alias("rejected"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Formatted pairs of both kinds; ``pairing`` is ``opening`` or ``swap``.

    Long texts are rendered whole. An empty table gives an empty result; other columns are ignored.
    """
    opening = pairs_by_first_turn(turns).withColumn("pairing", F.lit("opening"))
    return format_pairs(opening.unionByName(pairs_by_swap(turns).withColumn("pairing", F.lit("swap"))))
