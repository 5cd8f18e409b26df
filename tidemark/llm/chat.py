"""Preference formatting of conversations.

A pair is a chosen and a rejected conversation, arrays of (role, text) turns. Their longest
common prefix of turns is rendered once, as the prompt. What follows on each side is its
completion, and a mask marks the spans of it that a model is trained on: the texts of
assistant turns, with their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), _text(turn["role"]), F.lit("|>\n"))


def render(turns: Column) -> Column:
    """All turns as one string."""
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), _text(t["text"]), F.lit("<|end|>\n"))), "")


def mask(turns: Column, trained: str = TRAINED) -> Column:
    """[start, end) code points of render(turns) that are trained on: texts and end marks."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(head(t))
        end = begin + F.length(_text(t["text"])) + F.lit(len("<|end|>"))
        spans = F.when(_text(t["role"]) == trained, F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(state["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text in order of turn) from rows conv_id, turn, role, text.

    Nulls order first; turns at a tie are ordered by role and text; repeated rows are repeated
    turns; rows with a null conv_id are one conversation.
    """
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.transform(rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_preferences(pairs: DataFrame, trained: str = TRAINED) -> DataFrame:
    """pairs (chosen, rejected and any other columns) with n_shared, prompt, chosen_text,
    rejected_text, chosen_mask and rejected_mask added; columns of these names are replaced.

    Turns are equal if role and text are (null equals null). A null conversation is empty. A
    null role or text renders as empty. If one conversation is a prefix of the other, its
    completion is empty with an empty mask; equal conversations have two empty ones. Nothing is
    shuffled. Conversations of any length are rendered whole; an empty table gives an empty one.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    df = pairs.withColumns({"chosen": F.coalesce("chosen", empty), "rejected": F.coalesce("rejected", empty)})
    same = F.zip_with("chosen", "rejected", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    df = df.withColumn("__differ", F.array_position(same, F.lit(False)))
    df = df.withColumn("n_shared", F.when(F.col("__differ") > 0, F.col("__differ") - 1).otherwise(F.size("chosen")).cast("long"))
    rest = lambda c: F.slice(c, F.col("n_shared").cast("int") + 1, F.size(c))
    df = df.withColumn("prompt", render(F.slice("chosen", F.lit(1), F.col("n_shared").cast("int"))))
    for side in ("chosen", "rejected"):
        df = df.withColumns({f"{side}_text": render(rest(side)), f"{side}_mask": mask(rest(side), trained)})
    return df.drop("__differ")


def with_truncated_answer(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Pairs from single conversations: chosen as it is, rejected with its last trained turn cut to
    the first half of its code points."""
    df = conversations.withColumn("__last", F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == trained, i))))
    cut = lambda t, i: F.when(i == F.col("__last"), F.struct(t["role"].alias("role"), F.substring(_text(t["text"]), F.lit(1), F.floor(F.length(_text(t["text"])) / 2).cast("int")).alias("text"))).otherwise(t)
    return df.withColumn("rejected", F.transform("turns", cut)).withColumnRenamed("turns", "chosen").drop("__last")
