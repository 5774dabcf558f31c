"""Chat formatting by rotating the perspective.

For every participant of a conversation the whole dialogue is rendered once with that
participant as the assistant, all others as named users and system turns as they are.  The mask
lists the ranges of characters that are trained on: what the assistant says and the mark that
ends it.

A conversation is rendered in parts of `part_turns` turn numbers, so that a very long one
never has to fit one value: joined in the order of `part`, the texts of a perspective are the
whole rendering, and masks count from the start of their part.  Participants are found by a
sum over the conversation and joined, so every part has all perspectives.

Turns are in the order of turn, role and text; null turns come last, in a part of their own
(-1).  A null text is empty.  A null or empty role is a user without a name and is never
the assistant; a conversation of such and system turns alone has no perspective and no rows.  A
null conv_id is a conversation.  Repeated rows are rendered as often as they come.  Marks
inside a text are broken up (`<|` becomes `< |`), so a text cannot pose as a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 512
SYSTEM = "system"
END = "<|end|>\n"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _head(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .when(F.coalesce(role, F.lit("")) == "", F.lit("<|user|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), _safe(role), F.lit("|>\n")))
    )


def rotate(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """conv_id, perspective, part, n_turns, rendered, mask (array of start and end)."""
    if part_turns < 1:
        raise ValueError(f"part_turns must be positive, not {part_turns}")
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(role).alias("role"),
        F.coalesce(F.floor(F.col(turn) / part_turns), F.lit(-1)).cast("long").alias("part"),
        F.struct(
            F.col(turn).alias("turn"), F.col(role).alias("role"), _safe(F.coalesce(F.col(text), F.lit(""))).alias("text")
        ).alias("said"),
    )
    people = (
        rows.filter((F.col("role") != SYSTEM) & (F.col("role") != "")).groupBy("conv_id", "role").agg(F.count("*"))
        .select(F.col("conv_id").alias("c"), F.col("role").alias("perspective"))
    )
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("said")).alias("said"))
    both = parts.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    speaker = F.col("perspective")
    both = both.withColumn("pieces", F.transform("said", lambda s: F.struct(
        F.concat(_head(s["role"], speaker), s["text"], F.lit(END)).alias("text"),
        F.length(_head(s["role"], speaker)).alias("head"),
        F.coalesce((s["role"] == speaker) & (s["role"] != SYSTEM), F.lit(False)).alias("own"),
    )))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece["text"])
        span = F.array(F.struct((state["at"] + piece["head"]).alias("start"), end.alias("end")))
        return F.struct(
            end.alias("at"), F.when(piece["own"], F.concat(state["mask"], span)).otherwise(state["mask"]).alias("mask")
        )

    return both.select(
        "conv_id", "perspective", "part", F.size("said").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("rendered"),
        F.aggregate("pieces", empty, step)["mask"].alias("mask"),
    )
