"""Conversations: appending answered questions and clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# New turns of one conversation numbered in one group at most.
RANGE = 65536


def append_answers(history: DataFrame, answers: DataFrame, width: int = RANGE) -> DataFrame:
    """history plus a user and an assistant turn per answered question.

    answers: conv_id, ask_no (a whole number that orders the questions of a conversation,
    not repeated in it), query, response.  Turns go on from the last turn of the
    conversation, or from 0.
    """
    last = history.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    placed = _numbered(answers, width).join(last, "conv_id", "left")
    first = F.coalesce(F.col("_last") + 1, F.lit(0).cast("long")) + 2 * F.col("_n")
    pair = F.array(
        F.struct(first.alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text")),
        F.struct((first + 1).alias("turn"), F.lit("assistant").alias("role"),
                 F.col("response").alias("text")),
    )
    turns = placed.select("conv_id", F.inline(pair))
    return history.select("conv_id", "turn", "role", "text").unionByName(turns)


def _numbered(answers: DataFrame, width: int) -> DataFrame:
    """The place of a question in its conversation, from 0 (column _n).

    Questions are counted per range of ask_no, the counts are added up, and only inside
    a range are rows put in order: a conversation that holds most of the rows is spread
    over many groups.
    """
    ranged = answers.withColumn("_range", F.floor(F.col("ask_no") / F.lit(width)))
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy("conv_id", "_range").agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select("conv_id", "_range", "_offset")
    )
    inside = Window.partitionBy("conv_id", "_range").orderBy("ask_no")
    return (
        ranged.withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, ["conv_id", "_range"])
        .withColumn("_n", F.col("_offset") + F.col("_place"))
        .drop("_range", "_place", "_offset")
    )


def clear(history: DataFrame, conversations: DataFrame) -> DataFrame:
    """history without the conversations named in the second table."""
    return history.join(conversations.select("conv_id").distinct(), "conv_id", "left_anti")
