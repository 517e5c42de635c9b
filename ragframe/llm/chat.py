"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and the others as named users; the training mask holds
the character spans of that speaker's own turns.

A rendering is one row, so a conversation without bound would be one task's
array. Turns are therefore dealt into segments of ``segment_turns`` turn
numbers, and a segment into parts of as many rows (turn numbers may repeat); a
part is a row of its own and nothing is left out. Participants are those of the
whole conversation, found by a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM_ROLES = ("system",)
NO_NAME = "unknown"
SEGMENT_TURNS = 1024


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text",
                        segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per (conversation, participant, segment, part): conv_id, assistant,
    segment, part, n_turns, n_masked, rendered, mask_start and mask_end.

    Spans count characters of ``rendered`` from 0, end exclusive, and cover the
    text and end mark of each turn of the speaker. A system turn is context
    in all perspectives, is never masked in, and does not make a participant; a
    conversation of system turns alone gives no row. A null or blank
    role is the participant "unknown"; a null text is empty; a null turn number
    sorts first, in segment 0; turns of one number sort by role, then text, and
    repeated rows stay. Rows without a conversation id form one conversation
    with a null id, which the segments bound like any other by turn number."""
    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.nullif(F.trim(F.col(role_col).cast("string")), F.lit("")), F.lit(NO_NAME)).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(0)).cast("long"))
    people = (t.where(~F.col("role").isin(*SYSTEM_ROLES)).groupBy("conv_id", "role").agg(F.lit(1).alias("one"))
              .select(F.col("conv_id").alias("of"), F.col("role").alias("assistant")))
    order = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text")
    t = t.withColumn("part", F.floor((F.row_number().over(order) - 1) / segment_turns).cast("long"))
    segments = (t.groupBy("conv_id", "segment", "part")
                .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2 ** 63))).alias("turn"),
                                                          "role", "text"))).alias("turns")))
    views = segments.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    heads = F.transform("turns", lambda x: _head(x["role"], F.col("assistant")))
    tails = F.transform("turns", lambda x: F.concat(x["text"], F.lit("<|end|>\n")))
    views = views.withColumn("heads", heads).withColumn("tails", tails).withColumn(
        # running length after each turn: the offsets of the spans
        "ends", F.aggregate(F.arrays_zip("heads", "tails"), F.array(F.lit(0).cast("long")),
                            lambda acc, x: F.concat(acc, F.array(
                                F.element_at(acc, -1) + F.length(x["heads"]) + F.length(x["tails"])))))
    views = views.withColumn("own", F.filter(F.arrays_zip(
        F.transform("turns", lambda x: x["role"]).alias("role"), F.slice("ends", 2, F.size("tails")).alias("end"), "tails"),
        lambda x: x["role"] == F.col("assistant")))
    return views.select(
        "conv_id", "assistant", "segment", "part", F.size("turns").cast("long").alias("n_turns"),
        F.size("own").cast("long").alias("n_masked"),
        F.array_join(F.zip_with("heads", "tails", lambda a, b: F.concat(a, b)), "").alias("rendered"),
        # the line feed after the end mark is outside the span
        F.transform("own", lambda x: x["end"] - F.length(x["tails"])).alias("mask_start"),
        F.transform("own", lambda x: x["end"] - 1).alias("mask_end"))


def _head(role: Column, assistant: Column) -> Column:
    return (F.when(role == assistant, F.lit("<|assistant|>\n"))
            .when(role.isin(*SYSTEM_ROLES), F.concat(F.lit("<|"), role, F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user name="), role, F.lit("|>\n"))))
