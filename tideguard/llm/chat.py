"""Chat formatting by perspective rotation: every participant in turn is the assistant.

For each conversation and each of its speakers, the whole dialogue is rendered with that
speaker's turns as the assistant, all others as named users, and the assistant's words marked
as what is trained on.

A rendered dialogue comes as one row per turn with its place in the dialogue, not as one text:
a conversation of any length is then spread over tasks. `dialogues` joins the rows of dialogues
that fit one row.

Defined cases: a null role is a speaker called `unknown`; a null or empty text renders as an
empty turn; rows with a null conversation number are a conversation of their own. `system` turns
stay system turns in every perspective and nobody takes the system's place, so a conversation of
system turns only has no rows. Turns are ordered by number (null first), then speaker and text;
repeated rows are repeated turns. Only the four columns named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideguard.llm.common import running_totals, text_of

SYSTEM = "system"
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Turn numbers that one window task sorts.
BLOCK_TURNS = 256


def rotate_perspectives(turns: DataFrame) -> DataFrame:
    """`turns(conv_id, turn, role, text)` as segments of one dialogue per perspective.

    Returns conv_id, perspective, seq (from 0), turn, role, name (of users), segment, start and
    end_ (code points in the dialogue, end exclusive), trained, mask_start and mask_end (the
    assistant's words and end mark; null for others).
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"), text_of().alias("text")
    )
    people = said.where(F.col("speaker") != SYSTEM).select(
        F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")
    ).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    name = F.when(F.col("role") == "user", F.col("speaker"))
    head = F.concat(
        F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("\n")
    )
    rows = (
        said.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .drop("_conv")
        .withColumn("role", role)
        .withColumn("name", name)
        .withColumn("_head", head)
        .withColumn("segment", F.concat("_head", "text", F.lit(CLOSE)))
        .withColumn("_long", F.length("segment").cast("long"))
        .withColumn("_block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))
    )
    placed = running_totals(
        rows, ["conv_id", "perspective"], "_block", ["turn", "speaker", "text"],
        {"start": "_long", "seq": F.lit(1).cast("long")},
    )
    trained = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "perspective", "seq", "turn", "role", "name", "segment", "start",
        (F.col("start") + F.col("_long")).alias("end_"),
        trained.alias("trained"),
        F.when(trained, F.col("start") + F.length("_head")).alias("mask_start"),
        F.when(trained, F.col("start") + F.col("_long")).alias("mask_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """One row per conversation and perspective: its text and masks, for dialogues of row size."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "segment", "mask_start", "mask_end")))
    masks = F.filter("parts", lambda p: p["mask_start"].isNotNull())
    return segments.groupBy("conv_id", "perspective").agg(parts.alias("parts")).select(
        "conv_id",
        "perspective",
        F.concat_ws("", F.transform("parts", lambda p: p["segment"])).alias("text"),
        F.transform(masks, lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end_"))).alias("masks"),
    )
