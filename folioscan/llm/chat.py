"""Multi-party perspective rotation of dialogues.

Every participant of a conversation gets a rendering in which that speaker is
the assistant and all others are named users; the training mask covers what
the assistant says. A rendering is made of segments, a row for each turn, with
code-point offsets: the segments of a perspective in order, joined, are its
text. No conversation is gathered into one value unless ``assemble`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of one conversation that are summed apart before the sums are summed.
TURN_BLOCK = 256


def _neutral(text: Column) -> Column:
    """Content can't end a turn or open one."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<|im_start |>")), F.lit(END), F.lit("<|im_end |>"))


def _name(speaker: Column) -> Column:
    """A speaker's name without what would break a turn's head: other names stay other names."""
    for sign in "%\t\n\r <>|":
        speaker = F.replace(speaker, F.lit(sign), F.lit(f"%{ord(sign):02X}"))
    return speaker


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = ("system",)) -> DataFrame:
    """Renders every conversation once for each of its participants.

    Returns conv, perspective, turn, position (0 for the first turn of the
    conversation), speaker, segment, start, end (the segment's place in the
    perspective's text), content_start, content_end, masked.

    A conversation gives turns times participants rows, as every participant
    gets all turns. Blanks and the signs ``%<>|`` in a name are written as % and
    two digits, so names that differ stay different.

    ``masked`` marks the segments to learn from: from content_start to end,
    which holds the content and its end mark; all else is context. Speakers in
    ``narrators`` take no perspective and appear as themselves.

    A null text is empty, a null speaker is the participant ``unknown``, a
    null conversation id is a conversation of its own and null turns come
    first. Turns with equal numbers are ordered by speaker and text; repeated
    rows are kept. Marks inside a text are defused. Other columns are not
    read. A conversation of narrators alone and an empty table give no rows.
    """
    t = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    speakers = t.where(~F.col("speaker").isin(list(narrators))).select("conv", F.col("speaker").alias("perspective")).distinct()
    both = t.join(speakers, t["conv"].eqNullSafe(speakers["conv"])).drop(speakers["conv"])
    is_own = F.col("speaker") == F.col("perspective")
    name = _name(F.col("speaker"))
    role = F.when(is_own, F.lit("assistant")).when(F.col("speaker").isin(list(narrators)), name).otherwise(F.concat(F.lit("user name="), name))
    cut = (
        both.withColumn("head", F.concat(F.lit(START), role, F.lit("\n")))
        .withColumn("segment", F.concat("head", _neutral(F.col("text")), F.lit(END + "\n")))
        .withColumn("size", F.length("segment").cast("long"))
        .withColumn("head_size", F.length("head").cast("long"))
    )
    by_block = ["conv", "perspective", "block"]
    within = Window.partitionBy(*by_block).orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    local = cut.withColumn("position", F.row_number().over(within).cast("long") - 1).withColumn("start", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    blocks = cut.groupBy(*by_block).agg(F.sum("size").alias("block_size"), F.count(F.lit(1)).alias("block_turns"))
    earlier = Window.partitionBy("conv", "perspective").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in by_block], F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("size_before"), F.coalesce(F.sum("block_turns").over(earlier), F.lit(0)).alias("turns_before"))
    placed = local.join(blocks, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in by_block])
    start = F.col("start") + F.col("size_before")
    return placed.select(
        F.col("conv").alias(conv_col),
        "perspective",
        F.col("turn").alias(turn_col),
        (F.col("position") + F.col("turns_before")).alias("position"),
        "speaker",
        "segment",
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        (start + F.col("head_size")).alias("content_start"),
        (start + F.col("size") - 1).alias("content_end"),
        is_own.alias("masked"),
    )


def assemble(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """A row for each conversation and perspective: its text and the spans to learn from.

    Gathers whole conversations, so it is for those that fit in a row.
    """
    order = F.sort_array(F.collect_list(F.struct("position", "segment", "content_start", "content_end", "masked")))
    rows = segments.groupBy(conv_col, "perspective").agg(order.alias("all"))
    spans = F.transform(F.filter("all", lambda s: s["masked"]), lambda s: F.struct(s["content_start"].alias("start"), s["content_end"].alias("end")))
    return rows.select(conv_col, "perspective", F.array_join(F.transform("all", lambda s: s["segment"]), "").alias("text"), spans.alias("mask_spans"))
