"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; masks cover what the
assistant says.  DataFrame functions only.

A dialogue of up to WHOLE characters is one row for each participant.  A longer
one comes in parts of TURNS turn numbers, so it is dealt out over tasks; places in
a part count from the dialogue's start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a dialogue that is rendered in one piece, and turn numbers of a part
#: of a longer one.
WHOLE, TURNS = 1 << 20, 64
#: Characters that a message counts besides its text.
MESSAGE = 32
START, END = "<|im_start|>", "<|im_end|>"


def rotated(conversations: DataFrame, whole: int = WHOLE, turns: int = TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_messages, n_masked, rendered, mask,
    mask_text) of ``conversations`` (conv_id, turn, role, text).

    Participants are the roles of a conversation but ``system`` and null.
    Messages go by turn, then role, then text, nulls first; rows that are equal
    in all four are as many messages.  Null text is empty, a speaker without a role
    is the user ``unknown``; marks of the format within a text are broken up by a
    blank.  ``mask``: code-point spans (start, end) of the assistant's texts with
    their end marks, counted from the start of the dialogue; ``mask_text`` the same as
    start-end,...  ``part`` is 0 for a dialogue that fits ``whole`` characters of text;
    the parts of a longer one, in order, are the whole dialogue.  A conversation
    without participants gives no row, a null conv_id is a conversation of its own,
    a null turn counts as 0 for its part.
    """
    said = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sizes = said.groupBy("conv_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + MESSAGE).alias("_size")).where(F.col("_size") > whole)
    long = sizes.select(F.col("conv_id").alias("_long"), F.lit(True).alias("_is_long"))
    part = F.when(F.col("_is_long"), F.floor(F.coalesce("turn", F.lit(0)) / turns)).otherwise(F.lit(0)).cast("long")
    parts = said.join(long, F.col("conv_id").eqNullSafe(F.col("_long")), "left").groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"), F.coalesce(F.first("_is_long"), F.lit(False)).alias("_cut"))
    speakers = said.where("role is not null and role <> 'system'").select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    def shaped(m):
        mine = F.coalesce(m["role"] == F.col("perspective"), F.lit(False))
        head = F.when(mine, "assistant").when(m["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), F.coalesce(m["role"], F.lit("unknown"))))
        head = F.concat(F.lit(START), head, F.lit("\n"))
        body = F.concat(F.replace(F.coalesce(m["text"], F.lit("")), F.lit("<|im_"), F.lit("<| im_")), F.lit(END))
        return F.struct(mine.alias("mine"), F.concat(head, body, F.lit("\n")).alias("text"), F.length(head).alias("head"), F.length(body).alias("body"))

    both = both.select("conv_id", "perspective", "part", "_cut", F.transform("said", shaped).alias("said"))
    length = F.aggregate("said", F.lit(0).cast("long"), lambda a, m: a + m["head"] + m["body"] + 1)
    # Only dialogues in parts need to know what comes before a part.
    ahead = both.where("_cut").select(F.col("conv_id").alias("_conv"), F.col("perspective").alias("_who"), F.col("part").alias("_part"), length.alias("_chars"))
    ahead = ahead.withColumn("_at", F.coalesce(F.sum("_chars").over(W.partitionBy("_conv", "_who").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    cut = both.where("_cut").join(ahead, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("perspective") == F.col("_who")) & (F.col("part") == F.col("_part")))
    kept = ["conv_id", "perspective", "part", "said", "_at"]
    both = both.where("not _cut").withColumn("_at", F.lit(0).cast("long")).select(kept).union(cut.select(kept))
    zero = F.struct(F.col("_at").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a, m):
        start = a["at"] + m["head"]
        span = F.array(F.struct(start.alias("start"), (start + m["body"]).alias("end")))
        return F.struct((start + m["body"] + 1).alias("at"), F.when(m["mine"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    mask = F.aggregate("said", zero, step, lambda a: a["spans"])
    both = both.select("conv_id", "perspective", "part", F.size("said").cast("long").alias("n_messages"), F.array_join(F.transform("said", lambda m: m["text"]), "").alias("rendered"), mask.alias("mask"))
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    text = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return both.select("conv_id", "perspective", "part", "n_messages", masked.alias("n_masked"), "rendered", "mask", text.alias("mask_text"))


def assembled(parts: DataFrame) -> DataFrame:
    """(conv_id, perspective, n_messages, n_masked, rendered, mask) of the rows of
    ``rotated``: one for each conversation and perspective, its parts in order.  A
    dialogue must fit a row."""
    whole = parts.groupBy("conv_id", "perspective").agg(F.sum("n_messages").alias("n_messages"), F.sum("n_masked").alias("n_masked"), F.sort_array(F.collect_list(F.struct("part", "rendered", "mask"))).alias("parts"))
    return whole.select("conv_id", "perspective", "n_messages", "n_masked", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("rendered"), F.flatten(F.transform("parts", lambda p: p["mask"])).alias("mask"))
