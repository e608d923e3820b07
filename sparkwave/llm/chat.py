"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as `assistant`, all
other participants as `user` with their name, and system turns as `system`; the mask marks the assistant's content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENT_TURNS = 64
BLOCK_SEGMENTS = 4096


def _head(role, perspective):
    """What stands before a turn."""
    return F.when(role == perspective, "<|assistant|>\n").when(role == "system", "<|system|>\n").otherwise(F.concat(F.lit("<|user "), role, F.lit("|>\n")))


def _starts(turns: DataFrame, people: DataFrame) -> DataFrame:
    """conv_id, segment, perspective, start: code points of the rendering before each segment.

    Sums over narrow rows (no text) in two levels, blocks of segments and segments in a block, so that no task gets all
    segments of a long conversation.
    """
    sizes = turns.groupBy("conv_id", "segment", "role").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    size = F.col("chars") + F.col("n") * (1 + F.length(_head(F.col("role"), F.col("perspective"))))
    sizes = sizes.join(people, "conv_id").groupBy("conv_id", "perspective", "segment").agg(F.sum(size).alias("size"))
    sizes = sizes.withColumn("block", F.floor(F.col("segment") / BLOCK_SEGMENTS))
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keys = ["conv_id", "perspective"]
    blocks = sizes.groupBy(*keys, "block").agg(F.sum("size").alias("size"))
    blocks = blocks.select(*keys, "block", F.coalesce(F.sum("size").over(before(keys, "block")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(before([*keys, "block"], "segment")), F.lit(0))
    return sizes.withColumn("inside", inside).join(blocks, [*keys, "block"]).select(*keys, "segment", (F.col("base") + F.col("inside")).alias("start"))


def rotate(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """conv_id, perspective, segment, part, n_turns, n_masked, start, text, mask (list of [start, end) in code points).

    Each turn is `<|role name|>\\n` + content + `\\n`; the name is left out for assistant and system.  One row
    holds the turns of one stretch of `segment_turns` turn numbers (and at most that many rows: more rows of the
    same stretch go to further parts), so a conversation of any length is dealt over many rows and tasks;
    concatenating segments and parts gives the whole dialogue.  `start` and `mask` count from the beginning of the whole
    dialogue, so they are the same however it is cut.  Every participant but `system` gets a rendering.

    Null text counts as empty; a null role is the participant `unknown`; a null turn comes first, in segment -1;
    rows of the same turn keep role, then text order; repeated rows are kept.  A turn without conv_id is a dialogue of its
    own.  A conversation with system turns only has no rendering.  An empty table gives an empty result; extra columns are
    ignored.  Rows of one conversation with one turn number (or none) are put in order by one task.
    """
    turns = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce(F.floor(F.col("turn") / segment_turns), F.lit(-1)).alias("segment"),
    )
    alone = turns.where("conv_id is null and role <> 'system'").select(
        "conv_id", F.col("role").alias("perspective"), "segment", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("start"),
        F.array(F.struct(F.lit(0).alias("rn"), "role", "content")).alias("turns"))
    turns = turns.where("conv_id is not null")
    people = turns.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    inside = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "content")
    placed = turns.withColumn("rn", F.row_number().over(inside) - 1).withColumn("part", F.floor(F.col("rn") / segment_turns))
    stretches = placed.groupBy("conv_id", "segment", "part").agg(
        F.array_sort(F.collect_list(F.struct("rn", "role", "content"))).alias("turns")
    )
    # joined by (conv_id, segment), the key by which the texts are dealt already: the texts are shuffled once
    views = stretches.join(_starts(turns, people), ["conv_id", "segment"]).select("conv_id", "perspective", "segment", "part", "start", "turns")
    shown = F.transform("turns", lambda t: F.struct(
        F.concat(_head(t["role"], F.col("perspective")), t["content"], F.lit("\n")).alias("text"), F.length(_head(t["role"], F.col("perspective"))).alias("head"),
        F.length(t["content"]).alias("size"), (t["role"] == F.col("perspective")).alias("own")))
    views = views.select("conv_id", "perspective", "segment", "part", "start", shown.alias("shown"))
    # parts of a segment follow each other; they are in one task already
    size = F.aggregate("shown", F.lit(0).cast("long"), lambda acc, t: acc + t["head"] + t["size"] + 1)
    earlier = Window.partitionBy("conv_id", "segment", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    views = views.withColumn("start", F.col("start") + F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    views = views.unionByName(alone.select("conv_id", "perspective", "segment", "part", "start", shown.alias("shown")))
    # at - the code points rendered so far; one step per turn
    first = F.struct(F.col("start").alias("at"), F.array().cast("array<array<long>>").alias("spans"))
    walked = F.aggregate("shown", first, lambda acc, t: F.struct(
        (acc["at"] + t["head"] + t["size"] + 1).alias("at"),
        F.when(t["own"], F.concat(acc["spans"], F.array(F.array(acc["at"] + t["head"], acc["at"] + t["head"] + t["size"])))).otherwise(acc["spans"]).alias("spans")))
    return views.select(
        "conv_id", "perspective", "segment", "part", F.size("shown").cast("long").alias("n_turns"), "start",
        F.array_join("shown.text", "").alias("text"), walked["spans"].alias("mask"),
    ).withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0]))
