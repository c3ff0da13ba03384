"""Chat formatting by rotation of perspective, with DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once with that speaker as
the assistant and the others as users under their names. The mask tells which characters
are learned from: the assistant's words and the end marker after them.

A participant is a ``role``; a null role is the participant ``unknown``. A dialogue is rendered whole. Its rendering is
one row up to ``PART_TURNS`` turn numbers; a longer one is stored in consecutive pieces, so that no row or group grows with the
longest conversation: ``start`` says where a piece begins in the rendering, masks count from the rendering's beginning, and the
pieces in order of ``part`` (null first) join to the whole text. Turns are ordered by number (null first), then role, then text.
A null text is empty. Repeated rows are rendered as often as they
occur. A null ``conv_id`` is a conversation of its own. Markers that stand in a text stay; offsets, not
markers, make the mask. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TURNS = 4096
START, END = "<|im_start|>", "<|im_end|>\n"


def _header(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), role, F.lit("\n")))


def rotate_perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, speaker, start, n_turns, n_own, text, mask`` for each participant and piece of a conversation.

    ``mask`` is an array of structs ``first, last``: characters of the whole rendering, past-the-end.
    """
    turns = conversations.select(
        F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / part_turns).cast("long").alias("part")).alias("k"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("m"),
    )
    # Lengths and participants are added up before the shuffle; texts are shuffled once.
    role, speaker = F.col("role"), F.col("speaker")
    sums = turns.groupBy("k", F.col("m.role").alias("role")).agg(F.count("*").alias("n"), F.sum(F.length("m.text")).alias("chars"))
    people = sums.groupBy(F.col("k.conv_id").alias("c")).agg(F.array_sort(F.collect_set("role")).alias("people"))
    each = sums.join(people, F.col("k.conv_id").eqNullSafe(F.col("c"))).select("k", "role", "n", "chars", F.explode("people").alias("speaker"))
    sizes = each.groupBy("k", "speaker").agg(F.sum(F.col("n") * (F.length(_header(role, speaker)) + len(END)) + F.col("chars")).alias("size"))
    before = W.partitionBy("k.conv_id", "speaker").orderBy(F.col("k.part").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("k", "speaker", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start"))
    starts = starts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("speaker", "start"))).alias("starts"))
    parts = turns.groupBy("k").agg(F.array_sort(F.collect_list("m")).alias("turns"))
    seen = parts.join(starts, "k").select(F.col("k.conv_id").alias("conv_id"), F.col("k.part").alias("part"), "turns", F.inline("starts"))
    start = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"))

    def add(acc: Column, m: Column) -> Column:
        first = acc["at"] + F.length(_header(m["role"], speaker))
        last = first + F.length(m["text"]) + len(END)
        span = F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"))
        return F.struct(last.cast("long").alias("at"), F.when(m["role"] == speaker, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return seen.select(
        "conv_id", "part", "speaker", "start",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda m: m["role"] == speaker)).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda m: F.concat(_header(m["role"], speaker), m["text"], F.lit(END))), "").alias("text"),
        F.aggregate("turns", start, add)["spans"].alias("mask"),
    )
