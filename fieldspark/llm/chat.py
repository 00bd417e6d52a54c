"""Multi-party perspective rotation of dialogues.

For every participant the whole dialogue is rendered with that participant's turns as
the assistant's (the targets of the mask) and everyone else's as a named user's.  Roles
in ``context_roles`` are nobody's seat: their turns read as context in every rendering.

Turns are ordered and rendered in blocks of ``block`` consecutive turn numbers, which
are put together at the end, so a long dialogue is the work of many tasks until its
rendering becomes one row.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatParams:
    """``block`` is the number of turn numbers rendered together; it does not change the result."""

    context_roles: tuple[str, ...] = ("system",)
    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    block: int = 64


SPANS = "array<struct<start:long,length:long>>"


def rotate_perspectives(turns: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to one row per conversation and participant.

    Columns: conv_id, speaker, rendered, n_turns, n_target_turns, n_chars, target_chars and ``spans``, the (start, length)
    of each target text in ``rendered``, in characters.  Turns go by number; ties by role, then text.  Rows that repeat
    conversation, turn, role and text are said once.  A null text is an empty turn, a null role is the participant
    "unknown", a null turn comes first, and null conversation ids are one conversation.  A conversation of context roles
    alone has no participant and gives no row.  Extra columns are ignored.  A rendering is one row however long the
    dialogue is, so it has to fit into one (2 GB).
    """
    p = params or ChatParams()
    said = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    context = F.col("role").isin(*p.context_roles)
    seats = said.where(~context).select("conv_id", F.col("role").alias("speaker")).distinct()
    seen = said.alias("t").join(seats.alias("s"), F.col("t.conv_id").eqNullSafe(F.col("s.conv_id"))).select("t.*", "speaker")
    target = F.col("role") == F.col("speaker")
    head = F.concat(F.lit(p.begin), F.when(target, F.lit("assistant")).when(context, F.col("role")).otherwise(F.concat(F.lit("user name="), F.col("role"))), F.lit("\n"))
    seen = seen.select("conv_id", "speaker", F.floor(F.col("turn") / p.block).alias("block"), F.struct("turn", "role", "text", target.alias("target"), head.alias("head")).alias("e"))
    blocks = seen.groupBy("conv_id", "speaker", "block").agg(F.sort_array(F.collect_list("e")).alias("es"))
    pieces = F.array_join(F.transform("es", lambda e: F.concat(e["head"], e["text"], F.lit(p.end))), "")
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def place(acc, e):
        begin, size = acc["at"] + F.length(e["head"]), F.length(e["text"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + len(p.end)).alias("at"), F.when(e["target"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    made = blocks.select("conv_id", "speaker", F.struct("block", pieces.alias("text"), F.size("es").cast("long").alias("n"), F.aggregate("es", empty, place).alias("laid")).alias("b"))
    whole = made.groupBy("conv_id", "speaker").agg(F.sort_array(F.collect_list("b")).alias("bs"))

    def shift(acc, b):
        moved = F.transform(b["laid"]["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].alias("length")))
        return F.struct((acc["at"] + b["laid"]["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    total = F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["n"])
    laid = whole.select("conv_id", "speaker", F.array_join(F.col("bs.text"), "").alias("rendered"), total.alias("n_turns"), F.aggregate("bs", empty, shift).alias("laid"))
    spans = F.col("laid.spans")
    return laid.select(
        "conv_id", "speaker", "rendered", "n_turns", F.size(spans).cast("long").alias("n_target_turns"), F.col("laid.at").alias("n_chars"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("target_chars"), spans.alias("spans"),
    )
