"""Chat formatting with Spark expressions only.

Template: ``<turn ROLE>\\n`` text ``</turn>\\n``; texts of adjacent turns of one role share a turn
with ``<next>`` between them. In texts and roles a backslash becomes ``\\b`` and the first
character of a control string ``\\l`` (in roles also ``>`` becomes ``\\g``), so that control
strings occur only where the template puts them and all texts can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, END = "<turn ", "</turn>\n", "<next>", ">\n"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    text = _swap(text, "\\", "\\b")
    for mark in ("<turn", "</turn", "<next"):
        text = _swap(text, mark, "\\l" + mark[1:])
    return text


def escape_role(role: Column) -> Column:
    return _swap(escape(role), ">", "\\g")


def unescape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\g", ">"), "\\l", "<"), "\\b", "\\")


def format_chats(turns: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (text, loss) that join to it.

    ``turns`` is (conv_id, turn, role, text), a row a turn. Turns sort by (turn, role, text),
    nulls first; repeated rows are separate turns; null roles and texts are empty; rows without
    a conv_id are one conversation. Loss is on the texts of ``learn_role`` only, not on any
    control string. A conversation is one row of the result, so its text must fit a cell.
    """
    first = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", first.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Where a role begins: the turn differs from the one before it.
    begun = sorted_turns.withColumn(
        "starts",
        F.expr("filter(sequence(1, size(turns)), i -> i = 1 or turns[i - 1].role <> turns[i - 2].role)"),
    )
    merged = begun.select(
        "conv_id",
        F.expr(
            "transform(starts, (s, j) -> struct(turns[s - 1].role as role, transform(slice(turns, s,"
            " coalesce(get(starts, j + 1), size(turns) + 1) - s), t -> t.text) as texts))"
        ).alias("merged"),
    )

    def pieces(turn: Column) -> Column:
        learn = turn["role"] == learn_role
        plain = F.lit(False)
        texts = F.flatten(F.transform(turn["texts"], lambda t, i: F.filter(F.array(
            F.struct(F.when(i > 0, F.lit(NEXT)).alias("text"), plain.alias("loss")),
            F.struct(escape(t).alias("text"), learn.alias("loss")),
        ), lambda x: x["text"].isNotNull())))
        head = F.array(F.struct(F.concat(F.lit(OPEN), escape_role(turn["role"]), F.lit(END)).alias("text"), plain.alias("loss")))
        return F.concat(head, texts, F.array(F.struct(F.lit(CLOSE).alias("text"), plain.alias("loss"))))

    segments = merged.select("conv_id", F.flatten(F.transform("merged", pieces)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, an array, unescaped."""
    blocks = F.filter(F.split(formatted, "\\Q" + CLOSE + "\\E"), lambda b: b != "")

    def turns(block: Column) -> Column:
        at = F.instr(block, END)
        role = unescape(F.substr(block, F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        texts = F.split(F.substr(block, at + len(END)), "\\Q" + NEXT + "\\E")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its formatted text and mask."""
    read = formatted.select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
