"""Chat formatting with relational operations: collected turns, merged roles, reversible escapes.

The project keeps no conversations of its own, so the operator is general: any table of (conversation, turn, role, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import content

START, END, NEXT, CLOSE = "<|im_start|>", "<|im_end|>", "<|next|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    """One backslash more in every `<|`, `<\\|`, ...: afterwards no text holds `<|`, with which all control strings begin."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role(role: Column) -> Column:
    """A role on one line, without control strings; unescaped in reverse order."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: (conv_id, pieces, formatted).

    Turns are sorted by turn, then role and text; NULL role or text counts as empty, a NULL turn sorts first, NULL ids form one
    conversation, repeated rows are repeated turns, other columns are ignored. Neighbouring turns of one role share a block
    `<|im_start|>role\\n...<|im_end|>\\n`, in which `<|next|>` separates them. `pieces` is the formatted text cut where the loss
    mask changes: array<struct<text, loss>>, with loss over the assistant's texts alone, control strings excluded.

    A conversation is one record of the result, hence its turns meet in one row; no other group is gathered.
    """
    item = F.struct(F.col(turn).alias("turn"), content(role).alias("role"), content(text).alias("text"))
    chats = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("turns"))
    chats = chats.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), escaped(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss"))))
    at, size = F.col("turns"), F.size("turns")
    first = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(at, i)["role"] != F.get(at, F.greatest(i - 1, F.lit(0)))["role"]))
    chats = chats.withColumn("first", first)
    merged = F.transform("first", lambda s, k: F.struct(
        F.get(at, s)["role"].alias("role"), F.slice(at, s + 1, F.coalesce(F.get(F.col("first"), k + 1), size) - s).alias("said")))

    def piece(text: Column | str, loss: Column | bool) -> Column:
        return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def block(b: Column) -> Column:
        said = F.flatten(F.transform(b["said"], lambda t, i: F.array(piece(F.when(i > 0, NEXT).otherwise(""), False), piece(t["text"], t["loss"]))))
        return F.concat(F.array(piece(F.concat(F.lit(START), _role(b["role"]), F.lit("\n")), False)), said, F.array(piece(CLOSE, False)))

    pieces = F.flatten(F.transform(merged, block))
    return chats.select("conv_id", F.filter(pieces, lambda p: p["text"] != "").alias("pieces")) \
        .withColumn("formatted", F.array_join(F.transform("pieces", lambda p: p["text"]), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, recovered from format_conversations' output.

    Returns (conv_id, turns array<struct<role, text>>, loss_text, formatted). Turns come from `formatted` alone.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(head) + F.lit(2), F.length(block) - F.length(head) - F.lit(1 + len(CLOSE)))
        role = unescaped(head)
        # the first character of \\\\ and \\n tells what follows; a mark that roles cannot hold keeps pairs apart
        pairs = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda t: F.struct(F.array_join(pairs, "\\").alias("role"), unescaped(t).alias("text")))

    loss = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescaped(p["text"]))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")
