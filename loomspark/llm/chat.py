"""Chat formatting with relational operations only: collected turns, merged, marked, masked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own marks. Every one starts with "<|", which escaped text never holds.
START, TEXT, MORE, END = "<|start|>", "<|text|>", "<|more|>", "<|end|>\n"
#: Control strings of common templates; a text may not bring them in. Each
#: is the opening character and the rest.
CONTROL = (("<", r"\|"), ("<", r"/?s>"), (r"\[", r"/?INST\]"), ("<", r"</?SYS>>"))


def escape(col: Column) -> Column:
    r"""Makes a text free of control strings: "\" is doubled, and one "\" goes after
    the first character of every control string. unescape() undoes it exactly.
    """
    out = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for first, rest in CONTROL:
        out = F.regexp_replace(out, f"({first})(?={rest})", r"$1\\")
    return out


def unescape(col: Column) -> Column:
    for first, rest in reversed(CONTROL):
        col = F.regexp_replace(col, f"({first})\\\\(?={rest})", "$1")
    return F.replace(col, F.lit("\\\\"), F.lit("\\"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments from rows (conv_id, turn, role, text).

    The turns of a conversation are collected as structs and sorted by (turn,
    role, text); adjacent turns of one role become one block whose texts
    stand apart by a mark. `segments` cuts `formatted` into (piece, loss):
    loss marks the assistant's texts, each a piece of its own. Null text
    and null role count as empty. Rows with the same turn number keep the sort's
    order; repeated rows are turns like others. A null conv_id is a
    conversation like others; an empty table gives no rows. Other columns are not read.

    A conversation is one output row, so its turns meet in one task by nature.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # where the blocks of one role begin
    first = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    chats = chats.withColumn("at", F.array_append(first, F.size("t")))
    block = F.transform(
        F.sequence(F.lit(0), F.size("at") - 2),
        lambda k: F.struct(
            F.get("t", F.get("at", k))["role"].alias("role"),
            F.transform(F.slice("t", F.get("at", k) + 1, F.get("at", k + 1) - F.get("at", k)), lambda x: escape(x["text"])).alias("texts"),
        ),
    )

    def marked(b: Column) -> Column:
        loss = b["role"] == "assistant"

        def piece(s, is_loss):
            return F.struct(s.alias("piece"), is_loss.alias("loss"))

        body = F.flatten(F.transform(b["texts"], lambda x, i: F.array(piece(F.when(i == 0, F.lit("")).otherwise(F.lit(MORE)), F.lit(False)), piece(x, loss))))
        return F.concat(F.array(piece(F.concat(F.lit(START), escape(b["role"]), F.lit(TEXT)), F.lit(False))), body, F.array(piece(F.lit(END), F.lit(False))))

    chats = chats.select("conv_id", F.flatten(F.transform(block, marked)).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments")


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) read back from `formatted`: the inverse of format_chats."""
    blocks = F.slice(F.split("formatted", r"<\|start\|>"), 2, 2_000_000_000)

    def turns(block):
        role = unescape(F.substring_index(block, TEXT, 1))
        body = F.substring_index(F.substring_index(block, TEXT, -1), END, 1)
        return F.transform(F.split(body, r"<\|more\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return formatted.select("*", F.flatten(F.transform(blocks, turns)).alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the output of format_chats says about itself, for comparison with its input."""
    read = read_chats(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
