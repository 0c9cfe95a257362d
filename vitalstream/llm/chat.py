"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as
context, then the reply, and the loss mask covers the text of that reply alone.
A conversation that does not end with an assistant turn gives one more example
of all its turns with an empty mask, so that the output keeps every turn.

    <|im_start|>role NEWLINE text<|im_end|> NEWLINE       per turn

Inside a text ``<|`` never appears: one backslash is put between ``<`` and
``|``, after any that stand there, and taken out again on reading. In a role, a backslash and a
newline are written as ``\\-`` and ``\\n`` before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalstream.llm.common import col, settled

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\-")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\-"), F.lit("\\"))


def format_chats(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per example: ``conv_id``, ``example`` (the target's place, from 0), ``formatted``, ``loss_start``, ``loss_end``.

    The mask is the code points ``loss_start`` to ``loss_end`` (exclusive) of
    ``formatted``; both are null where nothing is trainable. Turns are put in
    order of ``turn``, nulls first, ties by role and text; repeated rows are
    repeated turns. A null text or role is empty. A null ``conv_id`` names no conversation:
    each such row is one of a single turn. A conversation is one row at a time,
    as is an example; conversations are spread by id. Other columns are not read.
    """
    turn_row = F.struct(
        col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = df.select(col(conv_id).alias("conv_id"), turn_row.alias("t"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    # Head, escaped text: their lengths place the mask.
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == ASSISTANT).alias("target"),
    ))
    chats = settled(grouped.unionByName(alone), parts=parts).select("conv_id", "parts")
    place = F.filter(
        F.sequence(F.lit(0), F.size("parts") - 1),
        lambda i: F.get("parts", i)["target"] | (i == F.size("parts") - 1),
    )
    examples = chats.select("conv_id", "parts", F.explode(place).alias("example"))
    context = F.array_join(
        F.transform(F.slice("parts", 1, F.col("example")), lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), ""
    )
    examples = examples.select("conv_id", "example", context.alias("context"), F.get("parts", F.col("example")).alias("last"))
    start = F.length("context") + F.length("last.head")
    target = F.col("last.target")
    return examples.select(
        "conv_id", "example", F.concat("context", "last.head", "last.body", F.lit(END + "\n")).alias("formatted"),
        F.when(target, start).alias("loss_start"), F.when(target, start + F.length("last.body")).alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """An example back to its turns: an array of structs (role, text), unescaped."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape_role(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(t, F.locate("\n", t) + 1)).alias("text"),
    ))


def read_chats(examples: DataFrame) -> DataFrame:
    """Examples back to conversations: ``conv_id``, ``turns``, ``losses`` (trainable texts in order), ``formatted_chars``.

    The longest example of a conversation holds all its turns.
    """
    loss = F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    loss = F.struct("example", unescape(loss).alias("text"))
    rows = examples.select(
        "conv_id", "example", "formatted", F.when(F.col("loss_start").isNotNull(), loss).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.collect_list("loss").alias("losses"),
        F.sum("chars").alias("formatted_chars"),
    )
    alone = rows.where("conv_id is null").select(
        "conv_id", F.col("formatted").alias("longest"), F.array_compact(F.array("loss")).alias("losses"),
        F.col("chars").alias("formatted_chars"),
    )
    return grouped.unionByName(alone).select(
        "conv_id", parse_turns(F.col("longest")).alias("turns"),
        F.transform(F.sort_array("losses"), lambda x: x["text"]).alias("losses"), "formatted_chars",
    )
