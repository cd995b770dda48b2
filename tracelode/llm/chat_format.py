"""Chat formatting with Spark SQL expressions.

Layout of one conversation, blocks one after another:

    <|turn|>ROLE newline TEXT (<|next|>TEXT)* <|end|> newline

Adjacent turns of one role share a block and are parted by `<|next|>`. In texts and roles a backslash
becomes `\\b` and `<|` becomes `\\l|`, in roles a newline becomes `\\n`; so no text can hold a control
string, and `unescape` gives back every character.

A conversation is one value by definition, so its turns meet in one row; work on it is linear in its
length. Nulls: a null text or role is empty, null turns come first, rows that tie in `turn` are ordered
by role and text, and repeated rows are repeated turns. A null conv_id is a conversation of its own.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.columns import let

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l|"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns of one role: array of (role, texts)."""
    count = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(0), count - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    return let(
        starts,
        lambda heads: F.transform(
            heads,
            lambda at, k: F.struct(
                F.get(turns, at)["role"].alias("role"),
                F.transform(
                    F.slice(turns, at + 1, F.coalesce(F.get(heads, k + 1), count) - at), lambda t: t["text"]
                ).alias("texts"),
            ),
        ),
    )


def _segments(blocks: Column, loss_role: str) -> Column:
    """The parts of the formatted text in order, each marked whether it counts for the loss."""

    def plain(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def parts(block: Column) -> Column:
        content = F.flatten(
            F.transform(
                block["texts"],
                lambda t, i: F.array(
                    plain(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit(""))),
                    F.struct(escape(t).alias("text"), (block["role"] == loss_role).alias("loss")),
                ),
            )
        )
        head = F.array(plain(F.concat(F.lit(TURN), escape_role(block["role"]), F.lit("\n"))))
        return F.concat(head, content, F.array(plain(F.lit(END))))

    return F.flatten(F.transform(blocks, parts))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments: array of (text, loss) whose texts joined are `formatted`."""
    cell = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(cell)).alias("turns"))
    segmented = collected.select("conv_id", let(_merged(F.col("turns")), lambda b: _segments(b, loss_role)).alias("segments"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return segmented.select("conv_id", joined.alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of (role, text), one for each turn before merging."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = unescape_role(F.substr(head, F.lit(len(TURN) + 1)))
        body = F.substr(block, F.char_length(head) + 2)
        texts = F.split(body, r"<\|next\|>")
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns))


def format_digest(turns: DataFrame) -> DataFrame:
    """Digests of what `read_back` and the loss mask give for each conversation."""
    read = format_conversations(turns).select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        read_back(F.col("formatted")).alias("back"),
        unescape(
            F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
        ).alias("loss_text"),
    )
    listed = F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
