"""Chat formatting from relational rows, with Spark expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text), adjacent turns of one role are
merged into one block, and all pieces are aggregated from the array into one string:

    <|im_start|>role<|im_body|>text[<|im_next|>text ...]<|im_end|>\\n

Control strings inside roles and texts are escaped: a backslash becomes two, and a control string gets a
backslash after its first character, so that none occurs in an escaped text and unescape() restores it exactly.

Results for odd input: null text or role is the empty string; a null turn number sorts first; a null
conversation id forms a conversation of its own; repeated rows stay repeated; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BODY, NEXT, STOP = "<|im_start|>", "<|im_body|>", "<|im_next|>", "<|im_end|>"
#: Strings with a meaning to this template or to common others; fixed values.
CONTROL = (START, BODY, NEXT, STOP, "<|im_sep|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HEADS = "".join(sorted({c[0] for c in CONTROL}))


def escape(text: Column) -> Column:
    """``text`` without control strings; unescape() is its inverse."""
    tails = "|".join(rf"(?<=\Q{c[0]}\E)(?=\Q{c[1:]}\E)" for c in CONTROL)
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, tails, r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, formatted string, segments array<struct<text, loss>>.

    The segments' texts, joined, are ``formatted``; ``loss`` marks those under the loss mask: the escaped text
    of every ``loss_role`` turn, without the template's own strings.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv).alias("_conv"), F.struct(F.col(turn).alias("turn"), escape(blank(role)).alias("role"), escape(blank(text)).alias("text")).alias("_t"))
    turns = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_t")).alias("_t"))
    # every turn gives what stands before its text and the text; a turn opens a block unless its neighbour has its role.
    # Neighbours are read by index, as slices and growing arrays would copy the conversation for every turn.
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    opening = lambda t: F.concat(F.lit(START), t.role, F.lit(BODY))

    def pieces(t: Column, i: Column) -> Column:
        same = F.get(F.col("_t"), i - 1).role == t.role
        before = F.when(i == 0, opening(t)).when(same, F.lit(NEXT)).otherwise(F.concat(F.lit(STOP + "\n"), opening(t)))
        return F.array(piece(before, F.lit(False)), piece(t.text, t.role == loss_role))

    every = F.concat(F.flatten(F.transform("_t", pieces)), F.array(piece(F.lit(STOP + "\n"), F.lit(False))))
    out = turns.select(F.col("_conv").alias(conv), every.alias("segments"))
    return out.select(conv, F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted string: array<struct<role, text>>, unescaped, merged turns apart again."""
    quoted = lambda s: rf"\Q{s}\E"
    blocks = F.filter(F.split(formatted, quoted(STOP + "\n")), lambda b: b != "")

    def turns(b: Column) -> Column:
        parts = F.split(b, quoted(BODY))
        role = unescape(F.substr(parts[0], F.lit(len(START) + 1)))
        return F.transform(F.split(parts[1], quoted(NEXT)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read back from format_conversations(): counts and digests of turns and of the text under the loss mask."""
    read = formatted.select(
        conv,
        read_turns(F.col("formatted")).alias("_turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(s.text)), "").alias("_loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    turns = F.array_join(F.transform("_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        conv,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
