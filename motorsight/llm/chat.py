"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn is written as ``### role:`` on a line, the escaped text, and ``</turn>`` on a line.
Escaping writes ``\\`` as ``\\\\``, ``<`` as ``\\l`` and ``#`` as ``\\h`` (in roles also ``:`` as ``\\c``), so a
text holds no ``<`` or ``#`` when formatted, no marker can appear in it, and it is undone exactly.

Every assistant turn becomes an example of its own: all turns before it as context and
only its reply under the loss mask, given as the span (loss_start, loss_chars) of ``formatted``.
A conversation whose last turn is no reply also gives one row with its whole text and an empty
mask, so that no turn is lost.

Scale: conversations are gathered by id (turns are combined in one shuffle); an example
holds all turns before its reply, so one conversation has to fit in a row by the
nature of the method, while hot contents (one first turn or conversation under many ids) spread
by id.  Prefixes of one conversation follow each other; written as zstd Parquet they
take little more room than the conversation.

Defined results: null texts and null roles are empty; turns are ordered by (turn, role, text), null
turns first, repeated turns stay; a row without a conversation id is a conversation of its
own; an empty table gives no rows.  Only the id, turn, role and text columns are read, so other columns can't
clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPLY_ROLE = "assistant"
TURN_END = "</turn>\n"
HEAD, HEAD_END = "### ", ":\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    """Undo ``escape``: doubled backslashes are parted first, from the left, as they were written."""
    parts = F.split(text, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")))
    return F.array_join(plain, "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    plain = F.transform(parts, lambda p: F.replace(F.replace(F.replace(
        p, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":")))
    return F.array_join(plain, "\\")


def examples(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """Rows (conv_id, alone, target, formatted, loss_start, loss_chars, complete).

    ``target`` is the place of the reply (from 0), null in a row that only completes a conversation;
    ``complete`` marks the row that holds all turns; ``alone`` tells rows without an id apart.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    head = F.concat(F.lit(HEAD), escape_role(role), F.lit(HEAD_END))
    body = escape(text)
    turns = conversations.select(
        F.col(id_col).alias("conv_id"),
        # Rows without an id share no conversation.
        F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                 F.concat(head, body, F.lit(TURN_END)).alias("out"), F.length(head).alias("head"), F.length(body).alias("body")).alias("t"))
    whole = turns.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rows = whole.select("conv_id", "alone", "t", F.posexplode("t").alias("target", "x"))
    reply, last = F.col("x.role") == REPLY_ROLE, F.col("target") == F.size("t") - 1
    rows = rows.filter(reply | last).select(
        "conv_id", "alone", "target", "x", reply.alias("reply"), last.alias("complete"),
        F.array_join(F.transform(F.slice("t", 1, F.col("target") + 1), lambda x: x["out"]), "").alias("formatted"))
    start = F.length("formatted") - F.length("x.out") + F.col("x.head")  # the reply is the last turn
    return rows.select(
        "conv_id", "alone", F.when(F.col("reply"), F.col("target")).alias("target"), "formatted",
        F.when(F.col("reply"), start).otherwise(0).alias("loss_start"),
        F.when(F.col("reply"), F.col("x.body")).otherwise(0).alias("loss_chars"), "complete")


def loss_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, start + 1, chars))


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    each = F.filter(F.split(formatted, TURN_END), lambda x: x != "")

    def turn(x):
        at = F.instr(x, HEAD_END)
        return F.struct(unescape_role(F.substring(x, F.lit(len(HEAD) + 1), at - 1 - len(HEAD))).alias("role"),
                        unescape(F.substring(x, at + len(HEAD_END), F.length(x))).alias("text"))

    return F.transform(each, turn)
