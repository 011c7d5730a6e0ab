"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted, and adjacent
turns of one role are merged into a block by joining the array:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

Control strings begin with ``<|``.  Inside texts and roles a backslash becomes
``\\b`` and ``<|`` becomes ``<\\p`` (in roles also a line feed ``\\n``), so no
control string can occur there and ``parse`` gives back every turn unchanged.
``loss_spans`` marks the (escaped) text of each turn of the ``loss_role``.

Rows without conv_id form one conversation, null.  Null text or role: empty.
Turns sort by turn (null first), then role, then text; repeated rows stay.  An
empty table gives no rows.  A conversation of any length is one row, so it must
fit a task; where its turns and spans stand comes from running sums, so the work
grows with their number (``loss_text`` looks up each span from the start of the
string).  Other columns, of whatever name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_spans): one string per conversation.

    ``loss_spans`` is an array of (start, length) in characters of ``formatted``,
    start counting from 1.
    """
    value = lambda c: F.col("`" + c.replace("`", "``") + "`")
    empty = lambda c: F.coalesce(value(c).cast("string"), F.lit(""))
    rows = turns.select(value(conv).alias("conv"), value(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("raw"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "raw")  # the grouping below has the same keys: one shuffle
    rows = rows.select(
        "conv", F.row_number().over(order).alias("place"), (F.col("role") == loss_role).alias("loss"), escape(F.col("raw")).alias("text"),
        F.when(F.lag("role").over(order) == F.col("role"), F.lit(SEP)).otherwise(F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))).alias("before"),
        F.when(F.lead("role").over(order) == F.col("role"), F.lit("")).otherwise(F.lit(END + "\n")).alias("after"),
    )
    length = F.length("before") + F.length("text") + F.length("after")
    start = F.coalesce(F.sum(length).over(Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("before") + 1
    pieces = rows.withColumn("start", start.cast("int")).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "before", "text", "after", "loss", "start"))).alias("pieces"))
    marked = F.filter("pieces", lambda p: p["loss"])
    return pieces.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "").alias("formatted"),
        F.transform(marked, lambda p: F.struct(p["start"].alias("start"), F.length(p["text"]).alias("length"))).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """Back from a formatted string to the array of its turns (role, text)."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)  # the last block's end leaves an empty string

    def turns(block):
        body = F.substr(block, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.transform(F.split(F.substr(body, F.length(role) + 2), r"<\|im_sep\|>"), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")
