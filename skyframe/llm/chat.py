"""Chat formatting with Spark expressions only.

A conversation becomes one string.  Adjacent turns of one role share a block:

    ### role<msg>first text<and>second text</turn>\\n

Inside roles and texts a backslash is doubled, ``<`` written ``\\l`` and ``#``
``\\h``, so no marker ever occurs inside them and the whole is read back exactly.  The loss
mask is a list of (start, length) spans of code points in the formatted string:
the texts of the trained roles, markers left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import or_empty

OPEN, MSG, AND, CLOSE = "### ", "<msg>", "<and>", "</turn>\n"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("\\l")), F.lit("#"), F.lit("\\h"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes first, kept apart as ``#``, which no escaped text holds."""
    paired = F.replace(F.replace(text, F.lit("\\\\"), F.lit("#")), F.lit("\\l"), F.lit("<"))
    return F.translate(F.replace(paired, F.lit("\\h"), F.lit("\\")), "#\\", "\\#")


def format_chats(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    Turns are sorted by turn number, then role, then text; null turns come first.
    Null roles and texts count as empty.  Repeated rows are repeated turns.  Null
    conversation ids are one conversation.  A formatted conversation is one
    value, so its turns do meet in one task; it is bounded by what one string
    may hold (2 GB), not by a cap here.  An empty table gives an empty table.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), or_empty(F.col(role_col)).alias("role"), or_empty(F.col(text_col)).alias("text"))
    grouped = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    escaped = grouped.select("conv_id", F.transform("turns", lambda t, i: F.struct(i.alias("i"), escape(t.role).alias("role"), escape(t.text).alias("text"))).alias("turns"))
    begun = escaped.select("conv_id", "turns", F.filter("turns", _begins_block).alias("starts"))
    blocks = begun.select("conv_id", F.transform("starts", _block).alias("blocks"))
    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: _parts(b, trained))).alias("parts"))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: p.text), "").alias("formatted"), _spans("parts").alias("loss_spans"))


def _begins_block(t: Column) -> Column:
    """Whether the role differs from that of the turn before."""
    return (t.i == 0) | (t.role != F.element_at("turns", F.greatest(t.i, F.lit(1))).role)


def _block(start: Column, k: Column) -> Column:
    """(role, texts) from this start up to the next."""
    end = F.coalesce(F.get("starts", k + 1).i, F.size("turns"))
    return F.struct(start.role.alias("role"), F.transform(F.slice("turns", start.i + 1, end - start.i), lambda t: t.text).alias("texts"))


def _parts(block: Column, trained: tuple[str, ...]) -> Column:
    """The strings to be concatenated, in order, each with its loss flag."""

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    loss, off = block.role.isin(*[_escaped(r) for r in trained]), F.lit(False)
    body = F.flatten(F.transform(block.texts, lambda t, i: F.when(i == 0, F.array(part(t, loss))).otherwise(F.array(part(F.lit(AND), off), part(t, loss)))))
    return F.concat(F.array(part(F.concat(F.lit(OPEN), block.role, F.lit(MSG)), off)), body, F.array(part(F.lit(CLOSE), off)))


def _escaped(role: str) -> str:
    return role.replace("\\", "\\\\").replace("<", "\\l").replace("#", "\\h")


def _spans(parts: str) -> Column:
    empty = F.array().cast("array<struct<start:bigint,length:bigint>>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        n = F.length(p.text).cast("long")
        more = F.when(p.loss, F.array(F.struct(acc.at.alias("start"), n.alias("length")))).otherwise(empty)
        return F.struct((acc.at + n).alias("at"), F.concat(acc.spans, more).alias("spans"))

    return F.aggregate(parts, zero, step, lambda acc: acc.spans)


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that were formatted."""
    blocks = F.slice(F.split(formatted, r"</turn>\n"), 1, F.greatest(F.size(F.split(formatted, r"</turn>\n")) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        head = F.split(block, MSG, 2)
        role = unescape(F.substring(F.get(head, F.lit(0)), len(OPEN) + 1, 2**31 - 1))
        return F.transform(F.split(F.get(head, F.lit(1)), AND), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = F.transform(spans, lambda s: unescape(F.substr(formatted, (s.start + 1).cast("int"), s.length.cast("int"))))
    return F.array_join(cut, "")
