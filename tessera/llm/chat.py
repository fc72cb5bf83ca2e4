"""Chat formatting (native): typed content parts, a reversible template, loss spans.

A message has ``conv_id, turn, role, parts``; a part is ``(kind, text, ref, units)``. The visitor
flattens the parts of a message, in order, into text and placeholders, and notes for each attachment
where its placeholder stands, what it refers to and how many tokens it expands to.

Template of a turn: ``<|im_start|>`` role newline content ``<|im_end|>`` newline. Inside role and
text every ``<``, backslashes, ``|`` gets one backslash more, so no text can hold a control string;
taking one backslash away restores it. In roles, ``%`` and newline become ``%25`` and ``%0A``.

Defined cases: null role, text or parts count as empty; text parts that touch are one text; an unknown
kind is an attachment of no tokens, a null part or kind is text; turns with equal or null numbers are ordered by (turn, role, content), nulls first; repeated
rows are turns of their own; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that one unit of an attachment expands to: image tiles, audio seconds, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
LOSS_ROLE = "assistant"
#: Code points in a piece of a formatted text, when spans are cut out of it.
PIECE = 4096
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _visit(parts: Column, kinds: Sequence[str]) -> Column:
    """The parts in a row, escaped: each NUL of a text is followed by ``t``, and a placeholder's name
    stands between NUL ``p`` and NUL ``q``. Texts that touch are escaped as one, so that no control
    string can be put together out of several parts."""

    def one(part: Column) -> Column:
        name = F.when(part["kind"].isin(*kinds), part["kind"]).otherwise(F.lit("attachment"))
        text = F.replace(F.coalesce(part["text"], F.lit("")), F.lit("\0"), F.lit("\0t"))
        return F.when(_is_text(part), text).otherwise(F.concat(F.lit("\0p"), name, F.lit("\0q")))

    return escape(F.array_join(F.transform(parts, one), ""))


def _shown(visited: Column) -> Column:
    """The content: placeholders as control strings, NULs as they were."""
    marked = F.replace(F.replace(visited, F.lit("\0p"), F.lit("<|")), F.lit("\0q"), F.lit("|>"))
    return F.replace(marked, F.lit("\0t"), F.lit("\0"))


def _ends(visited: Column) -> Column:
    """Where each placeholder starts in the content: one walk that carries the length so far."""
    gaps = F.transform(F.split(visited, "\0p", -1), lambda x: F.length(_shown(x)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("ends"))
    step = lambda a, x: F.struct((a["n"] + x + 2).alias("n"), F.array_append(a["ends"], a["n"] + x).alias("ends"))
    return F.aggregate(gaps, start, step, lambda a: a["ends"])


def _attachments(parts: Column, tokens: Mapping[str, int]) -> Column:
    def note(part: Column, i: Column) -> Column:
        each = F.lit(0).cast("long")
        for kind, n in tokens.items():
            each = F.when(part["kind"] == kind, F.lit(n).cast("long")).otherwise(each)
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), (each * F.coalesce(part["units"], F.lit(1))).alias("tokens"), F.get("ends", i).alias("at"))

    return F.transform(F.filter(parts, lambda p: ~_is_text(p)), note)


def format_chat(messages: DataFrame, tokens: Mapping[str, int] = TOKENS_PER_UNIT) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns, attachments, attachment_tokens.

    turns: ``(role, start, length, loss)`` of each turn's content, in code points of ``formatted``;
    loss marks what a model learns from. attachments: ``(turn, kind, ref, tokens, position)``.
    A conversation is one training example, hence one row, and is put together in one place.
    """
    if odd := [k for k in tokens if not re.fullmatch("[A-Za-z0-9_.-]+", k)]:
        raise ValueError(f"kinds that can't be placeholders: {odd}")
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts"))
    rows = rows.withColumn("visited", _visit(F.col("parts"), list(tokens))).withColumn("ends", _ends(F.col("visited")))
    rows = rows.select("conv_id", "turn", "role", _shown(F.col("visited")).alias("content"), _attachments(F.col("parts"), tokens).alias("found"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumns({"head": F.length(head).cast("long"), "block": F.concat(head, F.col("content"), F.lit(END))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    rows = rows.withColumns(
        {
            "k": F.row_number().over(order),
            "at": F.sum(F.length("block").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("block") + F.col("head"),
        }
    )
    turn = F.struct(
        F.col("k"),
        F.col("block"),
        F.struct("role", F.col("at").alias("start"), F.length("content").cast("long").alias("length"), (F.col("role") == LOSS_ROLE).alias("loss")).alias("turn"),
        F.transform(
            "found", lambda x: F.struct((F.col("k") - 1).alias("turn"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"), (F.col("at") + x["at"]).alias("position"))
        ).alias("found"),
    )
    joined = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    return joined.select(
        "conv_id",
        F.array_join("all.block", "").alias("formatted"),
        F.col("all.turn").alias("turns"),
        F.flatten("all.found").alias("attachments"),
        F.aggregate(F.flatten("all.found"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as ``(role, text)``: the template undone."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))

    def part(block: Column) -> Column:
        body = F.substring(block, len(START) + 1, 2147483647)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(blocks, part)


def cut_at(pieces: Column, start: Column, length: Column) -> Column:
    """The code points ``start`` to ``start + length`` of a text in ``pieces`` of ``PIECE`` each: only the
    pieces under the span are read, so all spans of a text cost one pass."""
    first = F.floor(start / PIECE)
    last = F.floor((start + length) / PIECE)
    near = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    return F.substr(near, (start - first * PIECE + 1).cast("int"), length.cast("int"))


def conversations_digest(messages: DataFrame) -> DataFrame:
    """Format, read back and digest: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    What is learned is cut out of ``formatted`` at the spans with a loss, and unescaped.
    """
    out = format_chat(messages).withColumn("back", read_back(F.col("formatted"))).withColumn("pieces", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    spans = F.filter("turns", lambda t: t["loss"])
    learned = F.array_join(F.transform(spans, lambda t: unescape(cut_at(F.col("pieces"), t["start"], t["length"]))), "")
    out = out.withColumns({"said": said, "learned": learned})
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
