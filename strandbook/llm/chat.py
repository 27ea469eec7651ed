"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template. A block is one role's adjacent turns:
#: OPEN role HEAD turn [NEXT turn]... CLOSE
OPEN, HEAD, NEXT, CLOSE = "[INST]", "[/INST]", "[AND]", "</s>"
#: What an escaped text must not hold, split after its first character.
CONTROL = r"([\[<])(/?(?:INST|AND|s)[\]>])"
ESCAPED = r"([\[<])\\(/?(?:INST|AND|s)[\]>])"


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks every control string with one; ``unescape`` undoes it exactly."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_chats(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: ``conv_id``, ``n_blocks``, ``segments``, ``formatted``.

    A conversation's turns are collected as structs and sorted by turn, then
    role and text. Adjacent turns of one role are merged into a block, with
    their boundaries kept. ``segments`` is the formatted text cut at the borders
    of the loss mask: structs of ``text`` and ``loss`` in order, whose texts
    joined are ``formatted``; only texts of the ``loss_roles`` are under the mask.

    Null texts and roles are empty strings, null turns come first, null
    conversation ids form one conversation, repeated rows are turns of their own.
    An empty table gives no rows; other columns are not read. A conversation is
    one output value, so it must fit in a row.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = F.col("turns")
    # Where a block begins; the block ends where the next begins.
    numbered = F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), i.alias("i")))
    chats = chats.withColumn("starts", F.transform(
        F.filter(numbered, lambda x: (x["i"] == 0) | (x["role"] != F.get(turns, x["i"] - 1)["role"])), lambda x: x["i"]))
    starts = F.col("starts")
    block = lambda i, k: F.struct(
        F.get(turns, i)["role"].alias("role"),
        F.transform(F.slice(turns, i + 1, F.coalesce(F.get(starts, k + 1), F.size(turns)) - i), lambda t: escape(t["text"])).alias("texts"))
    chats = chats.withColumn("blocks", F.transform(starts, block))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = lambda b: F.concat(
        F.array(segment(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD)), F.lit(False))),
        F.flatten(F.transform(b["texts"], lambda x, i: F.filter(
            F.array(F.when(i > 0, segment(F.lit(NEXT), F.lit(False))), segment(x, b["role"].isin(*loss_roles))), lambda s: s.isNotNull()))),
        F.array(segment(F.lit(CLOSE), F.lit(False))))
    chats = chats.withColumn("segments", F.flatten(F.transform("blocks", parts)))
    return chats.select(
        "conv_id", F.size("blocks").cast("long").alias("n_blocks"), "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), from its text alone."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), HEAD, 1))
    body = lambda b: F.substr(b, F.lit(1) + F.length(F.substring_index(b, HEAD, 1)) + F.lit(len(HEAD)))
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(body(b), r"\[AND\]"), lambda x: F.struct(role(b).alias("role"), unescape(x).alias("text")))))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
