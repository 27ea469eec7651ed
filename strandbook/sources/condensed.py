"""Raw transcript lines in short: what kind a line is, and its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbook.functions.text import redact_chat

MOST_CHARS = 500
BLOCKS = "array<struct<type: string, text: string, thinking: string, name: string, input: string, content: string>>"


def _get(line: Column, path: str) -> Column:
    return F.get_json_object(line, path)


def _texts(content: Column) -> Column:
    """A text, or the texts of a list of blocks."""
    parts = F.from_json(content, "array<struct<text: string>>")
    return F.when(content.startswith("["), F.array_join(F.transform(parts, lambda b: F.coalesce(b["text"], F.lit(""))), " ")).otherwise(F.coalesce(content, F.lit("")))


def _block(b: Column) -> Column:
    said = lambda c: F.coalesce(b[c], F.lit(""))
    return (
        F.when(b["type"] == "text", said("text"))
        .when(b["type"] == "thinking", F.concat(F.lit("[thinking] "), said("thinking")))
        .when(b["type"] == "tool_use", F.concat(F.lit("[tool_use:"), said("name"), F.lit("] "), F.coalesce(b["input"], F.lit("{}"))))
        .when(b["type"] == "tool_result", F.concat(F.lit("[tool_result] "), _texts(b["content"])))
        .when(said("type") != "", F.concat(F.lit("["), b["type"], F.lit("]"))).otherwise(F.lit(""))
    )


def _of_transcript(line: Column) -> tuple[Column, Column]:
    content = _get(line, "$.message.content")
    blocks = F.array_join(F.transform(F.from_json(content, BLOCKS), _block), " | ")
    text = F.when(_get(line, "$.type") == "system", F.coalesce(_get(line, "$.content"), F.lit(""))).when(content.startswith("["), blocks).otherwise(F.coalesce(content, F.lit("")))
    return F.coalesce(_get(line, "$.type"), F.lit("unknown")), text


def _of_rollout(line: Column) -> tuple[Column, Column]:
    kind, inner = F.coalesce(_get(line, "$.type"), F.lit("unknown")), _get(line, "$.payload.type")
    part = lambda path: F.coalesce(_get(line, f"$.payload.{path}"), F.lit(""))
    text = (
        F.when(inner == "message", _texts(_get(line, "$.payload.content")))
        .when(inner == "function_call", F.concat(F.lit("[tool_call:"), part("name"), F.lit("] "), part("arguments")))
        .when(inner == "function_call_output", F.concat(F.lit("[tool_output] "), part("output")))
        .when(inner == "reasoning", F.concat(F.lit("[reasoning] "), part("summary")))
        .otherwise(F.coalesce(_get(line, "$.payload"), F.lit("{}")))
    )
    return F.when(F.coalesce(inner, F.lit("")) != "", F.concat_ws(":", kind, inner)).otherwise(kind), text


def condensed(lines: DataFrame, source: str = "source", line: str = "raw") -> DataFrame:
    """``lines`` with ``type`` and ``text`` (cut, then redacted) in place of the raw line; ``source`` tells the format."""
    a, b = _of_transcript(F.col(line)), _of_rollout(F.col(line))
    own = F.col(source) == "claude"
    text = F.substring(F.when(own, a[1]).otherwise(b[1]), 1, MOST_CHARS)
    return lines.withColumns({"type": F.when(own, a[0]).otherwise(b[0]), "text": redact_chat(text)}).drop(line)
