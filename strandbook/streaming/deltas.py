"""Messages that come in parts: lines of a chat process, put together whatever order they arrive in.

A line is a delta with text, a sign of life without, the result with its token
counts, or nothing that is known (broken lines too); each has its place in its
turn. A turn is whole when its result is there and every line before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds without a line after which a turn is given up.
LIMIT = 120
COMPLETE, MISSING, NO_RESULT = "complete", "parts missing", "no result"
OUTPUT = "conversation_id string, turn long, text string, token_in long, token_out long, status string"


def parsed(lines: DataFrame) -> DataFrame:
    """Adds to each ``line`` its ``kind`` (delta, alive, end or null), ``text``, ``token_in`` and ``token_out``."""
    v = F.try_parse_json(F.trim("line"))
    get = lambda path, kind="string": F.try_variant_get(F.col("_v"), path, kind)
    rows = lines.withColumn("_v", F.when(F.trim("line").startswith("{"), v))
    text = F.when(get("$.event.delta.type") == "text_delta", F.nullif(get("$.event.delta.text"), F.lit("")))
    kind = F.when(get("$.type") == "result", "end").when(get("$.type") == "stream_event", F.when(text.isNotNull(), "delta").otherwise("alive"))
    count = lambda name: F.when(kind == "end", F.coalesce(get(f"$.usage.{name}", "long"), F.lit(0)))
    return rows.withColumns({"kind": kind, "text": F.when(kind == "delta", text), "token_in": count("input_tokens"), "token_out": count("output_tokens")}).drop("_v")


def assembled(lines: DataFrame) -> DataFrame:
    """Each turn of a table of lines (conversation_id, turn, part from 0, line): its text, token counts and status.

    A part that is there twice counts once. What comes behind the result is not read.
    """
    parts = parsed(lines).groupBy("conversation_id", "turn", "part").agg(F.min(F.struct("kind", "text", "token_in", "token_out")).alias("p"))
    turns = parts.groupBy("conversation_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct("part", F.col("p.text").alias("text")))).alias("parts"), F.min_by("p", F.when(F.col("p.kind") == "end", F.col("part"))).alias("end"),
        F.min(F.when(F.col("p.kind") == "end", F.col("part"))).alias("last"))
    used = F.filter("parts", lambda p: F.col("last").isNull() | (p["part"] < F.col("last")))
    text = F.array_join(F.transform(used, lambda p: p["text"]), "")
    status = F.when(F.col("last").isNull(), NO_RESULT).when(F.size(used) < F.col("last"), MISSING).otherwise(COMPLETE)
    return turns.select("conversation_id", "turn", text.alias("text"), F.col("end.token_in").alias("token_in"), F.col("end.token_out").alias("token_out"), status.alias("status"))


class Assembler(StatefulProcessor):
    """State of a turn: its parts so far, its result if that is there, when the last line came, and whether it was given out."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "part long", "text string")
        self.end = handle.getValueState("end", "part long, token_in long, token_out long")
        self.clock = handle.getValueState("clock", "timer long, done boolean")

    def _given_out(self, key, status: str) -> pd.DataFrame:
        end = self.end.get() if self.end.exists() else (None, None, None)
        parts = sorted((k[0], v[0]) for k, v in self.parts.iterator())
        text = "".join(t or "" for p, t in parts if end[0] is None or p < end[0])
        self.parts.clear()
        self.end.clear()
        return pd.DataFrame([(key[0], key[1], text, end[1], end[2], status)], columns=["conversation_id", "turn", "text", "token_in", "token_out", "status"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, done = self.clock.get() if self.clock.exists() else (0, False)
        latest = 0
        for row in pd.concat(list(rows)).itertuples():
            at = row.at.replace(tzinfo=timezone.utc).timestamp() if isinstance(row.at, datetime) else float(row.at)
            latest = max(latest, int(at * 1000))
            if done:  # a part that came again
                continue
            self.parts.updateValue((int(row.part),), (row.text if isinstance(row.text, str) else None,))
            if row.kind == "end" and (not self.end.exists() or row.part < self.end.get()[0]):
                self.end.update((int(row.part), int(row.token_in), int(row.token_out)))
        due = latest + int(self.limit * 1000)
        if due > timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        whole = False
        if not done and self.end.exists():
            last = self.end.get()[0]
            whole = sum(k[0] < last for k, _ in self.parts.iterator()) == last
        if whole:
            yield self._given_out(key, COMPLETE)
        self.clock.update((timer, done or whole))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists() and not self.clock.get()[1]:
            yield self._given_out(key, MISSING if self.end.exists() else NO_RESULT)
        self.clock.clear()

    def close(self) -> None:
        pass


def assemble(lines: DataFrame, limit: float = LIMIT, lateness: str = "2 minutes") -> DataFrame:
    """A stream of turns from a stream of lines (conversation_id, turn, part, at, line).

    A turn is given out once, as soon as it is whole; if ``limit`` seconds of the
    stream's own time pass without a line of it, with what is there and why it is
    not whole. State goes when that time is over.
    """
    rows = parsed(lines).withWatermark("at", lateness).select(F.col("conversation_id").cast("string").alias("conversation_id"), F.col("turn").cast("long").alias("turn"), F.col("part").cast("long").alias("part"), "at", "kind", "text", "token_in", "token_out")
    return rows.groupBy("conversation_id", "turn").transformWithStateInPandas(statefulProcessor=Assembler(limit), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime")
