"""The watch over running sessions: throttled re-evaluation, warnings only when they change."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CALLS, SECONDS = 10, 60


def changed(messages: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The batch form: a message is passed on if its key's previous message had another value, or none came before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
    return messages.withColumn("_was", before).withColumn("_first", first).filter(F.col("_first") | ~F.col("_was").eqNullSafe(F.col(value))).drop("_was", "_first")


def decided(messages: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds ``note``: the newest done decision on the signature, global or of the same project (a stream-static join)."""
    done = decisions.filter("status = 'done'").groupBy("signature", "project").agg(F.max_by("note", "decided_at").alias("note"), F.max("decided_at").alias("decided_at"))
    world = done.filter("project is null").select("signature", F.struct("decided_at", "note").alias("_w"))
    own = done.filter("project is not null").select("signature", "project", F.struct("decided_at", "note").alias("_o"))
    joined = messages.join(world, "signature", "left").join(own, ["signature", "project"], "left")
    return joined.withColumn("note", F.greatest("_w", "_o")["note"]).drop("_w", "_o")


def output_mode(messages: DataFrame, levels: DataFrame) -> DataFrame:
    """Per session: ``ask`` if any rule's level says so, else ``warn``, with the first text. Levels: rule, level (off, warn, ask)."""
    asked = messages.join(levels, "rule").filter("level != 'off'")
    ask = F.bool_or(F.col("level") == "ask")
    text = F.coalesce(F.min_by("text", F.when(F.col("level") == "ask", F.col("seq"))), F.min_by("text", "seq"))
    return asked.groupBy("session_id").agg(F.when(ask, "ask").otherwise("warn").alias("mode"), text.alias("text"))


class Watch(StatefulProcessor):
    """State of a session: its size when last evaluated, when that was, calls since, and the values told so far.

    A session is evaluated if it grew and ten calls or a minute have passed; the
    first call only starts the clock. Of the evaluation's warnings (signature,
    value), those are passed on whose value was not told before.
    """

    def __init__(self, calls: int = CALLS, seconds: int = SECONDS):
        self.calls, self.seconds = calls, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "size long, last double, calls int")
        self.told = handle.getMapState("told", "signature string", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            at = row.at.replace(tzinfo=timezone.utc).timestamp() if isinstance(row.at, datetime) else float(row.at)
            if not self.clock.exists():
                self.clock.update((int(row.size), at, 1))
                continue
            size, last, calls = self.clock.get()
            calls += 1
            if row.size <= size or (calls < self.calls and at - last < self.seconds):
                self.clock.update((size, last, calls))
                continue
            self.clock.update((int(row.size), at, 0))
            for signature, value in ((x["signature"], x["value"]) for x in row.warnings):
                if self.told.containsKey((signature,)) and self.told.getValue((signature,))[0] == value:
                    continue
                self.told.updateValue((signature,), (value,))
                out.append((key[0], row.seq, signature, value))
        yield pd.DataFrame(out, columns=["session_id", "seq", "signature", "value"])

    def close(self) -> None:
        pass


OUTPUT = "session_id string, seq long, signature string, value string"


def watch(calls: DataFrame, every_calls: int = CALLS, every_seconds: int = SECONDS) -> DataFrame:
    """A stream of changed warnings from a stream of calls: session_id, seq, at, size, warnings (array of signature, value)."""
    return calls.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=Watch(every_calls, every_seconds), outputStructType=OUTPUT, outputMode="append", timeMode="None")


def ingest(versions: DataFrame, store: Callable[[DataFrame], None], checkpoint: str):
    """Runs the stream of session versions into an idempotent store, one batch at a time; replays add nothing."""
    return versions.writeStream.foreachBatch(lambda batch, _: store(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
