"""Messages from their parts, whatever order these come in."""

import random
from datetime import datetime, timedelta

from strandbook.plans.watch_queries import lines_of
from strandbook.streaming import deltas

START = datetime(2026, 1, 1, 12)
SCHEMA = "conversation_id string, turn long, part long, at timestamp, line string"


def run(spark, tmp_path, batches, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = deltas.assemble(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted(map(tuple, spark.table(name).collect()))


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    turns = spark.createDataFrame([(c, t, "".join(random.Random(10 * c + t).choice("abc äß\n\"") for _ in range(17 * t * (c + 1)))) for c in range(3) for t in range(4)], "conv_id long, turn long, t string")
    lines = lines_of(turns).collect()
    random.Random(2).shuffle(lines)
    rows = [(r.conversation_id, r.turn, r.part, START + timedelta(seconds=k % 50), r.line) for k, r in enumerate(lines)]
    third = len(rows) // 3
    got = run(spark, tmp_path, [rows[:third], rows[third:2 * third], rows[2 * third:] + rows[:5]], "whole")  # some come again
    want = sorted(map(tuple, deltas.assembled(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == want and len(want) == 12 and {r[5] for r in want} == {"complete"}


def test_turns_that_never_end(spark, tmp_path):
    delta = '{"type": "stream_event", "event": {"delta": {"type": "text_delta", "text": "%s"}}}'
    end = '{"type": "result", "usage": {"input_tokens": 3}}'
    first = [("a", 0, 0, START, delta % "un"), ("b", 0, 1, START, delta % "lost"), ("b", 0, 2, START, end), ("c", 0, 0, START, "no json"), ("c", 0, 1, START, end)]
    later = [("z", 0, 0, START + timedelta(minutes=20), delta % "late")]
    last = [("y", 0, 0, START + timedelta(minutes=40), "{}")]
    got = run(spark, tmp_path, [first, later, last], "given_up")
    assert got[:3] == [("a", 0, "un", None, None, "no result"), ("b", 0, "lost", 3, 0, "parts missing"), ("c", 0, "", 3, 0, "complete")]
    batch = {r.conversation_id: r.status for r in deltas.assembled(spark.createDataFrame(first, SCHEMA)).collect()}
    assert batch == {"a": "no result", "b": "parts missing", "c": "complete"}


def test_kinds(spark):
    lines = ['{"type": "stream_event", "event": {"delta": {"type": "thinking_delta", "thinking": "x"}}}', '{"type": "stream_event", "event": {"delta": {"type": "text_delta", "text": ""}}}', ' {"type": "result"}', '{"type": "system"}', "{broken", "[1]", ""]
    got = deltas.parsed(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [r.kind for r in got] == ["alive", "alive", "end", None, None, None, None] and (got[2].token_in, got[2].token_out) == (0, 0)
