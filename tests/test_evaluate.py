"""Rules as state: a stream's news, a replay's, the batch rules' findings."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from conftest import SF

from strandbook.operators import metrics, rounds, rules
from strandbook.plans.watch_queries import file_events
from strandbook.streaming import evaluate

COLUMNS = ["session_id", "seq", "ts", "kind", "name", "failed", "ref", "signature", "cost"]
SCHEMA = "session_id string, seq long, ts timestamp, kind string, name string, failed boolean, ref string, signature string, cost double"
START = datetime(2026, 1, 1, 12)


def made(session, n, seed):
    """A session's events, with calls and results that name them, costs, and a dear round."""
    rng, out, calls = random.Random(seed), [], []
    for seq in range(n):
        kind = "assistant" if seq == n // 2 else rng.choice(["user", "assistant", "tool", "tool", "tool_result", "subagent", "system"])
        name = ref = signature = failed = cost = None
        if kind == "tool":
            name, ref = rng.choice(["Edit", "Read", "Bash"]), f"c{seq}"
            signature = rng.choice(["f1", "f2"]) if name != "Bash" else ""
            calls.append(ref)
        if kind == "tool_result":
            failed, ref = rng.random() < 0.6, rng.choice([*calls[-3:], "", None, "unknown"])
        if kind == "assistant":
            cost = 40.0 if seq == n // 2 else None if rng.random() < 0.2 else 1.0
        out.append((session, seq, START + timedelta(seconds=7 * seq), kind, name, failed, ref, signature, cost))
    return out


ROWS = [r for k in range(6) for r in made(f"s{k}", 40 + 30 * k, k)]


def batch_findings(spark, rows):
    ev = spark.createDataFrame(rows, SCHEMA)
    counts = metrics.event_counts(ev)
    frames = rules.SessionFrames(ev.withColumn("duration_ms", ev.seq), ev, counts, ev)
    found = rules.error_rate(frames).unionByName(rules.rework_tool(frames)).unionByName(rules.rework_file(frames))
    prices = rules.spike_single(rounds.cost_profile(rounds.round_metrics(ev.withColumn("duration_ms", ev.seq))))
    return {(r.session_id, r.rule, r.signature, r.value) for r in found.unionByName(prices).filter("severity = 'warning'").collect()}


def test_replayed_calls_give_the_batch_rules_findings(spark):
    frame = pd.DataFrame(ROWS, columns=COLUMNS)
    got = {(s, *f) for s, own in frame.groupby("session_id") for f in evaluate.holding(own)}
    want = batch_findings(spark, ROWS)
    assert got == want and {r for _, r, _, _ in want} == {"tool:error_rate", "rework:tool", "rework:file", "cost:spike"}


@pytest.mark.parametrize(("calls", "seconds"), [(1, 0), (4, 90)])
def test_stream_equals_replay(spark, tmp_path, calls, seconds):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(3):  # a session's events come in three batches
        part = [r for r in ROWS if r[1] % 200 // 60 == k or k == 2 and r[1] >= 180]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"news{calls}"
    q = evaluate.evaluate(stream, calls, seconds, {"rework:tool": "ask", "tool:error_rate": "off"}).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    got = sorted(map(tuple, spark.table(name).collect()))
    frame = pd.DataFrame(ROWS, columns=COLUMNS)
    want = sorted((s, *r) for s, own in frame.groupby("session_id") for r in evaluate.replayed(own, calls, seconds, {"rework:tool": "ask", "tool:error_rate": "off"}))
    assert got == want and len(want) > 5 and {r[5] for r in want} == {"ask", "warn"}


def test_windows_equal_replay(spark):
    ev = file_events(spark, SF).select(*COLUMNS).toPandas()
    want = sorted((s, *r[:4]) for s, own in ev.groupby("session_id") for r in evaluate.replayed(own, 1, 0) if r[1] != "cost:spike")
    got = sorted((r.session_id, r.seq, r.rule, r.signature, r.value) for r in evaluate.told_at_each_call(file_events(spark, SF)).collect())
    assert got == want and len(want) > 20
    own = spark.createDataFrame(ROWS, SCHEMA)
    frame = pd.DataFrame(ROWS, columns=COLUMNS)
    want = sorted((s, *r[:4]) for s, e in frame.groupby("session_id") for r in evaluate.replayed(e, 1, 0) if r[1] != "cost:spike")
    assert sorted((r.session_id, r.seq, r.rule, r.signature, r.value) for r in evaluate.told_at_each_call(own).collect()) == want


def test_throttle():
    def one(gap, n=25):
        rows = [("s", k, START + timedelta(seconds=gap * k), "tool" if k % 2 else "tool_result", "Bash", True, None, "", None) for k in range(n)]
        return [r[0] for r in evaluate.replayed(pd.DataFrame(rows, columns=COLUMNS), 10, 60) if r[1] == "tool:error_rate"]

    assert one(1) == [19] and one(31)[:1] == [5]  # the tenth call, or the first one with three failures after a minute
