"""Packed transcripts are read as the files that they were."""

import json
import os

from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.operators import metrics
from strandbook.plans import reader_queries
from strandbook.sources import transcript
from strandbook.sources.lines import pack_lines, read_lines, read_packed

USE = {"input_tokens": 3, "output_tokens": 4}


def _line(kind, second, **more):
    return json.dumps({"type": kind, "timestamp": f"2026-01-02T10:00:{second:02d}.000Z", "cwd": "/work/p", **more})


def _said(second, id_, *blocks):
    return _line("assistant", second, message={"id": id_, "model": "m", "content": list(blocks), "usage": USE})


def _write(root):
    call = {"type": "tool_use", "id": "c1", "name": "Agent", "input": {}}
    again = {"type": "tool_use", "id": "c2", "name": "Read", "input": {"file_path": "/a"}}
    files = {
        "a.jsonl": [_line("user", 0, message={"content": "do"}), "", "  \t", "{broken", _said(1, "m1", call), _said(2, "m1", again), _said(2, "", again), _said(3, None, again),
                    _line("user", 4, message={"content": [{"type": "tool_result", "tool_use_id": "c2", "is_error": True, "content": "a\tb"}]}), _said(5, "m1"), "[1]"],
        "b.jsonl": [_line("user", 0, sessionId="s-b", message={"content": "tab\there"}), _said(9, "m1")],
        "a/subagents/agent-x.jsonl": [_line("user", 1, message={"content": "go"}), _said(3, "n1", {"type": "text", "text": "seen in a.py:3"})],
        "a/subagents/agent-x.meta.json": ["{", '"agentType": "worker",', '"toolUseId": "c1"}'],
    }
    for name, lines in files.items():
        os.makedirs(os.path.dirname(root / name), exist_ok=True)
        (root / name).write_text("\n".join(lines))
    return files


def test_packed_files_give_the_same_tables(spark, tmp_path):
    root, to = tmp_path / "files", str(tmp_path / "packed")
    rows = [(f"file://{root}/{name}", n, line) for name, lines in _write(root).items() for n, line in enumerate(lines)]
    pack_lines(spark.createDataFrame(rows, "path string, line_no long, line string"), to)
    packed, files = transcript.read_packed_transcripts(spark, to), transcript.read_transcripts(spark, str(root))
    told = lambda df: sorted(str(r).replace("file://", "file:").replace("file:", "") for r in df.collect())
    for name in ("headers", "capture", "events", "subagents", "quality"):
        ours, theirs = told(getattr(packed, name)), [r.replace("//", "/") for r in told(getattr(files, name))]
        assert ours == theirs and ours, name
    whole = sorted(map(str, read_packed(spark, to).drop("v").collect()))
    assert whole == sorted(map(str, read_packed(spark, to, range_bytes=50).drop("v").collect()))
    assert len(whole) == read_lines(spark, str(root)).count()


def test_transcripts_of_many_sessions_share_files(spark):
    """Sessions take no file each (before: one for each session of the table)."""
    path = reader_queries.write_transcripts(spark, "/root/testdata/sf0.01")
    sessions = read_packed(spark, path).select("path").distinct().count()
    files = spark.read.text(path).select(F.col("_metadata.file_path")).distinct().count()
    assert sessions == 150 and files <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sessions_scans(plan):
    return sum("FileScan text" in line and "session" in line.split("PartitionFilters")[1] for line in plan.splitlines())


def test_rework_reads_and_shuffles_transcripts_once(spark):
    """Sub-agents' files lie apart, and ids come with the events (before: transcripts were scanned three times, and events shuffled and sorted for two joins)."""
    plan = _plan(reader_queries.transcript_rework(spark, "/root/testdata/sf0.001"))
    assert _sessions_scans(plan) == 1 and plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan
    assert plan.count("Sort [path") == 1


def test_models_take_ids_from_the_pass_over_the_events(spark, tmp_path):
    """The last id counts, also on a line without events; no second scan of transcripts tells it (before: two, and a join by path)."""
    to, lines = str(tmp_path / "packed"), [_line("user", 0, sessionId="s-1", message={"content": "do"}), _said(1, "m1"), _said(2, "m1"), _line("mode", 3, sessionId="s-2"), "[1]", "{broken"]
    rows = [("file:/t/a.jsonl", n, line) for n, line in enumerate(lines)] + [("file:/t/b.jsonl", 0, _said(1, "m1"))]
    pack_lines(spark.createDataFrame(rows, "path string, line_no long, line string"), to)
    used = metrics.model_usage(transcript.read_packed_transcripts(spark, to).events)
    assert sorted(map(tuple, used.collect())) == [("b", "m", 1), ("s-2", "m", 1)]
    plan = _plan(reader_queries.transcript_models(spark, "/root/testdata/sf0.001"))
    assert _sessions_scans(plan) == 1 and "SortMergeJoin" not in plan


def test_costs_and_context_take_one_pass(spark):
    """The events are read once for both, and not shuffled by the names of models (before: a pass for each, and joins by few names)."""
    token = lambda n: (n, 2 * n, 1, 10 * n, 0)
    rows = [("s", "assistant", "model-0", token(7)), ("s", "assistant", "other", token(9)), ("s", "tool", "model-0", None), ("t", "assistant", "model-2", token(5)), ("u", "assistant", "model-0", None)]
    events = spark.createDataFrame(rows, f"session_id string, kind string, name string, token {S.TOKEN.simpleString()}")
    agents = spark.createDataFrame([("s", "model-1", token(3)), ("v", "model-1", token(4))], f"session_id string, model string, token {S.TOKEN.simpleString()}")
    prices = reader_queries.price_table(spark)
    apart = metrics.costs(events, agents, prices).join(metrics.context_use(events, prices), "session_id", "left")
    both = metrics.costs_and_context(events, agents, prices).select(apart.columns)
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect())) and both.count() == 4
    assert both.filter("session_id = 's'").first().context_use_max == 0.077
    plan = _plan(reader_queries.transcript_costs(spark, "/root/testdata/sf0.001"))
    assert plan.count("Window [row_number") == 1 and "hashpartitioning(name" not in plan and "hashpartitioning(_q_" not in plan
