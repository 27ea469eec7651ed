"""Contracts, raw lines in short, rule texts, appends that part good rows from bad."""

import json

from pyspark.sql import functions as F

from strandbook.operators import rule_texts
from strandbook.sources import commits, condensed, contracts


def test_append_checked(spark, tmp_path):
    rows = [("a", "done", None, None, "rule", "docs/x.md"), ("b", "done", None, None, None, None), ("", "open", "x" * 501, None, None, None), (None, "what", None, None, None, None)]
    df = spark.createDataFrame(rows, "signature string, status string, remark string, reason string, anchor_kind string, anchor_path string")
    for _ in range(2):  # the second time is a replay
        commits.append_checked(df, "decision", str(tmp_path), 0)
    assert [r.signature for r in commits.committed(spark, str(tmp_path), "decision").collect()] == ["a"]
    bad = {r.signature: r.violations for r in commits.committed(spark, str(tmp_path), "decision_rejects").collect()}
    assert len(bad) == commits.committed(spark, str(tmp_path), "decision_rejects").count()
    assert bad == {"b": ["done needs an anchor"], "": ["signature", "remark"], None: ["signature", "status"]}
    assert contracts.with_violations(df, "free").filter(F.size("violations") > 0).count() == 0


def test_runs_and_requests(spark):
    s = "scope string, session_id long, signatures array<string>, stage int, run_ref string, run_id string, duration_ms long, error string, classes array<string>"
    rows = [("pattern", None, ["s"], None, None, "p-20240101-120000-00ff", 5, None, ["clean"]), ("pattern", 3, ["s"], 2, None, "p-1", -1, None, ["odd"]), ("finding", 1, [], None, None, "p-20240101-120000-00ff", 0, None, None)]
    df = spark.createDataFrame(rows, s)
    told = lambda kind: [r.violations for r in contracts.with_violations(df, kind).collect()]
    assert told("review_run") == [[], ["pattern: one signature and no session", "run_id", "duration_ms", "classes"], []]
    assert told("review_request") == [[], ["pattern: one signature and no session", "stage and run together"], ["finding: session and signatures"]]


def test_raw_lines(spark):
    blocks = [{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "Bash", "input": {"c": 1}}, {"type": "tool_result", "content": [{"text": "ok"}, {"text": "done"}]}, {"type": "image"}]
    lines = [("claude", {"type": "assistant", "message": {"content": blocks}}), ("claude", {"type": "user", "message": {"content": "see /a/b/c now"}}), ("claude", {"type": "system", "content": "boot"}), ("claude", {}),
             ("codex", {"type": "item", "payload": {"type": "message", "content": [{"text": "a"}, {"text": "b"}]}}), ("codex", {"type": "item", "payload": {"type": "function_call", "name": "sh", "arguments": "{}"}}),
             ("codex", {"type": "item", "payload": {"type": "function_call_output", "output": "x"}}), ("codex", {"type": "turn", "payload": {"k": 1}})]
    df = spark.createDataFrame([(s, json.dumps(x)) for s, x in lines], "source string, raw string")
    got = [(r.type, r.text) for r in condensed.condensed(df).collect()]
    assert got == [("assistant", 'hi | [thinking] hm | [tool_use:Bash] {"c":1} | [tool_result] ok done | [image]'), ("user", "see <path> now"), ("system", "boot"), ("unknown", ""),
                   ("item:message", "a b"), ("item:function_call", "[tool_call:sh] {}"), ("item:function_call_output", "[tool_output] x"), ("turn", '{"k":1}')]


def test_rule_texts(spark):
    df = spark.createDataFrame([("rework:tool:Bash",), ("cost:spike",), ("new:rule",), (None,)], "signature string")
    assert [r.title for r in rule_texts.with_texts(df).orderBy(F.col("signature").asc_nulls_last()).collect()] == ["Cost spike", "Unknown rule", "One tool keeps failing", "Unknown rule"]
