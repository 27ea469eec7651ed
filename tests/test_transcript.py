"""Transcript reader A on a small session written here."""

import json

import pytest

from strandbook.sources import transcript


def at(s):
    return f"2026-01-02T10:00:{s:02d}.000Z"


def user(s, content, **more):
    return {"type": "user", "timestamp": at(s), "sessionId": "s-1", "cwd": "C:\\work\\proj", "version": "2.1", "gitBranch": "main", "message": {"content": content}, **more}


def said(s, id_, content, usage=None, model="model-a"):
    return {"type": "assistant", "timestamp": at(s), "message": {"id": id_, "model": model, "content": content, **({"usage": usage} if usage else {})}}


USE = {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 2, "cache_read_input_tokens": 100, "output_tokens_details": {"thinking_tokens": 3}}
LINES = [
    user(0, "do it"),
    said(1, "m1", [{"type": "thinking", "thinking": "x"}], USE),
    said(1, "m1", [{"type": "text", "text": "reading"}], USE),
    said(2, "m1", [{"type": "tool_use", "id": "t1", "name": "Read", "input": {"file_path": "/a/b.py"}}], USE),
    user(5, [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "Blocked by rule"}]),
    said(6, "m2", [{"type": "tool_use", "id": "t2", "name": "odd name!", "input": {}}, {"type": "tool_use", "id": "a1", "name": "Agent", "input": {}}], USE),
    user(9, [{"type": "tool_result", "tool_use_id": "t2", "content": [{"type": "text", "text": "fine"}]}]),
    user(9, [{"type": "tool_result", "tool_use_id": "t2", "is_error": True, "content": "late"}]),
    user(10, "meta", isMeta=True),
    user(11, "<task-notification>x"),
    user(12, "continued", isCompactSummary=True, newField=1),
    {"type": "system", "timestamp": at(20), "subtype": "turn_duration", "durationMs": 1500},
    {"type": "user", "timestamp": at(21), "message": "not an object"},
    {"type": "queue-operation", "timestamp": at(55)},
    {"type": "brand-new", "timestamp": at(56)},
    ["list"],
]


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("t")
    text = "\n".join(map(json.dumps, LINES)) + "\n{broken\n\n"
    (root / "s-1.jsonl").write_text(text)
    agents = root / "s-1" / "subagents"
    agents.mkdir(parents=True)
    (agents / "agent-x.meta.json").write_text(json.dumps({"agentType": "helper", "description": "d" * 90, "toolUseId": "a1", "spawnDepth": 2, "model": "short"}))
    (agents / "agent-x.jsonl").write_text("\n".join(map(json.dumps, [user(1, "go"), said(2, "q", [{"type": "text", "text": "see lib.py:12"}], USE, "model-b"), user(3, [{"type": "tool_result", "tool_use_id": "z", "is_error": True, "content": "no"}])])))
    (agents / "agent-y.meta.json").write_text("{corrupt")
    return transcript.read_transcripts(spark, str(root), host="h")


def test_events(frames):
    rows = frames.events.orderBy("seq").collect()
    assert [r.kind for r in rows] == ["user", "assistant", "tool", "tool_result", "assistant", "tool", "subagent", "tool_result", "compaction", "user", "round_end"]
    tool, failed, odd = rows[2], rows[3], rows[5]
    assert tool.name == "Read" and len(tool.signature) == 12 and tool.duration_ms == 3000
    assert failed.error_class == "blocked" and failed.name == "Read" and failed.ref == "t1"
    assert odd.name.startswith("unbekannt:") and odd.duration_ms == 3000
    assert (rows[6].name, rows[6].ref) == ("helper", "x")
    assert rows[1].token.asDict() == {"input": 10, "output": 5, "cache_write": 2, "cache_read": 100, "thinking": 3}
    assert [r.seq for r in rows] == list(range(11)) and rows[10].duration_ms == 1500


def test_header_and_capture(frames):
    h = frames.headers.first()
    assert (h.session_id, h.project, h.version, h.git_branch, h.models) == ("s-1", "proj", "2.1", "main", ["model-a"])
    assert (h.start, h.end) == (at(0), at(21))
    c = frames.capture.first()
    assert (c.token, c.duration, c.subagents) == ("observed", "observed", "observed")
    assert c.unknown == ["brand-new", "feld:user.newField", "struktur:list", "struktur:str"]
    assert frames.quality.filter("session_id = 's-1'").first().broken_lines == 1


def test_subagents(frames):
    x, y = frames.subagents.orderBy("agent_id").collect()
    assert (x.model, x.depth, x.rounds, x.tool_errors, x.evidence, x.outcome, x.duration_ms) == ("model-b", 2, 1, 1, "observed", "error", 2000)
    assert len(x.task) == 80 and x.task.endswith("…")
    assert (y.outcome, y.evidence, y.depth, y.tools) == ("empty", "not_observed", 1, 0)
