"""Rollout reader B on a small session written here."""

import json

import pytest

from strandbook.sources import rollout


def line(s, kind, payload):
    return {"timestamp": f"2026-01-02T10:00:{s:02d}Z", "type": kind, "payload": payload}


def count(s, window, n):
    return line(s, "event_msg", {"type": "token_count", "info": {"model_context_window": window, "last_token_usage": {"input_tokens": n, "output_tokens": 1, "cached_input_tokens": 2, "reasoning_output_tokens": 3}}})


def item(s, kind, **more):
    return line(s, "response_item", {"type": kind, **more})


LINES = [
    line(0, "session_meta", {"session_id": "r-1", "cwd": "/work/p x", "cli_version": "0.1"}),
    count(1, 1000, 7),
    line(2, "turn_context", {"model": "m-1"}),
    item(3, "message", role="user"), item(3, "message", role="developer"),
    item(4, "message", role="assistant"),
    count(5, 1000, 10), count(6, 2000, 20),
    item(7, "function_call", name="shell", call_id="c1"), item(8, "function_call_output", call_id="c1", output="Exit code: 0\nWall time: 0.2 seconds"),
    item(9, "function_call", name="shell", call_id="c2"), item(10, "function_call_output", call_id="c2", output="Exit code: -3\nWall time: 1.5 seconds"),
    item(11, "function_call_output", call_id="c9", output="it timed out"),
    item(12, "reasoning", encrypted_content="x"), item(12, "new_thing"),
    line(13, "turn_context", {"model": "m-2", "odd": 1}), item(14, "message", role="assistant"),
    line(15, "world_state", {"a": 1}), line(16, "mystery", {}), line(17, "event_msg", "text"), line(18, "event_msg", None),
]


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("r")
    (root / "rollout-1.jsonl").write_text("\n".join(map(json.dumps, LINES)) + "\n{bad\n")
    return rollout.read_rollouts(spark, str(root))


def test_events(frames):
    rows = frames.events.orderBy("seq").collect()
    assert [(r.kind, r.name) for r in rows] == [
        ("system", "context_window"), ("user", None), ("assistant", "m-1"), ("system", "context_window"), ("tool", "shell"), ("tool", "shell"),
        ("tool_result", "shell"), ("tool_result", ""), ("system", "reasoning"), ("assistant", "m-2")]
    assert rows[2].token.asDict() == {"input": 30, "output": 2, "cache_write": 0, "cache_read": 4, "thinking": 6}
    assert (rows[3].ref, rows[4].duration_ms, rows[5].duration_ms) == ("2000", 200, None)
    assert (rows[6].error_class, rows[6].duration_ms, rows[7].error_class) == ("exit_nonzero", 1500, "timeout")
    assert rows[9].token is None


def test_header_and_markers(frames):
    h = frames.headers.first()
    assert (h.session_id, h.models, h.start[-3:], h.end[-3:]) == ("r-1", ["m-1", "m-2"], "00Z", "18Z")
    assert h.project.startswith("unbekannt:")
    assert frames.capture.first().unknown == [
        "token_count_ohne_assistent", "response_item:new_thing", "feld:turn_context.odd", "toplevel:mystery", "struktur:str", "event_msg:None", "defekte_zeilen:1"]
