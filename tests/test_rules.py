"""One positive and one negative case for each rule and threshold."""

import pytest
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.operators import metrics, rounds, rules

TOKEN = (100, 10, 0, 0, 0)


def make(spark, *events, session="s"):
    """Events as (kind, {field: value})."""
    names = S.EVENT.names
    out = []
    for i, e in enumerate(events):
        kind, more = e if isinstance(e, tuple) else (e, {})
        row = dict.fromkeys(names) | {"session_id": session, "seq": i, "kind": kind, "failed": False} | more
        out.append(tuple(row[n] for n in names))
    return spark.createDataFrame(out, S.EVENT)


def agents(spark, *rows):
    names = S.SUBAGENT_ROW.names
    base = dict.fromkeys(names) | {"session_id": "s", "depth": 1, "tools": 0, "tool_errors": 0, "rounds": 0, "type": "t", "model": "", "outcome": "ok", "evidence": "observed"}
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], S.SUBAGENT_ROW)


def prices(spark):
    return spark.createDataFrame([(0, "m", ["up/m"], 1.0, 2.0, None, 0.5, 1000)], "position int, key string, aliases array<string>, input double, output double, cache_write double, cache_read double, context_window long")


def frames(spark, events, subs=None):
    subs = subs if subs is not None else agents(spark)
    metric = metrics.session_metrics(events, subs, prices(spark))
    capture = spark.createDataFrame([("s", "observed", "not_recorded")], "session_id string, token string, duration string")
    priced = metrics.priced(events.filter("kind = 'assistant'"), "name", prices(spark)).select("session_id", "seq", "cost")
    with_cost = events.join(priced, ["session_id", "seq"], "left")
    return rules.SessionFrames(events, subs, metric, capture, rounds.round_metrics(with_cost))


def tool(name="Bash", **more):
    return ("tool", {"name": name, **more})


def failed(**more):
    return ("tool_result", {"failed": True, **more})


def signatures(df):
    return sorted(r.signature for r in df.collect())


def test_error_rate(spark):
    hit = frames(spark, make(spark, *[tool()] * 15, *[failed()] * 3))
    assert [r.value for r in rules.error_rate(hit).collect()] == ["20.0 %"]
    assert not rules.error_rate(frames(spark, make(spark, *[tool()] * 16, *[failed()] * 3))).collect()
    assert not rules.error_rate(frames(spark, make(spark, *[tool()] * 2, *[failed()] * 2))).collect()


def test_rework(spark):
    edit = [tool("Edit", signature="f", ref=f"r{i}") for i in range(5)]
    assert signatures(rules.rework_file(frames(spark, make(spark, *edit, failed(ref="r1"), failed())))) == ["rework:file:f"]
    assert not rules.rework_file(frames(spark, make(spark, *edit[:4], failed(ref="r1"), failed()))).collect()
    assert signatures(rules.rework_tool(frames(spark, make(spark, tool("X"), *[failed()] * 4)))) == ["rework:tool:X"]
    assert not rules.rework_tool(frames(spark, make(spark, tool("X"), *[failed()] * 3))).collect()


def test_subagents(spark):
    subs = agents(spark, {"agent_id": "a", "outcome": "error"}, {"agent_id": "b", "outcome": "empty"}, {"agent_id": "c", "evidence": None}, {"agent_id": "d", "depth": 3})
    f = frames(spark, make(spark, "user"), subs)
    assert [r.ref for r in rules.subagent_failed(f).orderBy("ref").collect()] == ["a", "b"]
    assert [r.ref for r in rules.unsupported_claim(f).collect()] == ["c"]
    assert [r.value for r in rules.overdelegation(f).collect()] == ["4 sub-agents, depth 3"]
    assert not rules.overdelegation(frames(spark, make(spark, "user"), agents(spark, *[{"agent_id": str(i)} for i in range(25)]))).collect()


def test_latency(spark):
    f = frames(spark, make(spark, ("round_end", {"duration_ms": 60_001}), tool("A", duration_ms=120_000), tool("B", duration_ms=120_001)))
    assert [r.value for r in rules.slow_turn(f).collect()] == ["p95 60 s"]
    assert signatures(rules.slow_tool(f)) == ["latency:slow_turn:tool:B"]
    assert signatures(rules.tool_timeout(f)) == ["latency:timeout:tool:A"]
    assert not rules.slow_turn(frames(spark, make(spark, ("round_end", {"duration_ms": 60_000})))).collect()


def spend(*costs, starts=0):
    out = []
    for c in costs:
        out += ["user", ("assistant", {"name": "m", "token": (c * 1_000_000, 0, 0, 0, 0)}), *["subagent"] * (starts if c == max(costs) else 0)]
    return out


@pytest.mark.parametrize(("costs", "starts", "expected"), [
    ((1, 1, 1, 1, 5), 0, ["cost:spike:single", "cost:spike:top3"]),
    ((1, 1, 1, 1, 5), 3, ["cost:spike:delegation", "cost:spike:top3"]),
    ((2, 2, 2, 2, 9), 0, ["cost:spike:top3"]),
    ((1, 1, 1, 1, 1, 1, 1, 4, 4, 4), 0, ["cost:spike:cluster", "cost:spike:top3"]),
    ((1, 1, 1, 5), 0, []),
    ((1, 1, 1, 1, 1, 1, 1), 0, []),
])
def test_cost_spikes(spark, costs, starts, expected):
    assert signatures(rules.cost_spikes(frames(spark, make(spark, *spend(*costs, starts=starts))))) == expected


def test_registry(spark):
    f = frames(spark, make(spark, *[tool("X")] * 2, *[failed()] * 4))
    found = rules.session_findings(f).orderBy("rule_order").collect()
    assert [r.rule for r in found] == ["tool:error_rate", "rework:tool", "capture:gap"]


def test_metrics(spark):
    events = make(
        spark, tool("Before"), "user", ("assistant", {"name": "m:tag", "token": TOKEN}), ("assistant", {"name": "unknown", "token": TOKEN}), tool("Edit", signature="f"), tool("Write", signature="f"),
        "compaction", ("round_end", {"duration_ms": 5}), "user", ("assistant", {"name": "m", "token": (400, 0, 0, 100, 7)}))
    m = metrics.session_metrics(events, agents(spark), prices(spark)).first()
    assert (m.rounds, m.tools, m.compactions, m.p50_ms, m.p95_ms) == (2, 3, 1, 5, 5)
    assert m.cost == pytest.approx((100 * 1 + 10 * 2 + 400 + 100 * 0.5) / 1e6) and m.cost_subagents is None and m.cost_total == m.cost
    assert m.context_use_max == 0.5 and m.thinking_turns == 1 and m.compaction_positions == [0.7]
    assert m.tools_by_name == {"Before": 1, "Edit": 1, "Write": 1}
    assert [r.n for r in metrics.rework(events).collect()] == [2]
    bare = metrics.session_metrics(make(spark, "user"), agents(spark), prices(spark)).first()
    assert bare.cost is None and bare.error_rate == 0.0 and bare.max_ms == 0


def test_nearest_rank_for_all_sizes(spark):
    events = None
    for n in range(1, 30):
        e = make(spark, *[("round_end", {"duration_ms": 10 * (i + 1)}) for i in range(n)], session=f"{n:02d}")
        events = e if events is None else events.unionByName(e)
    for r in metrics.latencies(events).collect():
        n = int(r.session_id)
        assert (r.p50_ms, r.p95_ms) == (10 * max(1, -(-50 * n // 100)), 10 * max(1, -(-95 * n // 100)))


def test_others_percentile(spark):
    import numpy as np

    values = [float(x) for x in np.random.default_rng(1).integers(0, 50, 23)] + [7.0, 7.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").withColumn("g", F.lit("g"))
    for r in rules.others_percentile(df, ["g"], "v", 0.95, "id").collect():
        assert r.others_p == pytest.approx(np.quantile([v for i, v in enumerate(values) if i != r.id], 0.95))
