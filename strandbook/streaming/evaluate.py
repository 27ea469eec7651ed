"""Rules over running sessions: counters kept from event to event, thresholds looked at with each tool call, news told once.

``Session`` is what the rules know of one session. A stream keeps it as state
(``evaluate``); ``told_at_each_call`` gives what it tells when every call is looked
at, as windows over a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, MutableMapping
from datetime import datetime, timezone
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strandbook import schema as S
from strandbook.operators.metrics import with_blamed_tool
from strandbook.operators.rules import percent_text
from strandbook.streaming.watch import CALLS, SECONDS, changed

OUTPUT = "session_id string, seq long, rule string, signature string, value string, level string"
CALL_KINDS = (S.TOOL, S.SUBAGENT)
# The thresholds of the rules, as operators/rules.py has them.
LEAST_RATE, LEAST_ERRORS, LEAST_TOOL_ERRORS, LEAST_REFS, LEAST_FILE_ERRORS = 0.20, 3, 4, 5, 2
LEAST_FACTOR, LEAST_SHARE, COSTLY_ROUNDS, EXPLAINED = 5, 0.15, 5, 3


class Session:
    """Counters of one session. ``refs`` may be any mapping, as it grows with the calls."""

    def __init__(self, refs: MutableMapping[str, tuple[str, str]] | None = None):
        self.counts: dict[tuple[str, str], int] = {}
        self.rounds: dict[int, tuple[float, int]] = {}
        self.told: dict[str, str] = {}
        self.refs = {} if refs is None else refs
        self.last = ("", "")  # name and file of the last tool
        self.size = self.evaluated_size = self.calls = 0
        self.evaluated_at: float | None = None

    def count(self, what: str, name: str = "") -> None:
        self.counts[what, name] = self.counts.get((what, name), 0) + 1

    def named(self, what: str) -> Iterator[tuple[str, int]]:
        return ((name, n) for (w, name), n in self.counts.items() if w == what)

    def add(self, kind: str, name: str, failed: bool, ref: str, signature: str, cost: float | None) -> None:
        """One more event."""
        self.size += 1
        if kind == S.USER:
            self.count("rounds")
            self.rounds[self.counts["rounds", ""]] = (0.0, 0)
        now = self.counts.get(("rounds", ""), 0)
        if now and kind in (S.ASSISTANT, S.SUBAGENT):
            spent, starts = self.rounds[now]
            self.rounds[now] = (spent + (cost or 0.0), starts) if kind == S.ASSISTANT else (spent, starts + 1)
        if kind == S.TOOL:
            file = signature if name in S.FILE_TOOLS else ""
            self.count("tools")
            if file:
                self.count("refs", file)
            if ref:
                self.refs[ref] = (name, file)
            self.last = (name, file)
        if kind == S.TOOL_RESULT and failed:
            self.count("errors")
            called, file = self.refs.get(ref, ("", "")) if ref else ("", "")
            if called or self.last[0]:
                self.count("tool_errors", called or self.last[0])
            if file or self.last[1]:
                self.count("file_errors", file or self.last[1])

    def findings(self) -> Iterator[tuple[str, str, str]]:
        """(rule, signature, value) of what warns by all that happened so far."""
        tools, errors = self.counts.get(("tools", ""), 0), self.counts.get(("errors", ""), 0)
        if tools and errors / tools >= LEAST_RATE and errors >= LEAST_ERRORS:
            yield "tool:error_rate", "tool:error_rate", f"{errors / tools * 100:.1f} %"
        for name, n in self.named("tool_errors"):
            if n >= LEAST_TOOL_ERRORS:
                yield "rework:tool", f"rework:tool:{name}", str(n)
        for file, n in self.named("file_errors"):
            refs = self.counts.get(("refs", file), 0)
            if refs >= LEAST_REFS and n >= LEAST_FILE_ERRORS:
                yield "rework:file", f"rework:file:{file}", f"{refs}/{n}"
        costly = [c for c, _ in self.rounds.values() if c > 0]
        if len(costly) >= COSTLY_ROUNDS:
            top = min(self.rounds, key=lambda r: (-self.rounds[r][0], r))
            cost, starts = self.rounds[top]
            share = cost / sum(c for c, _ in self.rounds.values())
            if cost / median(costly) >= LEAST_FACTOR and share >= LEAST_SHARE and starts < EXPLAINED:
                yield "cost:spike", "cost:spike:single", f"round {top}: {share * 100:.1f} %"

    def due(self, at: float, calls: int, seconds: float) -> bool:
        """Whether this call is looked at: the session grew, and so many calls or seconds have passed. The first call starts the clock."""
        if self.evaluated_at is None:
            self.evaluated_at = at
        self.calls += 1
        if self.size <= self.evaluated_size or (self.calls < calls and at - self.evaluated_at < seconds):
            return False
        self.evaluated_size, self.evaluated_at, self.calls = self.size, at, 0
        return True

    def news(self) -> list[tuple[str, str, str]]:
        """Findings whose value was not the last one told; from now on it is."""
        out = [f for f in self.findings() if self.told.get(f[1]) != f[2]]
        self.told |= {signature: value for _, signature, value in out}
        return out


def run(session: Session, events: pd.DataFrame, calls: int, seconds: float, levels: dict[str, str], standard: str = "warn") -> list[tuple]:
    """(seq, rule, signature, value, level) that a session's further events make it tell, in the order of ``seq``."""
    out = []
    text = lambda x: "" if x is None or x != x else str(x)
    for e in events.sort_values("seq").itertuples():
        cost = None if e.cost is None or e.cost != e.cost else float(e.cost)
        session.add(e.kind, text(e.name), e.failed is not None and e.failed == True, text(e.ref), text(e.signature), cost)  # noqa: E712
        at = e.ts.replace(tzinfo=timezone.utc).timestamp() if isinstance(e.ts, datetime) else float(e.ts)
        if e.kind in CALL_KINDS and session.due(at, calls, seconds):
            out += [(int(e.seq), *f, level) for f in session.news() if (level := levels.get(f[0], standard)) != "off"]
    return out


class StoredRefs(MutableMapping):
    """Calls by their ref in a stream's state, read and written one by one."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, ref: str) -> tuple[str, str]:
        if not self.state.containsKey((ref,)):
            raise KeyError(ref)
        return tuple(self.state.getValue((ref,)))

    def __setitem__(self, ref: str, value: tuple[str, str]) -> None:
        self.state.updateValue((ref,), value)

    def __delitem__(self, ref: str) -> None:
        self.state.removeKey((ref,))

    def __iter__(self) -> Iterator[str]:
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class RuleWatch(StatefulProcessor):
    def __init__(self, calls: int, seconds: float, levels: dict[str, str], standard: str):
        self.settings = (calls, seconds, levels, standard)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "size long, evaluated_size long, calls long, evaluated_at double, name string, file string")
        self.counts = handle.getMapState("counts", "what string, name string", "n long")
        self.rounds = handle.getMapState("rounds", "round long", "cost double, starts long")
        self.told = handle.getMapState("told", "signature string", "value string")
        self.refs = handle.getMapState("refs", "ref string", "name string, file string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = Session(StoredRefs(self.refs))
        if self.clock.exists():
            size, evaluated, calls, at, *last = self.clock.get()
            session.size, session.evaluated_size, session.calls, session.evaluated_at, session.last = size, evaluated, calls, at, tuple(last)
            session.counts = {tuple(k): v[0] for k, v in self.counts.iterator()}
            session.rounds = {k[0]: tuple(v) for k, v in self.rounds.iterator()}
            session.told = {k[0]: v[0] for k, v in self.told.iterator()}
        before = (dict(session.counts), dict(session.rounds), dict(session.told))
        out = run(session, pd.concat(list(rows)), *self.settings)
        for state, was, now in zip((self.counts, self.rounds, self.told), before, (session.counts, session.rounds, session.told), strict=True):
            for k, v in now.items():
                if was.get(k) != v:
                    state.updateValue(k if isinstance(k, tuple) else (k,), v if isinstance(v, tuple) else (v,))
        self.clock.update((session.size, session.evaluated_size, session.calls, session.evaluated_at, *session.last))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["session_id", "seq", "rule", "signature", "value", "level"])

    def close(self) -> None:
        pass


def evaluate(events: DataFrame, calls: int = CALLS, seconds: float = SECONDS, levels: dict[str, str] | None = None, standard: str = "warn") -> DataFrame:
    """A stream of news from a stream of events: session_id, seq, ts, kind, name, failed, ref, signature, cost.

    With each tool call a session's warnings are looked at, at most every ``calls``
    calls or ``seconds`` seconds, and those are told whose value has changed since
    they were last told. ``levels`` says by rule whether to warn, to ask, or nothing
    (off). A session's events must come in the order of ``seq`` from batch to batch;
    inside a batch they may lie in any order.
    """
    own = events.select(F.col("session_id").cast("string").alias("session_id"), "seq", "ts", "kind", "name", "failed", "ref", "signature", "cost")
    return own.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=RuleWatch(calls, seconds, dict(levels or {}), standard), outputStructType=OUTPUT, outputMode="append", timeMode="None")


def told_at_each_call(events: DataFrame) -> DataFrame:
    """What the counting rules tell when every call is looked at: ``session_id, seq, rule, signature, value``, a row for each change of a value.

    ``seq`` is the call that tells it. Failures tell with the next call after them.
    The stream gives the same rows with calls = 1; of the cost rule, whose median is
    no window, it gives more.
    """
    own = Window.partitionBy("session_id").orderBy("seq")
    upto, after = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    is_call, is_tool = F.col("kind").isin(*CALL_KINDS), F.col("kind") == S.TOOL
    failed = (F.col("kind") == S.TOOL_RESULT) & F.coalesce("failed", F.lit(False))
    file = F.when(is_tool & F.col("name").isin(*S.FILE_TOOLS) & (F.coalesce("signature", F.lit("")) != ""), F.col("signature"))
    ev = with_blamed_tool(events).withColumns({"_file": file, "_failed": failed})
    ev = ev.withColumns({
        "call": F.min(F.when(is_call, F.col("seq"))).over(after), "tools": F.count_if(is_tool).over(upto), "errors": F.count_if("_failed").over(upto),
        "last_file": F.last(F.when(is_tool, F.struct(F.coalesce("_file", F.lit("")).alias("f"))), ignorenulls=True).over(upto)["f"]})
    by_ref = ev.filter(F.col("_file").isNotNull() & (F.coalesce("ref", F.lit("")) != "")).groupBy("session_id", "ref").agg(F.max_by("_file", "seq").alias("ref_file"))

    def told(rows: DataFrame, rule: str, signature: Column, value: Column) -> DataFrame:
        return rows.select("session_id", F.col("call").alias("seq"), F.lit(rule).alias("rule"), signature.alias("signature"), value.alias("value"))

    rate = F.col("errors") / F.col("tools")
    rates = told(ev.filter(is_call & (F.col("tools") > 0)).filter((rate >= LEAST_RATE) & (F.col("errors") >= LEAST_ERRORS)), "tool:error_rate", F.lit("tool:error_rate"), percent_text(rate))
    by_tool = Window.partitionBy("session_id", "blamed").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    blamed = ev.filter("_failed and blamed != ''").withColumn("n", F.count("*").over(by_tool)).filter("call is not null")
    tools = blamed.groupBy("session_id", "blamed", "call").agg(F.max("n").alias("n")).filter(F.col("n") >= LEAST_TOOL_ERRORS)
    reworked = told(tools, "rework:tool", F.concat(F.lit("rework:tool:"), "blamed"), F.col("n").cast("string"))
    runs = ev.filter("_failed and call is not null").join(by_ref, ["session_id", "ref"], "left").select("session_id", "call", F.coalesce("ref_file", F.nullif(F.col("last_file"), F.lit(""))).alias("file"), F.lit(0).alias("ref_"), F.lit(1).alias("err_"))
    uses = ev.filter("_file is not null").select("session_id", "call", F.col("_file").alias("file"), F.lit(1).alias("ref_"), F.lit(0).alias("err_"))
    steps = runs.filter("file is not null").unionByName(uses).groupBy("session_id", "file", "call").agg(F.sum("ref_").alias("ref_"), F.sum("err_").alias("err_"))
    sofar = Window.partitionBy("session_id", "file").orderBy("call").rowsBetween(Window.unboundedPreceding, 0)
    files = steps.withColumns({"refs": F.sum("ref_").over(sofar), "n": F.sum("err_").over(sofar)}).filter((F.col("refs") >= LEAST_REFS) & (F.col("n") >= LEAST_FILE_ERRORS))
    reused = told(files, "rework:file", F.concat(F.lit("rework:file:"), "file"), F.concat_ws("/", "refs", "n"))
    return changed(rates.unionByName(reworked).unionByName(reused), ["session_id", "signature"], "seq", "value")


def replayed(events: pd.DataFrame, calls: int, seconds: float, levels: dict[str, str] | None = None) -> list[tuple]:
    """What one session tells, event after event, outside of any stream."""
    return run(Session(), events, calls, seconds, levels or {})


def holding(events: pd.DataFrame) -> Iterable[tuple[str, str, str]]:
    """The findings of a session's events as a whole."""
    session = Session()
    run(session, events, 1 << 60, float("inf"), {})
    return session.findings()
