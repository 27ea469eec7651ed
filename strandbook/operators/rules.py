"""Rules within a session and across sessions. Each gives finding rows; ``RULES`` can be extended."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandbook import schema as S
from strandbook.operators.metrics import tool_error_counts, with_blamed_tool
from strandbook.operators.rounds import cost_profile


@dataclass
class SessionFrames:
    """What the rules read. ``rounds`` is round_metrics(), null where no prices are known."""

    events: DataFrame
    subagents: DataFrame
    metrics: DataFrame
    capture: DataFrame
    rounds: DataFrame | None = None


@F.pandas_udf(StringType())
def percent_text(x: pd.Series) -> pd.Series:
    """One digit behind the point, rounded on the binary value, which format_string does not do."""
    return x.map(lambda v: None if pd.isna(v) else f"{v * 100:.1f} %")


def finding(df: DataFrame, rule: str, severity: Column | str, signature: Column | str, value: Column | str, ref: Column | str = "") -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    return df.select("session_id", F.lit(rule).alias("rule"), as_column(severity).alias("severity"), as_column(signature).alias("signature"), as_column(value).alias("value"), as_column(ref).alias("ref"))


def error_rate(f: SessionFrames) -> DataFrame:
    hit = f.metrics.filter("error_rate >= 0.20 and tool_errors >= 3")
    return finding(hit, "tool:error_rate", "warning", "tool:error_rate", percent_text("error_rate"))


def rework_file(f: SessionFrames) -> DataFrame:
    """Files with five or more references and two or more failures, by ref, else by the last file tool before."""
    events = f.events
    used = (F.col("kind") == S.TOOL) & F.col("name").isin(*S.FILE_TOOLS) & (F.coalesce("signature", F.lit("")) != "")
    refs = events.filter(used).groupBy("session_id", "signature").agg(F.count("*").alias("refs"))
    calls = events.filter(used & F.col("ref").isNotNull() & (F.col("ref") != "")).groupBy("session_id", "ref").agg(F.max_by("signature", "seq").alias("_by_ref"))
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") == S.TOOL, F.struct("name", "signature")), ignorenulls=True).over(before)
    failed = events.withColumn("_last", last).filter((F.col("kind") == S.TOOL_RESULT) & F.col("failed")).join(calls, ["session_id", "ref"], "left")
    blamed = F.coalesce("_by_ref", F.when(F.col("_last.name").isin(*S.FILE_TOOLS), F.col("_last.signature")))
    runs = failed.select("session_id", blamed.alias("signature")).filter("signature != ''").groupBy("session_id", "signature").agg(F.count("*").alias("failures"))
    hit = refs.join(runs, ["session_id", "signature"]).filter("refs >= 5 and failures >= 2")
    return finding(hit, "rework:file", "warning", F.concat(F.lit("rework:file:"), "signature"), F.concat_ws("/", "refs", "failures"), F.col("signature"))


def rework_tool(f: SessionFrames) -> DataFrame:
    hit = tool_error_counts(f.events).filter("n >= 4")
    return finding(hit, "rework:tool", "warning", F.concat(F.lit("rework:tool:"), "name"), F.col("n"), F.col("name"))


def subagent_failed(f: SessionFrames) -> DataFrame:
    hit = f.subagents.filter(F.col("outcome").isin("error", "empty"))
    return finding(hit, "subagent:failed", "warning", "subagent:failed", F.col("outcome"), F.col("agent_id"))


def unsupported_claim(f: SessionFrames) -> DataFrame:
    hit = f.subagents.filter((F.col("outcome") == "ok") & ~F.col("evidence").eqNullSafe("observed"))
    return finding(hit, "subagent:unsupported_claim", "hint", "subagent:unsupported_claim", F.col("type"), F.col("agent_id"))


def overdelegation(f: SessionFrames) -> DataFrame:
    hit = f.metrics.filter("depth_max >= 3 or subagents > 25")
    return finding(hit, "subagent:overdelegation", "hint", "subagent:overdelegation", F.concat(F.col("subagents"), F.lit(" sub-agents, depth "), F.col("depth_max")))


def slow_turn(f: SessionFrames) -> DataFrame:
    hit = f.metrics.filter("p95_ms > 60000")
    return finding(hit, "latency:slow_turn", "hint", "latency:slow_turn:round", F.concat(F.lit("p95 "), F.expr("p95_ms div 1000"), F.lit(" s")))


def _tools_by_duration(f: SessionFrames, condition: str) -> DataFrame:
    return f.events.filter(F.col("kind") == S.TOOL).filter(condition).groupBy("session_id", "name").agg(F.count("*").alias("n"))


def slow_tool(f: SessionFrames) -> DataFrame:
    hit = _tools_by_duration(f, f"duration_ms > {S.TIMEOUT_MS}")
    return finding(hit, "latency:slow_turn", "hint", F.concat(F.lit("latency:slow_turn:tool:"), "name"), F.concat(F.col("n"), F.lit(" calls > 120 s")), F.col("name"))


def tool_timeout(f: SessionFrames) -> DataFrame:
    hit = _tools_by_duration(f, f"duration_ms = {S.TIMEOUT_MS}")
    return finding(hit, "latency:timeout", "hint", F.concat(F.lit("latency:timeout:tool:"), "name"), F.col("n"), F.col("name"))


def capture_gap(f: SessionFrames) -> DataFrame:
    channels = f.capture.selectExpr("session_id", "stack(2, 'token', token, 'duration', duration) as (channel, state)").filter("state = 'not_recorded'")
    return finding(channels, "capture:gap", "hint", F.concat(F.lit("capture:gap:"), "channel"), F.col("channel"))


def spike_single(profile: DataFrame) -> DataFrame:
    """The dearest round is five times the median and 15 % of all; explained, hence milder, if it started three sub-agents."""
    explained = F.col("top_starts") >= 3
    hit = profile.filter("top_factor >= 5 and top_share >= 0.15")
    value = F.concat(F.lit("round "), F.col("top_round"), F.lit(": "), percent_text("top_share"))
    return finding(hit, "cost:spike", F.when(explained, "hint").otherwise("warning"), F.when(explained, "cost:spike:delegation").otherwise("cost:spike:single"), value, F.col("top_round"))


def spike_cluster(profile: DataFrame) -> DataFrame:
    return finding(profile.filter("rounds >= 3 and last3_factor >= 4"), "cost:spike", "hint", "cost:spike:cluster", percent_text("last3_factor"))


def spike_top3(profile: DataFrame) -> DataFrame:
    return finding(profile.filter("top3_share >= 0.5"), "cost:spike", "hint", "cost:spike:top3", percent_text("top3_share"))


def cost_spikes(f: SessionFrames) -> DataFrame | None:
    if f.rounds is None:
        return None
    profile = cost_profile(f.rounds)
    return spike_single(profile).unionByName(spike_cluster(profile)).unionByName(spike_top3(profile))


def compaction_risk(f: SessionFrames) -> DataFrame:
    """Not among RULES: a late position says nothing about how full the context is."""
    late = f.metrics.select("session_id", F.explode("compaction_positions").alias("position")).filter("position >= 0.75")
    return finding(late, "context:compaction_risk", "warning", "context:compaction_risk", percent_text("position"))


Rule = Callable[[SessionFrames], "DataFrame | None"]
RULES: dict[str, Rule] = {
    "error_rate": error_rate, "rework_file": rework_file, "rework_tool": rework_tool, "subagent_failed": subagent_failed,
    "unsupported_claim": unsupported_claim, "overdelegation": overdelegation, "slow_turn": slow_turn, "slow_tool": slow_tool,
    "tool_timeout": tool_timeout, "capture_gap": capture_gap, "cost_spikes": cost_spikes,
}


def register_rule(name: str, rule: Rule) -> None:
    RULES[name] = rule


def session_findings(f: SessionFrames) -> DataFrame:
    """All rules' findings with ``rule_order``; they replace any earlier findings of the sessions."""
    parts = [r.withColumn("rule_order", F.lit(i)) for i, rule in enumerate(RULES.values()) if (r := rule(f)) is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Across sessions.

def within(at: Column, as_of: datetime, days: int) -> Column:
    """Strictly later than ``days`` before the reference time, which is a parameter, never the clock."""
    return (at > F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")) & (at <= F.lit(as_of))


def recurring_errors(events: DataFrame, as_of: datetime, days: int = 7, sessions: int = 3) -> DataFrame:
    """Error signatures that at least so many sessions show."""
    failed = events.filter((F.col("kind") == S.TOOL_RESULT) & F.col("failed") & within(F.col("ts"), as_of, days))
    return failed.groupBy("signature").agg(F.count_distinct("session_id").alias("sessions")).filter(F.col("sessions") >= sessions)


def recurring_findings(events: DataFrame, as_of: datetime) -> DataFrame:
    shown = events.filter((F.col("kind") == S.TOOL_RESULT) & F.col("failed") & within(F.col("ts"), as_of, 7)).select("session_id", "signature").distinct()
    hit = shown.join(recurring_errors(events, as_of), "signature")
    return finding(hit, "error:recurring", "warning", F.concat(F.lit("error:recurring:"), "signature"), F.col("sessions"), F.col("signature"))


def others_percentile(df: DataFrame, groups: list[str], value: str, p: float, tie: str, bins: int = 4096) -> DataFrame:
    """Adds ``others`` (rows of the group besides this one) and ``others_p``: their interpolated percentile.

    Of n sorted values without one, the wanted places are among three
    neighbouring places of all n, whichever is taken out. A count of each group's
    values in ``bins`` of equal width tells in which bins these places lie, and
    only the rows of those are sorted, so that no task sorts a whole group. Rows
    with a null value are left out.
    """
    spans = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("_n"))
    place = F.lit(p) * (F.col("_n") - 2)
    spans = spans.withColumns({"_lo": F.floor(place), "_f": place - F.floor(place)})
    width = (F.col("_high") - F.col("_low")) / bins
    bin_ = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_low")) / width))).otherwise(F.lit(0))
    binned = df.filter(F.col(value).isNotNull()).join(spans, groups).withColumn("_bin", bin_)
    ahead = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most ``bins`` rows
    counts = binned.groupBy(*groups, "_bin", "_lo").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
    wanted = counts.filter("_before <= _lo + 2 and _before + _c > _lo").select(*groups, "_bin", "_before")
    first = wanted.groupBy(*groups).agg(F.min("_before").alias("_first"))
    near = binned.join(wanted.select(*groups, "_bin"), [*groups, "_bin"]).join(first, groups)
    near = near.withColumn("_i", F.col("_first") + F.row_number().over(Window.partitionBy(*groups).orderBy(value, tie)) - 1)
    at = lambda k: F.max(F.when(F.col("_i") == F.col("_lo") + k, F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))))
    three = near.groupBy(*groups).agg(at(0).alias("_0"), at(1).alias("_1"), at(2).alias("_2"))
    joined = binned.join(three, groups, "left")
    own = F.struct(F.col(value).alias("v"), F.col(tie).alias("t"))
    low = F.when(own > F.col("_0"), F.col("_0.v")).otherwise(F.col("_1.v"))
    high = F.when(own > F.col("_1"), F.col("_1.v")).otherwise(F.coalesce("_2.v", "_1.v"))
    high = F.when(F.col("_f") == 0, low).otherwise(high)
    out = joined.withColumn("others", F.col("_n") - 1).withColumn("others_p", F.when(F.col("_n") > 1, low + F.col("_f") * (high - low)))
    return out.drop("_low", "_high", "_n", "_lo", "_f", "_bin", "_0", "_1", "_2")


def percentiles(df: DataFrame, groups: list[str], fields: dict[str, Column], p: float, bins: int = 4096) -> DataFrame:
    """A row for each group with the interpolated percentile of each field, all fields in one pass; null where a field has no value.

    Equal values are counted first, so that no value is a group of its own. The
    counts of ``bins`` of equal width, and then of as many inside the bins that hold
    the wanted places, tell which values must be sorted: those of a ``bins``-th of a
    ``bins``-th of a group's span. Groups may be null.
    """
    keys = [f"_g{i}" for i in range(len(groups))] + ["_field"]
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("_field"), value.cast("double").alias("_v")) for name, value in fields.items())))
    long = df.select(*(F.struct(g).alias(f"_g{i}") for i, g in enumerate(groups)), named.alias("_x")).select(*keys[:-1], "_x._field", "_x._v").filter("_v is not null")
    counted = long.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))  # structs are never null, so groups that are join by equality
    place = F.lit(p) * (F.sum("_c") - 1)
    spans = counted.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.floor(place).alias("_lo"), (place - F.floor(place)).alias("_f")).withColumn("_ahead", F.lit(0).cast("long"))
    ahead = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 * ``bins`` rows
    for _ in range(2):
        width = (F.col("_high") - F.col("_low")) / bins
        bin_ = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_low")) / width))).otherwise(F.lit(0))
        binned = counted.join(spans, keys).filter("_v between _low and _high").withColumn("_bin", bin_)
        sums = binned.groupBy(*keys, "_bin", "_lo", "_f", "_ahead").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        sums = sums.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_c").over(ahead), F.lit(0)))
        spans = sums.filter("_before <= _lo + 1 and _before + _c > _lo").groupBy(*keys, "_lo", "_f").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_before").alias("_ahead"))
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = counted.join(spans, keys).filter("_v between _low and _high").withColumn("_end", F.col("_ahead") + F.sum("_c").over(upto))
    at = lambda k: F.min(F.when(F.col("_end") > F.col("_lo") + k, F.col("_v")))
    low, high, part = at(0), at(1), F.first("_f")
    found = near.groupBy(*keys).agg(F.when(part == 0, low).otherwise(low + part * (high - low)).alias("_p"))
    every = df.select(*(F.struct(g).alias(f"_g{i}") for i, g in enumerate(groups))).distinct() if groups else df.sparkSession.range(1).select()
    row = found.groupBy(*keys[:-1]).agg(*(F.max(F.when(F.col("_field") == name, F.col("_p"))).alias(name) for name in fields))
    joined = every.join(row, keys[:-1], "left") if groups else row
    return joined.select(*(F.col(f"_g{i}")[g].alias(g) for i, g in enumerate(groups)), *fields)


def cost_outliers(sessions: DataFrame, groups: list[str], value: str, tie: str, at_least: int = 10) -> DataFrame:
    """Sessions that cost more than the 95th percentile of at least ten others of their group."""
    return others_percentile(sessions, groups, value, 0.95, tie).filter(F.col("others") >= at_least).filter(F.col(value) > F.col("others_p"))


@F.pandas_udf(StringType())
def outlier_text(cost: pd.Series, p: pd.Series, n: pd.Series) -> pd.Series:
    """Two digits behind the point, rounded on the binary values."""
    return pd.Series([f"{c:.2f} > p95 {q:.2f} ({k} sessions)" for c, q, k in zip(cost, p, n, strict=True)], dtype=str)


def cost_outlier_findings(sessions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Sessions (session_id, at, cost) of the last days that cost more than the 95th percentile of all others of these days, of any project; ten must be there."""
    recent = sessions.filter(F.col("at") > F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")).filter("cost is not null").withColumn("_all", F.lit(1))
    hit = cost_outliers(recent, ["_all"], "cost", "session_id")
    return finding(hit, "cost:outlier", "warning", "cost:outlier", outlier_text("cost", "others_p", "others"))


def metadata_leaks(violations: DataFrame) -> DataFrame:
    """(session_id, redactions) to findings."""
    return finding(violations.filter("redactions > 0"), "privacy:metadata_leak", "high", "privacy:metadata_leak", F.col("redactions"))


def finding_positions(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Adds ``at_seq``: the first event that a finding is about; null for findings about the session as a whole."""
    blamed = with_blamed_tool(events).filter((F.col("kind") == S.TOOL_RESULT) & F.col("failed"))
    spots = blamed.select("session_id", "seq", F.explode(F.array(
        F.struct(F.lit("rework:tool").alias("rule"), F.col("blamed").alias("ref")),
        F.struct(F.lit("error:recurring").alias("rule"), F.col("signature").alias("ref")))).alias("s"))
    slow = events.filter((F.col("kind") == S.TOOL) & (F.col("duration_ms") >= S.TIMEOUT_MS)).select(
        "session_id", "seq", F.struct(F.when(F.col("duration_ms") == S.TIMEOUT_MS, "latency:timeout").otherwise("latency:slow_turn").alias("rule"), F.col("name").alias("ref")).alias("s"))
    files = events.filter(F.col("kind") == S.TOOL).select("session_id", "seq", F.struct(F.lit("rework:file").alias("rule"), F.col("signature").alias("ref")).alias("s"))
    first = spots.unionByName(slow).unionByName(files).select("session_id", "seq", "s.rule", "s.ref").groupBy("session_id", "rule", "ref").agg(F.min("seq").alias("at_seq"))
    return findings.join(first, ["session_id", "rule", "ref"], "left")
