"""Metrics of a session, from its events and sub-agents. Missing is not zero: cost stays null where nothing was priced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.operators.lookup import as_of_last, price_lookup

TOKENS = S.TOKEN.names


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def ratio(above: Column, below: Column) -> Column:
    """0 where nothing stands below."""
    return F.when(below > 0, above / below).otherwise(F.lit(0.0))


def event_counts(events: DataFrame) -> DataFrame:
    failed = _is(S.TOOL_RESULT) & F.coalesce(F.col("failed"), F.lit(False))
    return events.groupBy("session_id").agg(
        F.count_if(_is(S.USER)).alias("rounds"), F.count_if(_is(S.TOOL)).alias("tools"), F.count_if(failed).alias("tool_errors"),
        F.count_if(_is(S.COMPACTION)).alias("compactions"), F.count("*").alias("events"),
    ).withColumn("error_rate", ratio(F.col("tool_errors"), F.col("tools")))


def tool_counts(events: DataFrame) -> DataFrame:
    """(session_id, name, n): calls of each tool."""
    return events.filter(_is(S.TOOL)).groupBy("session_id", "name").agg(F.count("*").alias("n"))


def with_blamed_tool(events: DataFrame) -> DataFrame:
    """Adds ``blamed``: of a failed result, the tool with its ref, else the last tool before it; empty if none."""
    calls = events.filter(_is(S.TOOL) & F.col("ref").isNotNull() & (F.col("ref") != "")).groupBy("session_id", "ref").agg(F.max_by("name", "seq").alias("_called"))
    before = as_of_last(events, ["session_id"], ["seq"], F.when(_is(S.TOOL), F.col("name")), "_last")
    return before.join(calls, ["session_id", "ref"], "left").withColumn("blamed", F.coalesce(F.when(F.col("_called") != "", F.col("_called")), "_last", F.lit(""))).drop("_called", "_last")


def tool_error_counts(events: DataFrame) -> DataFrame:
    """(session_id, name, n): failures by blamed tool; failures without one are not counted."""
    failed = with_blamed_tool(events).filter(_is(S.TOOL_RESULT) & F.col("failed"))
    return failed.filter("blamed != ''").groupBy("session_id", F.col("blamed").alias("name")).agg(F.count("*").alias("n"))


def as_map(counts: DataFrame, name: str) -> DataFrame:
    """(session_id, map of name to n); a session's distinct tools are few."""
    entries = F.sort_array(F.collect_list(F.struct("name", "n")))
    return counts.groupBy("session_id").agg(F.map_from_entries(entries).alias(name))


def latencies(events: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of the round durations; 0 where there are none."""
    took = F.when(_is(S.ROUND_END), F.col("duration_ms")).cast("double")  # percentile_disc gives doubles
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY took)")
    return events.withColumn("took", took).groupBy("session_id").agg(zero(disc(0.5), "p50_ms"), zero(disc(0.95), "p95_ms"), zero(F.max("took"), "max_ms"))


def token_sums(events: DataFrame) -> DataFrame:
    said = _is(S.ASSISTANT) & F.col("token").isNotNull()
    sums = [F.coalesce(F.sum(F.when(said, F.col(f"token.{t}"))), F.lit(0)).alias(t) for t in TOKENS]
    return events.groupBy("session_id").agg(*sums, F.count_if(said & (F.col("token.thinking") > 0)).alias("thinking_turns"))


def cache_share(sums: DataFrame) -> DataFrame:
    below = F.col("input") + F.col("cache_write") + F.col("cache_read")
    return sums.withColumn("cache_share", F.when(below > 0, F.col("cache_read") / below))


def priced(usage: DataFrame, name: str, prices: DataFrame) -> DataFrame:
    """Adds ``cost``: four of the five token counters at their price per million; null without a price.

    ``prices``: position, key, aliases, and a rate for each counter (null: free).
    """
    rates = prices.select(F.col("key").alias("price_key"), *(F.coalesce(F.col(t), F.lit(0.0)).alias(f"_{t}") for t in TOKENS if t != "thinking"))
    found = price_lookup(usage, name, prices).join(rates, "price_key", "left")
    terms = [F.coalesce(F.col(f"token.{t}"), F.lit(0)) * F.col(f"_{t}") / 1_000_000 for t in TOKENS if t != "thinking"]
    return found.withColumn("cost", F.when(F.col("token").isNotNull(), sum(terms[1:], terms[0]))).drop(*(f"_{t}" for t in TOKENS), "tier")


def _context_share() -> Column:
    return (F.coalesce(F.col("token.input"), F.lit(0)) + F.coalesce(F.col("token.cache_read"), F.lit(0))) / F.col("context_window")


def costs_and_context(events: DataFrame, subagents: DataFrame, prices: DataFrame) -> DataFrame:
    """``costs``, and ``context_use_max`` as ``context_use`` has it (null where that has no row), from one pass over the events."""
    windows = prices.filter("context_window > 0").groupBy(F.col("key").alias("_windowed")).agg(F.min("context_window").alias("context_window"))
    said = priced(events.filter(_is(S.ASSISTANT)), "name", prices).join(windows, F.col("name") == F.col("_windowed"), "left")
    own = said.groupBy("session_id").agg(F.sum("cost").alias("cost"), F.max(F.when(F.col("token").isNotNull(), _context_share())).alias("context_use_max"))
    sub = priced(subagents, "model", prices).groupBy("session_id").agg(F.sum("cost").alias("cost_subagents"))
    both = own.join(sub, "session_id", "full")
    total = F.when(F.col("cost").isNotNull() | F.col("cost_subagents").isNotNull(), F.coalesce("cost", F.lit(0.0)) + F.coalesce("cost_subagents", F.lit(0.0)))
    return both.withColumn("cost_total", total)


def costs(events: DataFrame, subagents: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost`` (main session), ``cost_subagents`` and ``cost_total``, which is null only if both are."""
    return costs_and_context(events, subagents, prices).drop("context_use_max")


def context_use(events: DataFrame, prices: DataFrame) -> DataFrame:
    """The fullest context of a session; models are matched by their exact name, and those without a window skipped."""
    windows = prices.filter("context_window > 0").select(F.col("key").alias("name"), "context_window")
    return events.filter(_is(S.ASSISTANT) & F.col("token").isNotNull()).join(windows, "name").groupBy("session_id").agg(F.max(_context_share()).alias("context_use_max"))


def rework(events: DataFrame, at_least: int = 2) -> DataFrame:
    """(session_id, signature, n): files changed at least so often."""
    changed = events.filter(_is(S.TOOL) & F.col("name").isin(*S.CHANGING_TOOLS) & (F.coalesce("signature", F.lit("")) != ""))
    return changed.groupBy("session_id", "signature").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)


def compaction_positions(events: DataFrame, kind: str = S.COMPACTION) -> DataFrame:
    """(session_id, seq, position): where in its session, from 0 to 1, each compaction stands."""
    own = Window.partitionBy("session_id")
    placed = events.withColumn("i", F.row_number().over(own.orderBy("seq"))).withColumn("n", F.count("*").over(own))
    return placed.filter(_is(kind)).select("session_id", "seq", (F.col("i") / F.col("n")).alias("position"))


def model_usage(events: DataFrame) -> DataFrame:
    said = events.filter(_is(S.ASSISTANT) & F.col("token").isNotNull())
    model = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("?"))
    return said.groupBy("session_id", model.alias("model")).agg(F.count("*").alias("calls"))


def subagent_models(subagents: DataFrame) -> DataFrame:
    model = F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit("?"))
    return subagents.groupBy("session_id", model.alias("model")).agg(F.count("*").alias("agents"))


def delegation(sessions: DataFrame, subagents: DataFrame) -> DataFrame:
    """Delegation ratios. ``sessions``: rounds, duration_ms, tools, output, cost_subagents, cost_total."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = subagents.groupBy("session_id").agg(
        F.count("*").alias("starts"), zero(F.sum("tools")).alias("sub_tools"), zero(F.sum("tool_errors")).alias("sub_errors"),
        zero(F.sum("duration_ms")).alias("sub_ms"), zero(F.sum("token.output")).alias("sub_output"),
        F.count_if(F.col("evidence") == "observed").alias("with_evidence"), F.max("depth").alias("depth_max"))
    s = sessions.join(sums, "session_id", "left").fillna(0, ["starts", "sub_tools", "sub_errors", "sub_ms", "sub_output", "with_evidence", "depth_max"])
    c = F.col
    return s.select(
        "session_id", "starts", "with_evidence", "depth_max",
        ratio(c("starts"), c("rounds")).alias("call_ratio"),
        ratio(zero(c("cost_subagents")), zero(c("cost_total"))).alias("cost_ratio"),
        ratio(c("sub_output"), c("output") + c("sub_output")).alias("output_ratio"),
        ratio(c("sub_ms"), c("duration_ms")).alias("time_ratio"),
        ratio(c("sub_tools"), c("tools") + c("sub_tools")).alias("tool_ratio"),
        ratio(c("sub_errors"), c("sub_tools")).alias("error_ratio"))


def session_metrics(events: DataFrame, subagents: DataFrame, prices: DataFrame) -> DataFrame:
    """All metrics, a row for each session that has events."""
    agents = subagents.groupBy("session_id").agg(F.count("*").alias("subagents"), F.max("depth").alias("depth_max"))
    positions = compaction_positions(events).groupBy("session_id").agg(F.sort_array(F.collect_list("position")).alias("compaction_positions"))
    out = event_counts(events).join(latencies(events), "session_id").join(token_sums(events), "session_id")
    for more in (as_map(tool_counts(events), "tools_by_name"), as_map(tool_error_counts(events), "tool_errors_by_name"), agents, positions, costs_and_context(events, subagents, prices)):
        out = out.join(more, "session_id", "left")
    return out.fillna(0, ["subagents", "depth_max"])
