"""Comparison of a session with its peers: medians, guarded ratios, deltas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbook.operators.rules import others_percentile, percentiles, within


def medians(sessions: DataFrame, fields: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """``n`` and the exact, interpolated median of each field (SQL expressions by name); without keys always one row, n = 0 and nulls if empty."""
    found = percentiles(sessions, keys or [], {name: F.expr(e) for name, e in fields.items()}, 0.5)
    if not keys:
        return sessions.agg(F.count("*").alias("n")).crossJoin(found)  # one row each
    counts = sessions.groupBy(*keys).agg(F.count("*").alias("n")).select(*(F.col(k).alias(f"_{k}") for k in keys), "n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return found.join(counts, same).select(*keys, "n", *fields)


#: The whole session benchmark: what a session is compared with its peers in. The three last ones need columns that not every source has.
PEER_BENCHMARK = {
    "cost_per_round": "cost / greatest(rounds, 1)", "output_per_round": "output div greatest(rounds, 1)", "tools_per_round": "tools div greatest(rounds, 1)", "rounds": "rounds",
    "error_rate": "error_rate", "duration_per_round_ms": "duration_ms div greatest(rounds, 1)", "p50_ms": "p50_ms", "p95_ms": "p95_ms", "subagents": "subagents",
}


def peer_benchmarks(sessions: DataFrame, as_of: datetime, days: int = 30, least_rounds: int = 5) -> DataFrame:
    """Each session with ``n``, the number of its peers, and their median in each field of the session benchmark.

    Peers are the other sessions of the same project and source that began in the
    last days and have five rounds; a session is none of its own. ``sessions`` has
    session_id, project, source, start and what the fields need. Sessions that are
    no peers themselves get the medians of all.
    """
    keys = ["project", "source"]
    recent = sessions.filter((F.col("start") > F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")) & (F.col("rounds") >= least_rounds))
    counts = recent.groupBy(*keys).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.expr(e).cast("double").alias("own")) for name, e in PEER_BENCHMARK.items())))
    long = recent.select("session_id", *keys, named.alias("x")).select("session_id", *keys, "x.*")
    others = others_percentile(long, [*keys, "field"], "own", 0.5, "session_id").groupBy("session_id").pivot("field", list(PEER_BENCHMARK)).agg(F.first("others_p"))
    inside = recent.select("session_id", *keys).join(counts, keys).select("session_id", (F.col("n") - 1).alias("n")).join(others, "session_id", "left")
    # A peer without a value in a field has all others that have one as its peers there.
    lacking = medians(recent, PEER_BENCHMARK, keys)
    inside = inside.join(sessions.select("session_id", *keys), "session_id").join(lacking.select(*keys, *(F.col(f).alias(f"_{f}") for f in PEER_BENCHMARK)), keys, "left")
    own = recent.select("session_id", *(F.expr(e).isNull().alias(f"_no_{f}") for f, e in PEER_BENCHMARK.items()))
    inside = inside.join(own, "session_id").select("session_id", "n", *(F.when(F.col(f"_no_{f}"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in PEER_BENCHMARK))
    outside = sessions.select("session_id", *keys).join(recent.select("session_id"), "session_id", "left_anti").join(lacking, keys, "left")
    outside = outside.select("session_id", F.coalesce("n", F.lit(0)).alias("n"), *PEER_BENCHMARK)
    return inside.unionByName(outside)


#: Expressions of the session benchmark. Whole numbers are divided whole.
SESSION_BENCHMARK = {
    "cost_per_round": "cost / greatest(rounds, 1)",
    "output_per_round": "output div greatest(rounds, 1)",
    "tools_per_round": "tools div greatest(rounds, 1)",
    "rounds": "rounds",
    "error_rate": "error_rate",
    "duration_per_round_ms": "duration_ms div greatest(rounds, 1)",
}


def peers(sessions: DataFrame, at: Column, as_of: datetime, days: int = 30, without: str | int | None = None) -> DataFrame:
    """The sessions of the last days that one is compared with; itself is none of them."""
    recent = sessions.filter(within(at, as_of, days))
    return recent.filter(F.col("session_id") != without) if without is not None else recent


def session_benchmark(sessions: DataFrame, keys: list[str] | None = None, least_rounds: int = 5) -> DataFrame:
    return medians(sessions.filter(F.col("rounds") >= least_rounds), SESSION_BENCHMARK, keys)


DELEGATION_BENCHMARK = {n: n for n in ("call_ratio", "cost_ratio", "output_ratio", "time_ratio", "tool_ratio")}


def delegation_benchmark(ratios: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Only sessions with sub-agents count here, unlike in the session benchmark."""
    return medians(ratios.filter("starts >= 1"), DELEGATION_BENCHMARK, keys)


def delta(value: Column, peers: Column, n: Column) -> Column:
    """none without peers, few below ten, even within 15 %, else above or below."""
    change = (value - peers) / peers
    return F.when((n == 0) | peers.isNull(), "none").when(n < 10, "few").when((peers == 0) | (F.abs(change) <= 0.15), "even").when(change > 0, "above").otherwise("below")
