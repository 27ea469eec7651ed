"""Rounds: what a session does between one user turn and the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandbook import schema as S


def with_rounds(events: DataFrame) -> DataFrame:
    """Adds ``round`` (user turns so far) and ``display_round`` (at least 1)."""
    upto = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("round", F.sum(F.when(F.col("kind") == S.USER, 1).otherwise(0)).over(upto))
    return counted.withColumn("display_round", F.greatest("round", F.lit(1)))


def segments(events: DataFrame) -> DataFrame:
    """Events inside rounds: what comes before the first user turn, and the user turns themselves, are left out."""
    return with_rounds(events).filter((F.col("round") >= 1) & (F.col("kind") != S.USER))


def round_metrics(events: DataFrame) -> DataFrame:
    """One row for each round, also for empty ones; ``events`` needs a ``cost`` column (null: not priced)."""
    is_ = lambda k: (F.col("kind") == k)
    return with_rounds(events).filter("round >= 1").groupBy("session_id", "round").agg(
        F.coalesce(F.sum(F.when(is_(S.ASSISTANT), F.col("cost"))), F.lit(0.0)).alias("cost"),
        F.count_if(is_(S.TOOL_RESULT) & F.col("failed")).alias("tool_errors"),
        F.count_if(is_(S.SUBAGENT)).alias("subagent_starts"),
        F.coalesce(F.bool_or(is_(S.COMPACTION)), F.lit(False)).alias("compacted"),
        F.coalesce(F.max(F.when(is_(S.ROUND_END), F.col("duration_ms"))), F.lit(0)).alias("duration_ms"),
        F.coalesce(F.bool_or(is_(S.TOOL) & (F.coalesce("duration_ms", F.lit(0)) >= S.TIMEOUT_MS)), F.lit(False)).alias("timed_out"),
    )


def top_rounds(rounds: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The ``k`` rounds of each session with the largest ``by``; the earlier one first on ties. Adds ``rank``."""
    order = Window.partitionBy("session_id").orderBy(F.desc(by), "round")
    return rounds.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fan_out(rounds: DataFrame) -> DataFrame:
    """The most sub-agents that a session started within one round."""
    return rounds.groupBy("session_id").agg(F.max("subagent_starts").alias("fan_out_max"))


def cost_profile(rounds: DataFrame) -> DataFrame:
    """What the cost rules look at, a row for each session with at least five rounds that cost something."""
    by_cost = Window.partitionBy("session_id").orderBy(F.desc("cost"), "round")
    by_age = Window.partitionBy("session_id").orderBy(F.desc("round"))
    ranked = rounds.withColumn("by_cost", F.row_number().over(by_cost)).withColumn("by_age", F.row_number().over(by_age))
    top = lambda c: F.max(F.when(F.col("by_cost") == 1, F.col(c)))
    profile = ranked.groupBy("session_id").agg(
        F.median(F.when(F.col("cost") > 0, F.col("cost"))).alias("median_cost"),
        F.count_if(F.col("cost") > 0).alias("costly_rounds"),
        F.count("*").alias("rounds"),
        F.sum("cost").alias("total_cost"),
        top("cost").alias("top_cost"), top("round").alias("top_round"), top("subagent_starts").alias("top_starts"),
        F.sum(F.when(F.col("by_age") <= 3, F.col("cost")).otherwise(0.0)).alias("last3_cost"),
        F.sum(F.when(F.col("by_cost") <= 3, F.col("cost")).otherwise(0.0)).alias("top3_cost"),
    )
    return profile.filter("costly_rounds >= 5 and median_cost > 0 and total_cost > 0").withColumns({
        "top_factor": F.col("top_cost") / F.col("median_cost"),
        "top_share": F.col("top_cost") / F.col("total_cost"),
        "last3_factor": F.col("last3_cost") / (3 * F.col("median_cost")),
        "top3_share": F.col("top3_cost") / F.col("total_cost"),
    })
