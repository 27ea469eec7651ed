"""The session ledger's frames, projected onto the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.functions.text import hash_prefix

#: The reference time of all queries over events; no query reads the clock.
AS_OF = datetime(2024, 1, 31)
#: What an event type stands for.
KINDS = {"view": S.USER, "click": S.TOOL, "error": S.TOOL_RESULT, "purchase": S.ASSISTANT, "signup": S.ROUND_END}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a session; an event's place is its rank by time and id."""
    raw = table(spark, sf_dir, "events")
    kind = F.lit(S.SYSTEM)
    for name, means in KINDS.items():
        kind = F.when(F.col("event_type") == name, means).otherwise(kind)
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    placed = raw.select(
        F.col("user_id").alias("session_id"), "event_id", "ts", kind.alias("kind"), "event_type", k.alias("k"), "value",
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"))
    return placed.withColumns({
        "name": F.concat(F.lit("t"), F.col("k") % 7),
        "failed": F.col("kind") == S.TOOL_RESULT,
        "duration_ms": F.when(F.col("kind").isin(S.ROUND_END, S.TOOL), F.round(F.col("value") * 1000).cast("long")),
        "cost": F.when(F.col("kind") == S.ASSISTANT, F.col("value")),
        "signature": hash_prefix(F.concat_ws("|", "event_type", "k"), 12),
        "ref": F.lit(None).cast("string"),
        "project": (F.col("session_id") % 5).cast("string"),
        "source": (F.col("session_id") % 2).cast("string"),
    })


#: The same frame for DuckDB.
EVENTS_SQL = """
ev AS (
  SELECT *, 't' || CAST(k % 7 AS VARCHAR) AS name, kind = 'tool_result' AS failed,
    CASE WHEN kind IN ('round_end', 'tool') THEN CAST(round(value * 1000) AS BIGINT) END AS duration_ms,
    CASE WHEN kind = 'assistant' THEN value END AS cost,
    substr(sha256(event_type || '|' || CAST(k AS VARCHAR)), 1, 12) AS signature,
    CAST(session_id % 5 AS VARCHAR) AS project, CAST(session_id % 2 AS VARCHAR) AS source
  FROM (
    SELECT user_id AS session_id, event_id, ts, event_type, value,
      CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'tool' WHEN 'error' THEN 'tool_result'
        WHEN 'purchase' THEN 'assistant' WHEN 'signup' THEN 'round_end' ELSE 'system' END AS kind,
      TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
    FROM events)
)"""
ROUNDS_SQL = EVENTS_SQL + """,
rounded AS (
  SELECT *, sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS round FROM ev
),
rm AS (
  SELECT session_id, round, coalesce(sum(cost) FILTER (kind = 'assistant'), 0) AS cost,
    count(*) FILTER (kind = 'tool_result' AND failed) AS tool_errors, 0 AS subagent_starts,
    coalesce(max(duration_ms) FILTER (kind = 'round_end'), 0) AS duration_ms,
    coalesce(bool_or(kind = 'tool' AND duration_ms >= 120000), FALSE) AS timed_out
  FROM rounded WHERE round >= 1 GROUP BY session_id, round
)"""
