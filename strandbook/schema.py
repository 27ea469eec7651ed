"""Types and enumerations of the session ledger."""

from __future__ import annotations

from pyspark.sql import types as T

# Event kinds, as a session's timeline has them.
USER, ASSISTANT, TOOL, TOOL_RESULT = "user", "assistant", "tool", "tool_result"
SUBAGENT, COMPACTION, ROUND_END, SYSTEM = "subagent", "compaction", "round_end", "system"

#: Finding states, highest rank first.
STATUS_RANK = ("relapse", "dissent", "confirmed", "in_review", "open", "rejected", "done", "obsolete")
SEVERITY_RANK = ("high", "warning", "hint")

#: Tools whose calls refer to a file, and those that change it. Fixed values.
FILE_TOOLS = ("Edit", "Write", "MultiEdit", "Read")
CHANGING_TOOLS = ("Edit", "Write", "MultiEdit")

TIMEOUT_MS = 120_000

TOKEN = T.StructType([T.StructField(n, T.LongType()) for n in ("input", "output", "cache_write", "cache_read", "thinking")])

EVENT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("failed", T.BooleanType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("token", TOKEN),
    T.StructField("ref", T.StringType()),
    T.StructField("error_class", T.StringType()),
    T.StructField("signature", T.StringType()),
])

SUBAGENT_ROW = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("agent_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("start", T.TimestampType()),
    T.StructField("end", T.TimestampType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("rounds", T.LongType()),
    T.StructField("tools", T.LongType()),
    T.StructField("tool_errors", T.LongType()),
    T.StructField("token", TOKEN),
    T.StructField("evidence", T.StringType()),
    T.StructField("outcome", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("ref", T.StringType()),
])
FINDING_COLUMNS = FINDING.names
