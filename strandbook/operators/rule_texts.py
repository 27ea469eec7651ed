"""What rules mean in plain words, as a dimension to join findings with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = ("Unknown rule", "There is no plain text for this rule yet.", "", "", "")
#: rule: title, meaning, in short, unit of the value, advice. Each meaning says the condition in operators/rules.py.
TEXTS = {
    "tool:error_rate": ("One call in five fails", "Failed results make up 20 % of the tool calls or more, and there are three at least. The value is their share.", "A fifth of the calls failed.", "", "Sort the failures by class; one class that leads points at its cause."),
    "rework:file": ("Failures around one file", "Calls of file tools name this file five times, and two failures are blamed on it. The value is calls/failures.", "A file with many calls and failures.", "calls/failures", "Open the first failing call on it and check what the file held then."),
    "rework:tool": ("One tool keeps failing", "Four failures are blamed on this tool: the one that a result names, else the last one called. The value is their number.", "Four failures of one tool.", "failures", "Compare the arguments of the failing calls."),
    "subagent:failed": ("Sub-agent without result", "Its last tool result failed with no text behind it, or it never wrote a text.", "A sub-agent ended in error or wrote nothing.", "", "Start it again with what it lacked, or do its part in the session."),
    "subagent:unsupported_claim": ("Result that names nothing", "It ended well, but its last text names no line of a file, no quoted code and no count of tests.", "A good outcome that names no evidence.", "", "Ask for places and figures, and check one of them."),
    "subagent:overdelegation": ("Delegation goes deep or wide", "Sub-agents stand three levels deep, or there are more than 25.", "Three levels or 26 sub-agents.", "", "See whether the lowest level did work of its own."),
    "latency:slow_turn": ("Long waits", "The 95th percentile of the rounds is over a minute, or calls of a tool took over two.", "Rounds over a minute or calls over two.", "", "Start with the longest call of the longest round."),
    "latency:timeout": ("Calls cut off at the limit", "Calls of a tool took exactly the two minutes that a call may take.", "Calls that ended at two minutes.", "calls", "Give the work to several calls."),
    "capture:gap": ("Channel not recorded", "The source of this session does not record its tokens, or does not record its durations.", "Tokens or durations are not recorded.", "", "Leave the session out of sums over that channel."),
    "context:compaction_risk": ("Late compaction", "The context was compacted in the last quarter of the session's events. The value is how far in.", "A compaction in the last quarter.", "", "Check whether what was decided early was still followed at the end."),
    "privacy:metadata_leak": ("Strings were redacted", "Strings of the record looked like a path, a key, an address or local content, and were replaced. The value is their number.", "The record held strings that must not be stored.", "strings", "Look up the field in the violations and clean it at its source."),
    "cost:spike": ("Cost spike", "A round cost five times the median and 15 % of all, the last three cost four medians each, or three rounds cost half of all.", "Cost gathers in few rounds.", "", "Open the dearest round: its context, its answers, and what it started."),
    "cost:outlier": ("Dear among all sessions", "It cost more than the 95th percentile of all other sessions of 30 days, of which there are ten at least.", "Above 95 % of all sessions' costs.", "", "Hold its cost per round against the medians of its peers."),
    "error:recurring": ("Recurring error", "Three sessions or more of seven days show this signature. The value is their number.", "Seen in three sessions of a week.", "sessions", "Decide on the signature once, with an anchor, so that a relapse shows."),
}


def rule_texts(spark: SparkSession) -> DataFrame:
    """rule, title, meaning, short, unit, advice."""
    return spark.createDataFrame([(rule, *text) for rule, text in TEXTS.items()], "rule string, title string, meaning string, short string, unit string, advice string")


def with_texts(findings: DataFrame, column: str = "signature") -> DataFrame:
    """Adds a rule's texts: of the longest known rule that the signature is or begins with, else the texts of an unknown one."""
    parts = F.split(column, ":")
    two, one = F.concat_ws(":", F.slice(parts, 1, 2)), F.element_at(parts, 1)
    dim = F.broadcast(rule_texts(findings.sparkSession))  # TEXTS has some dozen rows
    found = findings.withColumn("_rule", F.when(two.isin(*TEXTS), two).otherwise(one)).join(dim.withColumnRenamed("rule", "_rule"), "_rule", "left").drop("_rule")
    for name, other in zip(("title", "meaning", "short", "unit", "advice"), UNKNOWN, strict=True):
        found = found.withColumn(name, F.coalesce(name, F.lit(other)))
    return found
