"""What rows must be like before they are written: violations as a column, and appends that part good rows from bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TEXT = 500
MAX_MESSAGE = 20_000
# The words that these fields may have, and the forms of ids.
SCOPES = ("finding", "session", "pattern")
STATUSES = ("done", "obsolete", "open")
CLASSES = ("clean", "deviating", "hallucinated")
ROLES = ("user", "assistant", "codex", "system")
PROVIDERS = ("claude", "ollama", "openrouter", "requesty")
CLOUD = ("claude", "openrouter", "requesty")
PROTECTION = ("cloud-ok", "local")
AGREEMENTS = ("agreed", "dissent", "single")
CONVERSATION_ID = r"^c-\d{8}-\d{4}-[0-9a-f]{4}$"
RUN_ID = r"^p-\d{8}-\d{6}-[0-9a-f]{4}$"

col = F.col
empty = lambda c: F.coalesce(F.size(col(c)), F.lit(0)) == 0
at_least = lambda c, least: col(c).isNotNull() & (col(c) >= least)
text = lambda c, most=MAX_TEXT: F.length(F.coalesce(col(c), F.lit(""))) <= most


def _scope() -> dict[str, Column]:
    pattern = col("scope") == "pattern"
    return {
        "scope": col("scope").isin(*SCOPES),
        "pattern: one signature and no session": ~pattern | (F.coalesce(F.size("signatures"), F.lit(0)) == 1) & col("session_id").isNull(),
        "session_id": pattern | at_least("session_id", 1),
    }


def _ratio(c: str) -> Column:
    return col(c).isNull() | col(c).between(0, 1)


RATIOS = ("call_ratio", "cost_ratio", "output_ratio", "time_ratio", "tool_ratio")


def contracts() -> dict[str, dict[str, Column]]:
    """For each kind of row, conditions that hold for good ones, by what a violation is called."""
    return {
        "decision": {
            "signature": F.trim(F.coalesce("signature", F.lit(""))) != "",
            "status": col("status").isin(*STATUSES),
            "remark": text("remark"), "reason": text("reason"),
            "done needs an anchor": (col("status") != "done") | (F.coalesce("anchor_kind", F.lit("")) != "") & (F.coalesce("anchor_path", F.lit("")) != ""),
        },
        "review_run": _scope() | {
            "run_id": col("run_id").rlike(RUN_ID), "duration_ms": at_least("duration_ms", 0), "error": text("error"),
            "classes": F.coalesce(F.forall("classes", lambda x: x.isin(*CLASSES)), F.lit(True)),
        },
        "deep_analysis": {
            "scope": col("scope").isin(*SCOPES), "signature": F.length(F.coalesce("signature", F.lit(""))) >= 1, "session_id": at_least("session_id", 1),
            "position": at_least("position", 0), "stage": col("stage").isin(1, 2), "cause": text("cause"), "advice": text("advice"),
            "agreement": col("agreement").isin(*AGREEMENTS), "single has no second position": (col("agreement") != "single") | col("second_verdict").isNull(),
        },
        "chat_message": {
            "conversation_id": col("conversation_id").rlike(CONVERSATION_ID), "role": col("role").isin(*ROLES), "provider": col("provider").isin(*PROVIDERS),
            "protection": col("protection").isin(*PROTECTION), "text": col("text").isNotNull() & text("text", MAX_MESSAGE),
            "token_in": at_least("token_in", 0), "token_out": at_least("token_out", 0),
            "cloud only where allowed": ~col("provider").isin(*CLOUD) | (col("protection") == "cloud-ok"),
        },
        "review_request": {
            "scope": col("scope").isin(*SCOPES),
            "finding: session and signatures": (col("scope") != "finding") | ~empty("signatures") & col("session_id").isNotNull(),
            "session: session": (col("scope") != "session") | col("session_id").isNotNull(),
            "pattern: one signature and no session": (col("scope") != "pattern") | (F.coalesce(F.size("signatures"), F.lit(0)) == 1) & col("session_id").isNull(),
            "stage and run together": col("stage").isNull() == col("run_ref").isNull(),
        },
        "delegation_benchmark": {
            "n": at_least("n", 0), **{c: _ratio(c) for c in RATIOS},
            "no sessions, no ratios": (col("n") == 0) == F.forall(F.array(*RATIOS), lambda x: x.isNull()),
        },
    }


def with_violations(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``violations``: the names of the conditions that do not hold, or that cannot be told; empty for good rows. Other kinds pass."""
    rules = contracts().get(kind, {})
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def parted(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their violations."""
    marked = with_violations(df, kind)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def built_decisions(df: DataFrame) -> DataFrame:
    """Decisions in normal form: trimmed signature and anchor, empty instead of null texts, a default for who decided."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return df.withColumns({
        "signature": blank("signature"), "remark": F.coalesce("remark", F.lit("")), "reason": F.coalesce("reason", F.lit("")),
        "anchor_kind": F.nullif(blank("anchor_kind"), F.lit("")), "anchor_path": F.nullif(blank("anchor_path"), F.lit("")), "anchor_section": blank("anchor_section"),
        "decided_by": F.coalesce(F.nullif(F.col("decided_by"), F.lit("")), F.lit("Maintainer")),
    })


def verdicts_of_text(answers: DataFrame) -> DataFrame:
    """The verdicts in reviewers' answers (``answer``): what lies between the first [ and the last ] is read as JSON.

    Text that is none gives no rows. A verdict without a signature is left out;
    unknown words count as unclear, and a complexity that is not told as complex.
    """
    shape = "array<struct<signature: string, rule: string, verdict: string, complexity: string, category: string, advice: string>>"
    found = F.from_json(F.regexp_extract("answer", r"(?s)(\[.*\])", 1), shape)
    rows = answers.withColumn("v", F.explode(found)).filter(F.col("v.signature").isNotNull())
    word = lambda c, allowed, other: F.when(F.lower(c).isin(*allowed), F.lower(c)).otherwise(F.lit(other))
    return rows.select(*[c for c in answers.columns if c != "answer"], "v.signature", word(F.col("v.verdict"), ("yes", "no", "unclear"), "unclear").alias("verdict"),
                       word(F.col("v.complexity"), ("simple", "complex"), "complex").alias("complexity"), F.substring(F.coalesce("v.category", F.lit("")), 1, MAX_TEXT).alias("category"),
                       F.substring(F.coalesce("v.advice", F.lit("")), 1, MAX_TEXT).alias("advice"))


def conversations(messages: DataFrame) -> DataFrame:
    """Each conversation's messages in the order they were written, as one array."""
    own = F.struct(*[c for c in messages.columns if c not in ("conversation_id", "message_id")])
    return messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("message_id", own.alias("message")))).alias("messages"))
