"""What becomes of findings: decisions, reviews, relapse, status."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.operators.rules import within

RANK = {s: i for i, s in enumerate(S.STATUS_RANK)}


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The newest decision of each (signature, session_id); a null session_id is a global decision.

    On equal times one that closes beats one that reopens, as one closing row of a tie is enough.
    """
    closing = (F.col("status") != "open").cast("int")
    newest = F.max(F.struct("decided_at", closing.alias("closing"), "status"))
    return decisions.groupBy("signature", "session_id").agg(newest.alias("d")).select("signature", "session_id", "d.decided_at", "d.status")


def effective_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Adds ``decision`` and ``decided_at`` to (session_id, signature) rows: the newer of the global and the session's own decision.

    Two equi-joins, one for each scope, take the place of one join with an OR over a nullable scope.
    """
    newest = latest_decisions(decisions)
    world = newest.filter("session_id is null").select("signature", F.struct("decided_at", (F.col("status") != "open").cast("int").alias("closing"), "status").alias("_world"))
    own = newest.filter("session_id is not null").select("signature", "session_id", F.struct("decided_at", (F.col("status") != "open").cast("int").alias("closing"), "status").alias("_own"))
    found = findings.join(world, "signature", "left").join(own, ["signature", "session_id"], "left")
    best = F.greatest("_world", "_own")
    return found.withColumn("decision", best["status"]).withColumn("decided_at", best["decided_at"]).drop("_world", "_own")


def open_findings(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings whose effective decision does not close them."""
    return effective_decisions(findings, decisions).filter(F.coalesce(F.col("decision") == "open", F.lit(True))).drop("decision", "decided_at")


def relapses(decisions: DataFrame, sightings: DataFrame) -> DataFrame:
    """Signatures last globally decided ``done`` that later sessions show again.

    ``sightings``: signature, session_id, seen_at, hits. Only ``done`` can relapse, never ``obsolete``.
    """
    done = latest_decisions(decisions.filter("session_id is null")).filter("status = 'done'").select("signature", "decided_at")
    later = sightings.join(done, "signature").filter(F.col("seen_at") > F.col("decided_at"))
    return later.groupBy("signature", "decided_at").agg(F.sum("hits").alias("hits"), F.count_distinct("session_id").alias("sessions"))


def latest_verdicts(runs: DataFrame) -> DataFrame:
    """The newest verdict of each (session_id, signature); runs without a start time always lose."""
    newest = F.max_by("result", F.coalesce("started_at", F.lit("1900-01-01").cast("timestamp")))
    return runs.groupBy("session_id", "signature").agg(newest.alias("verdict"))


def statuses(findings: DataFrame, decisions: DataFrame, running: DataFrame, runs: DataFrame, sightings: DataFrame) -> DataFrame:
    """Adds ``status``: a closing decision (or its relapse), else a running review, else the newest verdict, else open.

    ``running``: signature, session_id, null for a review of the signature everywhere.
    """
    decided = effective_decisions(findings, decisions)
    again = relapses(decisions, sightings).select("signature", F.lit(True).alias("_again"))
    everywhere = running.filter("session_id is null").select("signature", F.lit(True).alias("_all")).distinct()
    here = running.filter("session_id is not null").select("signature", "session_id", F.lit(True).alias("_here")).distinct()
    joined = (
        decided.join(again, "signature", "left").join(everywhere, "signature", "left")
        .join(here, ["signature", "session_id"], "left").join(latest_verdicts(runs), ["session_id", "signature"], "left")
    )
    closed = F.col("decision").isNotNull() & (F.col("decision") != "open")
    status = (
        F.when(closed & (F.col("decision") == "done") & F.coalesce("_again", F.lit(False)), "relapse")
        .when(closed, F.col("decision"))
        .when(F.coalesce("_all", "_here", F.lit(False)), "in_review")
        .otherwise(F.coalesce("verdict", F.lit("open")))
    )
    return joined.withColumn("status", status).drop("_again", "_all", "_here", "verdict", "decision", "decided_at")


def rank_of(status: Column) -> Column:
    out = F.lit(len(RANK))
    for name, i in RANK.items():
        out = F.when(status == name, i).otherwise(out)
    return out


def group_status(df: DataFrame, keys: list[str]) -> DataFrame:
    """The highest-ranking status of each group."""
    return df.groupBy(*keys).agg(F.min_by("status", rank_of(F.col("status"))).alias("status"))


def reconcile(first: Column, second: Column) -> Column:
    """One verdict (yes, no, unclear) alone, or two together: confirmed, rejected or dissent."""
    alone = F.when(first == "yes", "confirmed").otherwise("rejected")
    agreed = F.when((first == second) & (first == "yes"), "confirmed").when((first == second) & (first == "no"), "rejected").otherwise("dissent")
    return F.when(second.isNull(), alone).otherwise(agreed)


def pair_verdicts(first: DataFrame, second: DataFrame, order: str | None = None) -> DataFrame:
    """Both reviewers' verdicts on each finding: by signature, else by rule where the signature is empty; missing is unclear.

    Equal ones stand, different ones are ``dissent``. Of several on one finding the
    first by ``order`` counts, without an order the least.
    """
    chosen = F.min_by("verdict", order) if order else F.min("verdict")
    by_signature = second.filter("signature != ''").groupBy("signature").agg(chosen.alias("_s"))
    by_rule = second.filter("coalesce(signature, '') = ''").groupBy("rule").agg(chosen.alias("_r"))
    both = first.join(by_signature, "signature", "left").join(by_rule, "rule", "left")
    other = F.coalesce("_s", "_r", F.lit("unclear"))
    return both.withColumn("second", other).withColumn("result", F.when(F.col("verdict") == other, other).otherwise("dissent")).drop("_s", "_r")


def stage(findings: DataFrame, history: DataFrame, as_of: datetime) -> DataFrame:
    """Adds ``stage``: 1 for small faults, else 2.

    ``findings``: signature, rule, severity, complexity, first_verdict, scope, relapse.
    ``history``: signature, session_id, started_at, second_opinion. A skipped second opinion
    anywhere in the past, a cost spike, a pattern review or an unclear verdict always mean 2.
    """
    recent = F.when(within(F.col("started_at"), as_of, 30), F.col("session_id"))
    past = history.groupBy("signature").agg(F.bool_or(F.col("second_opinion") == "skipped").alias("_skipped"), F.count_distinct(recent).alias("_sessions"))
    f = findings.join(past, "signature", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    small = (F.col("severity") == "hint") & (F.col("complexity") == "simple") & (F.coalesce("_sessions", F.lit(0)) < 3) & ~no("relapse")
    forced = no("_skipped") | (F.col("rule") == "cost:spike") | (F.col("scope") == "pattern") | (F.col("first_verdict") == "unclear")
    return f.withColumn("stage", F.when(F.coalesce(forced, F.lit(False)), 2).when(small, 1).otherwise(2)).drop("_skipped", "_sessions")


def pattern_rollup(sightings: DataFrame, status: DataFrame) -> DataFrame:
    """Per signature: sessions, projects, last seen, findings of each status, and the group's status."""
    seen = sightings.groupBy("signature").agg(
        F.count_distinct("session_id").alias("sessions"), F.sort_array(F.collect_set("project")).alias("projects"), F.max("seen_at").alias("last_seen"))
    spread = status.groupBy("signature", "status").agg(F.count("*").alias("n"))
    spread = spread.groupBy("signature").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    return seen.join(spread, "signature", "left").join(group_status(status, ["signature"]), "signature", "left")


def grouped_findings(findings: DataFrame) -> DataFrame:
    """Findings by rule: worst severity, first place, hits; worst and then first rules first."""
    rank = F.array_position(F.array(*map(F.lit, S.SEVERITY_RANK)), F.col("severity"))
    return findings.groupBy("session_id", "rule").agg(
        F.min_by("severity", rank).alias("severity"), F.min("position").alias("first_position"), F.count("*").alias("hits"),
    ).orderBy("session_id", F.array_position(F.array(*map(F.lit, S.SEVERITY_RANK)), F.col("severity")), "first_position")


def consensus(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two analyses agree if verdict and category do; categories may differ by containment or three edits.

    Adds ``result``: the verdict, ``dissent``, or ``single`` without a second one; an unclear one is dissent.
    """
    from strandbook.functions.text import plain_category

    a, b = plain_category(F.col("category")), plain_category(F.col("category_2"))
    near = (a == b) | a.contains(b) | b.contains(a) | F.levenshtein(a, b, 3).between(0, 3)
    joined = first.join(second.select(*keys, F.col("verdict").alias("verdict_2"), F.col("category").alias("category_2")), keys, "left")
    unclear = (F.col("verdict") == "unclear") | (F.col("verdict_2") == "unclear")
    result = F.when(F.col("verdict_2").isNull(), "single").when(unclear | (F.col("verdict") != F.col("verdict_2")) | ~near, "dissent").otherwise(F.col("verdict"))
    return joined.withColumn("result", result)


def anchors(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``anchored``: the file exists and has the first 40 characters of the section, whatever the case.

    Decisions without an anchor are older than anchors and count as anchored. ``files``: path, content.
    """
    found = decisions.join(files, "path", "left")
    has = F.lower("content").contains(F.lower(F.substring("section", 1, 40)))
    return found.withColumn("anchored", F.when(F.col("path").isNull(), True).otherwise(F.coalesce(has, F.lit(False)))).drop("content")


def overlapping_runs(wanted: DataFrame, running: DataFrame, as_of: datetime, minutes: int = 30) -> DataFrame:
    """Runs still alive whose signatures overlap with the wanted ones of the same session."""
    alive = running.filter((F.col("started_at") > F.lit(as_of) - F.expr(f"INTERVAL {minutes} MINUTES")))
    return wanted.select("session_id", F.col("signatures").alias("_wanted")).join(alive, "session_id").filter(F.arrays_overlap("_wanted", "signatures")).drop("_wanted")
