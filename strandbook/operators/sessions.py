"""Session lists: filters, rows with what findings and reviews say about them, and the tiles above them."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.functions.origin import UNASSIGNED, choice
from strandbook.operators.lifecycle import group_status, latest_decisions, latest_verdicts, open_findings, relapses, statuses

RECURRING = "error:recurring:"
#: Events that say most: the first and last one, and those of these kinds.
SALIENT_KINDS = (S.SUBAGENT, S.COMPACTION)
LONG_ROUND_MS = 60_000
# What a session's document may say about these.
ENVIRONMENTS, CHANNELS, PERSONAS = ("terminal", "ide", "server"), ("terminal", "web", "api"), ("vico", "cura", "nova")
PROTECTED_PERSONA = "cura"


def when(*times: str) -> Column:
    """A session's time: its end, else its start, else when it was written down."""
    return F.coalesce(*map(F.col, times or ("end", "start", "written_at")))


def in_days(df: DataFrame, first: date, last: date, *times: str) -> DataFrame:
    """Rows whose time lies on one of the days from ``first`` to ``last``, the last one whole."""
    at = when(*times)
    return df.filter((at >= F.lit(first).cast("timestamp")) & (at < F.date_add(F.lit(last), 1).cast("timestamp")))


def of_project(sessions: DataFrame, aliases: DataFrame, project: str) -> DataFrame:
    """Sessions whose raw project stands for ``project``: by name, or by name and source where the alias has one.

    ``aliases``: name, source (null: any), project. Without an alias the name stands for itself.
    """
    raw = aliases.filter(F.col("project") == project).select(F.col("name").alias("_name"), F.col("source").alias("_source")).distinct()
    same = (F.col("project") == F.col("_name")) & (F.col("_source").isNull() | (F.col("source") == F.col("_source")))
    found = sessions.join(raw, same, "left_semi")
    listed = raw.agg(F.count("*").alias("_n"))  # one row
    itself = sessions.filter(F.col("project") == project).join(F.broadcast(listed), F.col("_n") == 0, "left_semi")
    return found.unionByName(itself)


def narrowed(sessions: DataFrame, **allowed: list[str]) -> DataFrame:
    """Sessions whose derived columns (source, context, environment, persona, project) have one of the values; none given means all.

    A context that is unassigned passes every choice of contexts.
    """
    for name, values in allowed.items():
        if values:
            own = F.col(name).isin(*values)
            sessions = sessions.filter(own | (F.col(name) == UNASSIGNED) if name == "context" else own)
    return sessions


def of_ids(sessions: DataFrame, ids: DataFrame) -> DataFrame:
    """The drill-down: sessions whose id is in ``ids`` (session_id)."""
    return sessions.join(ids.select("session_id").distinct(), "session_id", "left_semi")


def of_rule(findings: DataFrame, rule: str, prefix: bool = False) -> DataFrame:
    return findings.filter(F.col("rule").startswith(rule) if prefix else F.col("rule") == rule)


def session_rows(sessions: DataFrame, findings: DataFrame, decisions: DataFrame, verdicts: DataFrame, events: DataFrame | None = None, signature: str | None = None) -> DataFrame:
    """A row for each session, newest first: counts default to 0, an unknown cost stays null.

    ``open_findings`` counts findings that no effective decision closes;
    ``dissent`` is what the newest verdict says (session_id, written_at, dissents).
    With ``signature`` ``hits`` counts the session's failed results of it.
    """
    still = open_findings(findings.select("session_id", "signature"), decisions).groupBy("session_id").agg(F.count("*").alias("open_findings"))
    newest = verdicts.groupBy("session_id").agg((F.max_by("dissents", "written_at") > 0).alias("dissent"))
    rows = sessions.join(still, "session_id", "left").join(newest, "session_id", "left")
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("rounds", "tools", "tool_errors", "open_findings")}
    rows = rows.withColumns(filled | {
        "dissent": F.coalesce("dissent", F.lit(False)),
        "environment": choice(F.col("environment"), ENVIRONMENTS, ENVIRONMENTS[0]),
        "persona": choice(F.col("persona"), PERSONAS, PERSONAS[0]),
        "channel": choice(F.col("channel"), CHANNELS, CHANNELS[0]),
    })
    if signature is not None:
        failed = events.filter((F.col("kind") == S.TOOL_RESULT) & F.col("failed") & (F.col("signature") == signature))
        rows = rows.join(failed.groupBy("session_id").agg(F.count("*").alias("hits")), "session_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.orderBy(F.coalesce("start", "written_at").desc(), "session_id")


def visible_rows(rows: DataFrame, most: int = 30) -> DataFrame:
    """The first rows of a list, newest first, with ``status``: dissent before conspicuous before ok."""
    status = F.when(F.col("dissent"), "dissent").when(F.col("open_findings") > 0, "conspicuous").otherwise("ok")
    return rows.withColumn("status", status).orderBy(F.coalesce("start", "written_at").desc(), "session_id").limit(most)


def salient_events(events: DataFrame) -> DataFrame:
    """The events that a short timeline shows: first and last, sub-agents, compactions, failed results, rounds over a minute."""
    ends = events.groupBy("session_id").agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
    marked = (
        F.col("seq").isin(F.col("_first"), F.col("_last")) | F.col("kind").isin(*SALIENT_KINDS)
        | (F.col("kind") == S.TOOL_RESULT) & F.coalesce("failed", F.lit(False)) | (F.col("kind") == S.ROUND_END) & (F.coalesce("duration_ms", F.lit(0)) > LONG_ROUND_MS)
    )
    return events.join(ends, "session_id").filter(marked).drop("_first", "_last")


def done_groups(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all hits of a group are done: a hit is open unless its decision is neither open nor relapsed."""
    is_open = F.coalesce(F.col("decision").isin("open", "relapse"), F.lit(True))
    return findings.groupBy(*keys).agg(F.count("*").alias("hits"), F.count_if(is_open).alias("open_hits"), F.bool_and(~is_open).alias("all_done"))


def protected(sessions: DataFrame, private_projects: tuple[str, ...]) -> Column:
    """Whether a session must stay local: a violation of that class, a private project, or the guarded persona."""
    return F.coalesce(F.col("violation") == "local", F.lit(False)) | F.coalesce(F.lower("project").isin(*(p.lower() for p in private_projects)), F.lit(False)) | F.coalesce(F.col("persona") == PROTECTED_PERSONA, F.lit(False))


def compact(sessions: DataFrame) -> DataFrame:
    """What reviewers get: no events, of sub-agents their outcome only."""
    agent = lambda a: F.struct(*(a[c].alias(c) for c in ("type", "model", "rounds", "tools", "tool_errors", "duration_ms", "evidence", "outcome")))
    return sessions.select("session_id", "head", "capture", "metrics", "findings", F.transform("subagents", agent).alias("subagents"))


def sessions_of_event(events: DataFrame, sessions: DataFrame, key: str = "session_ref") -> DataFrame:
    """Events with their session; ``key`` is text and may be no number, then the event has none."""
    return events.withColumn("session_id", F.col(key).try_cast("long")).join(sessions, "session_id")


def decisions_with_session(decisions: DataFrame, versions: DataFrame) -> DataFrame:
    """Every decision with the newest version (largest id) of the session it is about, if any."""
    newest = versions.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "session_id"]), "version_id").alias("v"))
    return decisions.join(newest, "session_id", "left").select(*decisions.columns, "v.*")


def verdicts_of_session(verdicts: DataFrame, versions: DataFrame) -> DataFrame:
    """The newest verdict of each session: new ones name the session, old ones one of its versions."""
    new = verdicts.filter(F.col("session_id").isNotNull())
    old = verdicts.filter(F.col("session_id").isNull()).drop("session_id").join(versions.select("session_id", "version_id").distinct(), "version_id")
    every = new.unionByName(old.select(*new.columns))
    return every.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in every.columns if c != "session_id"]), F.struct("written_at", "verdict_id")).alias("v")).select("session_id", "v.*")


def own_or_legacy_verdicts(findings: DataFrame, own: DataFrame, legacy: DataFrame) -> DataFrame:
    """Adds ``verdict``: the finding's own, else a legacy one of its signature, or of its rule where it has no signature. Unclear is dissent."""
    by_signature = legacy.filter("coalesce(signature, '') != ''").groupBy("session_id", "signature").agg(F.max_by("result", "written_at").alias("_s"))
    by_rule = legacy.filter("coalesce(signature, '') = ''").groupBy("session_id", "rule").agg(F.max_by("result", "written_at").alias("_r"))
    found = findings.join(own.select("session_id", "signature", F.col("verdict").alias("_own")), ["session_id", "signature"], "left")
    found = found.join(by_signature, ["session_id", "signature"], "left").join(by_rule, ["session_id", "rule"], "left")
    old = F.coalesce("_s", F.when(F.coalesce("signature", F.lit("")) == "", F.col("_r")))
    return found.withColumn("verdict", F.coalesce("_own", F.when(old == "unclear", "dissent").otherwise(old))).drop("_own", "_s", "_r")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest pattern review of each signature that its signatures contain."""
    each = runs.filter("scope = 'pattern'").select(F.explode("signatures").alias("signature"), "run_id", "started_at")
    return each.groupBy("signature").agg(F.max_by(F.struct("run_id", "started_at"), F.struct("started_at", "run_id")).alias("r")).select("signature", "r.*")


def sessions_of_signature(findings: DataFrame, sessions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Each signature's sessions from the day on that lies ``days`` before the reference time, that day whole, each once."""
    recent = sessions.filter(when() >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")).select("session_id")
    return findings.select("signature", "session_id").join(recent, "session_id", "left_semi").distinct()


def classification(first: DataFrame, second: DataFrame, order: str | None = None) -> DataFrame:
    """Each session's class: the second reviewer's where there is one, else the first's; an unknown class counts as deviating.

    Of several second opinions on a session the last by ``order`` counts, without an order the greatest.
    """
    known = lambda c: F.when(F.lower(c).isin("clean", "deviating", "hallucinated"), F.lower(c)).otherwise("deviating")
    other = second.groupBy("signature", "session_id").agg((F.max_by("class", order) if order else F.max("class")).alias("_second"))
    return first.join(other, ["signature", "session_id"], "left").withColumn("class", F.when(F.col("_second").isNotNull(), known(F.col("_second"))).otherwise(known(F.col("class")))).drop("_second")


def signature_rows(sightings: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of the recurring-error tile: sessions and hits of each signature, and whether it is open, done, obsolete or relapsed.

    ``sightings``: signature, session_id, seen_at, hits. A signature with an open
    session is open; else its global decision counts, and it relapses if a later session shows it.
    """
    found = sightings.withColumn("raw", F.col("signature")).withColumn("signature", F.concat(F.lit(RECURRING), "raw"))
    still = open_findings(found.select("session_id", "signature"), decisions).select("signature").distinct().withColumn("_open", F.lit(True))
    again = relapses(decisions, found.select("signature", "session_id", "seen_at", "hits")).select("signature", F.col("sessions").alias("relapse_sessions"), F.col("hits").alias("relapse_hits"))
    world = latest_decisions(decisions.filter("session_id is null")).select("signature", F.col("status").alias("_world"))
    rows = found.groupBy("signature", "raw").agg(F.count_distinct("session_id").alias("sessions"), F.sum("hits").alias("hits"))
    rows = rows.join(still, "signature", "left").join(again, "signature", "left").join(world, "signature", "left")
    status = F.when(F.col("_open"), "open").when(F.col("relapse_sessions").isNotNull(), "relapse").when(F.col("_world") == "obsolete", "obsolete").otherwise("done")
    return rows.withColumn("status", status).drop("_open", "_world").orderBy(F.desc("sessions"), "signature")


def recurring_tile(rows: DataFrame) -> DataFrame:
    """One row: how many signatures are open or relapsed, and the one that most sessions have."""
    counts = F.col("status").isin("open", "relapse")
    top = F.max_by(F.struct("signature", "sessions", "hits"), F.when(F.col("status") == "open", F.struct("sessions", "signature")))
    return rows.agg(F.count_if(counts).alias("count"), top.alias("top")).select("count", F.coalesce("top.signature", F.lit("")).alias("top_signature"), F.coalesce("top.sessions", F.lit(0)).alias("top_sessions"), F.coalesce("top.hits", F.lit(0)).alias("top_hits"))


def rule_tiles(findings: DataFrame, sessions: DataFrame, decisions: DataFrame, tiles: dict[str, tuple[str, bool]], first: date, last: date) -> DataFrame:
    """Tile, session_id, open: the sessions of each tile's rule (or prefix) in the days, and whether a finding of them is still open.

    The session's own time counts, not when its findings were written down.
    """
    recent = in_days(sessions, first, last).select("session_id")
    name = F.lit(None).cast("string")
    for tile, (rule, prefix) in tiles.items():
        name = F.when(F.col("rule").startswith(rule) if prefix else F.col("rule") == rule, tile).otherwise(name)
    found = findings.withColumn("tile", name).filter("tile is not null").join(recent, "session_id", "left_semi")
    still = open_findings(found, decisions).select("tile", "session_id").distinct().withColumn("_open", F.lit(True))
    return found.select("tile", "session_id").distinct().join(still, ["tile", "session_id"], "left").select("tile", "session_id", F.coalesce("_open", F.lit(False)).alias("open"))


def marked_relapses(decided: DataFrame, decisions: DataFrame, sightings: DataFrame) -> DataFrame:
    """A session's decided signatures with ``status`` relapse where a later session shows the raw signature again, whenever that was."""
    again = relapses(decisions, sightings.withColumn("signature", F.concat(F.lit(RECURRING), "signature")))
    again = again.unionByName(relapses(decisions, sightings)).select("signature", F.lit(True).alias("_again")).distinct()
    status = F.when(F.col("_again") & F.col("status").isin("done", "obsolete"), "relapse").otherwise(F.col("status"))
    return decided.join(again, "signature", "left").withColumn("status", status).drop("_again")


def unassigned(sessions: DataFrame) -> DataFrame:
    """Sessions without a context or with a source that is unknown."""
    return sessions.filter((F.col("context") == UNASSIGNED) | (F.col("source") == "unknown"))


def top_then_alphabetical(sessions: DataFrame, by: str = "project", top: int = 5) -> DataFrame:
    """The values in the order of a filter list: the most frequent ones, then the rest by German rules. ``place`` counts from 1."""
    counts = sessions.groupBy(by).agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), by).limit(top).withColumn("_top", F.lit(True)).select(by, "_top")
    marked = counts.join(F.broadcast(first), by, "left")
    order = Window.orderBy(F.col("_top").desc_nulls_last(), F.when(F.col("_top"), -F.col("n")), F.collate(by, "de"))  # one row for each value
    return marked.withColumn("place", F.row_number().over(order)).drop("_top")


def drill_down(rows: DataFrame, sessions: DataFrame, status: DataFrame) -> DataFrame:
    """A signature's sessions, newest first, with their status."""
    return rows.join(sessions, "session_id").join(status, ["session_id", "signature"], "left").orderBy("signature", when().desc(), "session_id")


def around(lines: DataFrame, asked: DataFrame, most: int = 50) -> DataFrame:
    """The raw lines around a time: the first line not before it, else the last with a time, else the last, and n lines to either side.

    ``lines``: file, line, ts; ``asked``: file, at, n (1 to ``most``).
    """
    met = lines.join(asked, "file").groupBy("file", "at", "n").agg(
        F.min(F.when(F.col("ts") >= F.col("at"), F.col("line"))).alias("_after"), F.max(F.when(F.col("ts").isNotNull(), F.col("line"))).alias("_timed"), F.max("line").alias("_last"))
    n = F.greatest(F.lit(1), F.least(F.lit(most), F.col("n")))
    met = met.select("file", "at", F.coalesce("_after", "_timed", "_last").alias("position"), n.alias("n"))
    near = F.col("line").between(F.col("position") - F.col("n"), F.col("position") + F.col("n"))
    return lines.join(met, "file").filter(near).select("file", "at", "position", "line", "ts")


def reviewed_signatures(findings: DataFrame, legacy: DataFrame) -> DataFrame:
    """The signatures that a session's review may name: those of its findings and of its legacy verdicts, each once."""
    return findings.select("session_id", "signature").unionByName(legacy.select("session_id", "signature")).filter("signature != ''").distinct()


def session_answer(findings: DataFrame, sessions: DataFrame, decisions: DataFrame, running: DataFrame, runs: DataFrame, legacy: DataFrame, sightings: DataFrame, private_projects: tuple[str, ...] = ()) -> DataFrame:
    """What a session's page says of each finding (session_id, rule, signature): ``status``, ``verdict``, ``group_status``, ``running``, ``local``.

    Its status reckons with decisions, running reviews and the newest verdict; a
    legacy verdict (session_id, signature, rule, result) has no time, so any review
    run beats it, names a rule where it has no signature, and is dissent where it is
    unclear. ``verdict`` is that of review runs alone. ``group_status`` is the highest
    of its rule's findings in the session, ``running`` the session's running reviews,
    ``local`` whether the session must stay local.
    """
    named = F.coalesce(F.nullif(F.col("signature"), F.lit("")), "rule")
    old = legacy.select("session_id", named.alias("signature"), F.when(F.coalesce("result", F.lit("unclear")) == "unclear", "dissent").otherwise(F.col("result")).alias("result"), F.lit(None).cast("timestamp").alias("started_at"))
    every = runs.select("session_id", "signature", "result", "started_at").unionByName(old.filter("signature is not null"))
    told = statuses(findings.select("session_id", "rule", "signature"), decisions, running, every, sightings)
    groups = group_status(told, ["session_id", "rule"]).withColumnRenamed("status", "group_status")
    alive = running.filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("running"))
    own = sessions.select("session_id", protected(sessions, private_projects).alias("local"))
    out = told.join(latest_verdicts(runs), ["session_id", "signature"], "left").join(groups, ["session_id", "rule"]).join(alive, "session_id", "left").join(own, "session_id", "left")
    return out.select("session_id", "rule", "signature", "status", "verdict", "group_status", F.coalesce("running", F.lit(0)).alias("running"), "local")
