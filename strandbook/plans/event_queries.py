"""Queries over the events table: rounds, metrics, rules, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.operators import lifecycle, metrics, rounds, rules
from strandbook.plans.proxy import AS_OF, EVENTS_SQL, ROUNDS_SQL, events

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


@query(f"""WITH {EVENTS_SQL}
SELECT signature, count(DISTINCT session_id) AS sessions FROM ev
WHERE failed AND ts > TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31'
GROUP BY signature HAVING count(DISTINCT session_id) >= 3""")
def recurring_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.recurring_errors(events(spark, sf_dir), AS_OF)


@query(f"""WITH {EVENTS_SQL}, shown AS (SELECT DISTINCT session_id, signature FROM ev WHERE failed AND ts > TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31')
SELECT session_id, 'error:recurring' AS rule, 'warning' AS severity, 'error:recurring:' || signature AS signature,
  CAST(count(*) OVER (PARTITION BY signature) AS VARCHAR) AS value, signature AS ref
FROM shown QUALIFY count(*) OVER (PARTITION BY signature) >= 3""")
def recurring_error_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.recurring_findings(events(spark, sf_dir), AS_OF)


@query(f"""WITH {EVENTS_SQL}
SELECT signature, count(DISTINCT session_id) AS sessions, string_agg(DISTINCT project, ',' ORDER BY project) AS projects, max(ts) AS last_seen
FROM ev WHERE failed GROUP BY signature""")
def error_pattern_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir).filter("failed").withColumn("seen_at", F.col("ts"))
    none = seen.select("signature", F.lit("open").alias("status")).limit(0)
    out = lifecycle.pattern_rollup(seen, none)
    return out.select("signature", "sessions", F.array_join("projects", ",").alias("projects"), "last_seen")


@query(f"""WITH {EVENTS_SQL}
SELECT session_id, count(*) FILTER (kind = 'user') AS rounds, count(*) FILTER (kind = 'tool') AS tools,
  count(*) FILTER (failed) AS tool_errors, 0::BIGINT AS compactions, count(*) AS events,
  round(CASE WHEN count(*) FILTER (kind = 'tool') > 0 THEN count(*) FILTER (failed) / count(*) FILTER (kind = 'tool') ELSE 0 END, 6) AS error_rate
FROM ev GROUP BY session_id""")
def event_counts_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_counts(events(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 6))


@query(f"WITH {EVENTS_SQL} SELECT session_id, name, count(*) AS n FROM ev WHERE kind = 'tool' GROUP BY ALL")
def tool_counts_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = metrics.as_map(metrics.tool_counts(events(spark, sf_dir)), "by_name")
    return maps.select("session_id", F.explode("by_name").alias("name", "n"))


BLAMED = """, blamed AS (SELECT *, last_value(CASE WHEN kind = 'tool' THEN name END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tool FROM ev)"""


@query(f"WITH {EVENTS_SQL}{BLAMED} SELECT session_id, event_id, coalesce(tool, '') AS blamed FROM blamed WHERE failed")
def error_to_previous_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_blamed_tool(events(spark, sf_dir)).filter("failed").select("session_id", "event_id", "blamed")


@query(f"WITH {EVENTS_SQL}{BLAMED} SELECT session_id, tool AS name, count(*) AS n FROM blamed WHERE failed AND tool IS NOT NULL GROUP BY ALL HAVING count(*) >= 4")
def failures_per_tool_ge4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tool_error_counts(events(spark, sf_dir)).filter("n >= 4")


@query(f"""WITH {EVENTS_SQL} SELECT session_id, coalesce(quantile_disc(duration_ms, 0.5) FILTER (kind = 'round_end'), 0) AS p50_ms,
  coalesce(quantile_disc(duration_ms, 0.95) FILTER (kind = 'round_end'), 0) AS p95_ms, coalesce(max(duration_ms) FILTER (kind = 'round_end'), 0) AS max_ms
FROM ev GROUP BY session_id""")
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latencies(events(spark, sf_dir))


@query(f"WITH {ROUNDS_SQL} SELECT session_id, event_id, CAST(round AS BIGINT) AS round, CAST(greatest(round, 1) AS BIGINT) AS display_round FROM rounded")
def round_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.with_rounds(events(spark, sf_dir)).select("session_id", "event_id", "round", "display_round")


@query(f"WITH {ROUNDS_SQL} SELECT session_id, CAST(round AS BIGINT) AS round, round(cost, 6) AS cost, tool_errors, duration_ms, timed_out FROM rm")
def round_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.round_metrics(events(spark, sf_dir)).select("session_id", "round", r6("cost"), "tool_errors", "duration_ms", "timed_out")


def _top(by: str) -> str:
    return f"""WITH {ROUNDS_SQL} SELECT session_id, CAST(round AS BIGINT) AS round, round(cost, 6) AS cost, duration_ms,
row_number() OVER (PARTITION BY session_id ORDER BY {by} DESC, round) AS rank FROM rm QUALIFY rank <= 3"""


@query(_top("cost"))
def round_cost_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.top_rounds(rounds.round_metrics(events(spark, sf_dir)), "cost").select("session_id", "round", r6("cost"), "duration_ms", F.col("rank").cast("long").alias("rank"))


@query(_top("duration_ms"))
def slowest_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.top_rounds(rounds.round_metrics(events(spark, sf_dir)), "duration_ms").select("session_id", "round", r6("cost"), "duration_ms", F.col("rank").cast("long").alias("rank"))


PROFILE = ROUNDS_SQL + """, placed AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY cost DESC, round) AS by_cost, row_number() OVER (PARTITION BY session_id ORDER BY round DESC) AS by_age FROM rm),
profile AS (SELECT session_id, median(cost) FILTER (cost > 0) AS m, sum(cost) AS total, count(*) AS n, max(cost) AS top, max(round) FILTER (by_cost = 1) AS top_round,
  sum(cost) FILTER (by_age <= 3) AS last3, sum(cost) FILTER (by_cost <= 3) AS top3
  FROM placed GROUP BY session_id HAVING count(*) FILTER (cost > 0) >= 5)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounds.cost_profile(rounds.round_metrics(events(spark, sf_dir)))


@query(f"WITH {PROFILE} SELECT session_id, CAST(top_round AS BIGINT) AS round, 'warning' AS severity, round(top / m, 6) AS top_factor, round(top / total, 6) AS top_share FROM profile WHERE top >= 5 * m AND top >= 0.15 * total")
def cost_spike_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _profile(spark, sf_dir)
    hits = rules.spike_single(profile).select("session_id", "severity")
    return hits.join(profile, "session_id").select("session_id", F.col("top_round").alias("round"), "severity", r6("top_factor"), r6("top_share"))


@query(f"WITH {PROFILE} SELECT session_id, round(last3 / (3 * m), 6) AS last3_factor FROM profile WHERE n >= 3 AND last3 / (3 * m) >= 4")
def cost_spike_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _profile(spark, sf_dir)
    return rules.spike_cluster(profile).select("session_id").join(profile, "session_id").select("session_id", r6("last3_factor"))


@query(f"WITH {PROFILE} SELECT session_id, round(top3 / total, 6) AS top3_share FROM profile WHERE top3 / total >= 0.5")
def cost_spike_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = _profile(spark, sf_dir)
    return rules.spike_top3(profile).select("session_id").join(profile, "session_id").select("session_id", r6("top3_share"))


@query(f"""WITH {EVENTS_SQL}, p AS (SELECT session_id, event_id, kind, row_number() OVER (PARTITION BY session_id ORDER BY seq) / count(*) OVER (PARTITION BY session_id) AS position FROM ev)
SELECT session_id, event_id, round(position, 6) AS position FROM p WHERE kind = 'round_end'""")
def compaction_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    found = metrics.compaction_positions(ev, S.ROUND_END)
    return found.join(ev.select("session_id", "seq", "event_id"), ["session_id", "seq"]).select("session_id", "event_id", r6("position"))


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT session_id, count(*) FILTER (failed) AS e, count(*) FILTER (kind = 'tool') AS t FROM ev GROUP BY session_id)
SELECT session_id, 'tool:error_rate' AS rule, 'warning' AS severity, printf('%.1f %%', e / t * 100) AS value FROM c WHERE t > 0 AND e / t >= 0.2 AND e >= 3""")
def error_rate_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    frames = rules.SessionFrames(ev, ev, metrics.event_counts(ev), ev)
    return rules.error_rate(frames).select("session_id", "rule", "severity", "value")


@query(f"WITH {EVENTS_SQL} SELECT session_id, name, count(*) AS n FROM ev WHERE kind = 'tool' AND duration_ms > 120000 GROUP BY ALL")
def slow_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    hits = rules.slow_tool(rules.SessionFrames(ev, ev, ev, ev))
    return hits.select("session_id", F.col("ref").alias("name"), F.substring_index("value", " ", 1).cast("long").alias("n"))


# Sightings: a session shows a signature. Decisions derive from it: every k divisible by 3 was once decided.
SIGHTINGS = EVENTS_SQL + """, seen AS (SELECT signature, min(k) AS k, session_id, max(ts) AS seen_at, count(*) AS hits FROM ev WHERE failed GROUP BY signature, session_id),
dec AS (SELECT DISTINCT signature, NULL::BIGINT AS session_id, CASE WHEN k % 9 = 0 THEN 'obsolete' ELSE 'done' END AS status, TIMESTAMP '2024-01-15' AS decided_at FROM seen WHERE k % 3 = 0
  UNION ALL SELECT signature, session_id, 'open', TIMESTAMP '2024-01-20' FROM seen WHERE k % 6 = 0 AND session_id % 4 = 0
  UNION ALL SELECT signature, session_id, 'done', TIMESTAMP '2024-01-18' FROM seen WHERE k % 5 = 1 AND session_id % 3 = 0)"""


def sightings(ev: DataFrame) -> DataFrame:
    return ev.filter("failed").groupBy("signature", "session_id").agg(F.min("k").alias("k"), F.max("ts").alias("seen_at"), F.count("*").alias("hits"))


def decisions(seen: DataFrame) -> DataFrame:
    at = lambda d: F.lit(f"2024-01-{d}").cast("timestamp").alias("decided_at")
    world = seen.filter("k % 3 = 0").select("signature", F.lit(None).cast("long").alias("session_id"), F.when(F.col("k") % 9 == 0, "obsolete").otherwise("done").alias("status"), at(15)).distinct()
    again = seen.filter("k % 6 = 0 and session_id % 4 = 0").select("signature", "session_id", F.lit("open").alias("status"), at(20))
    own = seen.filter("k % 5 = 1 and session_id % 3 = 0").select("signature", "session_id", F.lit("done").alias("status"), at(18))
    return world.unionByName(again).unionByName(own)


EFFECTIVE = SIGHTINGS + """, eff AS (SELECT s.signature, s.session_id, s.k, d.status, d.decided_at,
  row_number() OVER (PARTITION BY s.signature, s.session_id ORDER BY d.decided_at DESC NULLS LAST, (d.status <> 'open')::INT DESC) AS rn
  FROM seen s LEFT JOIN dec d ON d.signature = s.signature AND (d.session_id IS NULL OR d.session_id = s.session_id))"""


@query(f"WITH {EFFECTIVE} SELECT signature, session_id, status AS decision, decided_at FROM eff WHERE rn = 1")
def decision_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sightings(events(spark, sf_dir))
    return lifecycle.effective_decisions(seen.select("signature", "session_id"), decisions(seen)).select("signature", "session_id", "decision", "decided_at")


@query(f"WITH {EFFECTIVE} SELECT signature, session_id FROM eff WHERE rn = 1 AND coalesce(status, 'open') = 'open'")
def open_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sightings(events(spark, sf_dir))
    return lifecycle.open_findings(seen.select("signature", "session_id"), decisions(seen))


RELAPSE = """, rel AS (SELECT s.signature, d.decided_at, CAST(sum(s.hits) AS BIGINT) AS hits, count(DISTINCT s.session_id) AS sessions
  FROM seen s JOIN dec d ON d.signature = s.signature AND d.session_id IS NULL AND d.status = 'done' WHERE s.seen_at > d.decided_at GROUP BY ALL)"""


@query(f"WITH {SIGHTINGS}{RELAPSE} SELECT * FROM rel")
def relapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sightings(events(spark, sf_dir))
    return lifecycle.relapses(decisions(seen), seen)


STATUS = EFFECTIVE + RELAPSE + """, run AS (SELECT DISTINCT signature FROM seen WHERE k % 7 = 2),
ver AS (SELECT signature, session_id, CASE WHEN k % 4 = 0 THEN 'confirmed' WHEN k % 4 = 1 THEN 'dissent' ELSE 'rejected' END AS result FROM seen WHERE session_id % 2 = 0),
st AS (SELECT e.signature, e.session_id, CASE WHEN e.status = 'done' AND rel.signature IS NOT NULL THEN 'relapse' WHEN e.status <> 'open' THEN e.status
  WHEN run.signature IS NOT NULL THEN 'in_review' ELSE coalesce(ver.result, 'open') END AS status
  FROM eff e LEFT JOIN rel ON rel.signature = e.signature LEFT JOIN run ON run.signature = e.signature
  LEFT JOIN ver ON ver.signature = e.signature AND ver.session_id = e.session_id WHERE e.rn = 1)"""


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sightings(events(spark, sf_dir))
    running = seen.filter("k % 7 = 2").select("signature", F.lit(None).cast("long").alias("session_id")).distinct()
    result = F.when(F.col("k") % 4 == 0, "confirmed").when(F.col("k") % 4 == 1, "dissent").otherwise("rejected")
    runs = seen.filter("session_id % 2 = 0").select("signature", "session_id", result.alias("result"), F.col("seen_at").alias("started_at"))
    return lifecycle.statuses(seen.select("signature", "session_id"), decisions(seen), running, runs, seen)


@query(f"WITH {STATUS} SELECT signature, session_id, status FROM st")
def status_derivation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).select("signature", "session_id", "status")


@query(f"WITH {STATUS} SELECT DISTINCT signature, session_id FROM st WHERE status = 'open'")
def open_findings_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statuses(spark, sf_dir).filter("status = 'open'").select("signature", "session_id").distinct()


@query(f"""WITH {STATUS}, ranked AS (SELECT *, list_position(['relapse', 'dissent', 'confirmed', 'in_review', 'open', 'rejected', 'done', 'obsolete'], status) AS p FROM st)
SELECT signature, arg_min(status, p) AS status FROM ranked GROUP BY signature""")
def pattern_group_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.group_status(_statuses(spark, sf_dir), ["signature"])


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT session_id, event_id, signature, k % 3 AS value,
  lag(k % 3) OVER (PARTITION BY session_id, name ORDER BY seq) AS was, name FROM ev WHERE failed)
SELECT session_id, event_id, name, value FROM w WHERE was IS NULL OR was <> value""")
def watch_emit_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandbook.streaming.watch import changed

    ev = events(spark, sf_dir).filter("failed").withColumn("value", F.col("k") % 3)
    return changed(ev, ["session_id", "name"], "seq", "value").select("session_id", "event_id", "name", "value")


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM events e JOIN events p ON p.user_id = e.user_id
WHERE e.event_type = 'error' AND p.event_type = 'purchase' AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 75 MINUTE""")
def interval_join_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandbook.operators.lookup import intervals_join

    ev = events(spark, sf_dir)
    points = ev.filter("failed").select("session_id", "event_id", F.col("ts").alias("at"))
    spans = ev.filter(F.col("kind") == S.ASSISTANT).select("session_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 60 MINUTES")).alias("end"))
    return intervals_join(points, spans, "at", "begin", "end", ["session_id"], 15, 60).select("event_id", "purchase_id")


@query(f"""WITH {EVENTS_SQL} SELECT p.event_id AS point_id, coalesce((SELECT max(e.seq) FROM ev e WHERE e.session_id = p.session_id AND e.kind = 'tool' AND e.ts <= p.ts), 0) AS seq
FROM ev p WHERE p.failed""")
def watch_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandbook.operators.lookup import latest_before

    ev = events(spark, sf_dir)
    points = ev.filter("failed").select("session_id", "ts", F.col("event_id").alias("point_id"))
    return latest_before(ev.filter(F.col("kind") == S.TOOL), points, ["session_id"], "ts", "seq").select("point_id", "seq")


@query(f"""WITH {EVENTS_SQL} SELECT e.session_id, e.event_id, (SELECT count(*) FROM ev t WHERE t.session_id = e.session_id AND t.kind = 'tool' AND t.seq BETWEEN e.seq - 5 AND e.seq + 5) AS tools_near FROM ev e WHERE e.failed""")
def raw_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    near = F.count_if(F.col("kind") == S.TOOL).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(-5, 5))
    return ev.withColumn("tools_near", near).filter("failed").select("session_id", "event_id", "tools_near")


@query(f"""WITH {EVENTS_SQL}, h AS (SELECT signature, min(k) AS k, count(DISTINCT session_id) FILTER (ts > TIMESTAMP '2024-01-01') AS n, bool_or(k % 11 = 0) AS skipped FROM ev WHERE failed GROUP BY signature)
SELECT signature, CASE WHEN skipped OR k % 13 = 0 OR k % 17 = 0 THEN 2 WHEN k % 2 = 0 AND n < 3 THEN 1 ELSE 2 END AS stage FROM h""")
def stage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir).filter("failed")
    f = seen.groupBy("signature").agg(F.min("k").alias("k")).select(
        "signature", F.when(F.col("k") % 13 == 0, "cost:spike").otherwise("rework:tool").alias("rule"), F.when(F.col("k") % 2 == 0, "hint").otherwise("warning").alias("severity"),
        F.lit("simple").alias("complexity"), F.when(F.col("k") % 17 == 0, "unclear").otherwise("yes").alias("first_verdict"), F.lit("session").alias("scope"), F.lit(False).alias("relapse"))
    history = seen.select("signature", "session_id", F.col("ts").alias("started_at"), F.when(F.col("k") % 11 == 0, "skipped").otherwise("taken").alias("second_opinion"))
    return lifecycle.stage(f, history, AS_OF).select("signature", "stage")
