"""Queries over what a watch tells and what a session's page says: rules at each call, decisions, messages in parts, commits, peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.operators import benchmarks, lifecycle, metrics, rounds, rules
from strandbook.operators import sessions as lists
from strandbook.plans.event_queries import EFFECTIVE, PROFILE, RELAPSE, SIGHTINGS, STATUS, decisions, r6, sightings
from strandbook.plans.proxy import AS_OF, EVENTS_SQL, events, table
from strandbook.sources import commits
from strandbook.sources.scratch import scratch
from strandbook.streaming import decisions as known
from strandbook.streaming import deltas
from strandbook.streaming.evaluate import told_at_each_call

QUERIES, SQL = {}, {}
#: Characters of a message that one part holds.
PIECE = 40


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return add


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, of which three tools in seven work on a file."""
    k, tool = F.col("k"), F.col("kind") == S.TOOL
    name = F.when(k % 7 == 0, "Edit").when(k % 7 == 1, "Write").when(k % 7 == 2, "Read").otherwise(F.col("name"))
    return events(spark, sf_dir).withColumns({"name": name, "signature": F.when(tool & (k % 7 < 3), "f").when(~tool, F.col("signature")).otherwise("")})


@query(f"""WITH {EVENTS_SQL},
w AS (SELECT *, CASE k % 7 WHEN 0 THEN 'Edit' WHEN 1 THEN 'Write' WHEN 2 THEN 'Read' ELSE name END AS tool, CASE WHEN kind = 'tool' THEN CASE WHEN k % 7 < 3 THEN 'f' ELSE '' END END AS file FROM ev),
x AS (SELECT *, min(CASE WHEN kind = 'tool' THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS call,
  sum(CASE WHEN kind = 'tool' THEN 1 ELSE 0 END) OVER u AS tools, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER u AS errors,
  last_value(CASE WHEN kind = 'tool' THEN tool END IGNORE NULLS) OVER u AS blamed, last_value(file IGNORE NULLS) OVER u AS last_file
  FROM w WINDOW u AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT session_id, blamed, call, count(*) OVER (PARTITION BY session_id, blamed ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM x WHERE failed AND blamed IS NOT NULL),
st AS (SELECT session_id, call, sum(CASE WHEN kind = 'tool' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS e FROM x WHERE call IS NOT NULL AND (file = 'f' OR failed AND last_file = 'f') GROUP BY session_id, call),
f AS (SELECT session_id, call, sum(r) OVER c AS refs, sum(e) OVER c AS n FROM st WINDOW c AS (PARTITION BY session_id ORDER BY call ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
found AS (
  SELECT session_id, seq, 'tool:error_rate' AS rule, 'tool:error_rate' AS signature, printf('%.1f %%', errors / tools * 100) AS value FROM x WHERE kind = 'tool' AND errors / tools >= 0.2 AND errors >= 3
  UNION ALL SELECT session_id, call, 'rework:tool', 'rework:tool:' || blamed, CAST(max(n) AS VARCHAR) FROM b WHERE call IS NOT NULL GROUP BY session_id, blamed, call HAVING max(n) >= 4
  UNION ALL SELECT session_id, call, 'rework:file', 'rework:file:f', CAST(CAST(refs AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(n AS BIGINT) AS VARCHAR) FROM f WHERE refs >= 5 AND n >= 2)
SELECT * FROM found QUALIFY lag(value) OVER (PARTITION BY session_id, signature ORDER BY seq) IS DISTINCT FROM value""")
def watch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_at_each_call(file_events(spark, sf_dir))


def _cache(spark: SparkSession, sf_dir: str, days: int) -> tuple[DataFrame, DataFrame]:
    """The decisions as a watch has them, through the versions on storage, and the sightings that they come from."""
    ev = events(spark, sf_dir)
    seen = sightings(ev).persist()
    made = decisions(seen).withColumn("anchor", F.concat(F.lit("docs/"), "signature"))
    sessions = ev.select("session_id").distinct()
    versions = sessions.select("session_id", F.lit(1).alias("version_id"), F.lit("old").alias("project")).unionByName(sessions.select("session_id", F.lit(2).alias("version_id"), (F.col("session_id") % 5).cast("string").alias("project")))
    path = scratch(spark, "decisions")
    known.write_cache(known.cache_rows(made, versions, AS_OF, 1), path)  # an older version, which the newer one hides
    known.write_cache(known.cache_rows(made, versions, AS_OF, days), path)
    seen.unpersist()
    return known.read_cache(spark, path), ev


@query(f"""WITH {SIGHTINGS} SELECT signature, session_id, CASE WHEN session_id IS NULL THEN '' ELSE CAST(session_id % 5 AS VARCHAR) END AS project, status, decided_at, 'docs/' || signature AS anchor
FROM dec WHERE status <> 'open' AND decided_at >= TIMESTAMP '2024-01-17'""")
def decision_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache(spark, sf_dir, 14)[0]


@query(f"""WITH {SIGHTINGS}, done AS (SELECT signature, CAST(session_id % 5 AS VARCHAR) AS project, decided_at FROM dec WHERE status = 'done')
SELECT e.event_id, max(d.decided_at) AS decided_at, CASE WHEN max(d.decided_at) IS NOT NULL THEN 'docs/' || e.signature END AS anchor
FROM ev e LEFT JOIN done d ON d.signature = e.signature AND (d.project IS NULL OR d.project = e.project) WHERE e.failed GROUP BY e.event_id, e.signature""")
def annotated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, ev = _cache(spark, sf_dir, 16)
    return known.annotated(ev.filter("failed").select("event_id", "signature", "project"), cache).select("event_id", "decided_at", "anchor")


@query(f"""WITH {EVENTS_SQL}, s AS (SELECT session_id, max(ts) AS at, sum(cost) AS cost, any_value(project) AS project, any_value(source) AS source FROM ev GROUP BY session_id),
shown AS (SELECT DISTINCT session_id, signature FROM ev WHERE failed AND ts > TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-31'),
p AS (SELECT s.session_id, s.cost, quantile_cont(o.cost, 0.95) AS q, count(*) AS n FROM s JOIN s o ON o.session_id <> s.session_id AND o.cost IS NOT NULL AND o.at > TIMESTAMP '2024-01-01' WHERE s.cost IS NOT NULL AND s.at > TIMESTAMP '2024-01-01' GROUP BY s.session_id, s.cost),
found AS (SELECT session_id, 'error:recurring' AS rule, 'error:recurring:' || signature AS signature, 'warning' AS severity, CAST(count(*) OVER (PARTITION BY signature) AS VARCHAR) AS value, signature AS ref
    FROM shown QUALIFY count(*) OVER (PARTITION BY signature) >= 3
  UNION ALL SELECT session_id, 'cost:outlier', 'cost:outlier', 'warning', printf('%.2f > p95 %.2f (%d sessions)', cost, q, n), '' FROM p WHERE n >= 10 AND cost > q
  UNION ALL SELECT session_id, 'capture:gap', 'capture:gap:duration', 'hint', 'duration', '' FROM s WHERE session_id % 3 = 0)
SELECT f.session_id, TIMESTAMP '2024-01-31' AS at, s.project, s.source, rule, signature, severity, value, ref FROM found f JOIN s ON s.session_id = f.session_id WHERE f.session_id % 2 = 0""")
def cross_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of half of the sessions are committed with them, and committed again as a replay would."""
    ev = events(spark, sf_dir)
    sessions = ev.groupBy("session_id").agg(F.max("ts").alias("at"), F.sum("cost").alias("cost"), F.min("project").alias("project"), F.min("source").alias("source"))
    saved = sessions.filter("session_id % 2 = 0")
    capture = sessions.select("session_id", F.lit("observed").alias("token"), F.when(F.col("session_id") % 3 == 0, "not_recorded").otherwise("observed").alias("duration"))
    own = rules.capture_gap(rules.SessionFrames(ev, ev, ev, capture))
    found = commits.cross_session_rows(saved, sessions, ev, own, AS_OF)
    path = scratch(spark, "findings")
    for _ in range(2):
        commits.commit({"findings": found, "sessions": saved}, path, 1)
    return commits.committed(spark, path, "findings")


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(min(text), '') AS t FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id, turn),
n AS (SELECT *, CAST(ceil(length(t) / {PIECE}.0) AS BIGINT) AS pieces, conv_id % 7 = 3 AND length(t) > 0 AS lacks, turn % 5 = 4 AS endless FROM c)
SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(turn AS BIGINT) AS turn, sha256(CASE WHEN lacks THEN substr(t, {PIECE + 1}) ELSE t END) AS text_sha256, CASE WHEN NOT endless THEN CAST(length(t) AS BIGINT) END AS token_in,
  CASE WHEN NOT endless THEN pieces END AS token_out, CASE WHEN endless THEN 'no result' WHEN lacks THEN 'parts missing' ELSE 'complete' END AS status FROM n""")
def assembled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer is cut into lines as a chat process gives them, with a sign of life and a broken line in front; some lack their first piece or their result."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant' and turn is not null and conv_id is not null").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("t"))
    return deltas.assembled(lines_of(c)).select("conversation_id", "turn", F.sha2("text", 256).alias("text_sha256"), "token_in", "token_out", "status")


def lines_of(turns: DataFrame) -> DataFrame:
    """(conversation_id, turn, part, line) of answers (conv_id, turn, t), in no order, the broken line twice."""
    delta = lambda *fields: F.to_json(F.struct(F.lit("stream_event").alias("type"), F.struct(F.struct(*fields).alias("delta")).alias("event")))
    n = F.ceil(F.length("t") / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring("t", i * PIECE + 1, F.lit(PIECE)))
    texts = F.transform(F.filter(pieces, lambda p: p != ""), lambda p: delta(F.lit("text_delta").alias("type"), p.alias("text")))
    end = F.to_json(F.struct(F.lit("result").alias("type"), F.struct(F.length("t").alias("input_tokens"), n.alias("output_tokens")).alias("usage")))
    every = F.concat(F.array(delta(F.lit("thinking_delta").alias("type"), F.lit("hm").alias("thinking")), F.lit('{"type": "stream_ev')), texts, F.array(F.when(F.col("turn") % 5 != 4, end)))
    rows = turns.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("long").alias("turn"), (F.col("conv_id") % 7 == 3).alias("lacks"), (F.length("t") > 0).alias("long"), F.posexplode(every).alias("part", "line"))
    rows = rows.filter("line is not null and not (lacks and long and part = 2)").drop("lacks", "long")
    return rows.unionByName(rows.filter("part = 1")).withColumn("part", F.col("part").cast("long"))


PEERS_SQL = EVENTS_SQL + """, s AS (SELECT session_id, any_value(project) AS project, any_value(source) AS source, min(ts) AS start, sum(cost) AS cost, CAST(sum(k) FILTER (kind = 'assistant') AS BIGINT) AS output,
  count(*) FILTER (kind = 'user') AS rounds, count(*) FILTER (kind = 'tool') AS tools, CASE WHEN count(*) FILTER (kind = 'tool') > 0 THEN count(*) FILTER (failed) / count(*) FILTER (kind = 'tool') ELSE 0 END AS error_rate,
  CAST(sum(duration_ms) FILTER (kind = 'round_end') AS BIGINT) AS duration_ms, coalesce(quantile_disc(duration_ms, 0.5) FILTER (kind = 'round_end'), 0) AS p50_ms, coalesce(quantile_disc(duration_ms, 0.95) FILTER (kind = 'round_end'), 0) AS p95_ms,
  count(*) FILTER (k % 10 = 0) AS subagents FROM ev GROUP BY session_id)"""
PEER_MEDIANS = {n: n for n in benchmarks.PEER_BENCHMARK} | {n: f"{n.removesuffix('_per_round')} // greatest(rounds, 1)" for n in ("output_per_round", "tools_per_round")} | {
    "cost_per_round": "cost / greatest(rounds, 1)", "duration_per_round_ms": "duration_ms // greatest(rounds, 1)"}


@query(f"""WITH {PEERS_SQL}, v AS (SELECT session_id, project, source, start, rounds AS own_rounds, {', '.join(f'{e} AS {n}' for n, e in PEER_MEDIANS.items())} FROM s)
SELECT a.session_id, count(o.session_id) AS n, {', '.join(f'round(median(o.{n}), 6) AS {n}' for n in PEER_MEDIANS)}
FROM v a LEFT JOIN v o ON o.project = a.project AND o.source = a.source AND o.session_id <> a.session_id AND o.start > TIMESTAMP '2024-01-02' AND o.own_rounds >= 5 GROUP BY a.session_id""")
def peer_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    said = F.col("kind") == S.ASSISTANT
    s = ev.groupBy("session_id").agg(
        F.min("project").alias("project"), F.min("source").alias("source"), F.min("ts").alias("start"), F.sum("cost").alias("cost"), F.sum(F.when(said, F.col("k"))).alias("output"), F.count_if(F.col("kind") == S.USER).alias("rounds"),
        F.count_if(F.col("kind") == S.TOOL).alias("tools"), F.count_if("failed").alias("errors"), F.sum(F.when(F.col("kind") == S.ROUND_END, F.col("duration_ms"))).alias("duration_ms"), F.count_if(F.col("k") % 10 == 0).alias("subagents"))
    s = s.withColumn("error_rate", metrics.ratio(F.col("errors"), F.col("tools"))).join(metrics.latencies(ev), "session_id")
    return benchmarks.peer_benchmarks(s, AS_OF, 29).select("session_id", "n", *map(r6, benchmarks.PEER_BENCHMARK))


LATE_PROFILE = PROFILE.replace("CASE WHEN kind = 'assistant' THEN value END AS cost", "CASE WHEN kind = 'assistant' THEN CASE WHEN ts >= TIMESTAMP '2024-01-29' THEN 60 * value ELSE value END END AS cost")


@query(f"""WITH {LATE_PROFILE}
SELECT session_id, 'cost:spike:single' AS signature, 'warning' AS severity, 'round ' || CAST(CAST(top_round AS BIGINT) AS VARCHAR) || ': ' || printf('%.1f %%', top / total * 100) AS value FROM profile WHERE m > 0 AND top / m >= 5 AND top / total >= 0.15
UNION ALL SELECT session_id, 'cost:spike:cluster', 'hint', printf('%.1f %%', last3 / (3 * m) * 100) FROM profile WHERE m > 0 AND n >= 3 AND last3 / (3 * m) >= 4
UNION ALL SELECT session_id, 'cost:spike:top3', 'hint', printf('%.1f %%', top3 / total * 100) FROM profile WHERE m > 0 AND top3 / total >= 0.5""")
def cost_spikes_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three cost rules over one profile; what is said on the last days costs sixty times as much, so that the last rounds stand out."""
    ev = events(spark, sf_dir)
    dear = ev.withColumn("cost", F.when(F.col("ts") >= F.lit("2024-01-29").cast("timestamp"), 60 * F.col("cost")).otherwise(F.col("cost")))
    return rules.cost_spikes(rules.SessionFrames(dear, dear, dear, dear, rounds.round_metrics(dear))).select("session_id", "signature", "severity", "value")


@query(f"""WITH {STATUS}, p AS (SELECT *, list_position(['relapse', 'dissent', 'confirmed', 'in_review', 'open', 'rejected', 'done', 'obsolete'], status) AS p FROM st),
g AS (SELECT signature, arg_min(status, p) AS status FROM p GROUP BY signature), n AS (SELECT signature, status, count(*) AS n FROM st GROUP BY ALL),
b AS (SELECT signature, string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY status) AS by_status FROM n GROUP BY signature)
SELECT s.signature, count(DISTINCT s.session_id) AS sessions, b.by_status, g.status FROM seen s JOIN g ON g.signature = s.signature JOIN b ON b.signature = s.signature GROUP BY s.signature, b.by_status, g.status""")
def pattern_rollup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandbook.plans.event_queries import _statuses

    seen = events(spark, sf_dir).filter("failed").withColumn("seen_at", F.col("ts"))
    out = lifecycle.pattern_rollup(seen, _statuses(spark, sf_dir).select("signature", "session_id", "status"))
    told = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("signature", "sessions", told.alias("by_status"), "status")


@query(f"""WITH {EFFECTIVE}{RELAPSE}, run AS (SELECT DISTINCT signature, session_id FROM seen WHERE k % 7 = 2), alive AS (SELECT session_id, count(*) AS n FROM run GROUP BY session_id),
ver AS (SELECT signature, session_id, CASE WHEN k % 4 = 0 THEN 'confirmed' WHEN k % 4 = 1 THEN 'dissent' ELSE 'rejected' END AS result FROM seen WHERE session_id % 2 = 0),
leg AS (SELECT signature, session_id, CASE WHEN k % 4 = 3 THEN 'dissent' ELSE 'confirmed' END AS result FROM seen WHERE k % 5 = 3),
st AS (SELECT e.signature, e.session_id, 'r' || CAST(e.k % 4 AS VARCHAR) AS rule, ver.result AS verdict, CASE WHEN e.status = 'done' AND rel.signature IS NOT NULL THEN 'relapse' WHEN e.status <> 'open' THEN e.status
  WHEN run.signature IS NOT NULL THEN 'in_review' ELSE coalesce(ver.result, leg.result, 'open') END AS status
  FROM eff e LEFT JOIN rel ON rel.signature = e.signature LEFT JOIN run ON run.signature = e.signature AND run.session_id = e.session_id
  LEFT JOIN ver ON ver.signature = e.signature AND ver.session_id = e.session_id LEFT JOIN leg ON leg.signature = e.signature AND leg.session_id = e.session_id WHERE e.rn = 1),
g AS (SELECT session_id, rule, arg_min(status, list_position(['relapse', 'dissent', 'confirmed', 'in_review', 'open', 'rejected', 'done', 'obsolete'], status)) AS group_status FROM st GROUP BY session_id, rule)
SELECT st.session_id, st.rule, st.signature, st.status, st.verdict, g.group_status, coalesce(alive.n, 0) AS running, st.session_id % 5 = 3 AS local
FROM st JOIN g ON g.session_id = st.session_id AND g.rule = st.rule LEFT JOIN alive ON alive.session_id = st.session_id""")
def session_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    seen = sightings(ev)
    k = F.col("k")
    findings = seen.select("session_id", F.concat(F.lit("r"), k % 4).alias("rule"), "signature")
    heads = ev.select("session_id", "project", F.lit(None).cast("string").alias("violation"), F.lit(None).cast("string").alias("persona")).distinct()
    runs = seen.filter("session_id % 2 = 0").select("session_id", "signature", F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "dissent").otherwise("rejected").alias("result"), F.col("seen_at").alias("started_at"))
    legacy = seen.filter("k % 5 = 3").select("session_id", "signature", F.lit("r").alias("rule"), F.when(k % 4 == 3, "unclear").otherwise("confirmed").alias("result"))
    return lists.session_answer(findings, heads, decisions(seen), seen.filter("k % 7 = 2").select("signature", "session_id"), runs, legacy, seen, ("3",))
