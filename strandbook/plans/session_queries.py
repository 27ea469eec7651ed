"""Queries over session lists, tiles, contracts and catalogue names."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.functions import keys
from strandbook.operators import catalogue, sessions
from strandbook.plans.event_queries import EFFECTIVE, RELAPSE, SIGHTINGS, STATUS, _statuses, decisions, sightings
from strandbook.plans.proxy import AS_OF, EVENTS_SQL, events, table
from strandbook.sources import contracts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


# A customer is a session: orders tell its start, the nation its source, the segment its project.
PERSONS_SQL = """per AS (SELECT c_custkey AS session_id, c_mktsegment AS project, CASE c_nationkey % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'unknown' END AS source,
  CASE WHEN c_nationkey % 4 = 0 THEN 'unassigned' ELSE 'work' END AS context, CASE c_nationkey % 5 WHEN 0 THEN 'ide' WHEN 1 THEN 'other' END AS environment,
  CASE c_nationkey % 7 WHEN 0 THEN 'cura' WHEN 1 THEN 'nobody' END AS persona FROM customer)"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("project"), F.when(n % 3 == 0, "claude").when(n % 3 == 1, "codex").otherwise("unknown").alias("source"),
        F.when(n % 4 == 0, "unassigned").otherwise("work").alias("context"), F.when(n % 5 == 0, "ide").when(n % 5 == 1, "other").alias("environment"),
        F.when(n % 7 == 0, "cura").when(n % 7 == 1, "nobody").alias("persona"))


@query("""SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderdate - INTERVAL 40 DAY END, TIMESTAMP '1996-02-10')
  BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-02-29 23:59:59.999999'""")
def coalesced_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, key = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 3 != 0, at).alias("end"), F.when(key % 2 != 0, at - F.expr("INTERVAL 40 DAYS")).alias("start"), F.lit(datetime(1996, 2, 10)).alias("written_at"))
    return sessions.in_days(rows, date(1996, 2, 1), date(1996, 2, 29)).select("o_orderkey")


@query(f"WITH {PERSONS_SQL} SELECT session_id FROM per WHERE project = 'MACHINERY' OR project = 'BUILDING' AND source = 'codex'")
def project_alias_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("MACHINERY", None, "Plant"), ("BUILDING", "codex", "Plant"), ("FURNITURE", None, "Home")], "name string, source string, project string")
    return sessions.of_project(persons(spark, sf_dir), aliases, "Plant").select("session_id")


@query(f"WITH {PERSONS_SQL} SELECT session_id FROM per WHERE source IN ('claude', 'unknown') AND (context = 'work' OR context = 'unassigned') AND project IN ('MACHINERY', 'FURNITURE')")
def derived_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.narrowed(persons(spark, sf_dir), source=["claude", "unknown"], context=["work"], project=["MACHINERY", "FURNITURE"], environment=[]).select("session_id")


@query(f"WITH {PERSONS_SQL} SELECT session_id FROM per WHERE session_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def drill_down_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("session_id"))
    return sessions.of_ids(persons(spark, sf_dir), ids).select("session_id")


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'STANDARD')")
def rule_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("rule", F.col("p_type"))
    return sessions.of_rule(part, "STANDARD", prefix=True).select("p_partkey", "p_type")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'")
def rule_exact_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.of_rule(table(spark, sf_dir, "part").withColumn("rule", F.col("p_brand")), "Brand#13").select("p_partkey")


ROWS_SQL = EFFECTIVE + f""", {PERSONS_SQL}, heads AS (SELECT session_id, min(ts) AS start, CAST(count(*) FILTER (kind = 'user') AS BIGINT) AS rounds, CAST(count(*) FILTER (kind = 'tool') AS BIGINT) AS tools,
  CASE WHEN session_id % 2 = 0 THEN CAST(count(*) FILTER (failed) AS BIGINT) END AS tool_errors FROM ev GROUP BY session_id),
still AS (SELECT session_id, count(*) AS n FROM eff WHERE rn = 1 AND coalesce(status, 'open') = 'open' GROUP BY session_id),
rows_ AS (SELECT h.session_id, h.start, h.rounds, h.tools, coalesce(h.tool_errors, 0) AS tool_errors, coalesce(s.n, 0) AS open_findings,
  coalesce((SELECT arg_max(k, seq) FROM ev v WHERE v.session_id = h.session_id AND v.kind = 'tool') % 4 > 0, FALSE) AS dissent,
  CASE WHEN p.environment = 'ide' THEN 'ide' ELSE 'terminal' END AS environment, CASE WHEN p.persona = 'cura' THEN 'cura' ELSE 'vico' END AS persona
  FROM heads h LEFT JOIN still s ON s.session_id = h.session_id LEFT JOIN per p ON p.session_id = h.session_id)"""


def _rows(spark: SparkSession, sf_dir: str, signature: str | None = None) -> DataFrame:
    ev = events(spark, sf_dir)
    seen = sightings(ev)
    heads = ev.groupBy("session_id").agg(
        F.min("ts").alias("start"), F.count_if(F.col("kind") == "user").alias("rounds"), F.count_if(F.col("kind") == "tool").alias("tools"), F.count_if("failed").alias("_errors"))
    heads = heads.withColumn("tool_errors", F.when(F.col("session_id") % 2 == 0, F.col("_errors"))).drop("_errors").withColumn("written_at", F.col("start"))
    heads = heads.join(persons(spark, sf_dir).drop("source", "project", "context"), "session_id", "left").withColumn("channel", F.lit(None).cast("string"))
    verdicts = ev.filter("kind = 'tool'").select("session_id", F.col("seq").alias("written_at"), (F.col("k") % 4).alias("dissents"))
    return sessions.session_rows(heads, seen.select("session_id", "signature"), decisions(seen), verdicts, ev, signature)


@query(f"WITH {ROWS_SQL} SELECT * FROM rows_")
def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("session_id", "start", "rounds", "tools", "tool_errors", "open_findings", "dissent", "environment", "persona")


@query(f"""WITH {ROWS_SQL}, t AS (SELECT arg_max(signature, (n, signature)) AS signature FROM (SELECT signature, count(*) AS n FROM ev WHERE failed GROUP BY signature))
SELECT session_id, (SELECT count(*) FROM ev WHERE ev.session_id = r.session_id AND failed AND signature = (SELECT signature FROM t)) AS hits FROM rows_ r""")
def session_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = events(spark, sf_dir).filter("failed").groupBy("signature").count().orderBy(F.desc("count"), F.desc("signature")).first()
    return _rows(spark, sf_dir, top.signature if top else "").select("session_id", "hits")


@query(f"WITH {ROWS_SQL} SELECT session_id, CASE WHEN dissent THEN 'dissent' WHEN open_findings > 0 THEN 'conspicuous' ELSE 'ok' END AS status FROM rows_ ORDER BY start DESC, session_id LIMIT 30")
def visible_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.visible_rows(_rows(spark, sf_dir)).select("session_id", "status")


@query(f"""WITH {EVENTS_SQL} SELECT session_id, event_id FROM ev e WHERE failed OR kind IN ('subagent', 'compaction') OR kind = 'round_end' AND coalesce(duration_ms, 0) > 60000
  OR seq = (SELECT min(seq) FROM ev x WHERE x.session_id = e.session_id) OR seq = (SELECT max(seq) FROM ev x WHERE x.session_id = e.session_id)""")
def salient_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.salient_events(events(spark, sf_dir)).select("session_id", "event_id")


@query(f"""WITH {EFFECTIVE} SELECT signature, count(*) AS hits, count(*) FILTER (coalesce(status, 'open') IN ('open', 'relapse')) AS open_hits, bool_and(coalesce(status, 'open') NOT IN ('open', 'relapse')) AS all_done
FROM eff WHERE rn = 1 GROUP BY signature""")
def done_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandbook.operators.lifecycle import effective_decisions

    seen = sightings(events(spark, sf_dir))
    return sessions.done_groups(effective_decisions(seen.select("signature", "session_id"), decisions(seen)), ["signature"])


@query(f"WITH {PERSONS_SQL} SELECT session_id, coalesce(project = 'HOUSEHOLD', FALSE) OR coalesce(persona = 'cura', FALSE) OR session_id % 11 = 0 AS protected FROM per")
def protection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = persons(spark, sf_dir).withColumn("violation", F.when(F.col("session_id") % 11 == 0, "local"))
    return marked.select("session_id", sessions.protected(marked, ("Household",)).alias("protected"))


@query("""SELECT e.event_id, c.c_mktsegment FROM events e JOIN customer c ON c.c_custkey = TRY_CAST(CASE WHEN e.event_id % 5 = 0 THEN 'none' ELSE CAST(e.user_id AS VARCHAR) END AS BIGINT)""")
def event_session_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "none").otherwise(F.col("user_id").cast("string")).alias("session_ref"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), "c_mktsegment")
    return sessions.sessions_of_event(ev, people).select("event_id", "c_mktsegment")


@query("""SELECT c_custkey, o.version_id, o.total FROM customer LEFT JOIN LATERAL (SELECT o_orderkey AS version_id, o_totalprice AS total FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 1) o ON TRUE""")
def latest_version_of_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("session_id"))
    versions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("version_id"), F.col("o_totalprice").alias("total"))
    return sessions.decisions_with_session(asked, versions).select("c_custkey", "version_id", "total")


@query("""WITH v AS (SELECT l_orderkey AS version_id, CASE WHEN l_linenumber % 2 = 0 THEN o_custkey END AS session_id, l_shipdate AS written_at, l_orderkey * 10 + l_linenumber AS verdict_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
w AS (SELECT coalesce(v.session_id, o.o_custkey) AS session_id, v.written_at, v.verdict_id FROM v LEFT JOIN orders o ON o.o_orderkey = v.version_id)
SELECT session_id, max((written_at, verdict_id))[2] AS verdict_id FROM w GROUP BY session_id""")
def verdicts_of_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("version_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("version_id"), "l_linenumber", F.col("l_shipdate").alias("written_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("verdict_id"))
    own = F.when(F.col("l_linenumber") % 2 == 0, F.col("session_id")).alias("session_id")
    verdicts = lines.join(orders, "version_id").select("version_id", own, "written_at", "verdict_id")
    return sessions.verdicts_of_session(verdicts, orders).select("session_id", "verdict_id")


@query(f"""WITH {SIGHTINGS}, own AS (SELECT session_id, signature FROM seen WHERE k % 5 = 0), leg AS (SELECT session_id, signature, CASE WHEN k % 2 = 0 THEN 'unclear' ELSE 'confirmed' END AS result FROM seen WHERE k % 3 = 0)
SELECT s.session_id, s.signature, CASE WHEN own.signature IS NOT NULL THEN 'rejected' WHEN leg.result = 'unclear' THEN 'dissent' ELSE leg.result END AS verdict
FROM seen s LEFT JOIN own ON own.session_id = s.session_id AND own.signature = s.signature LEFT JOIN leg ON leg.session_id = s.session_id AND leg.signature = s.signature""")
def own_or_legacy_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sightings(events(spark, sf_dir)).withColumn("rule", F.lit("error:recurring"))
    own = seen.filter("k % 5 = 0").withColumn("verdict", F.lit("rejected"))
    legacy = seen.filter("k % 3 = 0").select("session_id", "signature", "rule", F.when(F.col("k") % 2 == 0, "unclear").otherwise("confirmed").alias("result"), F.col("seen_at").alias("written_at"))
    return sessions.own_or_legacy_verdicts(seen.select("session_id", "signature", "rule"), own, legacy).select("session_id", "signature", "verdict")


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_orderdate AS started_at, unnest([o_orderstatus, substr(o_orderpriority, 1, 1)]) AS signature FROM orders WHERE o_orderkey % 2 = 0)
SELECT signature, max((started_at, run_id))[2] AS run_id FROM r GROUP BY signature""")
def latest_run_of_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("signatures"),
        F.when(F.col("o_orderkey") % 2 == 0, "pattern").otherwise("session").alias("scope"))
    return sessions.latest_runs(runs).select("signature", "run_id")


@query(f"""WITH {SIGHTINGS}, h AS (SELECT session_id, max(ts) AS t FROM ev GROUP BY session_id)
SELECT DISTINCT s.signature, s.session_id FROM seen s JOIN h ON h.session_id = s.session_id WHERE h.t >= TIMESTAMP '2024-01-01'""")
def sessions_of_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    heads = ev.groupBy("session_id").agg(F.max("ts").alias("end"), F.min("ts").alias("start")).withColumn("written_at", F.col("start"))
    return sessions.sessions_of_signature(sightings(ev), heads, AS_OF)


@query("""WITH f AS (SELECT doc_id AS session_id, CASE WHEN quality = 1 THEN 'Clean' ELSE 'odd' END AS c FROM labels), s AS (SELECT doc_id AS session_id, CASE WHEN toxic = 1 THEN 'hallucinated' END AS c FROM labels WHERE doc_id % 3 = 0)
SELECT f.session_id, CASE WHEN s.session_id IS NOT NULL AND s.c IS NOT NULL THEN s.c WHEN f.c = 'Clean' THEN 'clean' ELSE 'deviating' END AS class FROM f LEFT JOIN s ON s.session_id = f.session_id""")
def pattern_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.lit("s").alias("signature"), F.col("doc_id").alias("session_id"), "quality", "toxic")
    first = rows.select("signature", "session_id", F.when(F.col("quality") == 1, "Clean").otherwise("odd").alias("class"))
    second = rows.filter("session_id % 3 = 0").select("signature", "session_id", F.when(F.col("toxic") == 1, "hallucinated").alias("class"))
    return sessions.classification(first, second).select("session_id", "class")


TILE = SIGHTINGS.replace("SELECT DISTINCT signature, NULL", "SELECT DISTINCT 'error:recurring:' || signature AS signature, NULL").replace("UNION ALL SELECT signature,", "UNION ALL SELECT 'error:recurring:' || signature,") + """,
s2 AS (SELECT 'error:recurring:' || signature AS signature, session_id, seen_at, hits FROM seen),
eff2 AS (SELECT s.signature, s.session_id, d.status, row_number() OVER (PARTITION BY s.signature, s.session_id ORDER BY d.decided_at DESC NULLS LAST, (d.status <> 'open')::INT DESC) AS rn
  FROM s2 s LEFT JOIN dec d ON d.signature = s.signature AND (d.session_id IS NULL OR d.session_id = s.session_id)),
op AS (SELECT DISTINCT signature FROM eff2 WHERE rn = 1 AND coalesce(status, 'open') = 'open'),
again AS (SELECT DISTINCT s.signature FROM s2 s JOIN dec d ON d.signature = s.signature AND d.session_id IS NULL AND d.status = 'done' WHERE s.seen_at > d.decided_at),
tile AS (SELECT s.signature, count(DISTINCT s.session_id) AS sessions, CAST(sum(s.hits) AS BIGINT) AS hits, CASE WHEN s.signature IN (SELECT signature FROM op) THEN 'open' WHEN s.signature IN (SELECT signature FROM again) THEN 'relapse'
  WHEN s.signature IN (SELECT signature FROM dec WHERE session_id IS NULL AND status = 'obsolete') THEN 'obsolete' ELSE 'done' END AS status FROM s2 s GROUP BY s.signature)"""


def _tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = sightings(events(spark, sf_dir))
    decided = decisions(seen).withColumn("signature", F.concat(F.lit(sessions.RECURRING), "signature"))
    return sessions.signature_rows(seen.select("signature", "session_id", "seen_at", "hits"), decided)


@query(f"WITH {TILE} SELECT signature, sessions, hits, status FROM tile")
def tile_signature_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile(spark, sf_dir).select("signature", "sessions", "hits", "status")


@query(f"""WITH {TILE}, top AS (SELECT * FROM tile WHERE status = 'open' ORDER BY sessions DESC, signature DESC LIMIT 1)
SELECT (SELECT count(*) FROM tile WHERE status IN ('open', 'relapse')) AS count, coalesce((SELECT signature FROM top), '') AS top_signature, coalesce((SELECT sessions FROM top), 0) AS top_sessions, coalesce((SELECT hits FROM top), 0) AS top_hits""")
def recurring_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.recurring_tile(_tile(spark, sf_dir))


@query(f"""WITH {EFFECTIVE}, h AS (SELECT session_id, max(ts) AS t FROM ev GROUP BY session_id),
f AS (SELECT e.*, CASE WHEN e.k % 2 = 0 THEN 'outliers' WHEN e.k % 3 = 0 THEN 'gaps' END AS tile FROM eff e JOIN h ON h.session_id = e.session_id WHERE rn = 1 AND h.t >= TIMESTAMP '2024-01-10' AND h.t < TIMESTAMP '2024-01-31')
SELECT tile, session_id, bool_or(coalesce(status, 'open') = 'open') AS open FROM f WHERE tile IS NOT NULL GROUP BY ALL""")
def rule_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    seen = sightings(ev)
    rule = F.when(F.col("k") % 2 == 0, "cost:outlier").when(F.col("k") % 3 == 0, "capture:gap:tokens").otherwise("other")
    heads = ev.groupBy("session_id").agg(F.max("ts").alias("end"), F.min("ts").alias("start")).withColumn("written_at", F.col("start"))
    tiles = {"outliers": ("cost:outlier", False), "gaps": ("capture:gap", True)}
    return sessions.rule_tiles(seen.select("session_id", "signature", rule.alias("rule")), heads, decisions(seen), tiles, date(2024, 1, 10), date(2024, 1, 30))


@query(f"""WITH {EFFECTIVE}{RELAPSE} SELECT e.session_id, e.signature, CASE WHEN rel.signature IS NOT NULL AND e.status IN ('done', 'obsolete') THEN 'relapse' ELSE e.status END AS status
FROM eff e LEFT JOIN rel ON rel.signature = e.signature WHERE e.rn = 1 AND e.status IS NOT NULL""")
def marked_relapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandbook.operators.lifecycle import effective_decisions

    seen = sightings(events(spark, sf_dir))
    decided = effective_decisions(seen.select("signature", "session_id"), decisions(seen)).filter("decision is not null").select("session_id", "signature", F.col("decision").alias("status"))
    return sessions.marked_relapses(decided, decisions(seen), seen.select("signature", "session_id", "seen_at", "hits"))


@query(f"WITH {PERSONS_SQL} SELECT session_id FROM per WHERE context = 'unassigned' OR source = 'unknown'")
def unassigned_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.unassigned(persons(spark, sf_dir)).select("session_id")


@query("""WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), t AS (SELECT p_brand FROM c ORDER BY n DESC, p_brand LIMIT 5)
SELECT p_brand AS project, n, row_number() OVER (ORDER BY p_brand IN (SELECT p_brand FROM t) DESC, CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN -n END, p_brand) AS place FROM c""")
def top_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.top_then_alphabetical(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "project")).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {STATUS} SELECT s.signature, s.session_id, st.status FROM seen s LEFT JOIN st ON st.signature = s.signature AND st.session_id = s.session_id WHERE s.hits > 1""")
def drill_down_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    heads = ev.groupBy("session_id").agg(F.max("ts").alias("end"), F.min("ts").alias("start")).withColumn("written_at", F.col("start"))
    rows = sightings(ev).filter("hits > 1").select("signature", "session_id")
    return sessions.drill_down(rows, heads, _statuses(spark, sf_dir).select("signature", "session_id", "status")).select("signature", "session_id", "status")


@query(f"""WITH {EVENTS_SQL}, lines AS (SELECT session_id, seq, CASE WHEN seq % 4 <> 0 THEN ts END AS ts FROM ev),
asked AS (SELECT session_id, max(ts) - INTERVAL 36 HOUR AS at, 2 AS n FROM ev WHERE session_id % 5 <> 0 GROUP BY session_id UNION ALL SELECT session_id, TIMESTAMP '2030-01-01', 0 FROM ev WHERE session_id % 5 = 0 GROUP BY session_id),
met AS (SELECT a.session_id, a.at, a.n, coalesce(min(l.seq) FILTER (l.ts >= a.at), max(l.seq) FILTER (l.ts IS NOT NULL), max(l.seq)) AS position FROM asked a JOIN lines l ON l.session_id = a.session_id GROUP BY ALL)
SELECT l.session_id AS file, m.position, l.seq AS line FROM met m JOIN lines l ON l.session_id = m.session_id AND abs(l.seq - m.position) <= least(50, greatest(1, m.n))""")
def lines_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    lines = ev.select(F.col("session_id").alias("file"), F.col("seq").alias("line"), F.when(F.col("seq") % 4 != 0, F.col("ts")).alias("ts"))
    last = ev.groupBy(F.col("session_id").alias("file")).agg((F.max("ts") - F.expr("INTERVAL 36 HOURS")).alias("at"))
    some = F.col("file") % 5 != 0
    asked = last.select("file", F.when(some, F.col("at")).otherwise(F.lit(datetime(2030, 1, 1)).cast(ev.schema["ts"].dataType)).alias("at"), F.when(some, 2).otherwise(0).alias("n"))
    return sessions.around(lines, asked).select("file", "position", "line")


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS signature, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'maybe' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'docs/a.md' END AS path FROM orders)
SELECT o_orderkey, concat_ws(';', CASE WHEN signature IS NULL THEN 'signature' END, CASE WHEN status NOT IN ('done', 'obsolete', 'open') THEN 'status' END, CASE WHEN status = 'done' AND path IS NULL THEN 'done needs an anchor' END) AS violations FROM d""")
def decision_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 7 != 0, F.col("o_orderpriority")).alias("signature"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("maybe").alias("status"),
        F.lit(None).cast("string").alias("remark"), F.lit(None).cast("string").alias("reason"), F.when(key % 2 == 0, " rule ").alias("anchor_kind"), F.when(key % 2 == 0, "docs/a.md").alias("anchor_path"),
        F.lit(None).cast("string").alias("anchor_section"), F.lit(None).cast("string").alias("decided_by"))
    return contracts.with_violations(contracts.built_decisions(rows), "decision").select("o_orderkey", F.array_join("violations", ";").alias("violations"))


@query("""SELECT conv_id, turn, concat_ws(';', CASE WHEN coalesce(role NOT IN ('user', 'assistant', 'codex', 'system'), TRUE) THEN 'role' END,
  CASE WHEN text IS NULL OR length(text) > 20000 THEN 'text' END, CASE WHEN conv_id % 4 = 0 THEN 'cloud only where allowed' END) AS violations FROM conversations""")
def message_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = F.col("conv_id") % 2 == 0
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.lit("c-20240101-1200-00ff").alias("conversation_id"), "role", F.when(cloud, "openrouter").otherwise("ollama").alias("provider"),
        F.when(F.col("conv_id") % 4 == 0, "local").otherwise("cloud-ok").alias("protection"), "text", F.lit(1).alias("token_in"), F.lit(2).alias("token_out"))
    return contracts.with_violations(rows, "chat_message").select("conv_id", "turn", F.array_join("violations", ";").alias("violations"))


@query("""WITH b AS (SELECT p_partkey, p_size - 25 AS n, CASE WHEN p_size <> 25 THEN p_retailprice / 1500 END AS r FROM part)
SELECT p_partkey, concat_ws(';', CASE WHEN n < 0 THEN 'n' END, CASE WHEN r > 1 THEN 'call_ratio' END, CASE WHEN (n = 0) <> (r IS NULL) THEN 'no sessions, no ratios' END) AS violations FROM b""")
def benchmark_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = [F.lit(None).cast("double").alias(c) for c in contracts.RATIOS[1:]]
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 25).alias("n"), F.when(F.col("p_size") != 25, F.col("p_retailprice") / 1500).alias("call_ratio"), *none)
    return contracts.with_violations(rows, "delegation_benchmark").select("p_partkey", F.array_join("violations", ";").alias("violations"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id""")
def conversation_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_id"), "role")
    return contracts.conversations(rows).select(F.col("conversation_id").alias("conv_id"), F.array_join(F.transform("messages", lambda m: m["message"]["role"]), ",").alias("roles"))


@query("""SELECT p_partkey, p_brand AS signature, CASE WHEN p_size % 3 = 0 THEN 'yes' ELSE 'unclear' END AS verdict, CASE WHEN p_size % 2 = 0 THEN 'simple' ELSE 'complex' END AS complexity FROM part WHERE p_size % 5 <> 0""")
def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("p_size") % 3 == 0, "YES").otherwise("perhaps")
    size = F.when(F.col("p_size") % 2 == 0, ',"complexity":"simple"').otherwise("")
    answer = F.concat(F.lit('So: [{"signature":"'), "p_brand", F.lit('","verdict":"'), word, F.lit('"'), size, F.lit('},\n{"verdict":"no"}] Done.'))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "nothing [to say").otherwise(answer).alias("answer"))
    return contracts.verdicts_of_text(rows).select("p_partkey", "signature", "verdict", "complexity")


# Model names made of a part's number: makers, families, versions, sizes and endings in all orders.
MODELS_SQL = """m AS (SELECT p_partkey AS i, ['openai/', 'lab/sub/', '', 'parasail-'][p_partkey % 4 + 1] || ['gpt-oss', 'glm', 'claude-haiku', 'Gemma'][p_partkey // 4 % 4 + 1] AS head,
  ['', '-4-5', '4', '-5.2', '-20b', '-v3.2', '-2512'][p_partkey // 16 % 7 + 1] AS version, ['', ':cloud', '-it', '-latest', '-20251001', ':free', '-flash-preview', '@eu'][p_partkey // 112 % 8 + 1] AS tail FROM part)"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey")
    pick = lambda at, *x: F.element_at(F.array(*map(F.lit, x)), (at + 1).cast("int"))
    name = F.concat(pick(i % 4, "openai/", "lab/sub/", "", "parasail-"), pick(F.floor(i / 4) % 4, "gpt-oss", "glm", "claude-haiku", "Gemma"),
                    pick(F.floor(i / 16) % 7, "", "-4-5", "4", "-5.2", "-20b", "-v3.2", "-2512"), pick(F.floor(i / 112) % 8, "", ":cloud", "-it", "-latest", "-20251001", ":free", "-flash-preview", "@eu"))
    return table(spark, sf_dir, "part").select(i.alias("i"), name.alias("model"))


@query(f"""WITH {MODELS_SQL}, parts AS (SELECT i, CASE WHEN head LIKE 'parasail%' THEN 'parasail-' ELSE '' END || CASE WHEN head LIKE '%gpt-oss' THEN 'gpt-oss' WHEN head LIKE '%glm' THEN 'glm' WHEN head LIKE '%haiku' THEN 'claude-haiku' ELSE 'gemma' END AS h,
  CASE version WHEN '-5.2' THEN '-5-2' WHEN '-v3.2' THEN '-v3-2' WHEN '4' THEN CASE WHEN head LIKE '%Gemma' THEN '-4' ELSE '4' END ELSE version END AS v, CASE WHEN tail = '-flash-preview' THEN tail ELSE '' END AS t FROM m)
SELECT i, h || v || t AS canonical FROM parts""")
def catalogue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).select("i", keys.canonical_id(F.col("model")).alias("canonical"))


@query(f"""WITH {MODELS_SQL} SELECT i, CASE WHEN head LIKE '%gpt-oss' THEN 'gpt-oss' WHEN head LIKE '%glm' THEN 'glm' WHEN head LIKE '%haiku' THEN 'claude-haiku' ELSE 'gemma' END
  || CASE tail WHEN ':cloud' THEN '-cloud' WHEN '-latest' THEN '-latest' WHEN '-flash-preview' THEN '-flash' ELSE '' END AS family,
  CASE WHEN head LIKE '%gpt-oss' THEN 'gpt-oss' WHEN head LIKE '%glm' THEN 'glm' WHEN head LIKE '%haiku' THEN 'claude' ELSE 'gemma' END || CASE tail WHEN ':cloud' THEN '-cloud' WHEN '-latest' THEN '-latest' ELSE '' END AS line,
  CASE version WHEN '-4-5' THEN '4.0,0.5' WHEN '4' THEN '4.0' WHEN '-5.2' THEN '5.0,0.2' WHEN '-v3.2' THEN '3.0,0.2' ELSE '' END AS version FROM m WHERE tail <> '-20251001'""")
def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("model")
    return models(spark, sf_dir).filter(~m.endswith("-20251001")).select("i", keys.family(m).alias("family"), keys.product_line(m).alias("line"), F.array_join(keys.version_tuple(m).cast("array<string>"), ",").alias("version"))


@query("""WITH e AS (SELECT p_partkey, p_brand AS family, p_size // 10 AS v FROM part), t AS (SELECT family, max(v) AS top FROM e GROUP BY family)
SELECT p_partkey, CASE WHEN v < top THEN (SELECT min(CAST(x.p_partkey AS VARCHAR)) FROM e x WHERE x.family = e.family AND x.v = t.top) END AS newest FROM e JOIN t USING (family)""")
def newest_of_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("canonical"), F.col("p_brand").alias("family"), F.array(F.floor(F.col("p_size") / 10).cast("double")).alias("version"))
    return catalogue.newest_of_family(rows).select("p_partkey", "newest")


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN p_size * 1.5 END AS a, CASE WHEN p_size % 7 <> 0 THEN p_size * 1.1 END AS c, p_size % 4 = 0 AS old, CASE p_size % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END AS vision FROM part),
s AS (SELECT *, CASE WHEN a IS NULL THEN c WHEN c IS NULL THEN a ELSE (a + c) / 2 END AS score FROM e), b AS (SELECT max(score) FILTER (NOT old) AS best FROM s),
r AS (SELECT *, CASE WHEN score < 45 THEN 0.5 + 2.5 * score / 45 WHEN best > 45 THEN 3 + 2 * (score - 45) / (best - 45) ELSE 3 END AS raw FROM s, b)
SELECT p_partkey, CASE WHEN score IS NOT NULL THEN least(CASE WHEN vision = FALSE THEN 4.0 ELSE 5.0 END, greatest(0.5, floor(raw * 2 + 0.5) / 2)) END AS stars FROM r""")
def model_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", catalogue.score(F.when(n % 9 != 0, n * 1.5), F.when(n % 7 != 0, n * 1.1)).alias("score"), F.lit(None).cast("string").alias("generation"), F.when(n % 4 == 0, "newer").alias("newest"),
        F.when(n % 3 == 0, False).when(n % 3 == 1, True).alias("vision"))
    return catalogue.stars(rows).select("p_partkey", "stars")


@query(f"""WITH {MODELS_SQL} SELECT i, CASE WHEN head LIKE 'parasail%' THEN 'parasail-' ELSE '' END || CASE WHEN head LIKE '%gpt-oss' THEN 'gpt-oss' WHEN head LIKE '%glm' THEN 'glm' WHEN head LIKE '%haiku' THEN 'claude-haiku' ELSE 'Gemma' END || version
  || CASE WHEN tail IN (':cloud', ':free', '@eu') THEN '' ELSE tail END AS shown FROM m""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models(spark, sf_dir).select("i", keys.shown_name(F.col("model")).alias("shown"))


@query("""WITH m AS (SELECT p_brand, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 4 = 0 THEN ':free' ELSE '' END AS model_id, p_partkey AS place FROM part)
SELECT p_brand, arg_min(model_id, (CASE model_id WHEN '51' THEN 1 WHEN '50' THEN 2 WHEN '49' THEN 3 ELSE 9 END, CASE WHEN model_id LIKE '%:free' THEN 0 ELSE 1 END, place)) AS model_id FROM m WHERE place % 3 <> 0 GROUP BY p_brand""")
def default_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").filter("p_partkey % 3 != 0").select("p_brand", F.concat(size.cast("string"), F.when(size % 4 == 0, ":free").otherwise("")).alias("model_id"), F.col("p_partkey").alias("place"))
    return catalogue.default_model(rows, ("51", "50", "49"), ["p_brand"])


@query("SELECT p_brand AS provider, p_type AS model_id, max(p_partkey) AS place, arg_max(p_retailprice, p_partkey) AS price FROM part GROUP BY ALL")
def provider_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("provider"), F.col("p_type").alias("model_id"), F.col("p_partkey").alias("place"), F.col("p_retailprice").alias("price"))
    return catalogue.provider_entries(rows)


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0 AND p_size % 5 = 0")
def eu_without_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 3 == 0, "EU").otherwise("us").alias("region"), F.when(size % 5 == 0, False).when(size % 5 == 1, True).alias("trains"))
    return catalogue.european(rows).select("p_partkey")


@query("""WITH p AS (SELECT c_custkey, c_nationkey % 3 AS k FROM customer)
SELECT 'c' || c_custkey AS persona, 0 AS place, 'm' || k AS model, 'offen' AS level, FALSE AS primary FROM p WHERE k = 0 UNION ALL
SELECT 'c' || c_custkey, x, 'n' || x, CASE WHEN x = 1 THEN 'geschuetzt' ELSE 'offen' END, x = 1 FROM p, (SELECT unnest([0, 1]) AS x) WHERE k = 1""")
def persona_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 3
    routes = F.when(k == 0, '[{"modell": "m0"}]').when(k == 1, '{"rolle": "x", "wege": [{"modell": "n0"}, {"modell": "n1", "ebene": "geschuetzt", "primaer": true}]}').otherwise('"none"')
    return catalogue.persona_routes(table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("persona"), routes.alias("routes")))
