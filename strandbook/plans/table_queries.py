"""Queries over the other tables: versions, benchmarks, catalogue, redaction, dimensions."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbook.functions import keys, origin, text
from strandbook.operators import benchmarks, lifecycle, lookup, metrics, rules, sets
from strandbook.operators.catalogue import best_of_line, performance
from strandbook.operators.sessions import in_days
from strandbook.plans.event_queries import r6
from strandbook.plans.proxy import table
from strandbook.sources import store

QUERIES, SQL = {}, {}
#: Reference time of queries over orders.
ORDERS_AS_OF = datetime(2001, 1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return store.latest_versions(orders, ["o_custkey"], "o_orderdate", "o_orderkey")


@query("SELECT o_custkey, min(o_orderdate) AS first_at, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_id FROM orders GROUP BY o_custkey")
def first_version_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.first_versions(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""WITH b AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, nullif(o_orderstatus, 'F') AS status FROM orders),
known AS (SELECT * FROM b WHERE day < '1998-01-01')
SELECT DISTINCT o_custkey, day, status FROM b WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.o_custkey IS NOT DISTINCT FROM b.o_custkey AND k.day IS NOT DISTINCT FROM b.day AND k.status IS NOT DISTINCT FROM b.status)""")
def null_safe_dedup_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    return store.new_rows(batch, batch.filter("day < '1998-01-01'"), ["o_custkey", "day", "status"])


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS project, o_totalprice AS cost FROM orders),
n AS (SELECT project, list_sort(list(cost)) AS l FROM o GROUP BY project),
r AS (SELECT o.*, row_number() OVER (PARTITION BY project ORDER BY cost, o_orderkey) AS i FROM o),
x AS (SELECT r.*, len(l) - 1 AS others, CAST(floor(0.95 * (len(l) - 2)) AS INT) AS lo, 0.95 * (len(l) - 2) - floor(0.95 * (len(l) - 2)) AS f, l FROM r JOIN n USING (project)),
y AS (SELECT *, l[CASE WHEN lo + 1 < i THEN lo + 1 ELSE lo + 2 END] AS a, l[CASE WHEN lo + 2 < i THEN lo + 2 ELSE lo + 3 END] AS b FROM x)
SELECT o_orderkey, project, cost, others, round(a + f * (coalesce(b, a) - a), 4) AS others_p FROM y WHERE others >= 10 AND cost > a + f * (coalesce(b, a) - a)""")
def cost_outlier_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("project"), F.col("o_totalprice").alias("cost"))
    return rules.cost_outliers(o, ["project"], "cost", "o_orderkey").select("o_orderkey", "project", "cost", "others", F.round("others_p", 4).alias("others_p"))


SESSIONS_SQL = """s AS (SELECT l_orderkey, any_value(o_orderpriority) AS project, count(*) AS rounds, sum(l_extendedprice) AS cost, CAST(sum(l_quantity) AS BIGINT) AS output,
  count(*) FILTER (l_returnflag <> 'N') AS tools, count(*) FILTER (l_linestatus = 'F') / count(*) AS error_rate, CAST(sum(l_linenumber) AS BIGINT) * 1000 AS duration_ms
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)"""


def order_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a session, its lines are rounds, its priority the project."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("rounds"), F.sum("l_extendedprice").alias("cost"), F.sum("l_quantity").cast("long").alias("output"),
        F.count_if(F.col("l_returnflag") != "N").alias("tools"), (F.count_if(F.col("l_linestatus") == "F") / F.count("*")).alias("error_rate"),
        (F.sum("l_linenumber").cast("long") * 1000).alias("duration_ms"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("project"))
    return lines.join(orders, "l_orderkey")


MEDIANS_SQL = """count(*) AS n, round(median(cost / greatest(rounds, 1)), 6) AS cost_per_round, median(output // greatest(rounds, 1)) AS output_per_round,
  median(tools // greatest(rounds, 1)) AS tools_per_round, median(rounds) AS rounds, round(median(error_rate), 6) AS error_rate, median(duration_ms // greatest(rounds, 1)) AS duration_per_round_ms"""


def _medians(df: DataFrame) -> DataFrame:
    return df.withColumns({"cost_per_round": F.round("cost_per_round", 6), "error_rate": F.round("error_rate", 6)})


@query(f"WITH {SESSIONS_SQL} SELECT project, {MEDIANS_SQL} FROM s WHERE rounds >= 5 GROUP BY project")
def benchmark_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _medians(benchmarks.session_benchmark(order_sessions(spark, sf_dir), ["project"]))


@query(f"WITH {SESSIONS_SQL} SELECT {MEDIANS_SQL} FROM s WHERE rounds >= 5 AND project = 'none'")
def benchmark_empty_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _medians(benchmarks.session_benchmark(order_sessions(spark, sf_dir).filter("project = 'none'")))


RATIOS_SQL = """l AS (SELECT l_orderkey, l_returnflag = 'R' AS sub, l_quantity AS q, l_extendedprice AS p, l_linenumber AS i, l_linestatus FROM lineitem),
d AS (SELECT l_orderkey, count(*) FILTER (sub) AS starts,
  coalesce(count(*) FILTER (sub) / nullif(count(*), 0), 0) AS call_ratio,
  coalesce(sum(p) FILTER (sub), 0) / sum(p) AS cost_ratio,
  coalesce(sum(q) FILTER (sub), 0) / sum(q) AS output_ratio,
  coalesce(sum(i) FILTER (sub), 0) / sum(i) AS time_ratio,
  count(*) FILTER (sub) / count(*) AS tool_ratio,
  CASE WHEN count(*) FILTER (sub) > 0 THEN count(*) FILTER (sub AND l_linestatus = 'F') / count(*) FILTER (sub) ELSE 0 END AS error_ratio
  FROM l GROUP BY l_orderkey)"""


def order_delegation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines are sub-agents' work, the others the session's own."""
    l = table(spark, sf_dir, "lineitem").withColumn("session_id", F.col("l_orderkey"))
    sub = F.col("l_returnflag") == "R"
    sessions = l.groupBy("session_id").agg(
        F.count("*").alias("rounds"), F.sum("l_linenumber").alias("duration_ms"), F.count_if(~sub).alias("tools"), F.sum(F.when(~sub, F.col("l_quantity")).otherwise(0.0)).alias("output"),
        F.sum(F.when(sub, F.col("l_extendedprice"))).alias("cost_subagents"), F.sum("l_extendedprice").alias("cost_total"))
    agents = l.filter(sub).select(
        "session_id", F.lit(1).alias("tools"), (F.col("l_linestatus") == "F").cast("int").alias("tool_errors"), F.col("l_linenumber").alias("duration_ms"),
        F.struct(F.col("l_quantity").alias("output")).alias("token"), F.lit("observed").alias("evidence"), F.lit(1).alias("depth"))
    return metrics.delegation(sessions, agents)


RATIOS = ["call_ratio", "cost_ratio", "output_ratio", "time_ratio", "tool_ratio"]


@query(f"WITH {RATIOS_SQL} SELECT l_orderkey AS session_id, starts, {', '.join(f'round({c}, 6) AS {c}' for c in [*RATIOS, 'error_ratio'])} FROM d")
def delegation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_delegation(spark, sf_dir).select("session_id", "starts", *map(r6, [*RATIOS, "error_ratio"]))


@query(f"""WITH {RATIOS_SQL} SELECT o_orderpriority AS project, count(*) AS n, {', '.join(f'round(median({c}), 6) AS {c}' for c in RATIOS)}
FROM d JOIN orders ON o_orderkey = l_orderkey WHERE starts >= 1 GROUP BY o_orderpriority""")
def delegation_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderpriority").alias("project"))
    out = benchmarks.delegation_benchmark(order_delegation(spark, sf_dir).join(orders, "session_id"), ["project"])
    return out.select("project", "n", *map(r6, RATIOS))


NAMES_SQL = "CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || ':' || p_brand ELSE 'up/' || p_brand END"


@query(f"""WITH u AS (SELECT l_orderkey, l_linenumber, {NAMES_SQL} AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT p_type AS key, min(p_partkey) AS position FROM part GROUP BY p_type),
a AS (SELECT 'up/' || p_brand AS alias, p_type AS key FROM part WHERE p_size < 10 GROUP BY ALL),
f AS (SELECT alias, arg_min(key, position) AS key FROM a JOIN k USING (key) GROUP BY alias),
j AS (SELECT u.*, x.key AS e, CASE WHEN split_part(u.name, ':', 1) <> u.name THEN y.key END AS b, f.key AS al FROM u LEFT JOIN k x ON x.key = u.name LEFT JOIN k y ON y.key = split_part(u.name, ':', 1) LEFT JOIN f ON f.alias = u.name)
SELECT l_orderkey, l_linenumber, name, coalesce(e, b, al) AS price_key, CASE WHEN e IS NOT NULL THEN 'exact' WHEN b IS NOT NULL THEN 'base' WHEN al IS NOT NULL THEN 'alias' END AS tier FROM j""")
def price_lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, F.concat_ws(":", "p_type", "p_brand")).otherwise(F.concat(F.lit("up/"), "p_brand"))
    usage = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", name.alias("name")), "p_partkey")
    alias = F.when(F.col("p_size") < 10, F.concat(F.lit("up/"), "p_brand"))
    prices = part.groupBy(F.col("p_type").alias("key")).agg(F.min("p_partkey").alias("position"), F.collect_set(alias).alias("aliases"))
    return lookup.price_lookup(usage, "name", prices).select("l_orderkey", "l_linenumber", "name", "price_key", "tier")


@query("""SELECT o_orderkey, c_name AS project, o_orderdate AS start, coalesce(nullif(o_totalprice, 0), NULL) AS cost, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-02-01' QUALIFY place <= 30""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 30 of a month, as the list shows them."""
    rows = in_days(table(spark, sf_dir, "orders"), date(1997, 1, 1), date(1997, 1, 31), "o_orderdate")
    top = rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("project"))
    place = F.row_number().over(Window.orderBy(F.desc("start"), "o_orderkey")).cast("long")  # of at most 30 rows
    return top.join(customers, "o_custkey").select("o_orderkey", "project", F.col("o_orderdate").alias("start"), F.col("o_totalprice").alias("cost")).withColumn("place", place)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1996-03-01'")
def day_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_days(table(spark, sf_dir, "orders"), date(1996, 2, 1), date(1996, 2, 29), "o_orderdate").select("o_orderkey", "o_orderdate")


@query("""WITH a AS (SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'MACHINERY' END AS source, r_name AS project, n_nationkey % 2 = 0 AS hidden FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 <> 1),
s AS (SELECT c_custkey, n_name AS project, c_mktsegment AS source FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, coalesce(o.project, y.project, s.project) AS project_shown, CASE WHEN o.name IS NOT NULL OR y.name IS NOT NULL THEN 'known' ELSE 'unassigned' END AS context, coalesce(o.hidden, y.hidden, FALSE) AS hidden
FROM s LEFT JOIN a o ON o.name = s.project AND o.source = s.source LEFT JOIN a y ON y.name = s.project AND y.source IS NULL""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    aliases = nation.filter("n_nationkey % 4 != 1").join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "MACHINERY").alias("source"), F.col("r_name").alias("project"), F.lit("known").alias("context"), (F.col("n_nationkey") % 2 == 0).alias("hidden"))
    sessions = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("project"), F.col("c_mktsegment").alias("source"))
    return origin.resolve_projects(sessions, aliases).select("c_custkey", "project_shown", "context", "hidden")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'codex' WHEN c_mktsegment = 'FURNITURE' AND c_custkey % 2 = 0 THEN 'unknown' WHEN c_mktsegment = 'BUILDING' THEN 'openrouter' WHEN c_nationkey % 5 = 0 THEN 'claude'
  WHEN c_nationkey % 5 = 1 THEN 'ollama' WHEN c_nationkey % 5 = 2 THEN 'requesty' WHEN c_nationkey % 5 = 3 THEN 'openrouter' ELSE 'unknown' END AS shown FROM customer""")
def display_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    one = lambda *m: F.array(*map(F.lit, m))
    k = F.col("c_nationkey") % 5
    models = F.when(k == 0, one("claude-a", "<synthetic>")).when(k == 1, one("claude-a", "qwen:8b")).when(k == 2, one("lab/fast")).when(k == 3, one("claude-a", "other/slow")).otherwise(one("claude-a", "mystery"))
    other = (F.col("c_mktsegment") == "FURNITURE") & (F.col("c_custkey") % 2 == 0)
    source = F.when(F.col("c_mktsegment") == "MACHINERY", "codex").when(other, "elsewhere").otherwise("claude")
    backend = F.when(F.col("c_mktsegment") == "BUILDING", "openrouter").otherwise("unheard of")
    return c.select("c_custkey", origin.display_source(source, backend, models, one("qwen"), one("lab/fast"), one("claude-a")).alias("shown"))


@query("SELECT c_mktsegment AS project, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def project_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return origin.distribution(orders.join(table(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("c_mktsegment", "project"), "project")


STATUS_OF = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_review' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'dissent' ELSE 'open' END END"


@query(f"""WITH s AS (SELECT o_custkey, {STATUS_OF} AS status FROM orders)
SELECT o_custkey, arg_min(status, list_position(['relapse', 'dissent', 'confirmed', 'in_review', 'open', 'rejected', 'done', 'obsolete'], status)) AS status FROM s GROUP BY o_custkey""")
def group_status_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.expr(STATUS_OF).alias("status"))
    return lifecycle.group_status(rows, ["o_custkey"])


VERDICTS = "CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' ELSE 'unclear' END AS first, CASE WHEN doc_id % 5 <> 0 THEN CASE toxic WHEN 1 THEN 'no' WHEN 0 THEN 'yes' ELSE 'unclear' END END AS second"


@query(f"""WITH v AS (SELECT doc_id, {VERDICTS} FROM labels)
SELECT doc_id, CASE WHEN second IS NULL THEN CASE WHEN first = 'yes' THEN 'confirmed' ELSE 'rejected' END WHEN first = second AND first = 'yes' THEN 'confirmed' WHEN first = second AND first = 'no' THEN 'rejected' ELSE 'dissent' END AS result FROM v""")
def dissent_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").selectExpr("doc_id", *[x + e for x, e in zip(VERDICTS.replace(" AS second", "").split(" AS first, "), (" AS first", " AS second"), strict=True)])
    return rows.select("doc_id", lifecycle.reconcile(F.col("first"), F.col("second")).alias("result"))


@query("""SELECT p_type, p_partkey, p_retailprice, p_brand FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 7 = 1 THEN 0 ELSE p_retailprice END AS price FROM part)
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY price IS NULL, coalesce(price = 0, FALSE), price, p_partkey) = 1""")
def cheapest_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("p_size") % 7 == 0, F.lit(None)).when(F.col("p_size") % 7 == 1, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    part = table(spark, sf_dir, "part").withColumn("price", price)
    return lookup.cheapest(part, ["p_type"], ["price"], "p_partkey").select("p_type", "p_partkey", "p_retailprice", "p_brand")


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first FROM part WHERE p_type <> '' GROUP BY ALL)
SELECT p_brand, p_type, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) = 1""")
def most_frequent_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.most_frequent(table(spark, sf_dir, "part"), ["p_brand"], "p_type", "p_partkey")


@query("""WITH v AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 25 THEN p_name END AS v FROM part)
SELECT p_brand, arg_min(v, p_partkey) FILTER (v IS NOT NULL) AS v FROM v GROUP BY p_brand""")
def first_non_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).alias("v"))
    return lookup.first_non_null(rows, ["p_brand"], "v", ["p_partkey"])


@query("""WITH d AS (SELECT p_name || '/' || CAST(p_size AS VARCHAR) AS key, p_brand, p_type FROM part)
SELECT key, min(p_brand) AS p_brand, min(p_type) AS p_type FROM d GROUP BY key HAVING count(DISTINCT (p_brand, p_type)) = 1""")
def ambiguous_key_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("key", F.concat_ws("/", "p_name", "p_size"))
    return lookup.unambiguous(rows, "key", ["p_brand", "p_type"])


@query(r"""WITH m AS (SELECT p_partkey, p_brand || '/' || replace(p_name, ' ', '_') || '-' || p_size || ':free' AS model FROM part),
n AS (SELECT *, regexp_replace(regexp_replace(lower(split_part(split_part(model, '/', -1), ':', 1)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS normal FROM m)
SELECT p_partkey, normal, array_to_string(list_sort(string_split(normal, '-')), '-') AS sorted FROM n""")
def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.col("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_size"), F.lit(":free"))
    return table(spark, sf_dir, "part").select("p_partkey", keys.normal_key(model).alias("normal"), keys.sorted_key(model).alias("sorted"))


@query("""SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size < 30 AND o.p_name = b.p_name AND o.p_brand = b.p_brand)) AS new,
  count(*) FILTER (EXISTS (SELECT 1 FROM part o WHERE o.p_size < 30 AND o.p_name = b.p_name AND o.p_brand = b.p_brand)) AS updated
FROM (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size >= 25) b""")
def catalogue_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return store.upsert_counts(part.filter("p_size < 30"), part.filter("p_size >= 25"), ["p_name", "p_brand"])


@query("""WITH k AS (SELECT p_name, p_brand, p_size, p_retailprice FROM part), b AS (SELECT p_name, p_brand, max((p_size, p_retailprice)) AS r FROM k WHERE p_size >= 25 GROUP BY ALL)
SELECT p_name, p_brand, r[1] AS p_size, r[2] AS p_retailprice FROM b UNION ALL
SELECT * FROM k WHERE p_size < 30 AND NOT EXISTS (SELECT 1 FROM b WHERE b.p_name = k.p_name AND b.p_brand = k.p_brand)""")
def catalogue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_size", "p_retailprice")
    return store.upsert(part.filter("p_size < 30"), part.filter("p_size >= 25"), ["p_name", "p_brand"])


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey) AS place FROM customer""")
def nulls_last_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(known.desc_nulls_last(), "c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", place.cast("long").alias("place"))


@query("""SELECT p_partkey, round(CASE WHEN p_size % 10 <> 0 AND (3 * (p_size % 9) + p_retailprice) / 4 > 0 THEN p_size / ((3 * (p_size % 9) + p_retailprice) / 4) END, 6) AS performance FROM part""")
def price_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("p_size") % 10 != 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(performance(score, F.col("p_size") % 9, F.col("p_retailprice")), 6).alias("performance"))


@query(r"""WITH n AS (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 's' || c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'd' || doc_id, source FROM documents)
SELECT id, CASE WHEN regexp_full_match(name, '[A-Za-z0-9_.:\-]{1,48}') OR name = '' THEN name WHEN name IS NOT NULL THEN 'unbekannt:' || substr(sha256(name), 1, 8) END AS name FROM n""")
def safe_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, d = table(spark, sf_dir, "customer"), table(spark, sf_dir, "documents")
    one = lambda df, mark, id_, name: df.select(F.concat(F.lit(mark), id_).alias("id"), F.col(name).alias("name"))
    names = one(c, "c", "c_custkey", "c_name").unionByName(one(c, "s", "c_custkey", "c_mktsegment")).unionByName(one(d, "d", "doc_id", "source"))
    return names.select("id", text.safe_identifier(F.col("name")).alias("name"))


def violation_sql(c: str, length: bool = True) -> str:
    first = f"WHEN length({c}) > 80 THEN 'length' " if length else ""
    return (f"CASE {first}WHEN contains({c}, '_lokal') THEN 'local' WHEN regexp_matches({c}, '[/\\\\]|[A-Za-z]:\\\\') THEN 'path' "
            f"WHEN regexp_matches({c}, 'sk-|AKIA|ghp_|-----BEGIN') THEN 'secret' WHEN regexp_matches({c}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') THEN 'email' END")


@query(f"SELECT 'd' || doc_id AS id, {violation_sql('text', False)} AS violation FROM documents UNION ALL SELECT 'p' || page_id, {violation_sql('url')} FROM pages")
def violation_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), text.violation(F.col("text"), length=False).alias("violation"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), text.violation(F.col("url")).alias("violation"))
    return docs.unionByName(pages)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' - INTERVAL 1500 DAY AND o_orderpriority = '1-URGENT'")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.expired(table(spark, sf_dir, "orders"), "o_orderdate", ORDERS_AS_OF, 1500, "o_orderpriority", "1-URGENT").select("o_orderkey")


@query("""SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS round,
  CASE WHEN length(text) > 80 THEN rtrim(substr(text, 1, 79), ' ') || '…' ELSE text END AS label FROM conversations""")
def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(upto)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("round"), text.label(F.col("text")).alias("label"))


@query("""WITH p AS (SELECT p_partkey, p_name, CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS v, lower(p_name) AS c, lower(replace(p_name, 'e', 'a')) AS c2,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'no' ELSE CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END END AS v2 FROM part)
SELECT p_partkey, CASE WHEN v2 IS NULL THEN 'single' WHEN v = 'unclear' OR v2 = 'unclear' OR v <> v2 OR NOT (c = c2 OR contains(c, c2) OR contains(c2, c) OR levenshtein(c, c2) <= 3) THEN 'dissent' ELSE v END AS result FROM p""")
def string_similarity_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("p_size") % 3 == 0, "yes").when(F.col("p_size") % 3 == 1, "no").otherwise("unclear")
    first = table(spark, sf_dir, "part").select("p_partkey", "p_size", verdict.alias("verdict"), F.col("p_name").alias("category"))
    second = first.filter("p_size % 4 != 0").select("p_partkey", F.when(F.col("p_size") % 5 == 0, "no").otherwise(F.col("verdict")).alias("verdict"), F.replace("category", F.lit("e"), F.lit("a")).alias("category"))
    return lifecycle.consensus(first, second, ["p_partkey"]).select("p_partkey", "result")


@query("""WITH g AS (SELECT c_nationkey, list_sort(list(c_custkey) FILTER (c_acctbal > 5000)) AS o, list_sort(list(c_custkey) FILTER (c_acctbal <= 5000)) AS d, list(c_custkey) FILTER (c_acctbal < 0) AS x FROM customer GROUP BY c_nationkey)
SELECT c_nationkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(o, []), coalesce(x, [])))), ',') AS open, array_to_string(list_filter(coalesce(d, []), lambda e: NOT list_contains(coalesce(x, []), e)), ',') AS done FROM g""")
def set_union_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.collect_list(F.when(F.expr(c), F.col("c_custkey")))
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(ids("c_acctbal > 5000").alias("o"), ids("c_acctbal <= 5000").alias("d"), ids("c_acctbal < 0").alias("x"))
    open_, done = sets.reopened(F.col("o"), F.col("d"), F.col("x"))
    return g.select("c_nationkey", F.array_join(open_, ",").alias("open"), F.array_join(done, ",").alias("done"))


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900)")
def set_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return sets.minus(table(spark, sf_dir, "nation").select("n_nationkey"), rich, ["n_nationkey"])


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(m|blog)\.', '') AS host, CASE WHEN url LIKE 'https://%' THEN 'secure' ELSE 'plain' END AS scheme FROM pages""")
def page_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_replace(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"^(m|blog)\.", "")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.when(F.col("url").startswith("https://"), "secure").otherwise("plain").alias("scheme"))


@query("""SELECT p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) = 1""")
def best_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of_line(table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice"), "p_type", "p_retailprice", "p_partkey")
