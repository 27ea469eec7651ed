"""Queries over documents and sets: guarded merges, typed records, loads by id, substrings and containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandbook.functions import origin
from strandbook.operators import catalogue, sets
from strandbook.plans.proxy import events, table
from strandbook.sources import documents
from strandbook.sources.scratch import scratch

QUERIES, SQL = {}, {}
BUCKETS = 16
#: The shape of the documents that typed_records reads.
SHAPE = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("head", T.StructType([T.StructField("status", T.StringType())])),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())])))])


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f
    return add


@query("""WITH e AS (SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
r AS (SELECT *, CASE WHEN k % 10 <> 0 THEN event_id % 1000 END AS ref FROM e),
n AS (SELECT *, ref IS NOT NULL AND ref % 5 <> 4 AS known FROM r)
SELECT event_id, CASE WHEN k % 10 = 0 THEN 'x' WHEN known AND k % 3 = 1 AND k % 13 <> 0 THEN CAST(ref % 50 AS VARCHAR) ELSE CAST(ref AS VARCHAR) END AS session_ref,
  CASE WHEN k % 11 = 0 THEN 1 WHEN known AND k % 3 = 0 THEN ref % 50 END AS session_logical, CASE WHEN k % 13 = 0 THEN 5 WHEN known AND k % 3 = 1 THEN ref END AS session_ref_version FROM n""")
def guarded_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The backfill runs twice; the second run finds its own guards."""
    k, ref = F.col("k"), F.col("event_id") % 1000
    ev = events(spark, sf_dir)
    detail = F.parse_json(F.to_json(F.struct(
        F.when(k % 10 == 0, "x").otherwise(ref.cast("string")).alias("session_ref"), F.when(k % 11 == 0, 1).alias("session_logical"), F.when(k % 13 == 0, 5).alias("session_ref_version"))))
    source = F.when(k % 3 == 0, "legacy_review").when(k % 3 == 1, "owner").otherwise("other")
    rows = ev.select("event_id", source.alias("source"), F.lit("finding_decision").alias("kind"), detail.alias("detail"))
    versions = ev.select(ref.alias("version_id")).distinct().filter("version_id % 5 <> 4").withColumn("logical_id", F.col("version_id") % 50)
    out = documents.backfilled(documents.backfilled(rows, versions), versions)
    field = lambda name, kind: F.try_variant_get("detail", f"$.{name}", kind).alias(name)
    return out.select("event_id", field("session_ref", "string"), field("session_logical", "long"), field("session_ref_version", "long"))


@query("""WITH u AS (SELECT *, concat_ws(',', CASE WHEN o_orderkey % 7 = 2 THEN 'events[].odd' END, CASE WHEN o_orderkey % 10 = 3 THEN 'head.extra' END) AS unknown FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 1 THEN unknown END AS unknown, CASE WHEN unknown = '' AND o_orderkey % 50 <> 1 THEN o_orderstatus END AS status, CASE WHEN unknown = '' AND o_orderkey % 50 <> 1 THEN 2 END AS n_events FROM u""")
def typed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    one = F.struct(F.col("o_orderpriority").alias("kind"), F.lit(1).alias("n"), F.lit(None).cast("int").alias("odd"))
    other = F.struct(F.lit("end").alias("kind"), F.lit(2).alias("n"), F.when(k % 7 == 2, 1).alias("odd"))
    text = F.to_json(F.struct(k.alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.when(k % 10 == 3, "?").alias("extra")).alias("head"), F.array(one, other).alias("events")))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 50 == 1, "no json").otherwise(text).alias("text"))
    read = documents.records(docs, "text", SHAPE)
    return read.select("o_orderkey", F.array_join("unknown", ",").alias("unknown"), F.col("record.head.status").alias("status"), F.when(F.col("record").isNotNull(), F.size("record.events")).alias("n_events"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 997 = 1")
def document_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch(spark, "orders-by-id")
    documents.write_indexed(orders.select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_orderkey", BUCKETS)
    return documents.load_many(spark, path, orders.filter("o_orderkey % 997 = 1"), "o_orderkey", BUCKETS)


@query("""WITH o AS (SELECT l_orderkey, list(DISTINCT l_partkey % 40) AS have FROM lineitem GROUP BY l_orderkey)
SELECT s_suppkey AS ask_id, l_orderkey AS set_id FROM supplier JOIN o ON list_contains(have, s_suppkey % 40) AND list_contains(have, (7 * s_suppkey + 3) % 40) AND list_contains(have, (11 * s_suppkey + 5) % 40)""")
def contained_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.collect_set(F.col("l_partkey") % 40).alias("elements"))
    s = F.col("s_suppkey")
    return sets.containing(have, table(spark, sf_dir, "supplier").select(s.alias("ask_id"), F.array(s % 40, (7 * s + 3) % 40, (11 * s + 5) % 40).alias("elements")))


@query("""WITH w AS (SELECT DISTINCT lower(list_extract(string_split(p_type, ' '), -1)) AS needle FROM part), d AS (SELECT needle, row_number() OVER (ORDER BY needle DESC) AS ord FROM w),
m AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'azure/' || p_type WHEN 1 THEN p_type || ':' || p_brand WHEN 2 THEN p_brand || '/x' ELSE 'AZURE/azure/' || p_brand || '/' || p_type END AS model_id, p_brand, p_size FROM part),
f AS (SELECT p_partkey, arg_min(needle, ord) AS needle FROM m JOIN d ON contains(lower(model_id), needle) GROUP BY p_partkey)
SELECT m.p_partkey, model_id, CASE WHEN p_size % 4 IN (2, 3) THEN p_brand ELSE coalesce(needle, '') END AS manufacturer, CASE WHEN p_size % 4 IN (2, 3) THEN 'slug' WHEN needle IS NOT NULL THEN 'name' ELSE 'unknown' END AS origin
FROM m LEFT JOIN f ON f.p_partkey = m.p_partkey""")
def model_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = F.col("p_size") % 4
    name = F.when(n == 0, F.concat(F.lit("azure/"), "p_type")).when(n == 1, F.concat_ws(":", "p_type", "p_brand")).when(n == 2, F.concat("p_brand", F.lit("/x"))).otherwise(F.concat(F.lit("AZURE/azure/"), "p_brand", F.lit("/"), "p_type"))
    needles = part.select(F.lower(F.element_at(F.split("p_type", " "), -1)).alias("needle")).distinct()
    longer = needles.select(F.col("needle").alias("other"))
    ranked = needles.join(longer, F.col("other") >= F.col("needle")).groupBy("needle").agg(F.count("*").alias("ord"))  # some words, each with its place from the last
    dim = ranked.select("ord", F.lit(None).cast("string").alias("slug"), "needle", F.col("needle").alias("manufacturer"), F.lit("name").alias("origin"))
    slugs = part.select(F.lit(0).cast("long").alias("ord"), F.lower("p_brand").alias("slug"), F.lit(None).cast("string").alias("needle"), F.col("p_brand").alias("manufacturer"), F.lit("slug").alias("origin")).distinct()
    return catalogue.origins(part.select("p_partkey", name.alias("model_id")), dim.unionByName(slugs), ("azure",))


@query("""WITH m AS (SELECT p_partkey, p_brand, p_size, unnest([p_brand || ':x', lower(p_type), 'up/' || p_brand]) AS model FROM part),
u AS (SELECT p_partkey, model FROM m WHERE p_size % 5 <> 0 AND NOT contains(model, '/') AND split_part(model, ':', 1) NOT IN ('Brand#13', 'Brand#22', 'economy brushed tin'))
SELECT p.p_partkey, coalesce((SELECT string_agg(model, ',' ORDER BY model) FROM u WHERE u.p_partkey = p.p_partkey), '') AS models FROM part p""")
def unknown_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry of three names does not know; it has one by a tag, whose base name it knows too."""
    registry = F.array(*map(F.lit, ("Brand#13:q4", "Brand#22", "economy brushed tin")))
    source = F.when(F.col("p_size") % 5 == 0, "codex").otherwise("claude")
    models = F.array(F.concat("p_brand", F.lit(":x")), F.lower("p_type"), F.concat(F.lit("up/"), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(origin.unknown_models(source, models, registry), ",").alias("models"))
