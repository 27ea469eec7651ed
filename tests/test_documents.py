"""Loads by id read little; records and merges on odd documents; substrings and containment against plain loops."""

import random

from pyspark.sql import functions as F

from strandbook.operators import catalogue, sets
from strandbook.plans.document_queries import SHAPE
from strandbook.sources import documents


def test_one_id_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "t")
    documents.write_indexed(spark.range(5_000).withColumn("v", F.col("id") * 2), path, "id", 16)
    found = documents.load(spark, path, "id", 77, 16)
    assert found.collect() == [(77, 154)] and documents.load(spark, path, "id", 9_999_999, 16).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,77)]" in plan
    assert len(found.select(F.input_file_name()).distinct().collect()) == 1
    many = documents.load_many(spark, path, spark.range(10, 40), "id", 16)
    assert sorted(r.id for r in many.collect()) == list(range(10, 40)) and many.columns == ["id", "v"]


def test_records(spark):
    texts = ['{"id": 1, "head": {"status": "F"}, "events": [{"kind": "a", "n": 1}]}', '{"id": 2, "odd": 1, "head": {"x": 1, "y": 2}, "events": [{"kind": "a", "z": 1}, {"z": 2}]}', "{}", "[1]", "{broken", None, '{"id": null, "head": null, "events": null}']
    got = documents.records(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t", SHAPE).orderBy("k").collect()
    assert [r.unknown for r in got] == [[], ["events[].z", "head.x", "head.y", "odd"], [], None, None, None, []]
    assert [r.record is not None for r in got] == [True, False, True, False, False, False, True] and got[0].record.events[0].kind == "a"


def test_guarded_merge(spark):
    rows = [(1, '{"a": 1, "b": {"c": [1, null]}}'), (2, '{"g": null, "a": 1}'), (3, "[1]")]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("d", F.parse_json("t"))
    add = {"g": F.col("k"), "a": F.lit("new")}
    once = df.withColumn("d", F.when(F.col("k") < 3, documents.guarded(F.col("d"), "g", add, F.lit(True))).otherwise(F.col("d")))
    again = once.withColumn("d", F.when(F.col("k") < 3, documents.guarded(F.col("d"), "g", add, F.lit(True))).otherwise(F.col("d")))
    told = [r.j for r in again.orderBy("k").select(F.to_json("d").alias("j")).collect()]
    assert told == ['{"a":"new","b":{"c":[1,null]},"g":1}', '{"a":1,"g":null}', "[1]"]


def test_containing(spark):
    rng = random.Random(2)
    have = {k: {rng.choice([0, 0, 1, 2, 3, 4, 5, 6]) for _ in range(rng.randint(0, 5))} for k in range(60)}
    want = {k: {rng.randrange(8) for _ in range(rng.randint(0, 3))} for k in range(30)}
    df = lambda d, n: spark.createDataFrame([(k, [*v, *list(v)[:1], None]) for k, v in d.items()], f"{n} int, elements array<int>")
    got = sorted(map(tuple, sets.containing(df(have, "set_id"), df(want, "ask_id")).collect()))
    assert got == sorted((a, s) for a, w in want.items() for s, h in have.items() if w and w <= h) and got


def test_first_substring(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in range(80)] + ["", None]
    needles = [(k, "".join(rng.choice("ab") for _ in range(rng.randint(2, 5))), f"h{k}") for k in range(12)]
    got = {r.t: r.hit for r in catalogue.first_substring(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(needles, "ord int, needle string, hit string"), "t").collect()}
    want = {t: next((h for _, n, h in needles if n in t), None) for t in texts if t is not None}
    assert got == {t: h for t, h in want.items() if h} and got
    none = spark.createDataFrame([], "ord int, needle string, hit string")
    assert catalogue.first_substring(spark.createDataFrame([("a",)], "t string"), none, "t").count() == 0


def test_equal_asks_are_looked_for_once(spark):
    """2,500 equal asks meet a set as one (before: as so many rows of the join), and each is told of it."""
    have = spark.createDataFrame([(k, [1, 2, None] if k % 2 else [2, 3]) for k in range(40)], "set_id long, elements array<int>")
    want = spark.range(2_500).selectExpr("id AS ask_id", "IF(id % 2 = 0, array(2, 1), array(1, NULL, 2, 1)) AS elements")
    got = sets.containing(have, want)
    assert got.count() == got.distinct().count() == 2_500 * 20
    packs = sets._packs(want.selectExpr("ask_id", "array(1, 2) AS want")).selectExpr("size(asks) AS n").collect()
    assert sum(r.n for r in packs) == 2_500 and len(packs) == 3 and max(r.n for r in packs) < 1_100
