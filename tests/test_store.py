"""The store: idempotent appends, upserts, retention, re-ingest."""

from datetime import datetime

from strandbook.sources import store

T = [datetime(2026, 1, d) for d in range(1, 30)]
SCHEMA = "host string, source string, session_id string, end timestamp, start timestamp, project string, findings array<struct<rule:string,severity:string,signature:string>>"


def batch(spark, *rows):
    return spark.createDataFrame([("h", "c", s, e, T[0], "p", [("r", "hint", "g")]) for s, e in rows], SCHEMA)


def test_double_append_adds_nothing(spark):
    first = batch(spark, ("a", T[1]), ("b", None), ("b", None))
    empty = first.limit(0)
    fresh, flat = store.append_sessions(first, empty)
    assert (fresh.count(), flat.count()) == (2, 2)
    again, _ = store.append_sessions(first, fresh)
    assert again.count() == 0
    later, _ = store.append_sessions(batch(spark, ("a", T[2])), fresh)
    assert later.count() == 1
    latest = store.latest_versions(fresh.unionByName(later), store.LOGICAL_KEY, "end", "version_id")
    assert {r.session_id: r.end for r in latest.collect()} == {"a": T[2], "b": None}


def test_upsert_and_enrich(spark):
    table = spark.createDataFrame([("m", "p", 1), ("n", "p", 2)], "model string, provider string, x int")
    new = spark.createDataFrame([("n", "p", 3), ("o", "p", 4)], "model string, provider string, x int")
    assert sorted(store.upsert(table, new, ["model", "provider"]).collect()) == [("m", "p", 1), ("n", "p", 3), ("o", "p", 4)]
    assert store.upsert_counts(table, new, ["model", "provider"]).first() == (1, 1)
    assert sorted(store.upsert(table, new.limit(0), ["model", "provider"]).collect()) == [("m", "p", 1), ("n", "p", 2)]
    rich = store.enrich(table, spark.createDataFrame([("m", "p", None)], "model string, provider string, x int"), ["model", "provider"], ["x"])
    assert sorted((r.model, r.x) for r in rich.collect() if r.x is not None) == [("n", 2)]


def test_retention(spark):
    import pytest

    versions, findings = store.append_sessions(batch(spark, ("a", T[1]), ("b", T[2])), batch(spark))
    gone = versions.filter("session_id = 'a'").select("version_id", "logical_id")
    tables = {"versions": versions, "findings": findings, "chats": versions.select("logical_id"), "events": versions.select("logical_id"), "logical": versions.select("logical_id").distinct()}
    preview = store.retention_preview(tables, gone)
    assert preview == {"versions": 1, "findings": 1, "chats": 1, "events": 1, "logical": 1}
    assert store.expired(versions, "start", T[28], 10).count() == 2 and store.expired(versions, "start", T[9], 9).count() == 0
    with pytest.raises(ValueError):
        store.expired(versions, "start", T[9], 3)


def test_reingest(spark):
    versions, findings = store.append_sessions(batch(spark, ("a", T[1]), ("b", T[2])), batch(spark))
    versions = versions.withColumn("document", versions.session_id)
    again = versions.filter("session_id = 'a'").selectExpr("version_id", "'new' as document", "array(named_struct('rule', 'x', 'severity', 'high', 'signature', 'y')) as findings")
    docs, flat = store.reingest(versions, findings, again)
    assert sorted(r.document for r in docs.collect()) == ["b", "new"]
    assert sorted(r.rule for r in flat.collect()) == ["r", "x"]
