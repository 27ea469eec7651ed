"""A decision written while the stream runs counts from the next batch on."""

from datetime import datetime

from strandbook.streaming import decisions

AS_OF = datetime(2026, 6, 1)


def test_versions_and_projects(spark, tmp_path):
    made = spark.createDataFrame([
        ("a", None, "done", datetime(2026, 5, 1), "docs/a"), ("a", 1, "done", datetime(2026, 5, 9), None), ("b", 2, "obsolete", datetime(2026, 5, 1), None),
        ("c", None, "open", datetime(2026, 5, 1), None), ("d", None, "done", datetime(2025, 5, 1), None), ("e", 9, "done", datetime(2026, 5, 2), "docs/e")], "signature string, session_id long, status string, decided_at timestamp, anchor string")
    versions = spark.createDataFrame([(1, 1, "old"), (1, 2, "p"), (2, 1, "q")], "session_id long, version_id long, project string")
    rows = decisions.cache_rows(made, versions, AS_OF)
    assert sorted((r.signature, r.session_id or 0, r.project) for r in rows.collect()) == [("a", 0, ""), ("a", 1, "p"), ("b", 2, "q"), ("e", 9, "")]
    path = str(tmp_path / "cache")
    messages = spark.createDataFrame([("a", "p"), ("a", "q"), ("b", "q"), ("e", "")], "signature string, project string")
    assert decisions.undecided(messages, decisions.read_cache(spark, path)).count() == 4  # no version yet
    assert [decisions.write_cache(rows, path), decisions.write_cache(rows, path)] == [0, 1]
    told = {(r.signature, r.project): (r.decided_at, r.anchor) for r in decisions.annotated(messages, decisions.read_cache(spark, path)).collect()}
    assert told == {("a", "p"): (datetime(2026, 5, 9), None), ("a", "q"): (datetime(2026, 5, 1), "docs/a"), ("b", "q"): (None, None), ("e", ""): (None, None)}
    assert sorted(r.signature for r in decisions.undecided(messages, decisions.read_cache(spark, path)).collect()) == ["b", "e"]


def test_a_decision_during_the_stream_silences_the_next_message(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "signature string, project string, seq long"
    decision = spark.createDataFrame([("x", None, "", "done", datetime(2026, 5, 1), None)], decisions.SCHEMA)
    for k in range(3):
        spark.createDataFrame([("x", "p", k), ("y", "p", k)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []

    def put(batch, number):
        told.append(sorted(r.signature for r in batch.collect()))
        if number == 0:
            decisions.write_cache(decision, path)  # someone decides while the stream runs

    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(decisions.with_newest(path, decisions.undecided, put)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert told == [["x", "y"], ["y"], ["y"]]
