"""Appends to several tables as one, with stops at every point, replays and merged records."""

import pytest

from strandbook.sources import commits


def tables(spark, k):
    return {"good": spark.createDataFrame([(k, "a"), (k, "b")], "k int, v string"), "bad": spark.createDataFrame([(k,)], "k int")}


def rows(spark, path, table, schema):
    return sorted(tuple(r) for r in commits.committed(spark, path, table, schema).collect())


def test_a_stop_between_the_writes_and_a_replay(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert commits.commit(tables(spark, 1), path, 1)
    from pyspark.sql.readwriter import DataFrameWriter

    whole, written = DataFrameWriter.parquet, []

    def stops(self, to, *more, **options):
        if written:
            raise OSError("stopped")
        written.append(to)
        whole(self, to, *more, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", stops)
    with pytest.raises(OSError):
        commits.commit(tables(spark, 2), path, 2)
    monkeypatch.setattr(DataFrameWriter, "parquet", whole)
    assert rows(spark, path, "good", "k int, v string") == [(1, "a"), (1, "b")]  # nothing of the stopped batch is seen
    assert len(commits.leftovers(spark, path)) == 1
    assert commits.commit(tables(spark, 2), path, 2) and not commits.commit(tables(spark, 2), path, 2)
    assert rows(spark, path, "good", "k int, v string") == [(1, "a"), (1, "b"), (2, "a"), (2, "b")] and rows(spark, path, "bad", "k int") == [(1,), (2,)]


def test_a_stop_before_the_record_is_in_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(commits.Files, "put_new", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            commits.commit(tables(spark, 1), path, 1)
    assert rows(spark, path, "good", "k int, v string") == [] and len(commits.leftovers(spark, path)) == 2
    assert commits.commit(tables(spark, 1), path, 1)
    assert len(rows(spark, path, "good", "k int, v string")) == 2


def test_merged_records_and_newest(spark, tmp_path):
    path = str(tmp_path)
    assert commits.last_batch(spark, path) == -1 and commits.newest(spark, path, "good", "k int, v string").count() == 0
    for k in (1, 2, 10):
        commits.commit(tables(spark, k), path, k)
    before = rows(spark, path, "good", "k int, v string")
    assert commits.merge_records(spark, path) == 3 and rows(spark, path, "good", "k int, v string") == before
    assert not commits.commit(tables(spark, 2), path, 2)
    commits.commit(tables(spark, 11), path, 11)
    assert commits.merge_records(spark, path) == 4 and len(rows(spark, path, "bad", "k int")) == 4
    assert commits.last_batch(spark, path) == 11 and {r.k for r in commits.newest(spark, path, "good", "k int, v string").collect()} == {11}
    with pytest.raises(ValueError):
        commits.commit(tables(spark, 1), path, "../x")


def test_a_stream_replayed_from_its_start(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    put = commits.each_batch(lambda b: {"all": b, "even": b.filter("id % 2 = 0")}, str(tmp_path / "out"))
    for k in range(2):  # the second stream has lost its checkpoint
        q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / f"cp{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert commits.committed(spark, str(tmp_path / "out"), "all").count() == 5 and commits.committed(spark, str(tmp_path / "out"), "even").count() == 3
