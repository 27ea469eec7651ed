"""The watch as a stream: throttle, emission on change, replays."""

from datetime import datetime, timedelta

from strandbook.streaming import watch

START = datetime(2026, 1, 1, 12)
CALLS = "session_id string, seq long, at timestamp, size long, warnings array<struct<signature:string,value:string>>"


def test_throttle_and_change(spark, tmp_path):
    rows = []
    for i in range(25):
        warnings = [("slow", "1")] if i < 15 else [("slow", "2")]
        rows.append(("s", i, START + timedelta(seconds=i), 100 + (0 if i == 10 else i), warnings))
    rows.append(("t", 0, START, 5, [("x", "1")]))
    rows.append(("t", 1, START + timedelta(seconds=61), 6, [("x", "1")]))
    rows.append(("t", 2, START + timedelta(seconds=200), 6, [("x", "9")]))  # has not grown
    spark.createDataFrame(rows, CALLS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CALLS).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = watch.watch(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.session_id, r.seq, r.value) for r in spark.table("told").collect())
    # The first call only starts the clock; ten calls later it is evaluated, then ten later again with a new value.
    assert got == [("s", 9, "1"), ("s", 19, "2"), ("t", 1, "1")]


def test_ingest_replay_adds_nothing(spark, tmp_path):
    from strandbook.sources import store

    table = str(tmp_path / "table")
    rows = spark.createDataFrame([("h", "c", "a", START), ("h", "c", "b", None)], "host string, source string, session_id string, end timestamp")
    rows.limit(0).write.parquet(table)

    def put(batch):
        store.new_rows(batch, spark.read.parquet(table), store.VERSION_KEY).write.mode("append").parquet(table)

    rows.write.parquet(str(tmp_path / "in"))
    for k in range(2):  # the second run sees the same files as new
        watch.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), put, str(tmp_path / f"cp{k}")).awaitTermination(120)
    assert spark.read.parquet(table).count() == 2


def test_output_mode(spark):
    m = spark.createDataFrame([("s", "a", 1, "first"), ("s", "b", 2, "second"), ("t", "a", 1, "x"), ("u", "c", 1, "y")], "session_id string, rule string, seq int, text string")
    levels = spark.createDataFrame([("a", "warn"), ("b", "ask"), ("c", "off")], "rule string, level string")
    assert sorted(watch.output_mode(m, levels).collect()) == [("s", "ask", "second"), ("t", "warn", "x")]
