"""Files are read once, again when they change, and counted by what became of them."""

import json
import os

from strandbook.sources import commits, manifest
from strandbook.sources.lines import read_lines


def reader(spark):
    def read(paths):
        lines = read_lines(spark, paths)
        from pyspark.sql import functions as F

        quality = lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("v").isNull()).alias("broken_lines"))
        return {"lines": lines.filter("v is not null").select("path", "line_no", "line")}, quality, lines.filter("line like '%secret%'").select("path")
    return read


def test_ingest(spark, tmp_path):
    files, store = tmp_path / "in", str(tmp_path / "store")
    files.mkdir()
    put = lambda name, *lines: (files / name).write_text("\n".join(lines))
    put("a.jsonl", json.dumps({"n": 1}), "{broken")
    put("b.jsonl", "{broken", "nothing")
    put("c.jsonl", json.dumps({"n": "secret"}))
    put("d.txt", "{}")
    run = lambda batch: manifest.ingest(spark, str(files), store, batch, reader(spark), "*.jsonl")
    assert run(1) == {"new": 1, "changed": 0, "existing": 0, "broken": 1, "refused": 1}
    assert run(1) is None or run(1)["existing"] == 3  # a replay of the same batch adds nothing
    assert commits.committed(spark, store, "lines").count() == 1
    put("a.jsonl", json.dumps({"n": 1}), json.dumps({"n": 2}), json.dumps({"n": 3}))
    os.utime(files / "a.jsonl", (2_000_000_000, 2_000_000_000))
    put("e.jsonl", json.dumps({"n": 5}))
    assert run(2) == {"new": 1, "changed": 1, "existing": 2, "broken": 0, "refused": 0}
    assert commits.committed(spark, store, "lines").count() == 5
    assert run(3) == {"new": 0, "changed": 0, "existing": 4, "broken": 0, "refused": 0}
