"""Appends to several tables that count as one: all of a batch is there, once, or nothing of it.

A batch's rows are written beside the tables under a path of the attempt's own, and
then one small record that names these paths is put in place. Readers follow records
alone, so an attempt that stopped half-way is never seen. A record's name is its
batch, and putting it in place fails where it already lies: a replay adds nothing.

The folder is ``<path>/<table>/<batch>-<attempt>`` for rows, ``<path>/_commits/<batch>.json``
for records, and ``<path>/_commits/_merged-<n>.json`` for many old records as one.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.operators import rules
from strandbook.sources.contracts import parted

#: Records that are read one by one before they should be merged.
MERGE_AT = 1_000


class Files:
    """The few operations on the shared storage that records need, by the session's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._bytes = lambda text: text.encode()
        self._io = jvm.org.apache.commons.io.IOUtils

    def exists(self, file: str) -> bool:
        return self._fs.exists(self._path(file))

    def put_new(self, file: str, text: str) -> bool:
        """Puts a file in place, whole, unless there is one; says whether it did."""
        target = self._path(file)
        if self._fs.exists(target):
            return False
        draft = self._path(f"{file.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(self._bytes(text))
        out.close()
        if self._fs.rename(draft, target):
            return True
        self._fs.delete(draft, False)
        return False

    def text_if_there(self, file: str) -> str | None:
        if not self.exists(file):
            return None
        stream = self._fs.open(self._path(file))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def delete(self, file: str) -> None:
        self._fs.delete(self._path(file), True)


def _records(files: Files, path: str) -> dict[str, dict[str, str]]:
    """batch: {table: folder} of everything that was committed."""
    out: dict[str, dict[str, str]] = {}
    for name in files.names(f"{path}/_commits"):
        if not name.endswith(".json"):
            continue
        text = files.text_if_there(f"{path}/_commits/{name}")
        if text is None:  # merged between the listing and now
            return _records(files, path)
        found = json.loads(text)
        out |= found if name.startswith("_merged-") else {name.removesuffix(".json"): found}
    return out


def commit(tables: dict[str, DataFrame], path: str, batch: int | str) -> bool:
    """Appends rows to each table as the one batch ``batch``; False if that batch is already there, and then nothing is written.

    Batch names are numbers or words of letters, digits, ``-`` and ``.``. Two writers of one
    batch may both write rows, but one record is put in place, so one's rows count.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", str(batch)):
        raise ValueError("a batch's name has letters, digits, - and . only")
    spark = next(iter(tables.values())).sparkSession
    files = Files(spark, path)
    if str(batch) in _records(files, path):
        return False
    attempt = uuid.uuid4().hex
    folders = {name: f"{name}/{batch}-{attempt}" for name in tables}
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{folders[name]}")
    return files.put_new(f"{path}/_commits/{batch}.json", json.dumps(folders))


def committed(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame:
    """The rows of all committed batches of a table; no batches give no rows, which needs a ``schema``."""
    files = Files(spark, path)
    folders = [f"{path}/{f[table]}" for f in _records(files, path).values() if table in f]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    return reader.parquet(*folders)


def last_batch(spark: SparkSession, path: str) -> int:
    """The largest number among the batches, -1 if there are none."""
    return max((int(b) for b in _records(Files(spark, path), path) if b.isdecimal()), default=-1)


def newest(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of the newest batch alone: a table that is put down whole each time."""
    records = _records(Files(spark, path), path)
    last = max((int(b) for b in records if b.isdecimal()), default=None)
    if last is None or table not in records[str(last)]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{records[str(last)][table]}")


def merge_records(spark: SparkSession, path: str) -> int:
    """Puts all records into one, so that readers list few files; returns how many batches it names.

    The merged record is in place before the old ones go, and naming a batch twice is
    harmless, so that a stop at any point loses nothing.
    """
    files = Files(spark, path)
    known = _records(files, path)
    old = [n for n in files.names(f"{path}/_commits") if n.endswith(".json")]
    last = max([int(m[1]) for n in old if (m := re.fullmatch(r"_merged-(\d+)\.json", n))], default=-1)
    if not files.put_new(f"{path}/_commits/_merged-{last + 1}.json", json.dumps(known)):
        return 0  # another writer is merging
    for name in old:
        files.delete(f"{path}/_commits/{name}")
    return len(known)


def leftovers(spark: SparkSession, path: str) -> list[str]:
    """Folders of rows that no record names: what stopped attempts left. Delete them when no writer is at work."""
    files = Files(spark, path)
    named = {f for folders in _records(files, path).values() for f in folders.values()}
    tables = [t for t in files.names(path) if not t.startswith("_")]
    return [f"{path}/{t}/{name}" for t in tables for name in files.names(f"{path}/{t}") if f"{t}/{name}" not in named]


def append_checked(df: DataFrame, kind: str, path: str, batch: int | str, more: dict[str, DataFrame] | None = None) -> bool:
    """Good rows to ``<kind>``, bad ones with their violations to ``<kind>_rejects``, and ``more`` tables' rows, as one batch."""
    good, bad = parted(df, kind)
    return commit({kind: good, f"{kind}_rejects": bad, **(more or {})}, path, batch)


def each_batch(build: Callable[[DataFrame], dict[str, DataFrame]], path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: what ``build`` makes of a micro-batch is committed under the micro-batch's number, so replays add nothing."""
    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # several tables are built from it
        try:
            commit(build(held), path, number)
        finally:
            held.unpersist()
    return run


def cross_session_rows(saved: DataFrame, sessions: DataFrame, events: DataFrame, own: DataFrame, as_of: datetime) -> DataFrame:
    """Rows of the findings table for the sessions just saved: ``session_id, at, project, source, rule, signature, severity, value, ref``.

    ``saved`` has their session_id; ``sessions`` session_id, at, cost, project and
    source; ``own`` the findings that their own rules gave, of which capture gaps go
    in too. Errors are recurring if three sessions show them in seven days; a cost is
    an outlier above the 95th percentile of at least ten other sessions of 30 days.
    """
    recurring = rules.recurring_findings(events, as_of)
    dear = rules.cost_outlier_findings(sessions, as_of)
    gaps = own.filter("rule = 'capture:gap'").select(*recurring.columns)
    found = recurring.unionByName(dear).unionByName(gaps).join(saved.select("session_id").distinct(), "session_id", "left_semi")
    return found.join(sessions.select("session_id", "project", "source"), "session_id").select(
        "session_id", F.lit(as_of).alias("at"), "project", "source", "rule", "signature", "severity", "value", "ref")
