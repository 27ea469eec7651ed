"""Which files to read: what lies there, what was read before, and what became of each file, counted as it is written."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandbook.operators.lookup import latest_by
from strandbook.sources import commits
from strandbook.sources.scratch import counted_small

NEW, CHANGED, EXISTING, BROKEN, REFUSED = STATUSES = ("new", "changed", "existing", "broken", "refused")
SCHEMA = "path string, modified timestamp, size long, status string"
TABLE = "manifest"
#: Paths that a reader is given by name; of more, it reads the folder and what is not wanted is left out.
NAMED = 50_000


def listed(spark: SparkSession, path: str, glob: str | None = None, modified_after: datetime | None = None) -> DataFrame:
    """(path, modified, size) of the files below ``path``; none is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    return reader.load(path).select(F.col("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def latest(manifest: DataFrame) -> DataFrame:
    """Each path's newest row."""
    return latest_by(manifest, ["path"], [F.desc("modified"), F.desc("size"), F.col("status")])


def discovered(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``status``: new, changed since it was read (by time or size), or existing. Files that are gone stay in the manifest only."""
    known = latest(manifest).select("path", F.col("modified").alias("_modified"), F.col("size").alias("_size"))
    same = (F.col("modified") == F.col("_modified")) & (F.col("size") == F.col("_size"))
    status = F.when(F.col("_size").isNull(), NEW).when(same, EXISTING).otherwise(CHANGED)
    return files.join(known, "path", "left").withColumn("status", status).drop("_modified", "_size")


def outcomes(files: DataFrame, quality: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """What became of the files that were read: broken if no line of it is JSON, refused if it is among ``refused`` (path), else as before."""
    read = quality.select("path", (F.col("broken_lines") < F.col("lines")).alias("_fine"))
    out = files.join(read, "path", "left").withColumn("status", F.when((F.col("status") != EXISTING) & ~F.coalesce("_fine", F.lit(False)), BROKEN).otherwise(F.col("status"))).drop("_fine")
    if refused is None:
        return out
    out = out.join(counted_small(refused.select("path").distinct().withColumn("_no", F.lit(True))), "path", "left")
    return out.withColumn("status", F.when(F.col("_no") & (F.col("status") != EXISTING), REFUSED).otherwise(F.col("status"))).drop("_no")


def observed(files: DataFrame) -> tuple[DataFrame, Observation]:
    """The same rows, and their counts by status once an action has run over them; no pass of its own."""
    counts = Observation("files")
    return files.observe(counts, *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES)), counts


def ingest(spark: SparkSession, path: str, store: str, batch: int | str, read: Callable[[str | list[str]], tuple[dict[str, DataFrame], DataFrame, DataFrame | None]], glob: str | None = None) -> dict[str, int] | None:
    """Reads new and changed files below ``path`` and commits what they give, and the manifest, as one batch; the counts by status, None for a replay.

    ``read`` gets paths and returns tables with a ``path`` column, the files' quality
    (path, lines, broken_lines) and the paths that must be refused, if any; rows of
    refused files are left out. A stop at any point leaves the files as new as they were.
    """
    files = discovered(listed(spark, path, glob), commits.committed(spark, store, TABLE, SCHEMA)).persist()
    try:
        todo = files.filter(F.col("status") != EXISTING).select("path")
        names = [r.path for r in todo.limit(NAMED + 1).collect()]
        if names:
            tables, quality, refused = read(path if len(names) > NAMED else names)
            kept = {name: rows.join(counted_small(todo), "path", "left_semi") for name, rows in tables.items()}
            if refused is not None:
                kept = {name: rows.join(refused.select("path"), "path", "left_anti") for name, rows in kept.items()}
        else:
            kept, quality, refused = {}, spark.createDataFrame([], "path string, lines long, broken_lines long"), None
        marked, counts = observed(outcomes(files, quality, refused))
        if not commits.commit({**kept, TABLE: marked.filter(F.col("status") != EXISTING)}, store, batch):
            return None
        return counts.get
    finally:
        files.unpersist()
