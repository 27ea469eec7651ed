"""The decisions that a running watch knows: a small table in versions, read anew whenever a newer one lies there."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.sources import commits
from strandbook.sources.scratch import counted_small

DAYS = 180
TABLE = "decisions"
SCHEMA = "signature string, session_id long, project string, status string, decided_at timestamp, anchor string"


def cache_rows(decisions: DataFrame, versions: DataFrame, as_of: datetime, days: int = DAYS) -> DataFrame:
    """Done and obsolete decisions of the last days, without any free text.

    ``decisions``: signature, session_id (null: global), status, decided_at, anchor;
    ``versions``: session_id, version_id, project. ``project`` is that of the newest
    version of the session that a decision is about, empty for a global one.
    """
    project = versions.groupBy("session_id").agg(F.max_by("project", "version_id").alias("project"))
    kept = decisions.filter(F.col("status").isin("done", "obsolete") & (F.col("decided_at") >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")))
    return kept.join(project, "session_id", "left").select("signature", "session_id", F.coalesce("project", F.lit("")).alias("project"), "status", "decided_at", "anchor")


def write_cache(rows: DataFrame, path: str) -> int:
    """Puts a new version of the table beside the older ones, whole or not at all, and returns its number."""
    while True:
        number = commits.last_batch(rows.sparkSession, path) + 1
        if commits.commit({TABLE: rows}, path, number):
            return number


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest version; where there is none yet, no rows: the watch then tells its news without decisions."""
    return commits.newest(spark, path, TABLE, SCHEMA)


def annotated(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``decided_at`` and ``anchor`` of the newest done decision on a message's signature: a global one, or one on a session of the same project."""
    done = cache.filter("status = 'done'")
    newest: Column = F.max(F.struct("decided_at", "anchor"))
    world = done.filter("session_id is null").groupBy("signature").agg(newest.alias("_w"))
    own = done.filter("session_id is not null and project != ''").groupBy("signature", "project").agg(newest.alias("_o"))
    joined = messages.join(counted_small(world), "signature", "left").join(counted_small(own), ["signature", "project"], "left")
    best = F.greatest("_w", "_o")
    return joined.withColumns({"decided_at": best["decided_at"], "anchor": best["anchor"]}).drop("_w", "_o")


def undecided(messages: DataFrame, cache: DataFrame) -> DataFrame:
    """Messages that no done decision answers."""
    return annotated(messages, cache).filter("decided_at is null").drop("decided_at", "anchor")


def with_newest(path: str, join: Callable[[DataFrame, DataFrame], DataFrame], put: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: joins each micro-batch with the version that is newest then, so that a decision counts from the next batch on, without a restart."""
    def run(batch: DataFrame, number: int) -> None:
        put(join(batch, read_cache(batch.sparkSession, path)), number)
    return run
