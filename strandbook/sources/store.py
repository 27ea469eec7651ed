"""The ledger's tables: idempotent appends, latest versions, upserts, retention, re-ingest.

Parquet has no MERGE, so changes are anti-joins and rewrites; each function
returns the new table or the rows to add, and ``write_table`` puts it in place.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandbook.operators.lookup import latest_by

VERSION_KEY = ["host", "source", "session_id", "end"]
LOGICAL_KEY = ["host", "source", "session_id"]


def logical_id(*columns: str):
    """A session's id from its key alone, the same on every run."""
    return F.xxhash64(*(columns or LOGICAL_KEY))


def new_rows(batch: DataFrame, table: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose key ``table`` does not have; nulls in keys are equal.

    Of several rows with one key the first stays: by ``order``, else as the batch is read.
    """
    known = table.select(*(F.col(k).alias(f"_{k}") for k in key))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.col(order) if order else F.monotonically_increasing_id()
    first = batch.withColumn("_place", place).groupBy(*key).agg(F.min_by(F.struct(*batch.columns), "_place").alias("_row")).select("_row.*")
    return first.join(known, same, "left_anti")


def append_sessions(batch: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new versions and their findings flattened. ``batch`` has a ``findings`` array of structs."""
    fresh = new_rows(batch, sessions, VERSION_KEY).withColumn("logical_id", logical_id()).withColumn("version_id", F.xxhash64(*VERSION_KEY))
    flat = fresh.select("version_id", "logical_id", "project", "source", F.explode("findings").alias("f")).select("version_id", "logical_id", "project", "source", "f.*")
    return fresh, flat


def latest_versions(sessions: DataFrame, key: list[str], end: str, id_: str) -> DataFrame:
    """The version of each session that ended last; unknown ends lose, then the larger id wins."""
    return latest_by(sessions, key, [F.col(end).desc_nulls_last(), F.desc(id_)])


def first_versions(sessions: DataFrame, key: list[str], at: str, id_: str) -> DataFrame:
    """The earliest version of each session, from which its identity is filled in."""
    return sessions.groupBy(*key).agg(F.min(at).alias("first_at"), F.min_by(id_, F.struct(at, id_)).alias("first_id"))


def with_identity(events: DataFrame, sessions: DataFrame, key: list[str], reference: str) -> DataFrame:
    """Fills a missing ``logical_id`` of old events from the version that they refer to."""
    known = sessions.select(F.col("version_id").alias(reference), F.col("logical_id").alias("_logical"))
    return events.join(known, reference, "left").withColumn("logical_id", F.coalesce("logical_id", "_logical")).drop("_logical")


def upsert(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """All rows of both, the batch's where keys meet; of a batch's own repeats the last by all columns stays."""
    batch = batch.groupBy(*key).agg(F.max(F.struct(*(c for c in batch.columns if c not in key))).alias("_row")).select(*key, "_row.*")
    kept = table.join(batch.select(*key), key, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def upsert_counts(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many keys are ``new`` and how many ``updated``."""
    known = table.select(*key).distinct().withColumn("_known", F.lit(True))
    hit = batch.select(*key).distinct().join(known, key, "left")
    return hit.agg(F.count_if(F.col("_known").isNull()).alias("new"), F.count_if(F.col("_known")).alias("updated"))


def enrich(table: DataFrame, values: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Overwrites ``columns`` of the rows that ``values`` has, also with nulls."""
    side = values.select(*key, F.struct(*columns).alias("_new"))
    joined = table.join(side, key, "left")
    return joined.withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in columns}).drop("_new")


def expired(sessions: DataFrame, start: str, as_of: datetime, days: int, shown: str | None = None, source: str | None = None) -> DataFrame:
    """Sessions that began more than ``days`` (at least 7) before the reference time, of one display source if given."""
    if days < 7:
        raise ValueError("retention keeps at least 7 days")
    old = sessions.filter(F.col(start) < F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS"))
    return old.filter(F.col(shown) == source) if source else old


def retain(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without what belongs to expired sessions (version_id, logical_id).

    In the order of their references: chats, events and findings by logical id,
    versions by id, and logical sessions of which no version is left.
    """
    logical = gone.select("logical_id").distinct()
    out = dict(tables)
    out["versions"] = tables["versions"].join(gone.select("version_id").distinct(), "version_id", "left_anti")
    dead = logical.join(out["versions"].select("logical_id").distinct(), "logical_id", "left_anti")
    for name in ("chats", "events", "logical"):
        if name in tables:
            out[name] = tables[name].join(dead, "logical_id", "left_anti")
    out["findings"] = tables["findings"].join(gone.select("version_id").distinct(), "version_id", "left_anti")
    return out


def retention_preview(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, int]:
    """How many rows of each table would go."""
    kept = retain(tables, gone)
    return {name: tables[name].count() - kept[name].count() for name in kept}


def reingest(versions: DataFrame, findings: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New documents for existing versions: ``again`` has version_id, document, findings. Keys and times stay."""
    side = again.select("version_id", F.col("document").alias("_document"))
    documents = versions.join(side, "version_id", "left").withColumn("document", F.coalesce("_document", "document")).drop("_document")
    known = again.join(versions.select("version_id", "logical_id", "project", "source"), "version_id")
    flat = known.select("version_id", "logical_id", "project", "source", F.explode("findings").alias("f")).select("version_id", "logical_id", "project", "source", "f.*")
    return documents, findings.join(again.select("version_id"), "version_id", "left_anti").unionByName(flat)


def pulled(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of another host that are not here yet; (host, origin_id) names them."""
    return new_rows(batch.filter("origin_id is not null"), table, ["host", "origin_id"])


def write_table(df: DataFrame, path: str) -> str:
    """Writes a new version of a table beside the old one and returns its path; readers switch when it is complete."""
    to = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return to
