"""Byte-balanced contiguous shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandbook.llm.common import checkpointed, prefix_sums

#: Bytes that a row costs besides its text.
ROW_BYTES = 8


def shard(docs: DataFrame, shards: int = 24, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Deals the rows into ``shards`` contiguous ranges of nearly equal bytes.

    The order is (checksum of the text, id), so that equal texts lie side by
    side. Global prefix sums of the byte sizes come from partition totals, and
    a row goes to the shard in which its middle byte falls when all bytes are cut
    at equal targets; a cut is off by at most half of the row that it meets.

    Returns the id, ``size`` (UTF-8 bytes and 8 more; null text: 8),
    ``text_crc32``, ``shard`` (from 0) and ``slot`` (from 0, without gaps in
    each shard). Null ids sort first; equal rows may swap slots; an empty table
    gives no rows. Columns but id and text are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(id_column), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = prefix_sums(sized, ["text_crc32", id_column], "size")
    total = sized.agg(F.sum("size")).first()[0] or 1
    cut = F.expr(f"cast(least({shards - 1}, ((2 * before + size) * {shards}) div {2 * total}) as int)")
    cut = placed.withColumn("shard", cut)
    cut = checkpointed(cut)
    firsts = cut.groupBy("shard").agg(F.min("position").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(firsts), "shard").select(id_column, "size", "text_crc32", "shard", (F.col("position") - F.col("first")).alias("slot"))


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """Rows and bytes of every shard, for a manifest."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
