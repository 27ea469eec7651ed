"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbook.llm.common import WORD, checkpointed, hashed_unit, small_enough

#: Rows of the per-source plan up to which it is broadcast.
SOURCES_TO_BROADCAST = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size), one row for each source.

    Weights repeat along the sources in code-point order, null last. The sum of
    the targets is ``share`` times all sizes. A source is clamped at ``epochs``
    times its size and what it can't take goes to the others in proportion to
    their weights, again until none is above. That fixed point is reached in one
    pass: with sources sorted by cap over weight, the clamped ones are a prefix,
    and the rest share one water level.
    """
    ranked = sources.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("double")
    sorted_ = ranked.withColumn("weight", weight).withColumn("cap", F.lit(epochs) * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("fill", "n")
    all_ = Window.partitionBy()
    levelled = (
        sorted_.withColumn("capped", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.sum("source_size").over(all_) - F.col("capped")) / F.col("open"))
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(all_))
    )
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("water.level")))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    share: float = 1.5,
    epochs: float = 2.0,
    weights: tuple[int, ...] = (3, 1, 2),
    seed: str = "mix",
    bins: int = 4096,
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (words of its source) and ``taken`` (words the mix takes).

    Every document is taken whole as often as target / source_size has whole
    epochs. What is left of the target is filled with one more repetition of
    documents in a seeded order, the last of them only as far as the target
    goes, so that a source's words sum to its rounded target. The order is
    found without a sort of the source: seeded bins are summed first, and only
    the one bin of each source in which the target ends is ordered.

    Null texts have size 0 and null sources form a source of their own, last.
    Rows with one doc_id (repeated or null) stand at one place of the order and
    share what is left there. Empty tables give no rows. Other columns pass
    through, whatever their names; a column with an added name is replaced.
    """
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in added]
    docs = docs.select(*kept)
    order = hashed_unit(F.lit(seed), F.col("doc_id").cast("string"))
    # The documents' own columns travel in one, so that no name of theirs can clash with those below.
    work = docs.select(F.struct(*kept).alias("_own"), "source", word_count(F.col("text")).alias("size"), order.alias("_order"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"))
    work = work.withColumn("_bin", F.floor(F.col("_order") / ((1 << 60) // bins)).cast("int"))
    by_bin = checkpointed(work.groupBy("_key", "source", "_bin").agg(F.sum("size").alias("bin_size")))
    sizes = by_bin.groupBy("_key", "source").agg(F.sum("bin_size").alias("source_size"))
    targets = water_fill(sizes.select("source", "source_size"), share, epochs, weights)
    plan = targets.withColumns({
        "_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
        "_whole": F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
    }).withColumn("_rest", F.round("target").cast("long") - F.col("_whole") * F.col("source_size")).drop("source")
    # The bin in which the rest of the target ends, and the words of the bins before it.
    running = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        by_bin.join(plan, "_key")
        .withColumn("_ahead", F.coalesce(F.sum("bin_size").over(running), F.lit(0)))
        .filter("_ahead < _rest and _ahead + bin_size >= _rest")
        .groupBy("_key").agg(F.min(F.struct("_bin", "_ahead")).alias("_edge"))
    )
    plan = checkpointed(plan.join(edge, "_key", "left"))
    few = small_enough(plan, SOURCES_TO_BROADCAST)
    planned = work.join(F.broadcast(plan) if few else plan, "_key")
    # Inside that bin, the place in the order where the target ends; rows that tie there share what is left.
    at = Window.partitionBy("_key").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        planned.filter("_bin = _edge._bin")
        .groupBy("_key", "_order").agg(F.sum("size").alias("_tied"), F.first("_rest").alias("_rest"), F.first("_edge._ahead").alias("_ahead"))
        .withColumn("_left", F.col("_rest") - F.col("_ahead") - F.coalesce(F.sum("_tied").over(at), F.lit(0)))
        .filter("_left > 0 and _left <= _tied")
        .groupBy("_key").agg(F.min(F.struct("_order", "_left", "_tied")).alias("_cut"))
    )
    plan = checkpointed(plan.join(cut, "_key", "left"))
    planned = work.join(F.broadcast(plan) if few else plan, "_key", "left")
    extra = (
        F.when(F.col("_order") < F.col("_cut._order"), F.col("size"))
        .when(F.col("_order") == F.col("_cut._order"), F.floor(F.col("size") * F.col("_cut._left") / F.col("_cut._tied")))
        .otherwise(F.lit(0))
    )
    taken = (F.col("_whole") * F.col("size") + extra).cast("long")
    return planned.withColumn("taken", taken).select("_own.*", *added)
