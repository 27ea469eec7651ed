"""Set operations over rows and over arrays of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbook.sources.scratch import BROADCAST_ROWS


def minus(all_: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``all_`` whose keys ``some`` does not have; null keys equal null keys."""
    some = some.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return all_.join(some, on, "left_anti")


def reopened(open_: Column, done: Column, extra: Column) -> tuple[Column, Column]:
    """Open and done ids after some are seen again."""
    return F.array_sort(F.array_union(open_, extra)), F.array_sort(F.array_except(done, extra))


def by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of tables in which earlier ones win; ``source`` is the winning table's place."""
    from strandbook.operators.lookup import latest_by

    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return latest_by(out, [key], [F.col("source")])


def without_base_names(models: DataFrame, name: str) -> DataFrame:
    """Drops a bare name where a tagged variant (name:tag) stands beside it."""
    tagged = models.filter(F.col(name).contains(":")).select(F.substring_index(name, ":", 1).alias(name)).distinct()
    return models.join(tagged, name, "left_anti")


#: Asks of one pack, which a found set is told to at once.
PACK = 1_000


def containing(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """(ask_id, set_id): the sets that hold all elements of what is asked for.

    ``sets``: set_id, elements; ``asked``: ask_id, elements. Equal asks are looked
    for once: each distinct one meets the sets by the one of its elements that is in
    the fewest of them, so no pair is looked at that shares only a frequent one. The
    sets found are then told to all who ask for it, by packs of asks, so that the
    work besides the search is that of writing the result. An empty ask is in no set,
    an element that no set has finds none; nulls are no elements.
    """
    have = sets.select("set_id", F.array_distinct(F.array_compact("elements")).alias("have"))
    want = asked.select("ask_id", F.array_sort(F.array_distinct(F.array_compact("elements"))).alias("want"))
    small = F.broadcast if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else lambda df: df
    listed = have.select("set_id", "have", F.explode("have").alias("element"))
    often = listed.groupBy("element").agg(F.count("*").alias("often"))
    each = want.select("want").distinct().select("want", F.explode("want").alias("element")).join(often, "element", "left")
    rarest = each.groupBy("want").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "element")).alias("r")).select("want", "r.element")
    found = listed.join(small(rarest), "element").filter(F.size(F.array_except("want", "have")) == 0).select("set_id", "want")
    # Dealt by set, not by ask, as many sets may hold the same; a fixed number of partitions, as the rows grow once they are told.
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "set_id").join(small(_packs(want)), "want").select(F.explode("asks").alias("ask_id"), "set_id")


def _packs(want: DataFrame) -> DataFrame:
    """(want, asks): the asks of each distinct one, at most about PACK together."""
    dealt = want.groupBy("want").agg(F.count("*").alias("n")).withColumn("n", F.ceil(F.col("n") / PACK))
    return want.join(dealt, "want").groupBy("want", F.pmod(F.xxhash64("ask_id"), "n").alias("pack")).agg(F.collect_list("ask_id").alias("asks")).select("want", "asks")
