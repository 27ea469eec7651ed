"""Picking one row or value of a group, as-of lookups and tiered key lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; one partial pass before the shuffle keeps hot keys small."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def as_of_last(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the last non-null ``value`` strictly before each row of its key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(before))


def most_frequent(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The most frequent non-empty value of each key; of equally frequent ones, the one met first."""
    counted = df.filter((F.col(value).isNotNull()) & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    best = F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first")))
    return counted.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col(f"best.{value}").alias(value), F.col("best.n").alias("n"))


def first_non_null(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The non-null value that comes first; null where a key has none."""
    return df.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias(value))


def cheapest(df: DataFrame, keys: list[str], prices: list[str], tie: str) -> DataFrame:
    """The cheapest row of each key. Per price: known before unknown, paid before free, then low before high."""
    order = [x for p in prices for x in (F.col(p).isNull(), F.coalesce(F.col(p) == 0, F.lit(False)), F.col(p))] + [F.col(tie)]
    return latest_by(df, keys, order)


def unambiguous(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Derived keys whose rows all agree; keys with different values are dropped, as are null keys."""
    agreed = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*values)).alias("low"), F.max(F.struct(*values)).alias("high"))
    return agreed.filter(F.col("low").eqNullSafe(F.col("high"))).select(key, *(F.col(f"low.{v}").alias(v) for v in values))


def tiered_lookup(df: DataFrame, tiers: list[tuple[str, Column, DataFrame, str]], value: str) -> DataFrame:
    """Adds ``value`` and ``tier`` from the first tier that knows the row's key.

    A tier is (name, key of the row, table, key column of the table); tables
    have one row for each key. All are equi-joins; Catalyst broadcasts the small ones.
    """
    for name, key, table, column in tiers:
        side = table.select(F.col(column).alias(f"_k_{name}"), F.col(value).alias(f"_v_{name}"), F.lit(name).alias(f"_t_{name}"))
        df = df.withColumn(f"_q_{name}", key).join(side, F.col(f"_q_{name}") == F.col(f"_k_{name}"), "left")
    names = [t[0] for t in tiers]
    first = lambda p: F.coalesce(*(F.when(F.col(f"_t_{n}").isNotNull(), F.col(f"_{p}_{n}")) for n in names))
    out = df.withColumn(value, first("v")).withColumn("tier", F.coalesce(*(F.col(f"_t_{n}") for n in names)))
    return out.drop(*(f"_{p}_{n}" for p in "qkvt" for n in names))


def price_lookup(usage: DataFrame, name: str, prices: DataFrame) -> DataFrame:
    """Adds ``price_key`` and ``tier``: exact name, then the name before a colon, then a reported alias.

    ``prices`` has position, key, aliases (array); of several rows with one alias the first counts.
    """
    keys = prices.select("key", F.col("key").alias("price_key"))
    aliases = prices.select("position", "key", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min_by("key", "position").alias("price_key"))
    base = F.substring_index(F.col(name), ":", 1)
    return tiered_lookup(usage, [
        ("exact", F.col(name), keys, "key"),
        ("base", F.when(base != F.col(name), base), keys, "key"),
        ("alias", F.col(name), aliases, "alias"),
    ], "price_key")


def intervals_join(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, on: list[str], slack_minutes: int, widest_minutes: int) -> DataFrame:
    """Points inside [begin, end + slack] of spans with equal ``on`` columns.

    Time is cut into bins as wide as the widest span, so that an equi-join on
    (on, bin) replaces a range join; a span stands in the two bins it can touch.
    """
    width = (widest_minutes + slack_minutes) * 60
    bin_ = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(width * 1_000_000))
    upto = F.col(end) + F.expr(f"INTERVAL {slack_minutes} MINUTES")
    wide = spans.withColumn("_upto", upto).withColumn("_bin", F.explode(F.sequence(bin_(F.col(begin)), bin_(F.col("_upto")))))
    joined = points.withColumn("_bin", bin_(F.col(at))).join(wide, [*on, "_bin"])
    return joined.filter((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col("_upto"))).drop("_bin", "_upto")


def latest_before(df: DataFrame, points: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """For every point, the last ``order`` of its key's rows up to its time; 0 where there is none."""
    both = df.select(*keys, F.col(at), F.col(order).alias("_order"), F.lit(0).alias("_point"), F.lit(None).cast("long").alias("_id"))
    both = both.unionByName(points.select(*keys, F.col(at), F.lit(None).cast(df.schema[order].dataType).alias("_order"), F.lit(1).alias("_point"), F.col("point_id").cast("long").alias("_id")))
    upto = Window.partitionBy(*keys).orderBy(at, "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn(order, F.coalesce(F.max("_order").over(upto), F.lit(0)))
    return found.filter("_point = 1").select(*keys, F.col("_id").alias("point_id"), at, order)
