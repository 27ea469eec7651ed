"""Side files: the spool of session metadata, watch messages, prices, aliases, watch configuration."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandbook.functions.origin import choice
from strandbook.sources.lines import get, read_lines, type_of

PERSONAS, CHANNELS = ("amtsleitung", "cura", "privat", "offen"), ("cli", "chat", "api", "offen")
RATES = ("input", "output", "cache_write", "cache_read")
DEFAULT_WATCH = {"standard": "warnen", "regeln": {}, "mindest_werkzeugaufrufe": 10, "mindest_sekunden": 60}
WATCH_LEVELS = {"aus": "off", "warnen": "warn", "fragen": "ask"}


def read_spool(spark: SparkSession, path: str, personas: Iterable[str] = PERSONAS, channels: Iterable[str] = CHANNELS) -> DataFrame:
    """Sessions of a spool: lines that carry ``typ`` and broken ones are skipped, unknown personas and channels become ``offen``."""
    lines = read_lines(spark, path)
    v = F.col("v")
    fine = lines.filter(v.isNotNull() & (type_of(v) == "OBJECT") & ~F.array_contains(F.json_object_keys("line"), "typ"))
    return fine.select(
        "path", "line_no", get(v, "$.sitzung_id").alias("session_id"), get(v, "$.datei").alias("file"),
        choice(get(v, "$.persona"), tuple(personas), "offen").alias("persona"), choice(get(v, "$.kanal"), tuple(channels), "offen").alias("channel"))


def read_watch_messages(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Messages that the watch emitted, of a range of days if given."""
    lines = read_lines(spark, path)
    v = F.col("v")
    rows = lines.filter(v.isNotNull()).select(get(v, "$.zeit").try_cast("timestamp").alias("at"), get(v, "$.sitzung").alias("session_id"), get(v, "$.regel").alias("rule"), get(v, "$.stufe").alias("level"), get(v, "$.text").alias("text"))
    if first:
        rows = rows.filter(F.col("at") >= F.lit(first).cast("timestamp"))
    return rows.filter(F.col("at") < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")) if last else rows


def watch_counts(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("messages"), F.count_if(F.col("level") == "fragen").alias("asked"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The price table of a registry file: position, key, aliases, rates, context_window, currency.

    A row needs an input or an output price. A missing or broken file gives an empty table.
    """
    text = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    models = F.coalesce(F.get_json_object("value", "$.preise.modelle"), F.col("value"))
    parsed = text.select(F.coalesce(F.get_json_object("value", "$.preise.waehrung"), F.lit("")).alias("currency"), models.alias("models"))
    rows = parsed.select("currency", F.posexplode(F.coalesce(F.json_object_keys("models"), F.array().cast("array<string>"))).alias("position", "key"), F.try_parse_json("models").alias("v"))
    entry = F.try_variant_get("v", F.concat(F.lit("$['"), "key", F.lit("']")), "variant")
    rows = rows.withColumn("e", entry)
    number = lambda n: get(F.col("e"), f"$.{n}", "double").alias(n)
    out = rows.select(
        "position", "key", F.coalesce(get(F.col("e"), "$.meldet_als", "array<string>"), F.array().cast("array<string>")).alias("aliases"), *map(number, RATES),
        get(F.col("e"), "$.kontext_fenster", "long").alias("context_window"), get(F.col("e"), "$.herkunft").alias("origin"), get(F.col("e"), "$.referenz").alias("reference"), "currency")
    return out.filter("input is not null or output is not null")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """name, source (null: any), project, context, hidden, from ``{name or name@source: {...}}``."""
    text = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    rows = text.select(F.explode(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))).alias("key"), F.try_parse_json("value").alias("v"))
    e = F.try_variant_get("v", F.concat(F.lit("$['"), "key", F.lit("']")), "variant")
    return rows.select(
        F.substring_index("key", "@", 1).alias("name"), F.when(F.col("key").contains("@"), F.substring_index("key", "@", -1)).alias("source"),
        get(e, "$.projekt").alias("project"), get(e, "$.kontext").alias("context"), F.coalesce(get(e, "$.ausgeblendet", "boolean"), F.lit(False)).alias("hidden")).filter("project is not null")


def watch_config(text: str | None, rules: Iterable[str]) -> tuple[dict, list[str]]:
    """The watch's settings and the rule names that are not known; broken text gives the defaults."""
    try:
        found = json.loads(text or "")
        config = DEFAULT_WATCH | found
        unknown = [r for r in config["regeln"] if r not in set(rules)]
    except (ValueError, TypeError, AttributeError):
        return dict(DEFAULT_WATCH), []
    config["regeln"] = {r: WATCH_LEVELS.get(x, "warn") for r, x in config["regeln"].items() if r not in unknown}
    return config, unknown
