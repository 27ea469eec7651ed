"""Provider lists of models, as payload texts, to rows of one catalogue. Rows that say nothing usable are skipped and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandbook.sources.lines import get

COLUMNS = ["model_id", "provider", "context_k", "input_usd", "output_usd", "vision", "region", "trains", "local"]


def _items(payloads: DataFrame, provider: str, at: str) -> DataFrame:
    chosen = payloads.filter(F.col("provider") == provider).withColumn("v", F.try_parse_json("payload"))
    return chosen.select("provider", F.explode_outer(get(F.col("v"), at, "array<variant>")).alias("e"))


def per_million(price: Column) -> Column:
    """A price for one token, as text or number, per million; half-even to six digits."""
    return F.bround(price.try_cast("double") * 1_000_000, 6)


def context_k(n: Column) -> Column:
    return F.bround(n / 1000).cast("int")


def _row(items: DataFrame, **c: Column) -> DataFrame:
    types = {"model_id": "string", "context_k": "int", "input_usd": "double", "output_usd": "double", "vision": "boolean", "region": "string", "trains": "boolean", "local": "boolean"}
    return items.select("provider", *(c.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()))


def parse_openrouter(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    vision = F.array_contains(get(e, "$.architecture.input_modalities", "array<string>"), "image")
    rows = _row(_items(payloads, "openrouter", "$.data"), model_id=get(e, "$.id"), context_k=context_k(get(e, "$.context_length", "long")), input_usd=per_million(get(e, "$.pricing.prompt")), output_usd=per_million(get(e, "$.pricing.completion")), vision=vision)
    return rows.filter("coalesce(model_id, '') not like '~%' and coalesce(model_id, '') not like 'openrouter/%'")


def parse_requesty(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    return _row(_items(payloads, "requesty", "$.data"), model_id=get(e, "$.id"), context_k=context_k(get(e, "$.context_window", "long")), input_usd=per_million(get(e, "$.input_price")), output_usd=per_million(get(e, "$.output_price")),
                vision=get(e, "$.supports_vision", "boolean"), region=F.lower(get(e, "$.geolocation")), trains=get(e, "$.data_used_for_training", "boolean"))


def parse_ollama(payloads: DataFrame) -> DataFrame:
    e = F.col("e")
    return _row(_items(payloads, "ollama", "$.models"), model_id=get(e, "$.name"), context_k=context_k(get(e, "$.details.context_length", "long")), local=~get(e, "$.name").rlike(r"[-:]cloud$"))


def parse_indices(payloads: DataFrame) -> DataFrame:
    """Benchmark indices: slug, name and four figures, each rounded half-even to one digit."""
    e = F.col("e")
    one = lambda p: F.bround(get(e, p, "double"), 1)
    return _items(payloads, "indices", "$.data").select(
        get(e, "$.slug").alias("slug"), get(e, "$.name").alias("name"), one("$.evaluations.artificial_analysis_intelligence_index").alias("aa_index"),
        one("$.evaluations.artificial_analysis_coding_index").alias("coding_index"), one("$.evaluations.artificial_analysis_agentic_index").alias("agentic_index"), one("$.median_output_tokens_per_second").alias("speed")).filter("slug is not null")


def valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and how many each provider's list had besides."""
    good = F.coalesce((F.col("model_id") != "") & (F.length("model_id") <= 200) & (F.coalesce("input_usd", F.lit(0.0)) >= 0) & (F.coalesce("output_usd", F.lit(0.0)) >= 0), F.lit(False))
    return rows.filter(good), rows.groupBy("provider").agg(F.count_if(~good).alias("skipped"))


def parse_all(payloads: DataFrame) -> DataFrame:
    """``payloads``: provider, payload. A list that fails to parse gives no rows and leaves the others alone."""
    out = parse_openrouter(payloads).unionByName(parse_requesty(payloads)).unionByName(parse_ollama(payloads))
    return out.filter("model_id is not null").dropDuplicates(["model_id", "provider"])
