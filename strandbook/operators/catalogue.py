"""The model catalogue: rows of several providers to one ranked entry for each model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandbook.functions import keys
from strandbook.operators.lookup import latest_by, most_frequent, tiered_lookup, unambiguous

FLOOR = 45.0


def first_substring(texts: DataFrame, needles: DataFrame, text: str) -> DataFrame:
    """(text, hit): of the needles (ord, needle, hit) that a text holds, the one with the smallest ord; texts without one are left out.

    A text's substrings of the lengths that needles have meet them by equality, so
    that neither list is gone through for each row of the other.
    """
    lengths = sorted(r[0] for r in needles.select(F.length("needle")).distinct().collect() if r[0])  # no more than the longest needle's length
    if not lengths:
        return texts.select(text, F.lit(None).alias("hit")).limit(0)
    own = texts.select(text).distinct()
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    parts = own.select(text, F.explode(at).alias("at")).select(text, F.explode(F.array_distinct(F.array(*(F.substring(F.col(text), F.col("at"), F.lit(n)) for n in lengths)))).alias("needle"))
    return parts.join(needles, "needle").groupBy(text).agg(F.min_by("hit", "ord").alias("hit"))


def origins(models: DataFrame, dim: DataFrame, resellers: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``manufacturer`` and ``origin``: by the part before the slash, else by the first substring of the ordered list.

    ``dim``: ord, slug (null for substrings), needle, manufacturer, origin. The names
    of resellers in front of a slash, one or several, are passed over.
    """
    plain = F.regexp_replace(F.lower("model_id"), r"^hf\.co/", "")
    if resellers:
        plain = F.regexp_replace(plain, f"^(?:(?:{'|'.join(map(re.escape, resellers))})/)+", "")
    with_slug = models.withColumn("_plain", plain).withColumn("_slug", F.when(F.col("_plain").contains("/"), F.substring_index("_plain", "/", 1)))
    exact = dim.filter("slug is not null").select(F.col("slug").alias("_slug"), F.struct("manufacturer", "origin").alias("_exact"))
    needles = dim.filter("slug is null").select("ord", "needle", F.struct("manufacturer", "origin").alias("hit"))
    near = first_substring(with_slug, needles, "_plain").withColumnRenamed("hit", "_near")
    found = with_slug.join(exact, "_slug", "left").join(near, "_plain", "left")
    best = F.coalesce("_exact", "_near")
    return found.withColumns({"manufacturer": F.coalesce(best["manufacturer"], F.lit("")), "origin": F.coalesce(best["origin"], F.lit("unknown"))}).drop("_slug", "_plain", "_exact", "_near")


def enrich_indices(models: DataFrame, indices: DataFrame) -> DataFrame:
    """Benchmark figures by three keys: the normal one, its sorted parts, and those without noise words.

    Of equal normal keys the first row counts; derived keys that stand for different figures are dropped.
    """
    figures = ["aa_index", "coding_index", "agentic_index", "speed"]
    rows = indices.withColumns({"value": F.struct(*figures), "k1": keys.normal_key(F.col("slug")), "k2": keys.sorted_key(F.col("slug")), "k3": keys.noiseless_key(F.col("slug"))})
    first = latest_by(rows, ["k1"], [F.col("slug")])
    out = tiered_lookup(models, [
        ("exact", keys.normal_key(F.col("model_id")), first.select("k1", "value"), "k1"),
        ("sorted", keys.sorted_key(F.col("model_id")), unambiguous(rows, "k2", ["value"]), "k2"),
        ("plain", keys.noiseless_key(F.col("model_id")), unambiguous(rows, "k3", ["value"]), "k3"),
    ], "value")
    return out.select("*", *(F.col(f"value.{f}").alias(f) for f in figures)).drop("value")


def consolidate(models: DataFrame, order: dict[str, int]) -> DataFrame:
    """One entry for each canonical id: largest context, any vision and locality, cheapest provider, most frequent maker.

    ``order`` gives the providers' places; the first known value in it wins where no rule says otherwise.
    """
    place = F.lit(len(order))
    for name, i in order.items():
        place = F.when(F.col("provider") == name, i).otherwise(place)
    rows = models.withColumns({"canonical": keys.canonical_id(F.col("model_id")), "place": place})
    three = lambda c: F.when(F.bool_or(c), True).when(F.bool_or(c.isNotNull()), False)  # noqa: E731  unknown stays unknown
    best = rows.groupBy("canonical").agg(
        F.max("context_k").alias("context_k"), three(F.col("vision")).alias("vision"), F.coalesce(F.bool_or("local"), F.lit(False)).alias("local"),
        F.coalesce(F.bool_or((F.col("region") == "eu") & ~F.coalesce(F.col("trains"), F.lit(True))), F.lit(False)).alias("eu"),
        F.sort_array(F.collect_set("provider")).alias("providers"), F.min_by("model_id", F.struct("place", "model_id")).alias("shown"),
        F.min_by("aa_index", F.when(F.col("aa_index").isNotNull(), F.struct("place", "model_id"))).alias("aa_index"))
    price = [x for p in ("input_usd", "output_usd") for x in (F.col(p).isNull(), F.coalesce(F.col(p) == 0, F.lit(False)), F.col(p))]
    cheap = latest_by(rows, ["canonical"], [*price, F.col("provider")]).select("canonical", "input_usd", "output_usd", F.col("provider").alias("cheapest_at"))
    maker = most_frequent(rows.withColumn("position", F.struct("place", "model_id")), ["canonical"], "manufacturer", "place").select("canonical", "manufacturer")
    return best.join(cheap, "canonical").join(maker, "canonical", "left")


def generations(entries: DataFrame, thresholds: DataFrame, exceptions: DataFrame, legacy: DataFrame) -> DataFrame:
    """Adds ``line``, ``version`` and ``generation``: explicit legacy, exceptions, then the line's threshold, else none.

    ``thresholds``: line, least (array of numbers); ``exceptions``: canonical; ``legacy``: canonical, successor.
    """
    e = entries.withColumns({"family": keys.family(F.col("shown")), "line": keys.product_line(F.col("shown")), "version": keys.version_tuple(F.col("shown"))})
    e = e.join(legacy.select("canonical", F.col("successor"), F.lit(True).alias("_old")), "canonical", "left").join(exceptions.select("canonical", F.lit(True).alias("_kept")), "canonical", "left").join(thresholds, "line", "left")
    state = F.when(F.col("_old"), "legacy").when(F.col("_kept"), "current").when(F.col("least").isNotNull(), F.when(F.col("version") >= F.col("least"), "current").otherwise("legacy"))
    return e.withColumn("generation", state).drop("_old", "_kept", "least")


def newest_of_family(entries: DataFrame) -> DataFrame:
    """Adds ``newest``: null for every entry with its family's highest version; others point to the first of those by name."""
    top = entries.groupBy("family").agg(F.max("version").alias("_top"))
    ranked = entries.join(top, "family", "left").withColumn("_newest", F.col("version").eqNullSafe(F.col("_top")))
    first = ranked.filter("_newest").groupBy("family").agg(F.min("canonical").alias("_first"))
    return ranked.join(first, "family", "left").withColumn("newest", F.when(~F.col("_newest"), F.col("_first"))).drop("_newest", "_top", "_first")


def half_steps(x: Column) -> Column:
    """To the nearest half, halves up, from 0.5 to 5."""
    return F.greatest(F.lit(0.5), F.least(F.lit(5.0), F.floor(x * 2 + 0.5) / 2))


def score(*indices: Column) -> Column:
    """The mean of the indices that are known; null without any."""
    known = F.filter(F.array(*indices), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(known))


def stars(entries: DataFrame, by: str = "score") -> DataFrame:
    """Adds ``stars``: up to 3 below the floor of 45, from there to the best score up to 5; without vision at most 4.

    The best score is that of current entries: those whose generation says so, else those with no newer one.
    """
    legacy = F.coalesce(F.col("generation") == "legacy", F.col("newest").isNotNull())
    best = entries.agg(F.max(F.when(~legacy, F.col(by))).alias("_best"))  # one row
    s = F.col(by)
    raw = F.when(s < FLOOR, 0.5 + 2.5 * s / FLOOR).when(F.col("_best") > FLOOR, 3 + 2 * (s - FLOOR) / (F.col("_best") - FLOOR)).otherwise(F.lit(3.0))
    capped = F.when(F.col("vision").eqNullSafe(False), F.least(half_steps(raw), F.lit(4.0))).otherwise(half_steps(raw))
    return entries.join(F.broadcast(best)).withColumn("stars", F.when(s.isNotNull(), capped)).drop("_best")


def performance(score: Column, input_price: Column, output_price: Column) -> Column:
    """Score per price, where input weighs three times output; null if anything is missing or nothing costs."""
    mix = (3 * input_price + output_price) / 4
    return F.when(mix > 0, score / mix)


def best_of_line(entries: DataFrame, line: str, by: str, place: str) -> DataFrame:
    """Of each line the entry with the highest value; the first in place among equal ones."""
    best = F.max_by(F.struct(*entries.columns), F.struct(F.col(by), -F.col(place)))
    return entries.filter(F.col(by).isNotNull()).groupBy(line).agg(best.alias("_b")).select("_b.*")


def shown(entries: DataFrame, text: str = "", origins_: tuple[str, ...] = (), providers: tuple[str, ...] | None = None, local: bool = False, eu: bool = False, current: bool = False) -> DataFrame:
    """The catalogue's filters. No origins mean all; a list of providers that is empty means none."""
    out = entries
    if text:
        out = out.filter(F.lower("canonical").contains(text.lower()) | F.lower(F.coalesce("manufacturer", F.lit(""))).contains(text.lower()))
    if origins_:
        out = out.filter(F.col("origin").isin(*origins_))
    if providers is not None:
        out = out.filter(F.arrays_overlap("providers", F.array(*map(F.lit, providers)))) if providers else out.filter(F.lit(False))
    out = out.filter("local") if local else out
    out = out.filter("eu") if eu else out
    return out.filter(~F.col("generation").eqNullSafe("legacy")) if current else out


def ordered(entries: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Sorted for display: missing values last in either direction; texts by German rules."""
    kind = entries.schema[by].dataType.simpleString()
    key = F.collate(F.col(by), "de") if kind.startswith("string") else F.col(by)
    return entries.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "canonical")


def price_matches(prices: DataFrame, entries: DataFrame) -> DataFrame:
    """Which catalogue entry a price belongs to: by its id, by its alias, or none."""
    exact = entries.select(F.col("shown").alias("key"), "canonical")
    alias = entries.select("canonical", F.col("canonical").alias("_c"))
    out = prices.join(exact.withColumnRenamed("canonical", "_e"), "key", "left").withColumn("canonical", keys.canonical_id(F.col("key"))).join(alias, "canonical", "left")
    state = F.when(F.col("_e").isNotNull(), "exakt").when(F.col("_c").isNotNull(), "alias").otherwise("kein_match")
    return out.withColumn("match", state).withColumn("entry", F.coalesce("_e", "_c")).drop("_e", "_c", "canonical")


#: Sort orders by what a model is wanted for: column, whether the highest comes first.
PRESETS = {
    "all": ("canonical", False), "coding": ("coding_index", True), "reasoning": ("aa_index", True),
    "agentic": ("agentic_index", True), "price_performance": ("performance", True), "speed": ("speed", True),
}


def preset(entries: DataFrame, name: str) -> DataFrame:
    by, descending = PRESETS[name]
    return ordered(entries, by, descending)


def default_model(models: DataFrame, preferred: tuple[str, ...], keys_: list[str]) -> DataFrame:
    """Each group's model to begin with: the first of the preferred ones that it has, else its first free one, else its first (column ``place``)."""
    wish = F.array_position(F.array(*map(F.lit, preferred)), F.col("model_id"))
    rank = F.struct(F.when(wish > 0, wish).otherwise(len(preferred) + 1), F.when(F.col("model_id").endswith(":free"), 0).otherwise(1), F.col("place"))
    return models.groupBy(*keys_).agg(F.min_by("model_id", rank).alias("model_id"))


def provider_entries(rows: DataFrame) -> DataFrame:
    """Each provider's models once, the last row (column ``place``) of a repeated id, sorted by id."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("provider", "model_id")]), "place")
    return rows.groupBy("provider", "model_id").agg(last.alias("_r")).select("provider", "model_id", "_r.*").orderBy("provider", "model_id")


def european(entries: DataFrame, all_: bool = False) -> DataFrame:
    """Entries in the EU whose data are certainly not trained on, unless all are asked for."""
    return entries if all_ else entries.filter((F.lower("region") == "eu") & F.col("trains").eqNullSafe(False))


def own_ratings(models: DataFrame, registry: DataFrame) -> DataFrame:
    """Each entry's manual ratings: of the first of its models, in place, that the registry rates in anything.

    ``models``: canonical, model_id, place; ``registry``: name, coding, reasoning, total, comment.
    """
    rated = registry.filter(F.coalesce("coding", "reasoning", "total").isNotNull()).withColumn("_key", keys.normal_key(F.col("name")))
    rated = rated.groupBy("_key").agg(F.max_by(F.struct("coding", "reasoning", "total", F.coalesce("comment", F.lit("")).alias("comment")), "name").alias("_r"))
    found = models.withColumn("_key", keys.normal_key(F.col("model_id"))).join(rated, "_key")
    return found.groupBy("canonical").agg(F.min_by("_r", F.struct("place", "model_id")).alias("_r")).select("canonical", "_r.*")


def persona_routes(registry: DataFrame) -> DataFrame:
    """persona, place, model, level, primary: routes from a JSON column ``routes``, a list or an object with a list in it; the level is open by default.

    Anything else has no routes.
    """
    shape = "array<struct<modell: string, ebene: string, primaer: boolean>>"
    flat = F.when(F.trim("routes").startswith("["), F.col("routes")).otherwise(F.get_json_object("routes", "$.wege"))
    each = registry.select("persona", F.posexplode(F.from_json(flat, shape)).alias("place", "w")).filter("w is not null")
    return each.select("persona", "place", F.col("w.modell").alias("model"), F.coalesce("w.ebene", F.lit("offen")).alias("level"), F.coalesce("w.primaer", F.lit(False)).alias("primary"))


def persona_usage(prices: DataFrame, routes: DataFrame, personas: tuple[str, ...]) -> DataFrame:
    """Adds ``used_by``: the personas, in their fixed order, with a route of the price's source to its key or short name."""
    order = F.array_position(F.array(*map(F.lit, personas)), F.col("persona"))
    own = routes.select("source", F.explode(F.array_distinct(F.array("model", keys.short_name(F.col("model"))))).alias("_name"), F.struct(order.alias("o"), "persona").alias("_p")).distinct()
    named = prices.select("key", "source", F.explode(F.array_distinct(F.array("key", keys.short_name(F.col("key"))))).alias("_name"))
    used = named.join(own, ["source", "_name"]).groupBy("key", "source").agg(F.sort_array(F.collect_set("_p")).alias("_ps"))
    return prices.join(used, ["key", "source"], "left").withColumn("used_by", F.coalesce(F.transform("_ps", lambda p: p["persona"]), F.array().cast("array<string>"))).drop("_ps")
