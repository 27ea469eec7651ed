"""Where a session comes from: project aliases, display source, axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNASSIGNED = "unassigned"


def resolve_projects(sessions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``project_shown``, ``context`` and ``hidden``.

    ``aliases``: name, source (null: any), project, context, hidden. A name with
    the session's source comes first, then the name alone; names that begin with
    ``codex-`` are reviews; the rest keep their name and are unassigned.
    """
    own = aliases.filter("source is not null").select(F.col("name").alias("project"), "source", F.struct("project", "context", "hidden").alias("_own"))
    any_ = aliases.filter("source is null").select(F.col("name").alias("project"), F.struct("project", "context", "hidden").alias("_any"))
    joined = sessions.join(own, ["project", "source"], "left").join(any_, "project", "left")
    best = F.coalesce("_own", "_any")
    review = F.col("project").startswith("codex-")
    return joined.withColumns({
        "project_shown": F.coalesce(best["project"], "project"),
        "context": F.when(best.isNotNull(), best["context"]).when(review, "review").otherwise(UNASSIGNED),
        "hidden": F.coalesce(best["hidden"], F.lit(False)),
    }).drop("_own", "_any")


# Names that stand for no model, and the backend classes that name a source.
PLACEHOLDERS = ("<synthetic>", "<redigiert>")
BACKENDS = {"anthropic": "claude", "claude": "claude", "ollama": "ollama", "openrouter": "openrouter", "requesty": "requesty"}


def real_models(models: Column) -> Column:
    """The names that stand for models."""
    return F.filter(F.coalesce(models, F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != "") & ~m.isin(*PLACEHOLDERS))


def base_name(model: Column) -> Column:
    """Without the tag: sessions write it or leave it out."""
    return F.substring_index(model, ":", 1)


def display_source(source: Column, backend: Column, models: Column, local: Column, routed: Column, own: Column) -> Column:
    """The source as shown: product and codex sessions, then a known backend class, then what the models tell.

    ``local``, ``routed`` and ``own`` are arrays of registered model names: of the
    local runner, of the router, of the maker itself. Any other raw source than
    claude is unknown, and so are models that are registered nowhere.
    """
    names = real_models(models)
    local = F.transform(local, base_name)
    by_backend = F.lit(None).cast("string")
    for name, shown in BACKENDS.items():
        by_backend = F.when(backend == name, shown).otherwise(by_backend)
    by_models = (
        F.when(F.size(names) == 0, "claude")
        .when(F.exists(names, lambda m: F.array_contains(local, base_name(m))), "ollama")
        .when(F.exists(names, lambda m: F.array_contains(routed, m)), "requesty")
        .when(F.exists(names, lambda m: m.contains("/")), "openrouter")
        .when(F.forall(names, lambda m: F.array_contains(own, m)), "claude")
        .otherwise("unknown")
    )
    return F.when(source.isin("product", "codex"), source).when(~source.eqNullSafe("claude"), "unknown").otherwise(F.coalesce(by_backend, by_models))


def unknown_models(source: Column, models: Column, registry: Column) -> Column:
    """Models of a claude session that the registry knows neither by name nor by base name, and that no provider path explains; each once, in order.

    The base name of a tagged registry model is known too.
    """
    known = F.array_union(registry, F.transform(registry, base_name))
    names = F.filter(real_models(models), lambda m: ~F.array_contains(known, m) & ~F.array_contains(known, base_name(m)) & ~m.contains("/"))
    return F.when(source == "claude", F.array_sort(F.array_distinct(names))).otherwise(F.array().cast("array<string>"))


def backend_class(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return (
        F.when(host.isNull(), "").when(host.rlike(r"^(localhost|127\.0\.0\.1|.*\.local)$"), "ollama").when(host.endswith("requesty.ai"), "requesty")
        .when(host.endswith("openrouter.ai"), "openrouter").when(host.endswith("anthropic.com"), "claude").otherwise("other")
    )


def choice(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def distribution(sessions: DataFrame, by: str) -> DataFrame:
    """Sessions of each value; most first, then by name."""
    return sessions.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)
