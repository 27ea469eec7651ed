"""Text functions, redaction of records, catalogue keys, sources, side files."""

import json

from pyspark.sql import functions as F

from strandbook.functions import keys, origin, text
from strandbook.operators import catalogue
from strandbook.sources import catalogue_feeds, spool


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in df.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_identifiers_and_violations(spark):
    assert apply(spark, text.safe_identifier, "Read", "", None, "a" * 48)[:3] == ["Read", "", None]
    assert all(x.startswith("unbekannt:") and len(x) == 18 for x in apply(spark, text.safe_identifier, "a b", "a" * 49, "ä"))
    assert apply(spark, text.violation, "x" * 81, "a_lokal/b", "a/b", "C:\\x", "task-1", "me@x.org", "fine") == ["length", "local", "path", "path", "secret", "email", None]
    assert apply(spark, text.label, "x" * 80, "x" * 81, "y" * 78 + " zz") == ["x" * 80, "x" * 79 + "…", "y" * 78 + "…"]
    assert apply(spark, text.is_model_name, "lab/model:tag", "hf.co/u/repo", "60_Int/HR/Max.md", "plain", "a\\b") == [True, True, False, True, False]


def test_records_are_cleaned_to_a_fixpoint(spark):
    df = spark.sql("select 'a/b' as s, named_struct('x', 'ok', 'y', array('fine', 'me@x.org')) as n, map('good', 1, 'b/d', 2) as m, array(named_struct('k', cast(null as string))) as a")
    scanned = text.scan(df).first().violations
    assert sorted(scanned) == ["m{}: path", "n.y[]: email", "s: path"]
    cleaned = text.clean(df)
    row = cleaned.first()
    assert (row.s, row.n.y, row.m, row.redactions) == (text.REDACTED, ["fine", text.REDACTED], {"good": 1}, 3)
    assert text.scan(cleaned.drop("redactions")).first().violations == []


def test_free_text(spark):
    assert apply(spark, text.redact_chat, "see  /a/b/c now", "key sk-123", "plain text", "one/two") == ["see  <path> now", text.REDACTED, "plain text", "one/two"]
    assert apply(spark, lambda c: text.redact_error(c, ["maria"]), "Maria at https://x.y failed in ~/z") == ["<name> at <host> failed in <path>"]
    assert apply(spark, text.has_evidence, "lib.py:12", "`make`", "Tests: 5", "Test", None) == [True, True, True, False, None]
    assert apply(spark, text.project_name, "C:\\a\\proj", "/x/y/", "") == ["proj", "y", None]


def test_keys(spark):
    """Names that are one model, and names that are not; families, lines and versions."""
    same = [("gpt-oss:20b-cloud", "openai/gpt-oss-20b"), ("gemma4:31b-cloud", "google/gemma-4-31b-it"), ("glm-5.2:cloud", "z-ai/glm-5.2"), ("qwen3.5:9b", "qwen/qwen3.5-9b"), ("qwen3:14b", "qwen/qwen3-14b"),
            ("gemini-3-flash-preview:cloud", "google/gemini-3-flash-preview"), ("claude-haiku-4-5-20251001", "anthropic/claude-haiku-4-5"), ("o1:high", "o1"), ("gpt-5:priority", "gpt-5"), ("z-ai/glm-5.2:free", "glm-5.2"),
            ("codestral-latest", "codestral"), ("mistral-large-latest", "mistral-large"), ("claude-fable-5@eu", "claude-fable-5")]
    left, right = (apply(spark, keys.canonical_id, *x) for x in zip(*same, strict=True))
    assert left == right and "gemma-4-31b" in left and "qwen3-14b" in left
    assert apply(spark, keys.canonical_id, "google/gemma-3-27b-it", "mistral-large-2512", "m:8b", "m:70b", "hf.co/Lab/m-GGUF:q4") == ["gemma-3-27b", "mistral-large-2512", "m-8b", "m-70b", "hf-co-lab-m-gguf-q4"]
    assert apply(spark, keys.noiseless_key, "x/Big_Model-preview", "preview", "m-v1-thinking") == ["big-model", None, "m-thinking"]
    assert apply(spark, keys.sorted_key, "claude-haiku-4-5-20251001", "claude-4-5-haiku") == ["4-5-claude-haiku"] * 2
    assert apply(spark, keys.is_cloud, "gpt-oss:20b-cloud", "glm:cloud", "qwen:14b") == [True, True, False]
    families = {"glm-5.3-flash": "glm-flash", "glm-5.3": "glm", "gpt-oss-20b": "gpt-oss", "gpt-oss-120b": "gpt-oss", "gemini-3-flash-preview": "gemini-flash", "gemini-3.7-flash": "gemini-flash", "deepseek-v3.2": "deepseek",
                "deepseek-r1": "deepseek", "deepseek-v4-pro": "deepseek-pro", "mistral-large-3": "mistral-large", "mistral-small-3.2-24b-instruct": "mistral-small", "parasail-deepseek-v4-flash": "deepseek-flash",
                "gpt-4o-2024-11-20": "gpt-4o", "qwen3.8-2.4t-a95b": "qwen", "claude-haiku-4-5": "claude-haiku"}
    assert apply(spark, keys.family, *families) == list(families.values())
    lines = {"gpt-5.4-mini": "gpt", "gpt-4o-mini": "gpt-4o", "gpt-4o-2024-11-20": "gpt-4o", "claude-haiku-4-5": "claude", "glm-5v-turbo": "glm-v", "command-r-plus-08-2024": "command-r", "o1": "o", "o3-pro": "o", "qwen3.7-plus": "qwen"}
    assert apply(spark, keys.product_line, *lines) == list(lines.values())
    versions = {"gpt-oss": [], "qwen3.8": [3.0, 0.8], "deepseek-v3.2": [3.0, 0.2], "deepseek-r1": [1.0], "gemma4": [4.0], "qwen3.8-2.4t-a95b": [3.0, 0.8], "qwen-plus-2025-07-28": [], "gpt-4o-2024-11-20": []}
    assert [list(v) for v in apply(spark, keys.version_tuple, *versions)] == list(versions.values())
    v = spark.createDataFrame([("grok-4.6",), ("grok-4.20",), ("grok-5",), ("grok",)], "m string").select(keys.version_tuple(F.col("m")).alias("v"), "m").orderBy("v")
    assert [r.m for r in v.collect()] == ["grok", "grok-4.20", "grok-4.6", "grok-5"]


def test_names_and_routes(spark):
    assert apply(spark, keys.shown_name, "hf.co/Lab/Big-GGUF:q4", "a/b/glm:cloud", "x@eu", "qwen:14b", "m:FREE") == ["Big · q4 · Lab", "glm", "x", "qwen:14b", "m"]
    assert apply(spark, keys.name_order, "hf.co/Lab/Big-GGUF:q4", "Qwen:latest") == ["big", "qwen"]
    models = spark.createDataFrame([("m", "x/a", 1), ("m", "b", 2), ("n", "c", 1)], "canonical string, model_id string, place int")
    registry = spark.createDataFrame([("A", None, None, None, "none"), ("b", 3.0, None, 4.0, None)], "name string, coding double, reasoning double, total double, comment string")
    assert [tuple(r) for r in catalogue.own_ratings(models, registry).collect()] == [("m", 3.0, None, 4.0, "")]
    prices = spark.createDataFrame([("up/Q", "o"), ("z", "o")], "key string, source string")
    routes = spark.createDataFrame([("p2", "o", "q"), ("p1", "o", "up/Q"), ("p1", "r", "z")], "persona string, source string, model string")
    assert {r.key: r.used_by for r in catalogue.persona_usage(prices, routes, ("p1", "p2")).collect()} == {"up/Q": ["p1", "p2"], "z": []}


def test_catalogue(spark):
    feeds = [("openrouter", json.dumps({"data": [
        {"id": "lab/model-4.6", "context_length": 200_000, "pricing": {"prompt": "0.000003", "completion": "0.000015"}, "architecture": {"input_modalities": ["text", "image"]}},
        {"id": "lab/model-4.5", "pricing": {"prompt": "0", "completion": "0"}}, {"id": "~router"}, {"id": "openrouter/auto"}]})),
        ("requesty", json.dumps({"data": [{"id": "lab/model-4-6", "context_window": 100_000, "input_price": 0.000002, "output_price": 0.00001, "geolocation": "EU", "data_used_for_training": False}]})),
        ("ollama", "{broken"), ("indices", json.dumps({"data": [{"slug": "model-4-6", "name": "M", "evaluations": {"artificial_analysis_intelligence_index": 60.25}}]}))]
    payloads = spark.createDataFrame(feeds, "provider string, payload string")
    rows = catalogue_feeds.parse_all(payloads)
    assert rows.count() == 3
    rich = catalogue.enrich_indices(rows, catalogue_feeds.parse_indices(payloads)).withColumn("manufacturer", F.lit("Lab"))
    entries = catalogue.consolidate(rich, {"openrouter": 0, "requesty": 1})
    top = entries.filter("canonical = 'model-4-6'").first()
    assert (top.context_k, top.vision, top.eu, top.input_usd, top.cheapest_at, top.aa_index) == (200, True, True, 2.0, "requesty", 60.2)
    empty = lambda s: spark.createDataFrame([], s)
    thresholds = spark.createDataFrame([("model", [4.0, 0.55])], "line string, least array<double>")
    ranked = catalogue.stars(catalogue.newest_of_family(catalogue.generations(entries, thresholds, empty("canonical string"), empty("canonical string, successor string"))), "aa_index")
    got = {r.canonical: (r.generation, r.newest, r.stars) for r in ranked.collect()}
    assert got == {"model-4-6": ("current", None, 5.0), "model-4-5": ("legacy", "model-4-6", None)}


def test_sources(spark):
    df = spark.createDataFrame([("claude", "", ["claude-x"]), ("codex", "", []), ("claude", "", []), ("claude", "", ["qwen:8b"]), ("claude", "", ["a/b"]), ("claude", "", ["zzz"]), ("claude", "what", ["<synthetic>"]), ("else", "ollama", []), ("claude", "anthropic", ["zzz"])], "s string, b string, m array<string>")
    shown = df.select(origin.display_source(F.col("s"), F.col("b"), F.col("m"), F.array(F.lit("qwen:14b")), F.array(F.lit("r")), F.array(F.lit("claude-x"))).alias("x"))
    assert [r.x for r in shown.collect()] == ["claude", "codex", "claude", "ollama", "openrouter", "unknown", "claude", "unknown", "claude"]
    assert apply(spark, origin.backend_class, "https://router.requesty.ai/v1", "http://localhost:11434", None) == ["requesty", "ollama", ""]


def test_side_files(spark, tmp_path):
    (tmp_path / "meta.jsonl").write_text('{"sitzung_id": "a", "persona": "privat", "kanal": "??"}\n{"typ": "x"}\n{bad\n')
    row = spool.read_spool(spark, str(tmp_path / "meta.jsonl")).collect()
    assert [(r.session_id, r.persona, r.channel) for r in row] == [("a", "privat", "offen")]
    (tmp_path / "p.json").write_text(json.dumps({"preise": {"waehrung": "USD", "modelle": {"m.x": {"input": 1, "meldet_als": ["u/m"], "kontext_fenster": 10}, "none": {"output": None}}}}))
    p = spool.read_prices(spark, str(tmp_path / "p.json")).collect()
    assert [(r.key, r.input, r.aliases, r.context_window, r.currency) for r in p] == [("m.x", 1.0, ["u/m"], 10, "USD")]
    (tmp_path / "a.json").write_text(json.dumps({"x@codex": {"projekt": "P"}, "y": {"projekt": "Q", "ausgeblendet": True}}))
    assert sorted((r.name, r.source, r.project, r.hidden) for r in spool.read_aliases(spark, str(tmp_path / "a.json")).collect()) == [("x", "codex", "P", False), ("y", None, "Q", True)]
    config, unknown = spool.watch_config('{"regeln": {"a": "fragen", "zz": "aus"}}', ["a"])
    assert config["regeln"] == {"a": "ask"} and unknown == ["zz"] and spool.watch_config("{", [])[0]["standard"] == "warnen"
