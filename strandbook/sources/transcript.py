"""Transcripts of the first agent: one JSONL file for each session, and files of its sub-agents beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.functions.text import has_evidence, hash_prefix, label, project_name, safe_identifier
from strandbook.sources.lines import at, file_stem, get, marker_type, read_lines, read_packed, type_of, unknown_fields
from strandbook.sources.scratch import counted_small

# Fixed values of the format: line types, their fields, what blocked results begin with.
LINE_TYPES = "user assistant system attachment mode permission-mode atis-latch file-history-snapshot file-history-delta ai-title last-prompt queue-operation bridge-session frame-link agent-name".split()
CONTENT_TYPES = ("user", "assistant", "system")
COMMON = "cwd entrypoint gitBranch isSidechain parentUuid sessionId session_id slug timestamp type userType uuid version isMeta agentId".split()
FIELDS = {
    "user": COMMON + "classifierMetaLines interruptedMessageId isCompactSummary isVisibleInTranscriptOnly mcpMeta message origin permissionMode promptId promptSource queuePriority sourceToolAssistantUUID sourceToolUseID toolDenialKind toolUseResult turnCompanion userFeedback".split(),
    "assistant": COMMON + "apiErrorStatus attributionMcpServer attributionMcpTool attributionPlugin attributionSkill attributionAgent effort error isAbortedMidStream isApiErrorMessage apiErrorIsTransient message quotaLimits requestId".split(),
    "system": COMMON + "compactMetadata content durationMs hasOutput hookAdditionalContext hookCount hookErrors hookInfos level logicalParentUuid messageCount pendingBackgroundAgentCount pendingWorkflowCount preventedContinuation stopReason subtype toolUseID url".split(),
}
BLOCKED = r"^(Blocked|blocked|G5|G6|G7|Permission)"
NOTIFICATION = r"^\s*<task-notification"
FILE_TOOLS = S.FILE_TOOLS


@dataclass
class Frames:
    """What a transcript is reduced to; ``quality`` counts broken lines, which are no finding."""

    headers: DataFrame
    capture: DataFrame
    events: DataFrame
    subagents: DataFrame
    quality: DataFrame


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines with what is asked of them; ``object`` is null for broken ones. They are not filtered here: a filter would parse each line once more."""
    v = F.col("v")
    message = get(v, "$.message", "variant")
    lines = lines.withColumns({"object": F.when(v.isNotNull(), F.col("line").startswith("{")), "type": get(v, "$.type"), "ts": F.coalesce(get(v, "$.timestamp"), F.lit("")), "sid": get(v, "$.sessionId"), "message": message})
    wrong = F.col("type").isin("user", "assistant") & F.col("message").isNotNull() & ~F.is_variant_null("message") & (type_of(F.col("message")) != "OBJECT")
    content = get(F.col("message"), "$.content", "variant")
    # A message of a wrong type has no content. What is no array gives no blocks; only then its type is told, which goes through all that it holds.
    lines = lines.withColumns({"wrong": F.coalesce(wrong, F.lit(False)), "content": content}).withColumn("blocks", get(F.col("content"), "$", "array<variant>"))
    return lines.withColumn("plain", F.when(F.col("blocks").isNull() & (type_of(F.col("content")) == "STRING"), get(F.col("content"), "$")))


def _user_turn() -> Column:
    """A user line that begins a round: not meta, with text or blocks other than tool results, and no task notification."""
    kind = lambda b: get(b, "$.type")
    others = F.exists("blocks", lambda b: F.coalesce(kind(b) != "tool_result", F.lit(True)))
    texts = F.filter("blocks", lambda b: kind(b) == "text")
    text = F.coalesce("plain", get(F.get(texts, F.lit(0)), "$.text"), F.lit(""))
    begins = F.when(F.col("plain").isNotNull(), F.trim("plain") != "").otherwise(others)
    meta = F.coalesce(get(F.col("v"), "$.isMeta", "boolean"), F.lit(False))
    return (F.col("type") == "user") & ~meta & F.coalesce(begins, F.lit(False)) & ~text.rlike(NOTIFICATION)


def _result_text(block: Column) -> Column:
    inside = get(block, "$.content", "variant")
    first = F.get(F.filter(get(inside, "$", "array<variant>"), lambda b: get(b, "$.type") == "text"), F.lit(0))
    return F.coalesce(F.when(type_of(inside) == "STRING", get(inside, "$")), get(first, "$.text"), F.lit(""))


def _usage(message: Column) -> Column:
    n = lambda p: F.coalesce(get(message, f"$.usage.{p}", "long"), F.lit(0))
    return F.struct(n("input_tokens").alias("input"), n("output_tokens").alias("output"), n("cache_creation_input_tokens").alias("cache_write"), n("cache_read_input_tokens").alias("cache_read"), n("output_tokens_details.thinking_tokens").alias("thinking"))


def _has_usage() -> Column:
    """Whether an answer's usage is an object that is not empty."""
    shape = F.schema_of_variant(get(F.col("message"), "$.usage", "variant"))
    return (F.col("type") == "assistant") & F.coalesce(shape.startswith("OBJECT<") & (shape != "OBJECT<>"), F.lit(False))


def _events(parsed: DataFrame, agents: DataFrame | None) -> DataFrame:
    """Events by (path, line_no, place), with their file's last session id. Each line is parsed once, and its events are shuffled once."""
    v, message, b = F.col("v"), F.col("message"), F.col("b")
    kind = lambda b: get(b, "$.type")
    part = lambda kind, b: F.struct(F.lit(kind).alias("kind"), b.alias("b"))
    event = lambda kind, when, b: F.when(F.coalesce(when, F.lit(False)), part(kind, b))
    parts = lambda name, line, block: F.when(F.col("type") == line, F.transform(F.filter("blocks", lambda b: kind(b) == block), lambda b: part(name, b)))
    none, nothing = F.array().cast("array<struct<kind:string,b:variant>>"), F.lit(None).cast("variant")
    row = F.concat(
        F.array_compact(F.array(
            event(S.COMPACTION, get(v, "$.isCompactSummary", "boolean"), nothing),
            event(S.ROUND_END, (F.col("type") == "system") & (get(v, "$.subtype") == "turn_duration"), v),
            event(S.USER, _user_turn(), nothing),
            event(S.ASSISTANT, _has_usage(), message),
        )),
        F.coalesce(parts(S.TOOL_RESULT, "user", "tool_result"), none), F.coalesce(parts(S.TOOL, "assistant", "tool_use"), none))
    # A line without events goes on if it names the session.
    cut = parsed.select("path", "line_no", "ts", F.when(F.col("sid") != "", F.col("sid")).alias("_sid"), F.posexplode_outer(row).alias("place", "e")).select("path", "line_no", "place", "ts", "_sid", "e.kind", "e.b")
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    text = lambda p: F.coalesce(get(b, p), F.lit(""))
    cut = cut.filter("kind IS NOT NULL OR _sid IS NOT NULL").withColumns({"_name": F.when(is_(S.ASSISTANT), text("$.model")).when(is_(S.TOOL), text("$.name")), "_file": F.when(is_(S.TOOL), text("$.input.file_path"))})
    # Reduced before the shuffle, which all that follows within a file shares: text does not go through it.
    flat = cut.select(
        "path", "line_no", "place", "ts", "_sid", "kind", F.when(is_(S.ASSISTANT), get(b, "$.id")).alias("_said"),
        F.when(is_(S.TOOL), safe_identifier(F.col("_name"))).otherwise(F.col("_name")).alias("name"),
        F.when(is_(S.TOOL_RESULT), F.coalesce(get(b, "$.is_error", "boolean"), F.lit(False))).alias("failed"),
        F.when(is_(S.ROUND_END), get(b, "$.durationMs", "long")).alias("duration_ms"), F.when(is_(S.ASSISTANT), _usage(b)).cast(S.TOKEN).alias("token"),
        F.when(is_(S.TOOL_RESULT), text("$.tool_use_id")).when(is_(S.TOOL), text("$.id")).alias("ref"),
        F.when(is_(S.TOOL_RESULT), F.when(_result_text(b).rlike(BLOCKED), "blocked").otherwise("tool_error")).alias("error_class"),
        F.when(is_(S.TOOL), F.when(F.col("_name").isin(*FILE_TOOLS) & (F.col("_file") != ""), hash_prefix(F.col("_file"), 12)).otherwise("")).alias("signature")).repartition("path")
    # Of lines of one answer, the first counts. One order serves answers by their id, and calls and results by theirs.
    group = F.when(is_(S.ASSISTANT), 1).when(is_(S.TOOL, S.TOOL_RESULT), 2).otherwise(0)
    own = Window.partitionBy("path", group, F.when(is_(S.ASSISTANT), F.col("_said")).otherwise(F.coalesce("ref", F.lit("")))).orderBy("line_no", "place")
    again = is_(S.ASSISTANT) & F.col("_said").isNotNull() & (F.col("_said") != "") & (F.row_number().over(own) > 1)
    # A result belongs to the last call of its id before it; a call's duration ends with the first result after it.
    called = F.coalesce(F.last(F.when(is_(S.TOOL), F.col("name")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(""))
    after = F.lead(F.struct("kind", "ts")).over(own)
    took = F.when(after["kind"] == S.TOOL_RESULT, F.expr("timestampdiff(MILLISECOND, try_cast(ts AS timestamp), try_cast(_after.ts AS timestamp))"))
    last_id = F.max(F.when(F.col("_sid").isNotNull(), F.struct("line_no", "_sid"))).over(Window.partitionBy("path"))["_sid"]
    paired = flat.withColumns({"_again": again, "_after": after, "_called": called}).withColumn("session_id", F.coalesce(last_id, file_stem(F.col("path")))).filter("kind IS NOT NULL AND NOT _again")
    is_result, is_agent = is_(S.TOOL_RESULT), is_(S.TOOL) & (F.col("name") == "Agent")
    paired = paired.withColumns({
        "duration_ms": F.when((F.col("kind") == S.TOOL) & ~is_agent, took).otherwise(F.col("duration_ms")),
        "name": F.when(is_result, F.col("_called")).otherwise(F.col("name")),
        "signature": F.when(is_result, hash_prefix(F.concat("_called", "error_class"), 12)).otherwise(F.col("signature")),
        "kind": F.when(is_agent, S.SUBAGENT).otherwise(F.col("kind")),
    }).drop("_after", "_called", "_again", "_said", "_sid")
    if agents is not None:
        known = agents.filter("tool_use_id != ''").select(F.col("parent").alias("_parent"), F.col("tool_use_id").alias("ref"), F.struct("agent_id", "type").alias("_agent")).dropDuplicates(["_parent", "ref"])
        paired = paired.withColumn("_parent", F.regexp_replace("path", r"\.jsonl$", "")).join(known, ["_parent", "ref"], "left").drop("_parent")
        here = F.col("kind") == S.SUBAGENT
        paired = paired.withColumns({"name": F.when(here, F.coalesce("_agent.type", F.lit(""))).otherwise(F.col("name")), "ref": F.when(here, F.coalesce("_agent.agent_id", F.lit(""))).otherwise(F.col("ref"))}).drop("_agent")
    return paired


def _state(parsed: DataFrame, events: DataFrame) -> DataFrame:
    """For each file: span, models, counts, what its last text and last tool result were."""
    own = lambda c, ok: F.when(ok, F.struct("line_no", c))
    content = F.col("type").isin(*CONTENT_TYPES) & (F.col("ts") != "")
    model = get(F.col("message"), "$.model")
    blocks = parsed.filter("object").select("path", "line_no", "type", F.posexplode("blocks").alias("i", "b"))
    text = (F.col("type") == "assistant") & (get(F.col("b"), "$.type") == "text") & (F.trim(get(F.col("b"), "$.text")) != "")
    result = (F.col("type") == "user") & (get(F.col("b"), "$.type") == "tool_result")
    place = F.struct("line_no", "i")
    last = blocks.groupBy("path").agg(
        F.max(F.when(text, F.struct("line_no", "i", get(F.col("b"), "$.text").alias("text")))).alias("last_text"),
        F.max(F.when(result, place)).alias("last_result"),
        F.max_by(F.coalesce(get(F.col("b"), "$.is_error", "boolean"), F.lit(False)), F.when(result, place)).alias("last_failed"),
        F.count_if((F.col("type") == "assistant") & (get(F.col("b"), "$.type") == "thinking")).alias("thinking_blocks"))
    span = parsed.filter("object").groupBy("path").agg(
        F.min(own("ts", content))["ts"].alias("start"), F.max(own("ts", content))["ts"].alias("end"),
        F.min_by(model, F.when((F.col("type") == "assistant") & (model != ""), F.col("line_no"))).alias("first_model"),
        F.sort_array(F.collect_set(F.when((F.col("type") == "assistant") & (model != ""), model))).alias("models"))
    t = lambda n: F.coalesce(F.sum(f"token.{n}"), F.lit(0)).alias(n)
    counts = events.groupBy("path").agg(
        F.count_if(F.col("kind") == S.USER).alias("rounds"), F.count_if(F.col("kind") == S.TOOL).alias("tools"),
        F.count_if((F.col("kind") == S.TOOL_RESULT) & F.col("failed")).alias("tool_errors"), F.struct(*map(t, S.TOKEN.names)).alias("token"))
    return span.join(counts, "path", "left").join(last, "path", "left")


def _subagents(meta: DataFrame) -> DataFrame:
    """Rows of ``agent-*.meta.json`` by (path, value). A broken or missing meta is an empty one."""
    m = F.try_parse_json("value")
    file = F.col("path")
    return meta.select(
        F.regexp_replace(file, r"\.meta\.json$", ".jsonl").alias("path"), F.regexp_replace(file, r"/subagents/[^/]*$", "").alias("parent"),
        F.regexp_extract(file, r"agent-([^/]*)\.meta\.json$", 1).alias("agent_id"),
        safe_identifier(F.coalesce(get(m, "$.agentType"), F.lit(""))).alias("type"), F.coalesce(get(m, "$.model"), F.lit("")).alias("short_model"),
        label(F.trim(F.coalesce(get(m, "$.description"), F.lit("")))).alias("task"), F.coalesce(get(m, "$.spawnDepth", "int"), F.lit(1)).alias("depth"),
        F.coalesce(get(m, "$.toolUseId"), F.lit("")).alias("tool_use_id"))


def read_transcripts(spark: SparkSession, path: str, host: str = "", glob: str = "*.jsonl", **options) -> Frames:
    """All transcripts below ``path``. Nothing in a file can make the others fail: broken lines and drift are counted."""
    meta = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "agent-*.meta.json").text(path, wholetext=True)
    lines = read_lines(spark, path, glob, **options).filter(~F.col("path").contains("/subagents/"))
    return reduce(lines, read_lines(spark, path, "agent-*.jsonl"), meta.select(F.col("_metadata.file_path").alias("path"), "value"), host)


def read_packed_transcripts(spark: SparkSession, packed: str, host: str = "", **options) -> Frames:
    """``read_transcripts`` for transcripts and their sub-agents' files that ``pack_lines`` put together."""
    lines = lambda *kinds: read_packed(spark, packed, kinds=kinds, **options)
    one = F.sort_array(F.collect_list(F.struct("line_no", "line")))  # a meta file is small
    meta = lines("meta").groupBy("path").agg(F.array_join(F.transform(one, lambda x: x["line"]), "\n").alias("value"))
    return reduce(lines("session", "both"), lines("agent", "both"), meta, host)


def reduce(lines: DataFrame, sub_lines: DataFrame, meta: DataFrame, host: str = "") -> Frames:
    """Transcripts' and sub-agents' lines, and meta files as (path, value), reduced to tables."""
    meta = counted_small(_subagents(meta))
    parsed, sub_parsed = _parsed(lines), _parsed(sub_lines)
    events, sub_events = _events(parsed, meta), _events(sub_parsed, None)
    state, sub_state = _state(parsed, events), _state(sub_parsed, sub_events)
    v = F.col("v")
    first = lambda p: F.min_by(get(v, p), F.when(F.coalesce(get(v, p), F.lit("")) != "", F.col("line_no")))
    last_id = F.max_by(get(v, "$.sessionId"), F.when(F.coalesce(get(v, "$.sessionId"), F.lit("")) != "", F.col("line_no")))
    named = parsed.filter("object").groupBy("path").agg(
        last_id.alias("session_id"),
        first("$.cwd").alias("cwd"), first("$.version").alias("version"), first("$.gitBranch").alias("git_branch"))
    head = named.join(state, "path").withColumn("session_id", F.coalesce("session_id", file_stem(F.col("path"))))
    empty = lambda c: F.coalesce(c, F.lit(""))
    headers = head.select(
        "path", "session_id", F.lit("claude").alias("source"), F.lit(host).alias("host"), F.when(empty("cwd") != "", hash_prefix(F.col("cwd"), 12)).otherwise("").alias("project_hash"),
        safe_identifier(empty(project_name(F.col("cwd")))).alias("project"), empty("start").alias("start"), empty("end").alias("end"), empty("version").alias("version"), safe_identifier(empty("git_branch")).alias("git_branch"), "models")
    ids = named.select("path", F.coalesce("session_id", file_stem(F.col("path"))).alias("session_id"))  # the headers' paths and ids, without what headers need besides
    markers = F.concat(
        F.array_compact(F.array(
            F.when(~F.col("object"), F.concat(F.lit("struktur:"), marker_type(v))),
            F.when(F.col("object") & ~F.coalesce(F.col("type").isin(*LINE_TYPES), F.lit(False)), F.coalesce("type", F.lit("None"))),
            F.when(F.col("wrong"), F.concat(F.lit("struktur:"), marker_type(F.col("message")))))),
        F.when(F.col("object"), unknown_fields(F.col("line"), F.col("type"), FIELDS, "feld:")).otherwise(F.array().cast("array<string>")))
    # In one pass, without the events: a file has a counted answer if a line of it has usage, and few different lists of markers.
    seen_of = parsed.filter(v.isNotNull()).groupBy("path").agg(
        F.count_if("object").alias("objects"), F.coalesce(last_id, file_stem(F.col("path"))).alias("session_id"), F.max(F.col("object") & (get(v, "$.subtype") == "turn_duration")).alias("timed"),
        F.max(F.col("object") & _has_usage()).alias("counted"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(markers)))).alias("unknown")).filter("objects > 0")
    folders = meta.select(F.concat("parent", F.lit(".jsonl")).alias("path")).distinct().withColumn("has_agents", F.lit(True))
    seen = lambda c: F.when(c, "observed").otherwise("not_observed")
    capture = seen_of.join(folders, "path", "left").select(
        "session_id", seen(F.coalesce("counted", F.lit(False))).alias("token"), seen(F.coalesce("timed", F.lit(False))).alias("duration"), F.lit("not_observed").alias("cost"), F.lit("redacted").alias("contents"),
        seen(F.coalesce("has_agents", F.lit(False))).alias("subagents"), F.lit("observed").alias("compaction"), F.lit("partial").alias("reasoning"), F.coalesce("unknown", F.array().cast("array<string>")).alias("unknown"))
    shown = events.filter((F.col("kind") != S.TOOL_RESULT) | F.col("failed"))
    shown = shown.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("line_no", "place")).cast("long") - 1)
    typed = shown.select("session_id", "seq", at(F.col("ts")).alias("ts"), *S.EVENT.names[3:])
    after_text = F.coalesce(F.struct("last_text.line_no", "last_text.i") > F.col("last_result"), F.lit(True))
    outcome = F.when(F.col("last_text").isNull(), "empty").when(F.coalesce("last_failed", F.lit(False)) & ~after_text, "error").otherwise("ok")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    token = F.coalesce(F.col("token"), F.struct(*(F.lit(0).cast("long").alias(n) for n in S.TOKEN.names)))
    # Only transcripts that have sub-agents are read for their ids.
    parent = F.regexp_replace("path", r"\.jsonl$", "")
    parents = parsed.filter("object").withColumn("parent", parent).join(meta.select("parent").distinct(), "parent", "left_semi").groupBy("path").agg(last_id.alias("session_id"))
    parents = parents.select(parent.alias("parent"), F.coalesce("session_id", file_stem(F.col("path"))).alias("session_id"))
    agents = meta.join(sub_state, "path", "left").join(parents, "parent").select(
        "session_id", "agent_id", "type", F.coalesce(F.when(F.col("first_model") != "", F.col("first_model")), "short_model").alias("model"), "task", "depth",
        at(F.col("start")).alias("start"), at(F.col("end")).alias("end"), F.expr("timestampdiff(MILLISECOND, try_cast(start AS timestamp), try_cast(end AS timestamp))").alias("duration_ms"),
        zero("rounds").alias("rounds"), zero("tools").alias("tools"), zero("tool_errors").alias("tool_errors"), token.alias("token"),
        F.when(F.coalesce(has_evidence(F.col("last_text.text")), F.lit(False)), "observed").otherwise("not_observed").alias("evidence"), outcome.alias("outcome"))
    broken = lines.withColumn("_p", F.regexp_replace("path", r"/subagents/.*$", ".jsonl")).unionByName(sub_lines.withColumn("_p", F.regexp_replace("path", r"/subagents/.*$", ".jsonl")))
    quality = broken.groupBy(F.col("_p").alias("path")).agg(F.count("*").alias("lines"), F.count_if(v.isNull()).alias("broken_lines"))
    return Frames(headers, capture, typed, agents, quality.join(ids, "path", "left"))
