"""Rollouts of the second agent: JSONL lines of timestamp, type and payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandbook import schema as S
from strandbook.functions.text import hash_prefix, project_name, safe_identifier
from strandbook.sources.lines import at, get, marker_type, read_lines, type_of, unknown_fields
from strandbook.sources.transcript import Frames

# Fixed values of the format: what makes no event, and the known fields of each type.
QUIET_MESSAGES = ("task_started", "task_complete", "user_message", "agent_message", "thread_settings_applied", "web_search_end")
QUIET_ITEMS = ("web_search_call",)
QUIET_LINES = ("world_state",)
LINE_FIELDS = {"zeile": ["timestamp", "type", "payload"]}
FIELDS = {
    "session_meta": "base_instructions cli_version context_window cwd git history_mode id model_provider originator session_id source thread_source timestamp".split(),
    "turn_context": "approval_policy approvals_reviewer collaboration_mode comp_hash current_date cwd model multi_agent_version permission_profile personality realtime_active sandbox_policy summary timezone turn_id workspace_roots".split(),
    "response_item": "arguments call_id content encrypted_content id internal_chat_message_metadata_passthrough name output phase role status summary type action".split(),
    "event_msg": "info rate_limits type message phase memory_citation completed_at duration_ms last_agent_message started_at time_to_first_token_ms turn_id collaboration_mode_kind model_context_window thread_settings audio images local_audio local_images text_elements action call_id query".split(),
}
EXIT, WALL, TIMED_OUT = r"Exit code:\s*(-?\d+)", r"Wall time:\s*([0-9.]+)\s*\w+", "timed out"


def read_rollouts(spark: SparkSession, path: str, host: str = "", glob: str = "*.jsonl", **options) -> Frames:
    """All rollouts below ``path``. The model of a turn holds until the next; token counts go to the last assistant message."""
    lines = read_lines(spark, path, glob, **options)
    v = F.col("v")
    parsed = lines.filter(v.isNotNull()).withColumns({"object": type_of(v) == "OBJECT", "type": get(v, "$.type"), "ts": F.coalesce(get(v, "$.timestamp"), F.lit("")), "payload": get(v, "$.payload", "variant")})
    missing = F.col("payload").isNull() | F.is_variant_null("payload")
    parsed = parsed.withColumn("wrong", F.coalesce(F.col("object") & ~missing & (type_of(F.col("payload")) != "OBJECT"), F.lit(False)))
    p = lambda x, k="string": get(F.col("payload"), f"$.{x}", k)
    fine = F.col("object") & ~F.col("wrong")
    rows = parsed.filter(fine).withColumns({"sub": p("type"), "role": p("role"), "call": F.coalesce(p("call_id"), F.lit("")), "output": F.coalesce(p("output"), F.lit(""))})
    is_ = lambda t, s=None: (F.col("type") == t) & ((F.col("sub") == s) if s else F.lit(True))
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    model = F.when(is_("turn_context") & (F.coalesce(p("model"), F.lit("")) != ""), p("model"))
    said = is_("response_item", "message") & (F.col("role") == "assistant")
    counted = is_("event_msg", "token_count")
    rows = rows.withColumns({
        "model": F.coalesce(F.last(model, ignorenulls=True).over(upto), F.lit("")), "answer": F.sum(F.when(said, 1).otherwise(0)).over(upto),
        "window": F.when(counted, p("info.model_context_window", "long")),
    })
    before = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("window_was", F.last("window", ignorenulls=True).over(before))
    use = lambda x: F.coalesce(F.sum(F.coalesce(p(f"info.last_token_usage.{x}", "long"), F.lit(0))), F.lit(0))
    usage = rows.filter(counted & (F.col("answer") > 0)).groupBy("path", "answer").agg(F.struct(
        use("input_tokens").alias("input"), use("output_tokens").alias("output"), use("cache_write_input_tokens").alias("cache_write"),
        use("cached_input_tokens").alias("cache_read"), use("reasoning_output_tokens").alias("thinking")).alias("token"))
    code = F.regexp_extract("output", EXIT, 1).try_cast("int")
    wall = F.bround(F.regexp_extract("output", WALL, 1).try_cast("double") * 1000).cast("long")
    failure = F.when(F.col("output").contains(TIMED_OUT), "timeout").when(code != 0, "exit_nonzero").otherwise("")
    result = is_("response_item", "function_call_output")
    call = is_("response_item", "function_call")
    kind = (
        F.when(is_("response_item", "message") & (F.col("role") == "user"), S.USER).when(said, S.ASSISTANT).when(call, S.TOOL).when(result, S.TOOL_RESULT)
        .when(is_("response_item", "reasoning"), S.SYSTEM).when(counted & F.col("window").isNotNull() & ~F.col("window").eqNullSafe(F.col("window_was")), S.SYSTEM))
    name = F.when(said, F.col("model")).when(call, safe_identifier(F.coalesce(p("name"), F.lit("")))).when(is_("response_item", "reasoning"), "reasoning").when(counted, "context_window")
    shown = rows.withColumns({"kind": kind, "name": name, "error_class": F.when(result, failure), "took": F.when(result, wall), "code": F.when(result, code)}).filter("kind is not null")
    own = Window.partitionBy("path", "call", F.col("kind").isin(S.TOOL, S.TOOL_RESULT)).orderBy("line_no")
    called = F.coalesce(F.last(F.when(F.col("kind") == S.TOOL, F.col("name")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(""))
    # A success writes its wall time onto the call; of several the last one stays.
    group = F.sum(F.when(F.col("kind") == S.TOOL, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    shown = shown.withColumns({"called": F.when(F.col("call") == "", "").otherwise(called), "attempt": group})
    success = F.last(F.when((F.col("kind") == S.TOOL_RESULT) & (F.col("error_class") == ""), F.struct("took")), ignorenulls=True)
    both = Window.partitionBy("path", "call", F.col("kind").isin(S.TOOL, S.TOOL_RESULT), "attempt").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shown = shown.withColumn("done", success.over(both)).filter((F.col("kind") != S.TOOL_RESULT) | (F.col("error_class") != ""))
    shown = shown.join(usage, ["path", "answer"], "left")
    is_result, is_tool = F.col("kind") == S.TOOL_RESULT, F.col("kind") == S.TOOL
    session = rows.groupBy("path").agg(
        F.max_by(F.coalesce(F.when(p("session_id") != "", p("session_id")), p("id")), F.when(is_("session_meta"), F.col("line_no"))).alias("session_id"),
        F.max_by(F.coalesce(p("cwd"), F.lit("")), F.when(is_("session_meta"), F.col("line_no"))).alias("cwd"),
        F.max_by(F.coalesce(p("cli_version"), F.lit("")), F.when(is_("session_meta"), F.col("line_no"))).alias("version"),
        F.max(counted).alias("counted"), F.array_sort(F.collect_list(F.when(model.isNotNull(), F.struct("line_no", model.alias("m"))))).alias("turns"))
    span = parsed.filter("object and ts != ''").groupBy("path").agg(F.min_by("ts", "line_no").alias("start"), F.max_by("ts", "line_no").alias("end"))
    head = session.join(span, "path", "left").withColumn("session_id", F.coalesce("session_id", F.lit("")))
    ids = head.select("path", "session_id")
    none = lambda c: F.lit(None).cast(c)
    events = shown.join(ids, "path").select(
        "session_id", (F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1).cast("long").alias("seq"), at(F.col("ts")).alias("ts"), "kind",
        F.when(is_result, F.col("called")).otherwise(F.col("name")).alias("name"), F.when(is_result, True).alias("failed"),
        F.when(is_result, F.col("took")).when(is_tool & (F.col("call") != ""), F.col("done.took")).alias("duration_ms"),
        F.when(F.col("kind") == S.ASSISTANT, F.col("token")).alias("token"),
        F.when(is_result | is_tool, F.col("call")).when(F.col("name") == "context_window", F.col("window").cast("string")).alias("ref"), F.when(is_result, F.col("error_class")).alias("error_class"),
        F.when(is_result, hash_prefix(F.concat_ws("|", "called", "error_class", F.coalesce(F.col("code").cast("string"), F.lit("None"))), 12)).alias("signature"))
    empty = F.array().cast("array<string>")
    marks = parsed.withColumn("sub", p("type")).select("path", "line_no", F.posexplode(F.concat(
        F.array_compact(F.array(F.when(~F.col("object"), F.concat(F.lit("struktur:"), marker_type(v))))),
        F.when(F.col("object"), unknown_fields(F.col("line"), F.lit("zeile"), LINE_FIELDS, "feld:")).otherwise(empty),
        F.array_compact(F.array(
            F.when(F.col("wrong"), F.concat(F.lit("struktur:"), marker_type(F.col("payload")))),
            F.when(fine & ~F.coalesce(F.col("type").isin(*FIELDS, *QUIET_LINES), F.lit(False)), F.concat(F.lit("toplevel:"), F.coalesce("type", F.lit("None")))))),
        F.when(fine & ~missing, unknown_fields(F.to_json("payload"), F.col("type"), FIELDS, "feld:")).otherwise(empty),
        F.array_compact(F.array(
            F.when(fine & (F.col("type") == "response_item") & ~F.coalesce(F.col("sub").isin("message", "function_call", "function_call_output", "reasoning", *QUIET_ITEMS), F.lit(False)), F.concat(F.lit("response_item:"), F.coalesce("sub", F.lit("None")))),
            F.when(fine & (F.col("type") == "event_msg") & ~F.coalesce(F.col("sub").isin("token_count", *QUIET_MESSAGES), F.lit(False)), F.concat(F.lit("event_msg:"), F.coalesce("sub", F.lit("None")))))),
    )).alias("i", "marker"))
    early = rows.filter(counted & (F.col("answer") == 0)).select("path", "line_no", F.lit(1000).alias("i"), F.lit("token_count_ohne_assistent").alias("marker"))
    broken = lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(v.isNull()).alias("broken_lines"))
    torn = broken.filter("broken_lines > 0").select("path", F.lit(2**31 - 1).alias("line_no"), F.lit(0).alias("i"), F.concat(F.lit("defekte_zeilen:"), "broken_lines").alias("marker"))
    met = marks.unionByName(early).unionByName(torn).groupBy("path", "marker").agg(F.min(F.struct("line_no", "i")).alias("first"))
    drift = met.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "marker"))), lambda x: x["marker"]).alias("unknown"))
    text = lambda c: F.coalesce(c, F.lit(""))
    headers = head.select(
        "path", "session_id", F.lit("codex").alias("source"), F.lit(host).alias("host"), hash_prefix(text("cwd"), 12).alias("project_hash"), safe_identifier(text(project_name(F.col("cwd")))).alias("project"),
        text("start").alias("start"), text("end").alias("end"), text("version").alias("version"), F.lit("").alias("git_branch"), F.array_distinct(F.transform("turns", lambda t: t["m"])).alias("models"))
    capture = head.join(drift, "path", "left").select(
        "session_id", F.when(F.coalesce("counted", F.lit(False)), "observed").otherwise("not_observed").alias("token"), F.lit("partial").alias("duration"), F.lit("not_observed").alias("cost"), F.lit("redacted").alias("contents"),
        F.lit("not_recorded").alias("subagents"), F.lit("not_recorded").alias("compaction"), F.lit("not_recorded").alias("reasoning"), F.coalesce("unknown", empty).alias("unknown"))
    agents = headers.limit(0).select(*(none(f.dataType).alias(f.name) for f in S.SUBAGENT_ROW.fields))
    return Frames(headers, capture, events, agents, broken.join(ids, "path", "left"))
