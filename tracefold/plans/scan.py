"""The scan: raw telemetry to detector events, and events to observations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators import detectors, identity, normalise, observations, validate
from tracefold.operators.ordering import fitting_slice_ns, hot_keys, salted_join
from tracefold.sources import telemetry
from tracefold.sources.sinks import stored

EVENT_COLUMNS = [
    "event_id", "timestamp_ns", "project_id", "task_id", "counts_as_distinct_task",
    "event_name", "op_kind", "op_executable", "op_subcommand", "op_target", "op_exit_code",
    "op_key", "success_string", "success_bool", "status_code", "outcome", "is_mutation",
    "token_count", "skill_required", "skill_used", "decision_source", "is_quality_gate",
    "tool_call_count",
]


def link_logs(logs: DataFrame, placed: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Logs with the thread and project of their trace (the one log-trace join)."""
    return salted_join(logs, placed.select("trace_id", "thread_id", "project_id"), ["trace_id"],
                       F.col("log_id"), hot=hot)


def shortlist(linked: DataFrame) -> DataFrame:
    """Log ids worth hydrating.

    Explicit failures, decisions and sandbox outcomes, plus every call of a (task
    hint, tool) pair seen at least twice. Pairs are counted first and joined back, so
    a hot pair is never windowed in one task.
    """
    request = F.col("event_name").isin(*K.TRANSPORT_REQUEST_EVENTS)
    explicit = (
        ((F.col("event_name") == "codex.tool_result") & (F.col("success_string") == "false"))
        | (request & (~F.col("success_bool") | (F.col("status_code") >= 400)))
        | F.col("event_name").isin("codex.sandbox_outcome", "codex.tool_decision"))
    tools = linked.where(F.col("tool_name").isNotNull()).select(
        F.coalesce("thread_id", "conversation_id", "trace_id", "log_id").alias("hint"),
        "tool_name", "log_id")
    pairs = tools.groupBy("hint", "tool_name").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    repeated = salted_join(tools, pairs.drop("n"), ["hint", "tool_name"], F.col("log_id"),
                           "left_semi")
    return linked.where(explicit).select("log_id").unionByName(
        repeated.select("log_id")).distinct()


def operations(hydration: DataFrame) -> DataFrame:
    """Hydrated calls with their operation, exit code and outcome."""
    calls = hydration.withColumn("arguments", F.coalesce("arguments", "args", "argv"))
    done = normalise.normalise_operations(calls)
    op = F.col("operation")
    return done.select(
        "log_id", "outcome",
        *(op[f].alias(f"op_{f}") for f in ("kind", "executable", "subcommand", "target")),
        F.when(op.isNotNull(), F.col("exit_code")).alias("op_exit_code"),
        normalise.membership_key(op).alias("op_key"))


def place_traces(traces: DataFrame, roots: DataFrame,
                 aliases: DataFrame | None = None) -> DataFrame:
    """Traces with the project their working directory belongs to."""
    resolved = identity.resolve_projects(traces, roots, aliases).select("cwd", "project_id")
    return salted_join(traces, resolved, ["cwd"], F.col("trace_id"))


def detector_events(linked: DataFrame, placed: DataFrame, hydration: DataFrame,
                    extras: DataFrame | None = None) -> DataFrame:
    """Logs and token-bearing traces with identity, outcome and operation.

    ``extras`` (by event_id) supplies the optional facts no scan fills: skill_required,
    skill_used, is_quality_gate, tool_call_count.
    """
    tasked = identity.with_canonical_task(
        linked, identity.linked_thread_map(linked), F.coalesce("trace_id", "log_id"),
        F.col("log_id"))
    name, source = F.col("event_name"), F.col("decision_source")
    base = tasked.join(operations(hydration), "log_id", "left").select(
        F.col("log_id").alias("event_id"), "timestamp_ns",
        identity.project_or_unresolved(F.col("project_id"), F.col("task_id"))
        .alias("project_id"), "task_id", "counts_as_distinct_task",
        C.outcome_event_name(name, source).alias("event_name"),
        *(c for c in EVENT_COLUMNS if c.startswith("op_")),
        "success_string", "success_bool", "status_code",
        C.outcome_value(name, source, F.col("decision"), F.col("outcome")).alias("outcome"),
        C.is_mutation(F.col("tool_name")).alias("is_mutation"))
    events = base.unionByName(episode_events(placed), allowMissingColumns=True)
    if extras is not None:
        events = events.join(extras, "event_id", "left")
    optional = {"skill_required": "string", "skill_used": "boolean", "decision_source": "string",
                "is_quality_gate": "boolean", "tool_call_count": "bigint"}
    for column, kind in optional.items():
        if column not in events.columns:
            events = events.withColumn(column, F.lit(None).cast(kind))
    return events.select(*EVENT_COLUMNS)


def episode_events(placed: DataFrame) -> DataFrame:
    """One synthetic event per token-bearing trace, at its end.

    An episode has no conversation, so its task is its thread or else the trace.
    """
    thread = C.blank_to_null(F.col("thread_id"))
    task = F.concat(F.when(thread.isNotNull(), F.lit("thread:")).otherwise(F.lit("episode:")),
                    F.coalesce(thread, "trace_id"))
    return placed.where("total_tokens > 0").select(
        F.concat(F.lit("trace:"), "trace_id").alias("event_id"),
        F.col("ended_at_ns").alias("timestamp_ns"),
        identity.project_or_unresolved(F.col("project_id"), task).alias("project_id"),
        task.alias("task_id"), thread.isNotNull().alias("counts_as_distinct_task"),
        F.lit("trace.episode").alias("event_name"), F.lit(False).alias("is_mutation"),
        F.col("total_tokens").alias("token_count"))


def scan_window(raw_logs: DataFrame, raw_spans: DataFrame, roots: DataFrame, start_ns: int,
                end_ns: int, aliases: DataFrame | None = None, policy: str = "quarantine",
                entered: Callable[[str], None] = lambda phase: None
                ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Linked logs, placed traces, hydrated rows and rejects of one time range.

    The flat, typed, trace-linked logs are written once: three later steps read them,
    and none of those should decode the raw attribute maps again. The raw table is
    read a second time only for the shortlisted rows' heavy fields.

    Malformed rows and rows whose identity holds whitespace go to the rejects (source,
    row_id, reject_reason); with ``policy`` "fail" the first one stops the job instead.
    ``entered`` hears which source is being read.
    """
    def judged(parsed: DataFrame) -> DataFrame:
        return parsed if policy == "quarantine" else validate.enforced(parsed).withColumn(
            "reject_reason", F.lit(None).cast("string"))

    def placeable(rows: DataFrame, conversation: Column, fallback: Column) -> DataFrame:
        fault = identity.identity_fault(F.col("thread_id"), conversation, fallback)
        return judged(rows.withColumn("reject_reason", F.coalesce("reject_reason", F.concat(
            fault, F.lit(" must not contain whitespace")))))

    def reported(rows: DataFrame, source: str, row_id: str) -> DataFrame:
        return validate.rejected(rows).select(F.lit(source).alias("source"), F.col(
            row_id).alias("row_id"), "reject_reason")

    if policy not in ("quarantine", "fail"):
        raise ValueError(f"unknown policy {policy!r}")
    logs = judged(validate.parse_logs(telemetry.scan_logs(raw_logs, start_ns, end_ns)))
    entered("traces_query")
    traces = stored(placeable(
        validate.parse_traces(telemetry.scan_traces(raw_spans, start_ns, end_ns)),
        F.lit(None).cast("string"), F.col("trace_id")), "traces")
    placed = stored(place_traces(validate.accepted(traces), roots, aliases), "placed-traces")
    entered("logs_query")
    # Hot traces are counted on the trace column alone, without decoding the maps.
    hot = hot_keys(telemetry.time_range(raw_logs, start_ns, end_ns), ["trace_id"])
    every = stored(placeable(link_logs(logs, placed, hot), F.col("conversation_id"), F.coalesce(
        "trace_id", "log_id")), "linked-logs")
    linked = validate.accepted(every)
    entered("hydration")
    raw = telemetry.hydrate(raw_logs, shortlist(linked), start_ns, end_ns)
    # read by both branches of the operations
    hydration = stored(validate.parse_hydration(raw), "hydration")
    hydration = validate.accepted(hydration) if policy == "quarantine" else validate.enforced(
        hydration)
    return linked, placed, hydration, reported(every, "logs", "log_id").unionByName(
        reported(traces, "traces", "trace_id"))


def scan_events(raw_logs: DataFrame, raw_spans: DataFrame, roots: DataFrame, start_ns: int,
                end_ns: int, aliases: DataFrame | None = None,
                extras: DataFrame | None = None) -> DataFrame:
    """Detector events of one time range, straight from the raw tables."""
    return detector_events(
        *scan_window(raw_logs, raw_spans, roots, start_ns, end_ns, aliases)[:3], extras)


def observe(events: DataFrame, baselines: DataFrame | None = None,
            slice_ns: int | None = None, verified: bool = True) -> tuple[DataFrame, DataFrame]:
    """Observation records and their member rows; ``verified`` is the rule of ``tool_loop``.

    ``events`` is a stored table. The members of all detectors are written once;
    records and member rows are both derived from that table.
    """
    width = fitting_slice_ns(events) if slice_ns is None else slice_ns
    single, grouped = detectors.detect_all(events, baselines, width, verified)
    members = stored(single.unionByName(grouped), "members")
    records = observations.dedupe_observations(observations.observation_records(
        members.where("member_count = 1"), members.where("member_count > 1")))
    return records, members


def failure_trends(events: DataFrame, now_ns: int) -> DataFrame:
    """Which tool failures recur enough this week to act on."""
    records = observations.observation_records(detectors.tool_failure(events), None)
    return observations.trend_states(
        records, records.select("fingerprint").where("false"), now_ns, key="fingerprint")


def utc_session(spark: SparkSession) -> None:
    """Calendar expressions here assume a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
