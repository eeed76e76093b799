"""Strict typing of scanned rows.

Each parser adds ``reject_reason`` (null for a good row). ``accepted``/``rejected``
split on it; ``enforced`` is the fail-closed policy that stops the job instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import columns as C


def _first_reason(*checks: tuple[Column, str]) -> Column:
    chain = None
    for bad, reason in checks:
        chain = F.when(bad, F.lit(reason)) if chain is None else chain.when(bad, F.lit(reason))
    return chain


def _blank_all(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    return {c: C.blank_to_null(F.col(c)) for c in columns if c in df.columns}


_LOG_TEXT = ["trace_id", "span_id", "conversation_id", "call_id", "tool_name",
             "success_string", "decision", "decision_source"]
_HYDRATION_TEXT = ["trace_id", "span_id", "call_id", "tool_name", "arguments", "args", "argv",
                   "assistant_output", "error_message", "outcome", "diagnostic_code",
                   "success_string"]


def parse_logs(raw: DataFrame) -> DataFrame:
    ns, log_id = F.col("timestamp_ns"), C.blank_to_null(F.col("id"))
    reason = _first_reason(
        (ns.isNull() | (ns < 0), "timestamp must be an unsigned integer"),
        (log_id.isNull(), "id is required"),
        (C.duration_rejected(F.col("duration_ms")),
         "duration_ms must be a non-negative decimal string"))
    return raw.withColumns({
        "reject_reason": reason, "id": log_id,
        "event_name": F.coalesce("event_name", F.lit("")),
        "duration_ms": C.parse_duration_ms(F.col("duration_ms")),
        **_blank_all(raw, _LOG_TEXT),
    }).withColumnRenamed("id", "log_id")


def parse_traces(raw: DataFrame) -> DataFrame:
    started, ended = F.col("started_at_ns"), F.col("ended_at_ns")
    counters = [F.col("total_tokens"), F.col("tool_calls")]
    bad_counter = [c.isNull() | (c < 0) for c in counters]
    reason = _first_reason(
        (C.blank_to_null(F.col("trace_id")).isNull(), "trace_id is required"),
        (started.isNull() | ended.isNull(), "trace timestamps must be present"),
        (ended < started, "trace timestamps must be ordered"),
        (bad_counter[0] | bad_counter[1], "trace counters must be non-negative integers"))
    return raw.withColumns({
        "reject_reason": reason,
        **_blank_all(raw, ["trace_id", "turn_id", "thread_id", "cwd"])})


def parse_hydration(raw: DataFrame) -> DataFrame:
    ns = F.col("timestamp_ns")
    reason = _first_reason(
        (ns.isNull() | (ns < 0) | C.blank_to_null(F.col("log_id")).isNull(),
         "hydration timestamp and id are required"))
    return raw.withColumns({
        "reject_reason": reason, "event_name": F.coalesce("event_name", F.lit("")),
        **_blank_all(raw, _HYDRATION_TEXT)})


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason is null").drop("reject_reason")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason is not null")


def enforced(parsed: DataFrame) -> DataFrame:
    """All rows, failing at run time on the first rejected one."""
    checked = F.when(F.col("reject_reason").isNull(), F.lit(True)).otherwise(
        F.raise_error(F.col("reject_reason")).cast("boolean"))
    return parsed.where(checked).drop("reject_reason")
