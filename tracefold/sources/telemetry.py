"""Scans of raw telemetry tables, batch or streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators.ordering import salted_join

_STR, _NUM, _BOOL = (T.MapType(T.StringType(), t()) for t in (
    T.StringType, T.DoubleType, T.BooleanType))


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


RAW_LOGS = _schema(
    ("timestamp_ns", T.LongType()), ("id", T.StringType()), ("trace_id", T.StringType()),
    ("span_id", T.StringType()), ("attributes_string", _STR), ("attributes_number", _NUM),
    ("attributes_bool", _BOOL), ("resource", _STR), ("ts_bucket_start", T.LongType()))
RAW_SPANS = _schema(
    ("timestamp_ns", T.LongType()), ("trace_id", T.StringType()), ("name", T.StringType()),
    ("serviceName", T.StringType()), ("attributes_string", _STR), ("attributes_number", _NUM),
    ("ts_bucket_start", T.LongType()))


def attribute(key: str) -> Column:
    """Text attribute; a missing key and an empty value are both null."""
    return C.blank_to_null(F.col("attributes_string")[key])


def whole_number(key: str) -> Column:
    return F.col("attributes_number")[key].cast("bigint")


def time_range(df: DataFrame, start_ns: int, end_ns: int, closed: bool = False) -> DataFrame:
    """Exact ns range plus the coarse bucket range that prunes partitions."""
    ns, bucket = F.col("timestamp_ns"), F.col("ts_bucket_start")
    lower = ns >= start_ns if closed else ns > start_ns
    first = max(0, start_ns // K.NS_PER_SECOND - K.BUCKET_SLACK_SECONDS)
    return df.where(lower & (ns <= end_ns) & bucket.between(first, end_ns // K.NS_PER_SECOND))


def scan_logs(raw: DataFrame, start_ns: int, end_ns: int,
              services: tuple[str, ...] = K.SOURCE_SERVICES) -> DataFrame:
    """Log rows in (start, end] with the allowlisted attributes as flat columns."""
    return time_range(raw, start_ns, end_ns).where(
        F.col("resource")["service.name"].isin(*services)).select(*log_columns())


def log_columns() -> list[Column]:
    text = {"event_name": "event.name", "conversation_id": "conversation.id",
            "call_id": "call_id", "tool_name": "tool_name", "success_string": "success"}
    after = {"decision": "decision", "decision_source": "source"}
    numbers = {"input_tokens": "input_token_count", "output_tokens": "output_token_count",
               "reasoning_tokens": "reasoning_token_count", "prompt_length": "prompt_length"}
    return [
        F.col("timestamp_ns"), F.col("id"), F.col("trace_id"), F.col("span_id"),
        *(attribute(k).alias(n) for n, k in text.items()),
        F.col("attributes_bool")["success"].alias("success_bool"),
        F.col("attributes_string")["duration_ms"].alias("duration_ms"),
        whole_number("http.response.status_code").alias("status_code"),
        *(attribute(k).alias(n) for n, k in after.items()),
        *(whole_number(k).alias(n) for n, k in numbers.items()),
    ]


def _earliest(key: str) -> Column:
    value = attribute(key)
    return F.min_by(value, F.when(value.isNotNull(), F.struct("timestamp_ns", value)))


def scan_traces(raw: DataFrame, start_ns: int, end_ns: int,
                services: tuple[str, ...] = K.SOURCE_SERVICES) -> DataFrame:
    """Per-trace rollup of the spans in [start, end]."""
    usage = "codex.usage.total_tokens"
    wanted = (
        F.col("name").isin(*K.TURN_SPAN_NAMES)
        | F.map_contains_key("attributes_number", usage)
        | F.map_contains_key("attributes_string", "tool_name"))
    spans = time_range(raw, start_ns, end_ns, closed=True).where(
        F.col("serviceName").isin(*services) & wanted)
    return spans.groupBy("trace_id").agg(
        F.coalesce(_earliest("turn.id"), _earliest("turn_id")).alias("turn_id"),
        _earliest("thread.id").alias("thread_id"), _earliest("cwd").alias("cwd"),
        F.min("timestamp_ns").alias("started_at_ns"), F.max("timestamp_ns").alias("ended_at_ns"),
        F.coalesce(F.sum(F.col("attributes_number")[usage]), F.lit(0.0)).cast("bigint")
        .alias("total_tokens"),
        F.count_if(attribute("tool_name").isNotNull()).alias("tool_calls"))


def hydrate(raw: DataFrame, shortlist: DataFrame, start_ns: int, end_ns: int,
            kind: str = "log_id", services: tuple[str, ...] = K.SOURCE_SERVICES) -> DataFrame:
    """Raw fields of the rows whose ``kind`` identifier is on the shortlist."""
    if kind not in ("log_id", "trace_id", "call_id"):
        raise ValueError(f"unknown hydration key: {kind}")
    text = {"event_name": "event.name", "call_id": "call_id", "tool_name": "tool_name",
            "arguments": "arguments", "args": "args", "argv": "argv",
            "assistant_output": "output", "error_message": "error.message",
            "outcome": "outcome", "diagnostic_code": "diagnostic_code",
            "success_string": "success"}
    rows = time_range(raw, start_ns, end_ns).where(
        F.col("resource")["service.name"].isin(*services)
    ).select(
        "timestamp_ns", F.col("id").alias("log_id"), "trace_id", "span_id",
        *(attribute(k).alias(n) for n, k in text.items()),
        F.col("attributes_bool")["success"].alias("success_bool"),
        whole_number("http.response.status_code").alias("status_code"),
        whole_number("exit_code").alias("exit_code"))
    wanted = shortlist.select(kind).where(F.col(kind) != "").distinct()
    return rows.join(wanted, kind, "left_semi").select(*rows.columns)


def with_window_bounds(state: DataFrame, watermark: str = "watermark_ns",
                       end: str = "end_ns") -> DataFrame:
    """Scan bounds per row: from the watermark, else seven days before the end."""
    w, e = F.col(watermark), F.col(end)
    week = K.TREND_WINDOW_DAYS * K.NS_PER_DAY
    start = F.coalesce(w, F.greatest(F.lit(0), e - week))
    start = F.when(start >= e, F.greatest(F.lit(0), e - 1)).otherwise(start)
    return state.withColumn("start_ns", start.cast("bigint")).withColumns({
        "start_bucket": F.greatest(F.lit(0), C.floor_div(F.col("start_ns"), K.NS_PER_SECOND)
                                   - K.BUCKET_SLACK_SECONDS).cast("bigint"),
        "end_bucket": C.floor_div(e, K.NS_PER_SECOND),
    })


SESSION_FIELDS = ("assistant_output", "call_id", "sequence", "tool_name", "turn_id")


def session_enrichment(sessions: DataFrame, candidates: DataFrame,
                       order: str = "sequence") -> DataFrame:
    """Attach the session lines of each candidate's task, redacted.

    ``candidates`` holds candidate_id, task_id, trace_id, turn_id. Lines match on the
    task and, when a trace is given, on the trace or else on the turn. Documents are
    built once per distinct selector, and only where they fit the scanner limit, so
    no oversized list is ever collected.
    """
    lines = sessions.select(
        F.coalesce(C.blank_to_null(F.col("thread_id")), F.col("conversation_id")).alias("task"),
        F.col("trace_id").alias("line_trace"), F.col("turn_id").alias("line_turn"),
        F.col(order).alias("position"), F.xxhash64(*sessions.columns).alias("line_key"),
        F.to_json(F.struct(*SESSION_FIELDS)).alias("line"))
    turn = F.when(F.col("trace_id").isNotNull(), F.col("turn_id"))
    keyed = candidates.withColumn("selector", F.sha2(F.to_json(F.struct(
        F.col("task_id").alias("task"), "trace_id", turn.alias("turn"))), 256))
    selectors = keyed.select("selector", F.col("task_id").alias("task"), "trace_id",
                             turn.alias("turn")).distinct()
    body, salt = ["selector", "position", "line_key", "line"], F.col("line_key")
    traced = selectors.where("trace_id is not null")
    whole = salted_join(lines, selectors.where("trace_id is null").select("selector", "task"),
                        ["task"], salt, "inner").select(*body)
    by_trace = salted_join(lines.withColumn("trace_id", F.col("line_trace")), traced,
                           ["task", "trace_id"], salt, "inner").select(*body)
    by_turn = salted_join(lines.withColumn("turn", F.col("line_turn")), traced,
                          ["task", "turn"], salt, "inner").where(
        ~F.col("line_trace").eqNullSafe(F.col("trace_id"))).select(*body)
    matched = whole.unionByName(by_trace).unionByName(by_turn)
    wrapper = len('{"events":[]}') - 1
    sizes = matched.groupBy("selector").agg(
        (F.sum(F.length("line") + 1) + wrapper).alias("characters"))
    fits = F.col("characters") <= K.EVIDENCE_CHARACTER_LIMIT
    small = matched.join(sizes.where(fits).select("selector"), "selector").groupBy(
        "selector").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("position", "line_key", "line"))),
            lambda x: x["line"]), ",").alias("joined"))
    documents = sizes.join(small, "selector", "left").select(
        "selector", F.lit(True).alias("found"),
        C.redact(F.concat(F.lit('{"events":['), "joined", F.lit("]}"))).alias("content"))
    joined = salted_join(keyed, documents, ["selector"], F.col("candidate_id"))
    status = (
        F.when(F.col("found").isNull(), F.lit("pending"))
        .when(F.col("content").isNull(), F.lit("quarantined")).otherwise(F.lit("correlated")))
    return joined.select(
        *candidates.columns, status.alias("correlation_status"),
        F.col("content").alias("redacted_content"),
        F.sha2(F.coalesce("content", status), 256).alias("content_hash"))
