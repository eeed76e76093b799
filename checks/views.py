"""Adapter views: the given tables in the shapes the operators read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators.ordering import hot_keys
from tracefold.plans import scan
from tracefold.sources.sinks import new_path, stored

NOW_NS = 1_706_659_200_000_000_000  # 2024-01-31 00:00:00 UTC
START_NS = 1_703_980_800_000_000_000  # 2023-12-31 00:00:00 UTC
_SECOND = K.NS_PER_SECOND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan.utc_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(col: str) -> Column:
    return C.ns_of(F.col(col).cast("timestamp"))


def ev(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """events with ns time and the parsed integer ``k``, dealt into ``parts`` if given."""
    rows = table(spark, sf_dir, "events")
    return (rows if parts is None else rows.repartition(parts, "event_id")).select(
        "event_id", ns("ts").alias("timestamp_ns"), "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _pad(col: Column) -> Column:
    return F.lpad(col.cast("string"), 10, "0")


def _trace_id() -> Column:
    return F.concat(F.lit("tr-"), F.col("user_id").cast("string"), F.lit("-"),
                    F.date_format(C.timestamp_of(F.col("timestamp_ns")), "yyyyMMdd"))


def _day() -> Column:
    return F.dayofmonth(C.timestamp_of(F.col("timestamp_ns")))


def _thread() -> Column:
    user = F.col("user_id").cast("string")
    return F.when(_day() % 5 == 0, F.lit(None)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("th-"), user)).when(
        F.col("user_id") % 3 == 2,
        F.concat(F.lit("th-"), user, F.lit("-"), (_day() % 2).cast("string")))


def _cwd() -> Column:
    return F.when(F.col("user_id") % 7 != 0, F.concat(
        F.lit("/work/p"), (F.col("user_id") % 6).cast("string"), F.lit("/src")))


def _map(pairs: dict[str, Column], kind: str) -> Column:
    entries = F.filter(
        F.array(*(F.struct(F.lit(k).alias("key"), v.cast(kind).alias("value"))
                  for k, v in pairs.items())), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


def raw_logs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k")
    tool_event = kind.isin("error", "purchase")
    patch = (kind == "purchase") & (k % 4 == 0)
    exe = F.element_at(F.array(*map(F.lit, ("pytest", "ruff", "rg", "sed", "git"))),
                       (k % 5 + 1).cast("int"))
    target = F.concat(F.lit("src/m"), (k % 3).cast("string"), F.lit(".py"))
    words = F.when(exe == "ruff", F.lit('"ruff","check",')).when(
        exe == "git", F.lit('"git","status",')).otherwise(F.concat(F.lit('"'), exe, F.lit('",')))
    arguments = F.when(patch, F.concat(F.lit('{"path":"'), target, F.lit('"}'))).when(
        tool_event, F.concat(F.lit('{"cmd":['), words, F.lit('"'), target, F.lit('"]}')))
    name = (
        F.when(tool_event, F.lit("codex.tool_result"))
        .when(kind == "click", F.lit("codex.api_request"))
        .when(kind == "view", F.lit("codex.tool_decision"))
        .otherwise(F.lit("codex.sandbox_outcome")))
    duration = F.when(k == 1, F.lit("01")).when(k == 2, F.lit("1e3")).when(
        k == 3, F.lit("10ms")).otherwise(F.col("value").cast("string"))
    text = {
        "event.name": name,
        "conversation.id": F.when(F.col("user_id") % 4 != 0, F.concat(
            F.lit("cv-"), F.col("user_id").cast("string"))),
        "call_id": F.when(tool_event, F.concat(F.lit("call-"), _pad(F.col("event_id")))),
        "tool_name": F.when(patch, F.lit("apply_patch")).when(
            tool_event, F.lit("exec_command")),
        "success": F.when(kind == "error", F.lit("false")).when(
            kind == "purchase", F.lit("true")),
        "duration_ms": duration,
        "decision": F.when(kind == "view", F.when(k < 50, F.lit("approved")).otherwise(
            F.lit("denied"))),
        "source": F.when(kind == "view", F.when(k % 2 == 0, F.lit("user")).otherwise(
            F.lit("config"))),
        "outcome": F.when(kind == "signup", F.when(k < 30, F.lit("denied")).when(
            k < 60, F.lit(""))),
        "arguments": arguments,
        "output": F.when(kind == "error", F.concat(
            F.lit("failed token=abc"), k.cast("string"), F.lit(" end"))),
    }
    status = F.when(kind == "click", F.when(k >= 90, 503).when(k >= 80, 429).when(k >= 60, 200))
    exit_code = F.when(kind == "error", 1).when((kind == "purchase") & ~patch, 0)
    numbers = {"http.response.status_code": status, "exit_code": exit_code,
               "prompt_length": F.when(kind == "click", k)}
    success = F.when(kind == "click", F.when(k < 10, F.lit(False)).when(k < 60, F.lit(True)))
    return ev(spark, sf_dir, parts).select(
        "timestamp_ns", F.concat(F.lit("log-"), _pad(F.col("event_id"))).alias("id"),
        _trace_id().alias("trace_id"), F.lit(None).cast("string").alias("span_id"),
        _map(text, "string").alias("attributes_string"),
        _map(numbers, "double").alias("attributes_number"),
        _map({"success": success}, "boolean").alias("attributes_bool"),
        F.create_map(F.lit("service.name"), F.when(F.col("event_id") % 50 == 49, F.lit("other"))
                     .otherwise(F.lit("codex_cli_rs"))).alias("resource"),
        (C.floor_div(F.col("timestamp_ns"), 1800 * _SECOND) * 1800).alias("ts_bucket_start"))


def raw_spans(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "signup", F.lit("session_task.turn"))
        .when(kind == "view", F.lit("turn/steer"))
        .when(kind == "click", F.lit("run_sampling_request"))
        .when(kind == "error", F.lit("tool.call")).otherwise(F.lit("usage")))
    text = {"thread.id": _thread(), "cwd": _cwd(),
            "turn_id": F.concat(F.lit("turn-"), F.col("event_id").cast("string")),
            "tool_name": F.when(kind == "error", F.lit("exec_command"))}
    tokens = F.when(kind == "purchase", F.floor(F.col("value") * 100))
    return ev(spark, sf_dir, parts).select(
        "timestamp_ns", _trace_id().alias("trace_id"), name.alias("name"),
        F.lit("codex_cli_rs").alias("serviceName"),
        _map(text, "string").alias("attributes_string"),
        _map({"codex.usage.total_tokens": tokens}, "double").alias("attributes_number"),
        (C.floor_div(F.col("timestamp_ns"), 1800 * _SECOND) * 1800).alias("ts_bucket_start"))


def project_roots(spark: SparkSession) -> DataFrame:
    """Six project roots and the folder above them, to test the longest prefix."""
    projects = spark.range(6).select(
        F.concat(F.lit("/work/p"), F.col("id").cast("string")).alias("root"),
        F.lit("git").alias("kind"))
    return projects.unionByName(spark.range(1).select(
        F.lit("/work").alias("root"), F.lit("non_git").alias("kind")))


def skill_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional facts a caller may supply: required and used skills."""
    k = F.col("k")
    return ev(spark, sf_dir).where(k % 20 == 0).select(
        F.concat(F.lit("log-"), _pad(F.col("event_id"))).alias("event_id"),
        F.lit("review").alias("skill_required"),
        F.when(k != 0, k < 50).alias("skill_used"))


_STORED: dict[tuple[str, str, str], DataFrame] = {}
_PATHS: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str,
         build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Write a shared input once per session and given folder; read it afterwards."""
    scan.utc_session(spark)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _PATHS[key] = new_path(spark, name)
        _STORED[key] = stored(build(spark, sf_dir), name, _PATHS[key])
    return _STORED[key]


def folder(spark: SparkSession, sf_dir: str, name: str,
           build: Callable[[SparkSession, str], DataFrame]) -> str:
    """Folder of a shared input, for reading it as a stream."""
    once(spark, sf_dir, name, build)
    return _PATHS[(spark.sparkContext.applicationId, sf_dir, name)]


def _in_files(build: Callable[[SparkSession, str, int], DataFrame]):
    """Write an input as several files, as a lake would hold it. The narrow rows are dealt, not
    the maps built from them."""
    return lambda s, d: build(s, d, s.sparkContext.defaultParallelism)


def logs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "raw_logs", _in_files(raw_logs))


def spans_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "raw_spans", _in_files(raw_spans))


def events_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_events(logs_table(spark, sf_dir), spans_table(spark, sf_dir),
                            project_roots(spark), START_NS, NOW_NS,
                            extras=skill_facts(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector events, written once and read by every detector."""
    return once(spark, sf_dir, "events", events_plan)


def typed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.operators import validate
    from tracefold.sources import telemetry

    return validate.accepted(validate.parse_logs(telemetry.scan_logs(
        logs_table(spark, sf_dir), START_NS, NOW_NS)))


def typed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracefold.operators import validate
    from tracefold.sources import telemetry

    return validate.accepted(validate.parse_traces(telemetry.scan_traces(
        spans_table(spark, sf_dir), START_NS, NOW_NS)))


def placed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "placed_traces", lambda s, d: scan.place_traces(
        once(s, d, "traces", typed_traces), project_roots(s)))


def linked_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed logs with their trace's thread and project, as the scan stores them."""
    return once(spark, sf_dir, "linked_logs", lambda s, d: scan.link_logs(
        typed_logs(s, d), placed_traces(s, d), hot_keys(logs_table(s, d), ["trace_id"])))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
