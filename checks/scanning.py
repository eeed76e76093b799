"""Scans, typing, normalisation and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.prelude import EVENT_CTES, LOG_CTES, REDACT, sql
from checks.registry import query
from checks.tables import RUNS_SQL, runs
from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators import identity, normalise, validate
from tracefold.plans import scan
from tracefold.sources import contract, telemetry

_LOG_FIELDS = """timestamp_ns, log_id AS {id}, trace_id, CAST(NULL AS VARCHAR) AS span_id,
  event_name, conversation_id, call_id, tool_name, success_string, success_bool, {duration},
  status_code, decision, decision_source, CAST(NULL AS BIGINT) AS input_tokens,
  CAST(NULL AS BIGINT) AS output_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens,
  prompt_length"""


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.scan_logs(views.logs_table(spark, sf_dir), views.START_NS, views.NOW_NS)


@query("scan_logs", sql("SELECT " + _LOG_FIELDS.format(
    id="id", duration="duration_text AS duration_ms") + " FROM scanned"))
def scan_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir)


@query("scan_traces", sql("SELECT * FROM traces"))
def scan_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.scan_traces(views.spans_table(spark, sf_dir), views.START_NS, views.NOW_NS)


_HYDRATION = """SELECT timestamp_ns, log_id, trace_id, CAST(NULL AS VARCHAR) AS span_id,
  event_name, call_id, tool_name, arguments, CAST(NULL AS VARCHAR) AS args,
  CAST(NULL AS VARCHAR) AS argv, output AS assistant_output,
  CAST(NULL AS VARCHAR) AS error_message, raw_outcome AS outcome,
  CAST(NULL AS VARCHAR) AS diagnostic_code, success_string, success_bool, status_code, exit_code
FROM scanned """


def _hydrate(spark: SparkSession, sf_dir: str, ids: DataFrame, kind: str) -> DataFrame:
    return telemetry.hydrate(views.logs_table(spark, sf_dir), ids, views.START_NS, views.NOW_NS,
                             kind)


@query("shortlist", sql("SELECT log_id FROM hydrated WHERE listed", EVENT_CTES))
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.shortlist(views.linked_logs(spark, sf_dir))


@query("hydrate_by_log", sql(
    _HYDRATION + "WHERE log_id IN (SELECT log_id FROM hydrated WHERE listed)", EVENT_CTES))
def hydrate_by_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hydrate(spark, sf_dir, shortlist(spark, sf_dir), "log_id")


@query("hydrate_by_trace", sql(
    _HYDRATION + "WHERE trace_id IN (SELECT trace_id FROM traces WHERE tool_calls >= 2)"))
def hydrate_by_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hydrate(spark, sf_dir, scan_traces(spark, sf_dir).where("tool_calls >= 2"),
                    "trace_id")


@query("hydrate_by_call", sql(
    _HYDRATION + "WHERE call_id IN (SELECT call_id FROM logs WHERE success_string = 'false')"))
def hydrate_by_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = views.typed_logs(spark, sf_dir).where("success_string = 'false'")
    return _hydrate(spark, sf_dir, failed, "call_id")


@query("window_bounds", f"""WITH {RUNS_SQL}, b AS (
  SELECT id, started_ns AS end_ns, CASE sequence % 3 WHEN 0 THEN NULL
    WHEN 1 THEN started_ns - 3600000000000 ELSE started_ns + 5 END AS watermark_ns FROM runs),
s AS (SELECT *, CASE WHEN coalesce(watermark_ns, end_ns - 604800000000000) >= end_ns
    THEN end_ns - 1 ELSE coalesce(watermark_ns, end_ns - 604800000000000) END AS start_ns FROM b)
SELECT *, start_ns // 1000000000 - 1800 AS start_bucket, end_ns // 1000000000 AS end_bucket
FROM s""")
def window_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, third = F.col("started_ns"), F.col("sequence") % 3
    state = runs(spark, sf_dir).select(
        "id", start.alias("end_ns"),
        F.when(third == 1, start - 3600 * K.NS_PER_SECOND).when(third == 2, start + 5)
        .alias("watermark_ns"))
    return telemetry.with_window_bounds(state)


_SESSION_LINES = """
lines AS (
  SELECT CAST(conv_id AS VARCHAR) AS task, 'st-' || conv_id || '-' || (turn % 2) AS line_trace,
    'turn-' || turn AS line_turn, turn, '{"assistant_output":' || CAST(to_json(text) AS VARCHAR)
    || ',"sequence":' || turn || ',"turn_id":"turn-' || turn || '"}' AS line FROM conversations),
cand AS (
  SELECT 'c' || conv_id || '-' || turn AS candidate_id,
    CAST(conv_id AS VARCHAR) || CASE WHEN turn = 5 THEN 'x' ELSE '' END AS task_id,
    CASE turn % 3 WHEN 1 THEN 'st-' || conv_id || '-1' WHEN 2 THEN 'none' END AS trace_id,
    'turn-' || turn AS turn_id FROM conversations),
docs AS (
  SELECT c.candidate_id, '{"events":[' || string_agg(l.line, ',' ORDER BY l.turn) || ']}' AS doc
  FROM cand c JOIN lines l ON l.task = c.task_id AND (c.trace_id IS NULL
    OR l.line_trace = c.trace_id OR l.line_turn = c.turn_id)
  GROUP BY c.candidate_id)"""

@query("session_enrichment", f"""WITH {_SESSION_LINES}
SELECT c.*, CASE WHEN d.doc IS NULL THEN 'pending' ELSE 'correlated' END AS correlation_status,
  {REDACT.format(c="d.doc")} AS redacted_content,
  sha256(coalesce({REDACT.format(c="d.doc")}, 'pending')) AS content_hash
FROM cand c LEFT JOIN docs d USING (candidate_id)""")
def session_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id").cast("string")
    turn = F.concat(F.lit("turn-"), F.col("turn").cast("string"))
    base = views.table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    sessions = base.select(
        F.when(F.col("conv_id") % 4 != 0, conv).alias("thread_id"),
        conv.alias("conversation_id"),
        F.concat(F.lit("st-"), conv, F.lit("-"), (F.col("turn") % 2).cast("string"))
        .alias("trace_id"), turn.alias("turn_id"), F.col("text").alias("assistant_output"),
        none.alias("tool_name"), none.alias("call_id"), F.col("turn").alias("sequence"))
    third = F.col("turn") % 3
    candidates = base.select(
        F.concat(F.lit("c"), conv, F.lit("-"), F.col("turn").cast("string"))
        .alias("candidate_id"),
        F.concat(conv, F.when(F.col("turn") == 5, F.lit("x")).otherwise(F.lit("")))
        .alias("task_id"),
        F.when(third == 1, F.concat(F.lit("st-"), conv, F.lit("-1"))).when(
            third == 2, F.lit("none")).alias("trace_id"), turn.alias("turn_id"))
    return telemetry.session_enrichment(sessions, candidates)


_INVENTORY = LOG_CTES + """
recent AS (SELECT * FROM shaped WHERE service = 'codex_cli_rs'
  AND ts_bucket_start >= 1706659200 - 15 * 86400),
spans AS (SELECT * FROM shaped WHERE timestamp_ns >= 1705363200000000000),
inventory AS (
  SELECT DISTINCT 'logs' AS source, 'event_name' AS field, CASE WHEN is_tool
    THEN 'codex.tool_result' WHEN event_type = 'click' THEN 'codex.api_request'
    WHEN event_type = 'view' THEN 'codex.tool_decision' ELSE 'codex.sandbox_outcome' END AS name
  FROM recent
  UNION SELECT 'spans', 'event_name', CASE event_type WHEN 'signup' THEN 'session_task.turn'
    WHEN 'view' THEN 'turn/steer' WHEN 'click' THEN 'run_sampling_request'
    WHEN 'error' THEN 'tool.call' ELSE 'usage' END FROM spans
  UNION SELECT 'logs', 'attributes_string', unnest(['event.name', 'duration_ms']) FROM recent
  UNION SELECT 'logs', 'attributes_string', 'conversation.id' FROM recent WHERE user_id % 4 <> 0
  UNION SELECT 'logs', 'attributes_string', unnest(['call_id', 'tool_name', 'success',
    'arguments']) FROM recent WHERE is_tool
  UNION SELECT 'logs', 'attributes_string', unnest(['decision', 'source']) FROM recent
    WHERE event_type = 'view'
  UNION SELECT 'logs', 'attributes_string', 'outcome' FROM recent
    WHERE event_type = 'signup' AND k < 60
  UNION SELECT 'logs', 'attributes_string', 'output' FROM recent WHERE event_type = 'error'
  UNION SELECT 'logs', 'attributes_number', 'prompt_length' FROM recent
    WHERE event_type = 'click'
  UNION SELECT 'logs', 'attributes_number', 'http.response.status_code' FROM recent
    WHERE event_type = 'click' AND k >= 60
  UNION SELECT 'logs', 'attributes_number', 'exit_code' FROM recent
    WHERE event_type = 'error' OR (event_type = 'purchase' AND NOT is_patch)
  UNION SELECT 'logs', 'attributes_bool', 'success' FROM recent
    WHERE event_type = 'click' AND k < 60
  UNION SELECT 'spans', 'attributes_string', 'turn_id' FROM spans
  UNION SELECT 'spans', 'attributes_string', 'thread.id' FROM spans WHERE thread IS NOT NULL
  UNION SELECT 'spans', 'attributes_string', 'cwd' FROM spans WHERE cwd IS NOT NULL
  UNION SELECT 'spans', 'attributes_string', 'tool_name' FROM spans WHERE event_type = 'error'
  UNION SELECT 'spans', 'attributes_number', 'codex.usage.total_tokens' FROM spans
    WHERE event_type = 'purchase'),
"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.schema_inventory(views.logs_table(spark, sf_dir),
                                     views.spans_table(spark, sf_dir), views.NOW_NS)


@query("schema_inventory", sql("""SELECT source, field, string_agg(name, ',' ORDER BY name)
  AS names FROM inventory GROUP BY source, field""", _INVENTORY))
def schema_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract.inventory_lists(_inventory(spark, sf_dir)).withColumn(
        "names", F.array_join("names", ","))


@query("contract_check", sql("""SELECT * FROM (VALUES ('logs', 'attributes_string', 'call_id'),
    ('logs', 'attributes_string', 'diagnostic_code'), ('spans', 'attributes_string', 'turn.id'))
  AS r(source, field, name) ANTI JOIN inventory USING (source, field, name)""", _INVENTORY))
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame(
        [("logs", "attributes_string", "call_id"),
         ("logs", "attributes_string", "diagnostic_code"),
         ("spans", "attributes_string", "turn.id")], "source string, field string, name string")
    return contract.contract_check(_inventory(spark, sf_dir), required,
                                   ("source", "field", "name"))


_NEEDED = [("logs", "attributes_string", "call_id"), ("logs", "attributes_string", "event.name"),
           ("spans", "attributes_string", "thread.id"), ("spans", "attributes_string", "nope")]


@query("contract_fingerprint", sql(f"""SELECT sha256(CAST(to_json(list({{source: source,
    field: field, name: name}} ORDER BY source, field, name)) AS VARCHAR)) AS fingerprint
  FROM inventory WHERE (source, field, name) IN ({", ".join(map(str, _NEEDED))})""", _INVENTORY))
def contract_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame(_NEEDED, "source string, field string, name string")
    return contract.contract_fingerprint(_inventory(spark, sf_dir), required,
                                         ("source", "field", "name"))


@query("contract_stop", sql(f"""SELECT name FROM inventory
  WHERE source = 'logs' AND field = 'event_name' AND name <> 'codex.tool_result'""", _INVENTORY))
def contract_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event names stand for fingerprints; one of them is approved, one approval is withdrawn."""
    names = _inventory(spark, sf_dir).where("source = 'logs' and field = 'event_name'")
    approvals = spark.createDataFrame(
        [("codex.tool_result", 1), ("codex.api_request", None)], "fingerprint string, at int")
    return contract.unapproved(
        names.select(F.col("name").alias("fingerprint")),
        approvals.withColumn("approved_at", F.timestamp_seconds("at"))).select(
        F.col("fingerprint").alias("name"))


@query("parse_logs", sql("SELECT " + _LOG_FIELDS.format(
    id="log_id", duration="""CASE WHEN k NOT IN (1, 2, 3) THEN CAST(duration_text AS DOUBLE) END
    AS duration_ms, CASE WHEN k IN (1, 2, 3)
    THEN 'duration_ms must be a non-negative decimal string' END AS reject_reason""")
    + " FROM scanned"))
def parse_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.parse_logs(_scanned(spark, sf_dir))


@query("rejected_logs", sql("""SELECT reject_reason, count(*) AS n FROM (
  SELECT 'duration_ms must be a non-negative decimal string' AS reject_reason FROM scanned
  WHERE k IN (1, 2, 3)) GROUP BY reject_reason"""))
def rejected_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rejected(parse_logs(spark, sf_dir)).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("n"))


@query("run_rejects", sql("""SELECT source, row_id, reject_reason FROM (
  SELECT 'logs' AS source, log_id AS row_id,
    'duration_ms must be a non-negative decimal string' AS reject_reason
  FROM scanned WHERE k IN (1, 2, 3))"""))
def run_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_window(
        views.logs_table(spark, sf_dir), views.spans_table(spark, sf_dir),
        views.project_roots(spark), views.START_NS, views.NOW_NS)[3]


_BROKEN_TRACES = """broken AS (
  SELECT * REPLACE (CASE WHEN tool_calls = 3 THEN '' ELSE trace_id END AS trace_id,
    CASE WHEN total_tokens % 7 = 3 THEN started_at_ns - 1 ELSE ended_at_ns END AS ended_at_ns,
    CASE WHEN total_tokens % 11 = 5 THEN -1 ELSE tool_calls END AS tool_calls) FROM traces),"""


@query("parse_traces", sql("""SELECT * REPLACE (nullif(trace_id, '') AS trace_id),
  CASE WHEN trace_id = '' THEN 'trace_id is required'
    WHEN ended_at_ns < started_at_ns THEN 'trace timestamps must be ordered'
    WHEN tool_calls < 0 THEN 'trace counters must be non-negative integers' END AS reject_reason
  FROM broken""", LOG_CTES + _BROKEN_TRACES))
def parse_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, calls = F.col("total_tokens"), F.col("tool_calls")
    broken = scan_traces(spark, sf_dir).select(
        F.when(calls == 3, F.lit("")).otherwise(F.col("trace_id")).alias("trace_id"),
        "turn_id", "thread_id", "cwd", "started_at_ns",
        F.when(tokens % 7 == 3, F.col("started_at_ns") - 1).otherwise(F.col("ended_at_ns"))
        .alias("ended_at_ns"), "total_tokens",
        F.when(tokens % 11 == 5, F.lit(-1)).otherwise(calls).cast("bigint").alias("tool_calls"))
    return validate.parse_traces(broken)


@query("parse_hydration", sql("""SELECT log_id, event_name, arguments, outcome, reject_reason
  FROM (SELECT CASE WHEN k = 7 THEN NULL ELSE log_id END AS log_id, event_name, arguments,
    raw_outcome AS outcome, CASE WHEN k = 7 THEN 'hydration timestamp and id are required' END
    AS reject_reason FROM scanned)"""))
def parse_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.logs_table(spark, sf_dir)
    rows = telemetry.hydrate(raw, raw.select(F.col("id").alias("log_id")), views.START_NS,
                             views.NOW_NS)
    k7 = views.ev(spark, sf_dir).where("k = 7").select(
        F.concat(F.lit("log-"), F.lpad(F.col("event_id").cast("string"), 10, "0"))
        .alias("log_id"), F.lit(True).alias("bad"))
    broken = rows.join(k7, "log_id", "left").withColumn(
        "log_id", F.when(F.col("bad").isNull(), F.col("log_id")))
    return validate.parse_hydration(broken).select(
        "log_id", "event_name", "arguments", "outcome", "reject_reason")


_DECIMALS = """CASE k % 10 WHEN 0 THEN '0' WHEN 1 THEN '01' WHEN 2 THEN '1e3' WHEN 3 THEN '-1'
  WHEN 4 THEN '' WHEN 5 THEN '7.50' WHEN 6 THEN ' 7' WHEN 7 THEN '.5' WHEN 8 THEN '12'
  ELSE CAST(value AS VARCHAR) END"""


def _decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("0", "01", "1e3", "-1", "", "7.50", " 7", ".5", "12")
    chain = F.col("value").cast("string")
    for i, text in enumerate(texts):
        chain = F.when(F.col("k") % 10 == i, F.lit(text)).otherwise(chain)
    return views.ev(spark, sf_dir).select("event_id", chain.alias("raw"))


@query("parse_duration", f"""WITH {LOG_CTES} d AS (SELECT event_id, {_DECIMALS} AS raw FROM ev)
SELECT event_id, raw, CASE WHEN regexp_full_match(raw, '(0|[1-9][0-9]*)([.][0-9]+)?')
  THEN TRY_CAST(raw AS DOUBLE) END AS parsed,
  raw <> '' AND NOT regexp_full_match(raw, '(0|[1-9][0-9]*)([.][0-9]+)?') AS rejected FROM d""")
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _decimals(spark, sf_dir).select(
        "event_id", "raw", C.parse_duration_ms(raw).alias("parsed"),
        C.duration_rejected(raw).alias("rejected"))


@query("parse_uint", f"""WITH {LOG_CTES} d AS (SELECT event_id, {_DECIMALS} AS raw FROM ev)
SELECT event_id, nullif(raw, '') AS text, CASE WHEN regexp_full_match(raw, '0|[1-9][0-9]*')
  THEN TRY_CAST(raw AS BIGINT) END AS parsed FROM d""")
def parse_uint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decimals(spark, sf_dir).select(
        "event_id", C.blank_to_null(F.col("raw")).alias("text"),
        C.parse_uint(F.col("raw")).alias("parsed"))


@query("event_classes", sql("""SELECT log_id, CASE
    WHEN event_name = 'codex.tool_result' AND success_string = 'false' THEN 'tool_result_false'
    WHEN event_name = 'codex.api_request' AND success_bool = false THEN 'transport_success_false'
    WHEN event_name = 'codex.api_request' AND status_code >= 400
      THEN 'http_' || (status_code // 100) || 'xx' END AS failure_class,
  CASE WHEN decision_source = 'user' THEN 'turn/steer' ELSE event_name END AS outcome_name,
  CASE WHEN decision_source = 'user' THEN decision ELSE 'hydrated' END AS outcome,
  coalesce(tool_name = 'apply_patch', false) AS is_mutation FROM logs"""))
def event_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, source = F.col("event_name"), F.col("decision_source")
    return views.typed_logs(spark, sf_dir).select(
        "log_id", C.tool_failure_class(name, F.col("success_string"), F.col("success_bool"),
                                       F.col("status_code")).alias("failure_class"),
        C.outcome_event_name(name, source).alias("outcome_name"),
        C.outcome_value(name, source, F.col("decision"), F.lit("hydrated")).alias("outcome"),
        C.is_mutation(F.col("tool_name")).alias("is_mutation"))


@query("operation_fields", sql("""SELECT event_id, operation_kind, target_kind,
  normalized_target, coalesce(op_kind = 'shell' AND op_executable IN ('pytest', 'ruff'), false)
    AS is_gate FROM (SELECT *, coalesce(op_kind, 'event') AS operation_kind,
    CASE WHEN op_kind IS NULL THEN 'none' ELSE 'path' END AS target_kind,
    CASE WHEN op_kind IS NULL THEN event_name ELSE op_target END AS normalized_target
    FROM detector_events)""", EVENT_CTES))
def operation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, target, exe = F.col("op_kind"), F.col("op_target"), F.col("op_executable")
    return views.events(spark, sf_dir).select(
        "event_id", C.operation_kind(kind).alias("operation_kind"),
        C.target_kind(kind, target).alias("target_kind"),
        C.operation_target(kind, target, exe, F.col("event_name")).alias("normalized_target"),
        C.is_quality_gate(kind, exe, F.col("is_quality_gate")).alias("is_gate"))


@query("allowlist_fields", sql("""SELECT log_id, CAST(to_json({event_name: event_name,
  outcome: raw_outcome, tool_name: tool_name}) AS VARCHAR) AS fields FROM logs"""))
def allowlist_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = views.typed_logs(spark, sf_dir)
    raw = views.logs_table(spark, sf_dir).select(
        F.col("id").alias("log_id"), telemetry.attribute("outcome").alias("outcome"))
    fields = {c: F.col(c) for c in ("tool_name", "event_name", "outcome")}
    return logs.join(raw, "log_id").select("log_id", C.allowlisted_json(fields).alias("fields"))


# ---- normalisation -----------------------------------------------------------------

@query("mask_volatile", f"""WITH {LOG_CTES} d AS (
  SELECT event_id, CASE WHEN k % 9 = 0 THEN 'nonce' ELSE 'note' END AS key,
    CASE k % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
      WHEN 1 THEN '123e4567-e89b-42d3-a456-' || lpad(CAST(event_id AS VARCHAR), 12, '0')
      WHEN 2 THEN '/tmp/run-' || k WHEN 3 THEN '/tmpx/run' WHEN 4 THEN 'src/./m' || k || '.py:12:3'
      WHEN 5 THEN 'src//m.py:7' ELSE 'plain ' || k END AS raw FROM ev)
SELECT event_id, raw, CASE WHEN key = 'nonce' THEN '<nonce>'
  WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:]{{8}}Z') THEN '<timestamp>'
  WHEN starts_with(raw, '123e') THEN '<generated-id>'
  WHEN starts_with(raw, '/tmp/') THEN '<temporary-path>'
  WHEN ends_with(raw, ':12:3') THEN 'src/m' || regexp_extract(raw, 'm([0-9]+)', 1) || '.py'
  WHEN ends_with(raw, ':7') THEN 'src/m.py' ELSE raw END AS masked FROM d""")
def mask_volatile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, number = F.col("k"), F.col("k").cast("string")
    seventh = k % 7
    raw = (
        F.when(seventh == 0, F.date_format(C.timestamp_of(F.col("timestamp_ns")),
                                           "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(seventh == 1, F.concat(F.lit("123e4567-e89b-42d3-a456-"), F.lpad(
            F.col("event_id").cast("string"), 12, "0")))
        .when(seventh == 2, F.concat(F.lit("/tmp/run-"), number))
        .when(seventh == 3, F.lit("/tmpx/run"))
        .when(seventh == 4, F.concat(F.lit("src/./m"), number, F.lit(".py:12:3")))
        .when(seventh == 5, F.lit("src//m.py:7")).otherwise(F.concat(F.lit("plain "), number)))
    key = F.when(k % 9 == 0, F.lit("nonce")).otherwise(F.lit("note"))
    return views.ev(spark, sf_dir).select("event_id", raw.alias("raw"), key.alias("key")).select(
        "event_id", "raw", C.mask_volatile(F.col("raw"), F.col("key")).alias("masked"))


@query("clean_path", """WITH p AS (
  SELECT page_id, unnest([url, '//' || replace(url, 'https://', '/') || '/./x/',
    './a\\b/.//' || page_id || '/..', '', '///' || page_id]) AS raw FROM pages),
s AS (SELECT page_id, raw, replace(raw, '\\', '/') AS v FROM p)
SELECT page_id, raw, CASE WHEN joined = '' THEN '.' ELSE joined END AS path,
  CASE WHEN regexp_matches(raw, '^(https?|file)://') THEN raw
    WHEN joined = '' THEN '.' ELSE joined END AS target
FROM (SELECT *, CASE WHEN regexp_matches(v, '^//([^/]|$)') THEN '//' WHEN starts_with(v, '/')
    THEN '/' ELSE '' END || array_to_string(list_filter(string_split(v, '/'),
    lambda x: x <> '' AND x <> '.'), '/') AS joined FROM s)""")
def clean_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id").cast("string")
    texts = F.array(
        url, F.concat(F.lit("//"), F.replace(url, F.lit("https://"), F.lit("/")),
                      F.lit("/./x/")),
        F.concat(F.lit("./a\\b/.//"), page, F.lit("/..")), F.lit(""),
        F.concat(F.lit("///"), page))
    rows = views.table(spark, sf_dir, "pages").select("page_id", F.explode(texts).alias("raw"))
    return rows.select("page_id", "raw", C.clean_path(F.col("raw")).alias("path"),
                       C.clean_target(F.col("raw")).alias("target"))


@query("command_extraction", sql("""SELECT log_id, array_to_string(CAST(json_extract(arguments,
  '$.cmd') AS VARCHAR[]), ' ') AS command FROM logs WHERE tool_name = 'exec_command'"""))
def command_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.logs_table(spark, sf_dir).select(
        F.col("id").alias("log_id"), telemetry.attribute("arguments").alias("arguments"))
    calls = views.typed_logs(spark, sf_dir).join(raw, "log_id")
    return calls.where(normalise.is_plain_array(F.col("tool_name"), F.col("arguments"))).select(
        "log_id", F.array_join(normalise.plain_array(F.col("arguments")), " ").alias("command"))


@query("shell_words", f"""WITH {LOG_CTES} d AS (SELECT event_id, k FROM ev)
SELECT event_id, CASE k % 5 WHEN 0 THEN 'git|commit|-m|fix it|src/m' || k || '.py'
    WHEN 1 THEN 'echo|a\\b "c" ' || k WHEN 2 THEN 'rg||x y|' || k WHEN 4 THEN 'ls' || k END
    AS words FROM d""".replace("\\\\", "\\"))
def shell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, escapes and open quotes (null), over all events."""
    k = F.col("k").cast("string")
    texts = (
        F.concat(F.lit('git  commit -m "fix it"\t src/m'), k, F.lit(".py")),
        F.concat(F.lit("echo 'a\\b \"c\" '"), k), F.concat(F.lit("rg '' x\\ y "), k),
        F.concat(F.lit("ls 'open "), k), F.concat(F.lit(" ls"), k, F.lit("\n")))
    text = F.element_at(F.array(*texts), (F.col("k") % 5 + 1).cast("int"))
    return views.ev(spark, sf_dir).select(
        "event_id", F.array_join(normalise.shell_words(text), "|").alias("words"))


@query("positionals", f"""WITH {LOG_CTES} d AS (
  SELECT event_id, CASE k % 4 WHEN 0 THEN '-C' WHEN 1 THEN '-m' WHEN 2 THEN '--short'
    ELSE '--format=x' END AS opt, CASE WHEN k % 3 = 0 THEN '-v' ELSE 'v' || k END AS val FROM ev)
SELECT event_id, opt || ' ' || val AS head, array_to_string(list_filter([
    CASE WHEN opt NOT IN ('-C', '-m') AND val <> '-v' THEN val END, 'status', '-', 'src/a.py'],
    lambda x: x IS NOT NULL), ' ') AS kept FROM d""")
def positionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    opt = F.element_at(F.array(*map(F.lit, ("-C", "-m", "--short", "--format=x"))),
                       (k % 4 + 1).cast("int"))
    val = F.when(k % 3 == 0, F.lit("-v")).otherwise(F.concat(F.lit("v"), k.cast("string")))
    args = F.array(opt, val, *map(F.lit, ("status", "-", "--", "src/a.py")))
    return views.ev(spark, sf_dir).select(
        "event_id", F.concat(opt, F.lit(" "), val).alias("head"),
        F.array_join(normalise.positionals(args, F.lit("git")), " ").alias("kept"))


_CALLS = LOG_CTES + """
calls AS (
  SELECT event_id, k, CASE WHEN k % 8 IN (3, 7) THEN 'write_file' ELSE 'shell' END AS tool_name,
    'm' || (k % 5) || '.py' AS f FROM ev),
"""


@query("normalise_operations", sql("""SELECT event_id,
  CASE WHEN k % 8 IN (0, 1, 2) THEN 'shell' WHEN k % 8 IN (3, 7) THEN 'tool' END AS kind,
  CASE k % 8 WHEN 0 THEN 'git' WHEN 1 THEN 'rg' WHEN 2 THEN 'pytest' WHEN 3 THEN 'write_file'
    WHEN 7 THEN 'write_file' END AS executable,
  CASE k % 8 WHEN 0 THEN 'commit' WHEN 1 THEN 'needle' END AS subcommand,
  CASE k % 8 WHEN 0 THEN 'src/' || f WHEN 1 THEN 'src/' || f WHEN 2 THEN f WHEN 3 THEN 'a/' || f
    WHEN 7 THEN f END AS target,
  CASE k % 8 WHEN 0 THEN '/usr/bin/git|commit|-m|fix it|src/' || f
    WHEN 1 THEN 'rg|-g|*.py|needle|./src//' || f WHEN 2 THEN 'pytest|-k|x y|' || f
    WHEN 3 THEN '{"path":"./a//' || f || '","request_id":"<request_id>"}'
    WHEN 7 THEN '{"file":"' || f || '","meta":{"at":"<timestamp>","nonce":"<nonce>"},"n":1.5}'
    END AS argv FROM calls""", _CALLS))
def normalise_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    f = F.concat(F.lit("m"), (k % 5).cast("string"), F.lit(".py"))
    shapes = (
        (F.lit('{"cmd":"/usr/bin/git commit -m \\"fix it\\" src/'), F.lit('"}')),
        (F.lit('{"argv":["rg","-g","*.py","needle","./src//'), F.lit('"]}')),
        (F.lit('["pytest","-k","x y","'), F.lit('"]')),
        (F.lit('{"request_id":"r","path":"./a//'), F.lit('"}')),
        (F.lit('{"cmd":'), F.lit("")), (F.lit('{"cmd":[],"x":"'), F.lit('"}')),
        (F.lit('{"x":NaN,"y":"'), F.lit('"}')),
        (F.lit('{"n":1.5,"meta":{"nonce":"z","at":"2024-01-01T00:00:00Z"},"file":"'),
         F.lit('"}')))
    text = F.element_at(F.array(*(F.concat(a, f, b) for a, b in shapes)),
                        (k % 8 + 1).cast("int"))
    tool = F.when((k % 8).isin(3, 7), F.lit("write_file")).otherwise(F.lit("shell"))
    calls = views.ev(spark, sf_dir).select("event_id", tool.alias("tool_name"),
                                           text.alias("arguments"))
    op = F.col("operation")
    return normalise.normalise_operations(calls).select(
        "event_id", *(op[c].alias(c) for c in ("kind", "executable", "subcommand", "target")),
        F.array_join(op["argv"], "|").alias("argv"))


@query("membership_key", sql("""SELECT event_id, sha256(CAST(to_json({kind: op_kind,
    executable: op_executable, subcommand: op_subcommand, target: op_target,
    argv: CASE WHEN op_kind = 'tool' THEN ['{"path":"' || op_target || '"}']
      WHEN op_subcommand IS NULL THEN [op_executable, op_target]
      ELSE [op_executable, op_subcommand, op_target] END}) AS VARCHAR)) AS op_key
  FROM detector_events WHERE op_key IS NOT NULL""", EVENT_CTES))
def membership_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).where("op_key is not null").select("event_id", "op_key")


# ---- identities ----------------------------------------------------------------------

@query("conversation_thread_map", sql("SELECT conversation_id, thread_id FROM threads",
                                      EVENT_CTES))
def conversation_thread_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.conversation_thread_map(views.typed_logs(spark, sf_dir),
                                            views.typed_traces(spark, sf_dir))


@query("conversation_conflicts", sql("""SELECT conversation_id, min(t.thread_id) AS thread_id,
  max(t.thread_id) AS other_thread_id FROM logs JOIN traces t USING (trace_id)
  WHERE conversation_id IS NOT NULL AND t.thread_id IS NOT NULL
  GROUP BY conversation_id HAVING count(DISTINCT t.thread_id) > 1"""))
def conversation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.conversation_conflicts(views.typed_logs(spark, sf_dir),
                                           views.typed_traces(spark, sf_dir))


@query("canonical_task", sql("""SELECT log_id, split_part(task_id, ':', 1) AS task_kind, task_id,
  NOT starts_with(task_id, 'episode') AS counts_as_distinct_task,
  CAST(NULL AS VARCHAR) AS identity_error
  FROM (SELECT log_id, coalesce('thread:' || thread_id, 'thread:' || mapped,
    'conversation:' || conversation_id, 'episode:' || trace_id) AS task_id FROM linked)""",
    EVENT_CTES))
def canonical_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = views.linked_logs(spark, sf_dir)
    return identity.with_canonical_task(
        linked, identity.linked_thread_map(linked), F.coalesce("trace_id", "log_id"),
        F.col("log_id")).select(
        "log_id", "task_kind", "task_id", "counts_as_distinct_task", "identity_error")


@query("canonical_turn", sql("""SELECT trace_id, CASE WHEN tool_calls = 1 THEN NULL ELSE
  'episode:' || trace_id || '/turn:' || CASE WHEN tool_calls = 0 THEN 'dot' ELSE turn_id END END
  AS turn FROM traces"""))
def canonical_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = F.col("tool_calls")
    return views.typed_traces(spark, sf_dir).select("trace_id", identity.canonical_turn(
        F.concat(F.lit("episode:"), "trace_id"),
        F.when(calls == 0, F.lit("dot")).when(calls == 1, F.lit("bad id")).otherwise(F.lit("")),
        F.col("turn_id")).alias("turn"))


@query("resolve_projects", sql("""SELECT DISTINCT cwd, 'git' AS kind,
  regexp_replace(cwd, '/src$', '') AS root, CAST(NULL AS VARCHAR) AS alias_source,
  project AS project_id FROM placed WHERE cwd IS NOT NULL
  UNION ALL SELECT DISTINCT replace(cwd, '/work/p', '/work/q'), 'non_git', '/work', NULL,
  'non_git:' || sha256(encode('non_git') || '\\x00'::BLOB || encode('/work')) FROM placed
  WHERE cwd IS NOT NULL""", EVENT_CTES))
def resolve_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cwds = views.typed_traces(spark, sf_dir).where("cwd is not null").select("cwd")
    other = cwds.select(F.replace("cwd", F.lit("/work/p"), F.lit("/work/q")).alias("cwd"))
    outside = cwds.select(F.concat(F.lit("/elsewhere"), "cwd").alias("cwd"))
    return identity.resolve_projects(cwds.unionByName(other).unionByName(outside),
                                     views.project_roots(spark))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alias per nation: /work/p0 to /work/p1 is valid, the rest have faults."""
    key = F.col("n_nationkey")
    return views.table(spark, sf_dir, "nation").select(
        F.when(key % 5 == 3, F.lit("svn")).otherwise(F.lit("git")).alias("kind"),
        F.concat(F.lit("/work/p"), key.cast("string")).alias("root"),
        F.when(key % 5 == 2, F.lit("non_git")).otherwise(F.lit("git")).alias("target_kind"),
        F.when(key % 5 == 4, F.lit("/work/../p1")).otherwise(F.lit("/work/p1"))
        .alias("target_root"))


@query("project_aliases", sql("""SELECT DISTINCT cwd, CASE WHEN root = '/work/p0'
  THEN '/work/p1' ELSE root END AS root, CASE WHEN root IN ('/work/p0', '/work/p5')
  THEN 'git:' || root END AS alias_source FROM (SELECT cwd, CASE WHEN cwd = '/work/p5/src'
  THEN '/work/p5' ELSE regexp_replace(cwd, '/src$', '') END AS root FROM traces
  WHERE cwd IS NOT NULL AND cwd <> '/work/p5/src')
  UNION ALL SELECT DISTINCT cwd, '/work/p1', 'git:/work/p5' FROM traces
  WHERE cwd = '/work/p5/src'"""))
def project_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.resolve_projects(
        views.typed_traces(spark, sf_dir), views.project_roots(spark),
        _aliases(spark, sf_dir)).select("cwd", "root", "alias_source")


@query("rejected_aliases", """SELECT '/work/p' || n_nationkey AS root, CASE n_nationkey % 5
  WHEN 3 THEN 'unknown kind' WHEN 4 THEN 'path is not normalized and absolute'
  ELSE 'alias changes the kind' END AS fault FROM nation WHERE n_nationkey % 5 IN (2, 3, 4)""")
def rejected_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.rejected_aliases(_aliases(spark, sf_dir)).select("root", "fault")


@query("relative_target", f"""WITH {LOG_CTES} d AS (
  SELECT event_id, user_id % 6 AS p, CASE k % 6 WHEN 0 THEN 'src/m.py'
    WHEN 1 THEN '../p1/x.py' WHEN 2 THEN '/work/p1/src/./a/../b.py' WHEN 3 THEN '/etc/passwd'
    WHEN 4 THEN '.' ELSE 'src\\..\\lib//n.py' END AS raw FROM ev)
SELECT event_id, raw, CASE raw WHEN 'src/m.py' THEN 'src/m.py'
  WHEN '../p1/x.py' THEN CASE WHEN p = 1 THEN 'x.py' END
  WHEN '/work/p1/src/./a/../b.py' THEN CASE WHEN p = 1 THEN 'src/b.py' END
  WHEN '/etc/passwd' THEN NULL WHEN '.' THEN '.' ELSE 'lib/n.py' END AS relative FROM d""")
def relative_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("src/m.py", "../p1/x.py", "/work/p1/src/./a/../b.py", "/etc/passwd", ".",
             "src\\..\\lib//n.py")
    raw = F.element_at(F.array(*map(F.lit, texts)), (F.col("k") % 6 + 1).cast("int"))
    root = F.concat(F.lit("/work/p"), (F.col("user_id") % 6).cast("string"))
    return views.ev(spark, sf_dir).select(
        "event_id", raw.alias("raw"), C.relative_target(raw, root).alias("relative"))


@query("local_day", f"""WITH {LOG_CTES} d AS (
  SELECT event_id, timestamp_ns + (k * 7776000) * 1000000000 AS ns FROM ev)
SELECT event_id, ns, strftime(timezone('Europe/London',
  timezone('UTC', make_timestamp(ns // 1000))), '%Y-%m-%d') AS day FROM d""")
def local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.col("timestamp_ns") + F.col("k") * 7_776_000 * K.NS_PER_SECOND
    return views.ev(spark, sf_dir).select("event_id", shifted.alias("ns")).select(
        "event_id", "ns", C.local_day(F.col("ns")).cast("string").alias("day"))


@query("project_dimension", sql("""SELECT DISTINCT project AS id, 'git' AS identity_kind,
  regexp_replace(cwd, '/src$', '') AS canonical_path,
  regexp_replace(cwd, '/src$', '') || '/.git' AS git_common_dir FROM placed
  WHERE cwd IS NOT NULL AND cwd <> '/work/p2/src'""", EVENT_CTES))
def project_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = identity.resolve_projects(views.typed_traces(spark, sf_dir),
                                         views.project_roots(spark))
    existing = identity.project_dimension(resolved.where("root = '/work/p2'"))
    return identity.project_dimension(resolved, existing)
