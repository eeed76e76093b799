"""Derived events, delivery, reconciliation, generations and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.detection import _findings, _states, _TWO_RUNS, records
from checks.prelude import RECORD_CTES, sql
from checks.registry import query
from checks.tables import (
    DERIVED_SQL, OUTBOX_SQL, PANEL_END, PANEL_START, RUNS_SQL, customer_events, derived_events,
    finding_events, outbox, runs,
)
from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators import events, generations, identity
from tracefold.plans import panels
from tracefold.sources import sinks

_UUID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-'
  || substr(h, 17, 4) || '-' || substr(h, 21, 12) FROM (SELECT sha256({parts}) AS h))"""


def uuid_sql(*parts: str) -> str:
    return _UUID.format(parts=" || chr(31) || ".join(parts))


@query("event_id", f"""WITH {DERIVED_SQL} SELECT event_id AS row_id,
  {uuid_sql("'operational'", "entity_id", "CAST(entity_version AS VARCHAR)", "'1'", "event_name")}
  AS event_id FROM derived""")
def event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finding_events(spark, sf_dir).select(F.col("event_id").alias("row_id"), C.event_id(
        F.col("scope"), F.col("entity_id"), F.col("entity_version"), F.lit(1),
        F.col("event_name")).alias("event_id"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.project_dimension(identity.resolve_projects(
        views.typed_traces(spark, sf_dir), views.project_roots(spark)))


def _flat(df: DataFrame, text: dict[str, str], numbers: dict[str, str] | None = None) -> DataFrame:
    return df.select(
        "event_id", "scope", "entity_id", "entity_version", "event_sequence", "event_name",
        "timestamp_ns", *(F.col("attributes_string")[k].alias(n) for n, k in text.items()),
        *(F.col("attributes_number")[k].alias(n) for n, k in (numbers or {}).items()))


_OBS_TEXT = {"generation": "analysis.generation", "detector": "detector.id",
             "project_id": "project.id", "project_name": "project.name", "finding": "finding.id"}
_NAMED = """named AS (
  SELECT r.*, coalesce(p.name, 'unresolved') AS project_name,
    coalesce(r.project_identity_id, 'unresolved') AS project_id
  FROM records r LEFT JOIN (SELECT DISTINCT project, split_part(cwd, '/', 3) AS name FROM placed
    WHERE cwd IS NOT NULL) p ON p.project = r.project_identity_id),
"""
_OBSERVED = f"""SELECT {uuid_sql("'generation:g1'", "observation_id", "'1'", "'1'",
                                 "'introspection.observation.detected'")} AS event_id,
  'generation:g1' AS scope, observation_id AS entity_id, CAST(1 AS BIGINT) AS entity_version,
  CAST(1 AS BIGINT) AS event_sequence, 'introspection.observation.detected' AS event_name,
  occurred_at_ns AS timestamp_ns, 'g1' AS generation, detector_id AS detector, project_id,
  project_name, fingerprint AS finding FROM named"""


@query("observation_events", sql(_OBSERVED, RECORD_CTES + _NAMED))
def observation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(events.observation_events(records(spark, sf_dir), projects(spark, sf_dir),
                                           "g1"), _OBS_TEXT)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _findings(spark, sf_dir)[1].select(
        "fingerprint", "category", "detector_id", "project_identity_id", "entity_version")
    return _states(spark, sf_dir).join(findings, "fingerprint").withColumn(
        "finding_id", F.col("fingerprint"))


@query("trend_events", sql(f"""SELECT {uuid_sql("'generation:g1'", "fingerprint",
    "CAST(entity_version AS VARCHAR)", "CAST(entity_version AS VARCHAR)", "event_name")}
    AS event_id, 'generation:g1' AS scope, fingerprint AS entity_id, entity_version,
  entity_version AS event_sequence, event_name, 1706659200000000000 AS timestamp_ns,
  'g1' AS generation, trend_state AS state, category, category AS detector, project_id,
  project_name, CAST(occurrence_count AS DOUBLE) AS occurrences
  FROM (SELECT b.*, v.*, CASE WHEN trend_state = 'actionable' AND NOT was_actionable
      THEN 'introspection.trend.promoted' ELSE 'introspection.trend.evaluated' END AS event_name
    FROM both_runs b JOIN (SELECT fingerprint AS fp, min(detector_id) AS category,
      min(project_id) AS project_id, min(project_name) AS project_name,
      count(DISTINCT occurred_at_ns < 1705276800000000000) AS entity_version
      FROM named GROUP BY fingerprint) v ON v.fp = b.fingerprint)""",
    _TWO_RUNS + _NAMED))
def trend_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events.trend_events(_evaluated(spark, sf_dir), projects(spark, sf_dir), "g1")
    return _flat(made, {"generation": "analysis.generation", "state": "trend.state",
                        "category": "finding.category", "detector": "detector.id",
                        "project_id": "project.id", "project_name": "project.name"},
                 {"occurrences": "occurrence.count"})


_SNAPSHOT = f"""WITH {RUNS_SQL}, s AS (
  SELECT id, status AS terminal_status, completed_ns AS finished_ns,
    CASE WHEN sequence % 5 <> 0 THEN completed_ns - (sequence % 9000 - 20) * 1000000000 - 1 END
      AS logs_latest_ns,
    CASE WHEN sequence % 7 <> 0 THEN completed_ns - rows_processed * 7000000000 END
      AS traces_latest_ns,
    CASE WHEN sequence % 11 = 0 THEN 'failed' ELSE 'available' END AS traces_query_status
  FROM runs WHERE status <> 'running'),
l AS (SELECT *, CASE WHEN terminal_status = 'failed' THEN 'missing'
    WHEN greatest(logs_latest_ns, traces_latest_ns) IS NULL THEN 'fresh'
    WHEN greatest(logs_latest_ns, traces_latest_ns) > finished_ns THEN 'clock_skew'
    WHEN (finished_ns - greatest(logs_latest_ns, traces_latest_ns)) // 1000000 <= 3900000
      THEN 'fresh'
    WHEN (finished_ns - greatest(logs_latest_ns, traces_latest_ns)) // 1000000 <= 7200000
      THEN 'late' ELSE 'stale' END AS freshness FROM s)
SELECT id, freshness,
  CASE WHEN terminal_status = 'failed' OR traces_query_status <> 'available' THEN 'unhealthy'
    WHEN freshness = 'fresh' THEN 'healthy' WHEN freshness = 'late' THEN 'degraded'
    ELSE 'unhealthy' END AS pipeline_state,
  CASE WHEN logs_latest_ns IS NULL THEN 'not_applicable' WHEN logs_latest_ns > finished_ns
    THEN 'clock_skew' ELSE 'available' END AS logs_lag_state,
  CASE WHEN logs_latest_ns <= finished_ns THEN (finished_ns - logs_latest_ns) // 1000000 END
    AS logs_lag_ms,
  CASE WHEN traces_latest_ns IS NULL THEN 'not_applicable' WHEN traces_latest_ns > finished_ns
    THEN 'clock_skew' ELSE 'available' END AS traces_lag_state,
  CASE WHEN traces_latest_ns <= finished_ns THEN (finished_ns - traces_latest_ns) // 1000000 END
    AS traces_lag_ms FROM l"""


@query("pipeline_snapshots", _SNAPSHOT)
def pipeline_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, done, second = F.col("sequence"), F.col("completed_ns"), K.NS_PER_SECOND
    available = F.lit("available")
    metrics = runs(spark, sf_dir).where("status <> 'running'").select(
        "id", F.col("status").alias("terminal_status"), done.alias("finished_ns"),
        F.when(seq % 5 != 0, done - (seq % 9000 - 20) * second - 1).alias("logs_latest_ns"),
        F.when(seq % 7 != 0, done - F.col("rows_processed") * 7 * second)
        .alias("traces_latest_ns"), available.alias("logs_query_status"),
        F.when(seq % 11 == 0, F.lit("failed")).otherwise(available).alias("traces_query_status"),
        available.alias("hydration_query_status"))
    return events.pipeline_snapshots(metrics).select(
        "id", "freshness", "pipeline_state", "logs_lag_state", "logs_lag_ms", "traces_lag_state",
        "traces_lag_ms")


_DUE_NS = 946_684_800 * K.NS_PER_SECOND  # 2000-01-01


@query("delivery_batch", f"""WITH {OUTBOX_SQL} SELECT * FROM outbox WHERE status = 'pending'
  AND next_attempt_ns <= {_DUE_NS} ORDER BY created_ns, event_id LIMIT 500""")
def delivery_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.delivery_batch(outbox(spark, sf_dir), _DUE_NS, 500)


@query("retry_backoff", f"""WITH {OUTBOX_SQL}
SELECT event_id, CASE WHEN tried AND ok THEN 'delivered' ELSE status END AS status,
  attempt_count + CASE WHEN tried AND NOT ok THEN 1 ELSE 0 END AS attempt_count,
  CASE WHEN tried AND NOT ok THEN {_DUE_NS} + least(3600, CAST(pow(2, least(11, attempt_count))
    AS BIGINT)) * 1000000000 ELSE next_attempt_ns END AS next_attempt_ns, created_ns,
  CASE WHEN tried AND ok THEN {_DUE_NS} ELSE delivered_ns END AS delivered_ns
FROM (SELECT *, status = 'pending' AND next_attempt_ns <= {_DUE_NS} AS tried,
  next_attempt_ns % 7 = 0 OR attempt_count % 2 = 0 AS ok FROM outbox)""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outbox(spark, sf_dir)
    ok = (F.col("next_attempt_ns") % 7 == 0) | (F.col("attempt_count") % 2 == 0)
    attempts = rows.where((F.col("status") == "pending") & (
        F.col("next_attempt_ns") <= _DUE_NS)).select("event_id", ok.alias("delivered"))
    return events.retry_backoff(rows, attempts, _DUE_NS)


@query("outbox_status", f"""WITH {OUTBOX_SQL}
SELECT status, count(*) AS n FROM outbox GROUP BY status""")
def outbox_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.outbox_status(outbox(spark, sf_dir))


# ---- emission and reconciliation --------------------------------------------------------

@query("emit_events", f"""WITH {DERIVED_SQL} SELECT DISTINCT event_id, entity_id FROM derived
  WHERE timestamp_ns >= 915148800000000000""")
def emit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finding_events(spark, sf_dir)
    stored = rows.where("timestamp_ns < 915148800000000000")
    return sinks.new_events(rows.unionByName(rows), stored).select("event_id", "entity_id")


@query("event_payload", f"""WITH {DERIVED_SQL} SELECT event_id,
  '{{"analysis.generation":"' || generation || '","detector.id":"' || detector
  || '","entity.id":"' || entity_id || '","entity.version":' || entity_version
  || ',"event.id":"' || event_id || '","event.name":"' || event_name || '","event.scope":"operational"'
  || ',"event.sequence":' || entity_version || ',"finding.category":"' || category
  || '","occurrence.count":' || CAST(occurrences AS BIGINT) || ',"project.id":"' || project_id
  || '","project.name":"' || project_name || '","timestamp_ns":' || timestamp_ns
  || ',"trend.state":"' || state || '"}}' AS payload FROM derived""")
def event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finding_events(spark, sf_dir)
    return rows.select("event_id", events.payload_json(rows).alias("payload"))


@query("write_results", sql("""SELECT 'run-1' AS run_id, observation_id, detector_id
  FROM records WHERE occurred_at_ns < 1705276800000000000""", RECORD_CTES))
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published run that is repeated, an attempt that loses to it, and one of another run
    that is never published; only the first rows are read back."""
    path = sinks.new_path(spark, "results")
    rows = records(spark, sf_dir).select("observation_id", "detector_id", "occurred_at_ns")
    first = rows.where("occurred_at_ns < 1705276800000000000")
    for attempt in (first, first.where("false")):
        sinks.write_results({"observations": attempt}, path, "run-1")
    for run in ("run-1", "run-2"):
        attempt = sinks.new_attempt()
        sinks.write_attempt({"observations": rows}, path, attempt)
        if run == "run-1" and sinks.publish(spark, path, run, attempt):
            raise ValueError("two attempts of one run were published")
    return sinks.read_results(spark, path, "observations").select(
        "run_id", "observation_id", "detector_id")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations spread over scan runs by member count."""
    run = F.concat(F.lit("run-"), (F.col("member_count") % 4).cast("string"))
    return records(spark, sf_dir).withColumn("scan_run_id", run)


_PLAN = RECORD_CTES + _NAMED + f"""
ranked AS (
  SELECT *, 'run-' || (member_count % 4) AS scan_run_id,
    row_number() OVER (PARTITION BY member_count % 4 ORDER BY detector_id,
      coalesce(project_identity_id, 'unresolved:' || task_identity), first_event_id,
      observation_id) AS ordinal FROM named),
planned AS (
  SELECT *, {uuid_sql("'operational'", "observation_id", "'1'", "CAST(ordinal AS VARCHAR)",
                      "'introspection.observation.detected'")} AS event_id
  FROM ranked WHERE scan_run_id IN ('run-1', 'run-2')
    AND occurred_at_ns >= 1705276800000000000),
"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = spark.createDataFrame([("run-1",), ("run-2",)], "run_id string")
    rows = records(spark, sf_dir)
    local = events.observation_events(
        rows.where("occurred_at_ns < 1705276800000000000"), projects(spark, sf_dir), "g1")
    return events.reconciliation_plan(_observed(spark, sf_dir), failed, projects(spark, sf_dir),
                                      local)


@query("reconciliation_plan", sql("""SELECT event_id, observation_id AS entity_id,
  ordinal AS event_sequence, occurred_at_ns AS timestamp_ns, detector_id AS detector, project_id,
  project_name, fingerprint AS finding FROM planned""", _PLAN))
def reconciliation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = {k: v for k, v in _OBS_TEXT.items() if k != "generation"}
    return _flat(_plan(spark, sf_dir), text).drop("scope", "entity_version", "event_name")


@query("reconciliation_enqueue", sql("""SELECT event_id FROM planned
  WHERE occurred_at_ns < 1706054400000000000""", _PLAN))
def reconciliation_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    return events.reconciliation_enqueue(
        plan, plan.where("timestamp_ns >= 1706054400000000000")).select("event_id")


@query("reconciliation_counts", sql("""SELECT
  (SELECT count(*) FROM ranked WHERE scan_run_id IN ('run-1', 'run-2')) AS observations,
  (SELECT count(*) FROM ranked WHERE scan_run_id IN ('run-1', 'run-2')
    AND occurred_at_ns < 1705276800000000000) AS existing_local_observation_events,
  (SELECT count(*) FROM planned WHERE occurred_at_ns >= 1706054400000000000)
    AS existing_remote_observation_events,
  (SELECT count(*) FROM planned WHERE occurred_at_ns < 1706054400000000000)
    AS queued_observation_events""", _PLAN))
def reconciliation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)
    chosen = _observed(spark, sf_dir).where("scan_run_id in ('run-1', 'run-2')")
    return events.reconciliation_counts(
        chosen, plan, plan.where("timestamp_ns >= 1706054400000000000"))


@query("failed_run_faults", f"""WITH {RUNS_SQL}, asked AS (
  SELECT CASE WHEN sequence % 10 = 0 THEN 'missing-' || id WHEN sequence % 10 = 5 THEN ''
    ELSE id END AS run_id FROM runs WHERE sequence % 2 = 0 OR sequence % 10 = 5
  UNION ALL SELECT id FROM runs WHERE sequence % 10 = 2)
SELECT a.run_id, CASE WHEN a.run_id = '' THEN 'blank' WHEN n > 1 THEN 'repeated'
  WHEN r.status IS NULL THEN 'unknown' ELSE 'not failed' END AS fault
FROM (SELECT run_id, count(*) AS n FROM asked GROUP BY run_id) a
LEFT JOIN runs r ON r.id = a.run_id
WHERE a.run_id = '' OR n > 1 OR r.status IS NULL OR r.status <> 'failed'""")
def failed_run_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    tenth = F.col("sequence") % 10
    asked = rows.where((F.col("sequence") % 2 == 0) | (tenth == 5)).select(
        F.when(tenth == 0, F.concat(F.lit("missing-"), "id")).when(tenth == 5, F.lit(""))
        .otherwise(F.col("id")).alias("run_id"))
    again = rows.where(tenth == 2).select(F.col("id").alias("run_id"))
    return events.failed_run_faults(asked.unionByName(again), rows)


@query("local_event_entities", f"""WITH {DERIVED_SQL} SELECT DISTINCT entity_id FROM derived
  WHERE event_name = 'introspection.observation.detected'""")
def local_event_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.local_event_entities(finding_events(spark, sf_dir))


def remote_store(rows: DataFrame) -> DataFrame:
    """Delivered events as raw log rows of the deriving service."""
    return rows.select(
        "timestamp_ns", F.create_map(F.lit("event.id"), F.col("event_id"), F.lit("event.name"),
                                     F.col("event_name")).alias("attributes_string"),
        F.create_map(F.lit("service.name"), F.when(
            F.col("entity_version") == 3, F.lit("other")).otherwise(F.lit(K.DERIVED_SERVICE)))
        .alias("resource"))


@query("remote_presence", f"""WITH {DERIVED_SQL} SELECT d.event_id FROM derived d
  SEMI JOIN (SELECT * FROM derived WHERE entity_version <> 3 AND entity_version <> 5) h
  USING (event_id, event_name, timestamp_ns)""")
def remote_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finding_events(spark, sf_dir)
    store = remote_store(rows.where("entity_version <> 5"))
    return events.remote_presence(rows.select("event_id", "event_name", "timestamp_ns"),
                                  store).select("event_id")


# ---- generations ---------------------------------------------------------------------------

@query("generation_projection", sql(f"""SELECT event_id, entity_id, event_name, timestamp_ns,
  project_name FROM (SELECT * FROM ({_OBSERVED}) WHERE timestamp_ns BETWEEN
    1706054400000000000 AND 1706659200000000000)
  UNION ALL SELECT {uuid_sql("'generation:g1'", "fingerprint", "CAST(v AS VARCHAR)",
                             "CAST(v AS VARCHAR)", "'introspection.trend.evaluated'")},
    fingerprint, 'introspection.trend.evaluated', last_seen, project_name
  FROM (SELECT fingerprint, max(occurred_at_ns) AS last_seen, min(project_name) AS project_name,
    count(DISTINCT occurred_at_ns < 1705276800000000000) AS v FROM named GROUP BY fingerprint)
  WHERE last_seen BETWEEN 1706054400000000000 AND 1706659200000000000""", RECORD_CTES + _NAMED))
def generation_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _findings(spark, sf_dir)[1].withColumns({
        "finding_id": F.col("fingerprint"), "occurrence_count": F.lit(1)})
    made = generations.generation_projection(
        records(spark, sf_dir), findings, projects(spark, sf_dir), "g1",
        views.NOW_NS - 7 * K.NS_PER_DAY, views.NOW_NS)
    return _flat(made, {"project_name": "project.name"}).select(
        "event_id", "entity_id", "event_name", "timestamp_ns", "project_name")


_LINKS = f"""WITH {OUTBOX_SQL}, links AS (
  SELECT 'gen-' || (o_orderkey // 8) AS generation_id, 'e' || o_orderkey AS event_id,
    CASE WHEN o_orderkey % 8 = 7 THEN 'activation' ELSE 'projection' END AS role FROM orders),
remote AS (SELECT event_id FROM outbox WHERE attempt_count <> 12),
blocking AS (
  SELECT l.generation_id, l.event_id, CASE WHEN o.status <> 'delivered' THEN 'undelivered'
    ELSE 'not remotely verifiable' END AS reason
  FROM links l JOIN (SELECT * REPLACE (CASE WHEN attempt_count > 1 THEN 'delivered' ELSE status
    END AS status) FROM outbox) o USING (event_id)
  WHERE role = 'projection' AND (o.status <> 'delivered'
    OR event_id NOT IN (SELECT event_id FROM remote)))"""


def _generation_tables(spark: SparkSession, sf_dir: str):
    rows = outbox(spark, sf_dir)
    number = F.substring("event_id", 2, 20).cast("bigint")
    links = rows.select(
        F.concat(F.lit("gen-"), F.call_function("div", number, F.lit(8)).cast("string"))
        .alias("generation_id"), "event_id",
        F.when(number % 8 == 7, F.lit("activation")).otherwise(F.lit("projection"))
        .alias("role"))
    remote = rows.where("attempt_count <> 12").select("event_id")
    delivered = rows.withColumn("status", F.when(
        F.col("attempt_count") > 1, F.lit("delivered")).otherwise(F.col("status")))
    return links, delivered, remote


@query("blocking_events", _LINKS + " SELECT * FROM blocking")
def blocking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generations.blocking_events(*_generation_tables(spark, sf_dir))


@query("linked_references", _LINKS + """ SELECT l.generation_id, event_id, o.status
  FROM links l JOIN outbox o USING (event_id) WHERE role = 'activation'""")
def linked_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, _, _ = _generation_tables(spark, sf_dir)
    return generations.linked_references(links, outbox(spark, sf_dir), "activation").select(
        "generation_id", "event_id", "status")


@query("activation_ready", _LINKS + """ SELECT DISTINCT generation_id FROM links
  WHERE generation_id NOT IN (SELECT generation_id FROM blocking)""")
def activation_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, delivered, remote = _generation_tables(spark, sf_dir)
    return generations.activation_ready(links.select("generation_id").distinct(), links,
                                        delivered, remote)


@query("activations", _LINKS + f""" SELECT generation_id,
  {uuid_sql("'operational'", "generation_id", "'1'", "'1'",
            "'introspection.analysis_generation.activated'")} AS activation_event_id,
  {views.NOW_NS} AS activated_ns FROM (SELECT DISTINCT generation_id FROM links
  WHERE generation_id NOT IN (SELECT generation_id FROM blocking)
    AND NOT ends_with(generation_id, '3'))""")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = activation_ready(spark, sf_dir)
    return generations.activations(ready, ready.where("generation_id like '%3'"), views.NOW_NS)


@query("current_generation", """SELECT 'gen-' || c_custkey AS generation_id,
  'e' || c_custkey AS activation_event_id, c_custkey % 50 AS activated_ns FROM customer
  ORDER BY c_custkey % 50 DESC, 'gen-' || c_custkey DESC LIMIT 1""")
def current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return generations.current_generation(views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("gen-"), key.cast("string")).alias("generation_id"),
        F.concat(F.lit("e"), key.cast("string")).alias("activation_event_id"),
        (key % 50).alias("activated_ns")))


# ---- panels ------------------------------------------------------------------------------------

_LATEST = f"""WITH {DERIVED_SQL}, latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id
      ORDER BY entity_version DESC, timestamp_ns DESC, event_id DESC) AS r,
      max(timestamp_ns) OVER (PARTITION BY entity_id) AS last_ns
    FROM visible WHERE event_name <> 'introspection.observation.detected') WHERE r = 1)"""


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_events(spark, sf_dir)


@query("active_generation", f"WITH {DERIVED_SQL} SELECT generation FROM active")
def active_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.active_generation(_all(spark, sf_dir))


@query("latest_rows", f"""WITH {DERIVED_SQL} SELECT 'generation' AS what, generation AS value
  FROM active UNION ALL SELECT 'review', CAST(CAST(max(c_custkey) AS BIGINT) AS VARCHAR)
  FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 4 <> 0""")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer and review rows merged over four runs, each adding a quarter of the events."""
    held = None
    for i in range(4):
        part = _all(spark, sf_dir).where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i)
        held = sinks.stored(panels.latest_rows(part, held), "latest")
    marker = F.col("event_name") == K.ACTIVATION_EVENT
    return held.select(
        F.when(marker, F.lit("generation")).otherwise(F.lit("review")).alias("what"),
        F.when(marker, panels.text("analysis.generation")).otherwise(
            F.col("entity_version").cast("string")).alias("value"))


_SNAPSHOTS = """WITH s AS (
  SELECT *, 's' || o_orderkey AS event_id,
    epoch_us(o_orderdate) * 1000 + o_orderkey % 1440 * 60000000000 AS timestamp_ns FROM orders),
w AS (SELECT * FROM s WHERE timestamp_ns BETWEEN 883612800000000000 AND 978307200000000000)"""


@query("pipeline_health", _SNAPSHOTS + """ SELECT 'state-' || o_orderstatus AS pipeline_state,
  o_orderpriority AS terminal_status, CASE WHEN o_custkey % 2 = 0 THEN 'fresh' ELSE 'late' END
    AS freshness, 'available / ' || o_orderstatus AS logs, 'available / ' || (o_custkey % 4)
    AS traces, strftime(make_timestamp(timestamp_ns // 1000), '%d %b %H:%M') AS last_snapshot
FROM w ORDER BY timestamp_ns DESC, event_id DESC LIMIT 1""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.pipeline_health(_all(spark, sf_dir), PANEL_START, PANEL_END)


@query("scan_duration", _SNAPSHOTS + """ SELECT epoch_us(make_timestamp(timestamp_ns // 1000))
  AS ts_us, o_totalprice AS value FROM w""")
def scan_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.scan_duration(_all(spark, sf_dir), PANEL_START, PANEL_END).select(
        F.unix_micros("ts").alias("ts_us"), "value")


@query("identity_coverage", f"""WITH {DERIVED_SQL}, e AS (
  SELECT entity_id, bool_or(project_id NOT IN ('', 'unresolved')
    AND project_name NOT IN ('', 'unresolved')) AS ok FROM visible
  WHERE event_name = 'introspection.observation.detected' GROUP BY entity_id)
SELECT round(100 * CAST(count(*) FILTER (ok) AS DOUBLE) / greatest(CAST(count(*) AS DOUBLE), 1), 2)
  AS identity_coverage_pct, CAST(count(*) FILTER (ok) AS DOUBLE) AS resolved_observations,
  CAST(count(*) AS DOUBLE) AS observed_observations FROM e""")
def identity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.identity_coverage(_all(spark, sf_dir), PANEL_START, PANEL_END)


@query("actionable_trends", _LATEST + """ SELECT left(entity_id, 8) AS finding, category, detector,
  CASE WHEN project_name = '' THEN 'unresolved' ELSE project_name END AS project, occurrences,
  strftime(make_timestamp(last_ns // 1000), '%d %b %H:%M') AS last_evaluated
FROM latest WHERE state = 'actionable'""")
def actionable_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.actionable_trends(_all(spark, sf_dir), PANEL_START, PANEL_END)


@query("trend_context", _LATEST + """ SELECT state AS trend_state,
  max(last_ns) // 60000000000 * 60000000 AS ts_us, CAST(count(*) AS DOUBLE) AS value
FROM latest GROUP BY state""")
def trend_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.trend_context(_all(spark, sf_dir), PANEL_START, PANEL_END).select(
        "trend_state", F.unix_micros("ts").alias("ts_us"), "value")


@query("signal_mix", f"""WITH {DERIVED_SQL} SELECT timestamp_ns // 86400000000000 * 86400000000
  AS ts_us, detector, CAST(count(DISTINCT entity_id) AS DOUBLE) AS value FROM visible
WHERE event_name = 'introspection.observation.detected' GROUP BY 1, 2""")
def signal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.signal_mix(_all(spark, sf_dir), PANEL_START, PANEL_END).select(
        F.unix_micros("ts").alias("ts_us"), "detector", "value")


@query("detector_yield", _LATEST + """ SELECT detector,
  CAST(count(*) FILTER (state = 'actionable') AS DOUBLE) AS actionable_findings,
  CAST(count(*) AS DOUBLE) AS all_findings,
  round(100 * CAST(count(*) FILTER (state = 'actionable') AS DOUBLE) / CAST(count(*) AS DOUBLE), 2)
    AS actionable_yield_pct FROM latest GROUP BY detector""")
def detector_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.detector_yield(_all(spark, sf_dir), PANEL_START, PANEL_END)


@query("review_activity_panel", """SELECT CAST(c_custkey % 5 AS DOUBLE)
    AS classification_sessions, CAST(c_custkey % 3 AS DOUBLE) AS proposal_sessions,
  CAST(c_custkey % 50 AS DOUBLE) AS classification_results, CAST(0 AS DOUBLE) AS proposal_results
FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 4 <> 0 ORDER BY c_custkey DESC LIMIT 1""")
def review_activity_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.review_activity(customer_events(spark, sf_dir))
