"""Detectors, observations, findings and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.prelude import (
    DETECT_CTES, DETECTOR_SQL, EVENT_CTES, RECORD_CTES, REDACT, TOOL_LOOP_LITERAL, sql,
)
from checks.registry import query
from checks.tables import DERIVED_SQL, RUNS_SQL, finding_events, runs
from tracefold.functions import columns as C
from tracefold.operators import detectors, observations, validate
from tracefold.plans import scan
from tracefold.sources import sinks, telemetry

_SHOWN = ["detector_id", "ordinal", "member_count", "event_id", "timestamp_ns", "project_id",
          "task_id", "operation_kind", "target_kind", "normalized_target", "failure_class",
          "explanation"]


def _member_query(detector) -> None:
    name = detector.__name__
    text = sql(f"SELECT {', '.join(_SHOWN)} FROM ({DETECTOR_SQL[name]})", DETECT_CTES)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detector(views.events(spark, sf_dir)).select(*_SHOWN)

    query(name, text)(run)


for _detector in (*detectors.SINGLE_EVENT_DETECTORS, *detectors.GROUP_DETECTORS):
    _member_query(_detector)


@query("tool_loop_literal", sql(
    f"SELECT {', '.join(_SHOWN)} FROM ({TOOL_LOOP_LITERAL})", DETECT_CTES))
def tool_loop_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.tool_loop(views.events(spark, sf_dir), verified=False).select(*_SHOWN)


@query("token_outlier", sql(
    f"SELECT {', '.join(_SHOWN)} FROM ({DETECTOR_SQL['token_outlier']})", DETECT_CTES))
def token_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.events(spark, sf_dir)
    return detectors.token_outlier(
        events, detectors.project_token_baselines(events)).select(*_SHOWN)


def hot_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a third of them in one task of one project, for timing skew."""
    third = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0
    return views.once(spark, sf_dir, "events_with_hot_task", lambda s, d: views.events(
        s, d).withColumns({c: F.when(third, F.lit("hot")).otherwise(F.col(c))
                           for c in ("project_id", "task_id")}))


_EVENT_FIELDS = [
    "event_id", "timestamp_ns", "project_id", "task_id", "counts_as_distinct_task", "event_name",
    "op_kind", "op_executable", "op_subcommand", "op_target", "op_exit_code", "success_string",
    "success_bool", "status_code", "outcome", "is_mutation", "token_count", "skill_required",
    "skill_used"]


@query("detector_events", sql(
    f"SELECT {', '.join(_EVENT_FIELDS)} FROM detector_events", EVENT_CTES))
def detector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events_plan(spark, sf_dir).select(*_EVENT_FIELDS)


# ---- baselines -------------------------------------------------------------------------

@query("nearest_rank_p95", """WITH v AS (
  SELECT l_suppkey, CAST(l_extendedprice AS BIGINT) AS price, count(*) OVER w AS n,
    row_number() OVER (w ORDER BY CAST(l_extendedprice AS BIGINT)) AS r
  FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))
SELECT l_suppkey, min(price) AS p95, min(n) AS n_values FROM v
WHERE r >= ceil(0.95::DOUBLE * n) GROUP BY l_suppkey""")
def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.rint("l_extendedprice").cast("bigint")  # halves to even, as SQL casts
    rows = views.table(spark, sf_dir, "lineitem").select("l_suppkey", price.alias("price"))
    return detectors.nearest_rank(rows, ["l_suppkey"], "price")


@query("project_token_baselines", sql("""SELECT 'project' AS origin, project_id AS scope_key, p95,
  n_values FROM baselines""", DETECT_CTES))
def project_token_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.project_token_baselines(views.events(spark, sf_dir))


_SCOPES = DETECT_CTES + """
scopes AS (
  SELECT 'task' AS origin, task_id || ':token' AS scope_key, 7 AS p95 FROM detector_events
    WHERE token_count % 5 = 0
  UNION SELECT 'task', task_id, 8 FROM detector_events WHERE token_count % 5 = 1
  UNION SELECT 'task', project_id || ':tool_calls', 9 FROM detector_events
    WHERE token_count % 7 = 0
  UNION SELECT 'project', project_id || ':token', 10 FROM detector_events
    WHERE token_count % 3 = 0
  UNION SELECT 'project', project_id, 11 FROM detector_events WHERE token_count IS NOT NULL),
measures AS (
  SELECT event_id, project_id, task_id, unnest(['token', 'tool_call']) AS metric
  FROM detector_events WHERE token_count IS NOT NULL),
tries AS (
  SELECT m.*, o.origin, o.place * 4 + k.place AS priority, CASE k.place
    WHEN 0 THEN task_id || suffix WHEN 1 THEN task_id WHEN 2 THEN project_id || suffix
    WHEN 3 THEN CASE WHEN metric = 'token' THEN project_id END END AS scope_key
  FROM (SELECT *, CASE metric WHEN 'token' THEN ':token' ELSE ':tool_calls' END AS suffix
    FROM measures) m, (VALUES ('task', 0), ('project', 1)) o(origin, place),
    (VALUES (0), (1), (2), (3)) k(place)),
"""


@query("baseline_lookup", sql("""SELECT event_id, project_id, task_id, metric, origin, scope_key,
  p95, CAST(30 AS BIGINT) AS n_values FROM (
  SELECT t.*, s.p95, row_number() OVER (PARTITION BY event_id, metric ORDER BY priority) AS r
  FROM tries t JOIN scopes s USING (origin, scope_key)) WHERE r = 1""", _SCOPES))
def baseline_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = views.events(spark, sf_dir).where("token_count is not null")
    count, text = F.col("token_count"), F.lit

    def scope(origin: str, key, p95: int, kept) -> DataFrame:
        return episodes.where(kept).select(
            text(origin).alias("origin"), key.alias("scope_key"), F.lit(p95).alias("p95"),
            F.lit(30).cast("bigint").alias("n_values"))

    scopes = views.union_all([
        scope("task", F.concat("task_id", text(":token")), 7, count % 5 == 0),
        scope("task", F.col("task_id"), 8, count % 5 == 1),
        scope("task", F.concat("project_id", text(":tool_calls")), 9, count % 7 == 0),
        scope("project", F.concat("project_id", text(":token")), 10, count % 3 == 0),
        scope("project", F.col("project_id"), 11, F.lit(True))]).distinct()
    measures = episodes.select("event_id", "project_id", "task_id", F.explode(
        F.array(text("token"), text("tool_call"))).alias("metric"))
    return detectors.baseline_lookup(measures, scopes)


@query("episode_events", sql("""SELECT event_id, timestamp_ns, project_id, task_id, token_count,
  counts_as_distinct_task FROM detector_events WHERE event_name = 'trace.episode'""", EVENT_CTES))
def episode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.episode_events(views.placed_traces(spark, sf_dir)).select(
        "event_id", "timestamp_ns", "project_id", "task_id", "token_count",
        "counts_as_distinct_task")


@query("unresolved_projects", sql("""SELECT task_id, project_id, count(*) AS n
  FROM detector_events WHERE starts_with(project_id, 'unresolved:')
  GROUP BY task_id, project_id""", EVENT_CTES))
def unresolved_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.events(spark, sf_dir).where(
        F.col("project_id").startswith("unresolved:")).groupBy("task_id", "project_id").agg(
        F.count(F.lit(1)).alias("n"))


# ---- observations ------------------------------------------------------------------------

_RECORD = ["observation_id", "detector_id", "project_identity_id", "task_identity",
           "occurred_at_ns", "fingerprint", "operation_kind", "target_kind", "normalized_target",
           "normalized_failure_class", "membership_explanation", "member_count",
           "first_event_id"]


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of all detectors, written once."""
    return views.once(spark, sf_dir, "detected", lambda s, d: views.union_all(
        list(detectors.detect_all(views.events(s, d)))))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(spark, sf_dir)
    return observations.observation_records(rows.where("member_count = 1"),
                                            rows.where("member_count > 1"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation records, written once: the later stages read stored facts."""
    return views.once(spark, sf_dir, "observations", lambda s, d: (
        observations.dedupe_observations(_records(s, d))))


def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.once(spark, sf_dir, "members", lambda s, d: observations.observation_members(
        records(s, d), detected(s, d)))


@query("observation_records", sql(f"SELECT {', '.join(_RECORD)} FROM records", RECORD_CTES))
def observation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select(*_RECORD)


@query("detect_all", sql("""SELECT detector_id, count(*) AS n_observations,
  CAST(sum(member_count) AS BIGINT) AS n_members, count(DISTINCT fingerprint) AS n_fingerprints
  FROM records GROUP BY detector_id""", RECORD_CTES))
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("detector_id").agg(
        F.count(F.lit(1)).alias("n_observations"), F.sum("member_count").alias("n_members"),
        F.count_distinct("fingerprint").alias("n_fingerprints"))


@query("dedupe_observations", sql("SELECT detector_id, observation_id FROM records", RECORD_CTES))
def dedupe_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = records(spark, sf_dir)
    return observations.dedupe_observations(stored.unionByName(stored)).select(
        "detector_id", "observation_id")


@query("fingerprint", sql("SELECT DISTINCT fingerprint, detector_id FROM records", RECORD_CTES))
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("fingerprint", "detector_id").distinct()


@query("observation_members", sql(
    "SELECT observation_id, ordinal, event_id, timestamp_ns FROM member_rows", RECORD_CTES))
def observation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_rows(spark, sf_dir)


_STORED = "occurred_at_ns < 1705276800000000000"  # 2024-01-15


@query("append_new", sql(f"SELECT observation_id FROM records WHERE NOT ({_STORED})",
                         RECORD_CTES))
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return observations.append_new(rows, rows.where(_STORED)).select("observation_id")


@query("append_new_history", sql(f"SELECT observation_id FROM records WHERE NOT ({_STORED})",
                                 RECORD_CTES))
def append_new_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored observations in a day and bucket layout; only places of the new ones are read."""
    path = sinks.new_path(spark, "history")
    rows = records(spark, sf_dir)
    layout = {"observations": ("occurred_at_ns", "observation_id")}
    for i in range(2):
        part = rows.where(_STORED).where(F.pmod(F.xxhash64("observation_id"), F.lit(2)) == i)
        sinks.write_results({"observations": part}, path, f"run-{i}", i, layout)
    days, buckets = sinks.places(rows, "occurred_at_ns", "observation_id")
    held = sinks.read_results(spark, path, "observations", days, buckets)
    return observations.append_new(rows, held).select("observation_id")


@query("replay_conflicts", sql("""SELECT observation_id FROM records
  WHERE occurred_at_ns % 1000000 = 0 OR member_count = 3""", RECORD_CTES))
def replay_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    changed = (F.col("occurred_at_ns") % 1_000_000 == 0) | (F.col("member_count") == 3)
    replay = rows.withColumn("membership_explanation", F.when(changed, F.lit("changed")).otherwise(
        F.col("membership_explanation")))
    return observations.replay_conflicts(
        replay, rows, ["fingerprint", "membership_explanation"]).select("observation_id")


@query("watermark_audit", f"""WITH {RUNS_SQL}, log AS (
  SELECT 's' || (rows_processed % 7) AS source, sequence, started_ns AS timestamp_ns, id AS row_id
  FROM runs), b AS (
  SELECT *, lag(timestamp_ns) OVER w AS prev_ns, lag(row_id) OVER w AS prev_row_id FROM log
  WINDOW w AS (PARTITION BY source ORDER BY sequence))
SELECT source, sequence, timestamp_ns, row_id, prev_ns, prev_row_id FROM b
WHERE timestamp_ns < prev_ns OR (timestamp_ns = prev_ns AND row_id < prev_row_id)""")
def watermark_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = runs(spark, sf_dir).select(
        F.concat(F.lit("s"), (F.col("rows_processed") % 7).cast("string")).alias("source"),
        "sequence", F.col("started_ns").alias("timestamp_ns"), F.col("id").alias("row_id"))
    return observations.watermark_audit(log, span=64)


_EVIDENCE = RECORD_CTES + """
content AS (
  SELECT log_id AS event_id, regexp_replace(CAST(to_json({args: CAST(NULL AS VARCHAR),
    arguments: arguments, argv: CAST(NULL AS VARCHAR), assistant_output: output,
    diagnostic_code: CAST(NULL AS VARCHAR), error_message: CAST(NULL AS VARCHAR),
    outcome: raw_outcome}) AS VARCHAR), 'token=abc([0-9]+)', 'token=[REDACTED]') AS c
  FROM hydrated WHERE listed),
"""


@query("evidence_rows", sql("""SELECT sha256(observation_id || chr(31) || event_id || chr(31)
    || evidence_kind) AS evidence_id, observation_id, event_id, evidence_kind,
  'log:' || event_id AS source_reference, c AS redacted_content,
  sha256(coalesce(c, 'pending')) AS content_hash,
  CASE WHEN c IS NULL THEN 'pending' ELSE 'correlated' END AS correlation_status
  FROM (SELECT m.observation_id, m.event_id, c.c, CASE WHEN c.c IS NULL THEN 'source_reference'
    ELSE 'hydrated_log' END AS evidence_kind
    FROM member_rows m LEFT JOIN content c USING (event_id))""", _EVIDENCE))
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = telemetry.hydrate(views.logs_table(spark, sf_dir), scan.shortlist(
        views.linked_logs(spark, sf_dir)), views.START_NS, views.NOW_NS)
    return observations.evidence_rows(member_rows(spark, sf_dir), validate.accepted(
        validate.parse_hydration(raw)))


@query("redact", f"""SELECT doc_id, sha256({REDACT.format(c="text")}) AS redacted_hash,
  text <> {REDACT.format(c="text")} AS changed FROM documents""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = C.redact(F.col("text"))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", "text", clean.alias("clean")).select(
        "doc_id", F.sha2("clean", 256).alias("redacted_hash"),
        (F.col("text") != F.col("clean")).alias("changed"))


@query("hydrate_evidence", f"""WITH d AS (SELECT doc_id, CASE WHEN length(text) <= 1000000 THEN
  {REDACT.format(c="CAST(to_json({lang: lang, source: source, text: repeat(text, 12)}) AS VARCHAR)")}
  END AS t, length(CAST(to_json({{lang: lang, source: source, text: repeat(text, 12)}})
    AS VARCHAR)) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 1000000 THEN 'quarantined' ELSE 'correlated' END
  AS correlation_status, sha256(CASE WHEN n > 1000000 THEN 'quarantined' ELSE t END)
  AS content_hash FROM d""")
def hydrate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"text": F.repeat("text", F.lit(12)), "lang": F.col("lang"),
              "source": F.col("source")}
    return observations.hydrate_evidence(
        views.table(spark, sf_dir, "documents"), fields).select(
        "doc_id", "correlation_status", "content_hash")


# ---- findings and trends --------------------------------------------------------------------

_FIRST_HALF = "occurred_at_ns < 1705276800000000000"


def _findings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of the first half of the month, then the second half merged in."""
    rows = records(spark, sf_dir)
    first = observations.findings_upsert(rows.where(_FIRST_HALF))
    return first, observations.findings_upsert(rows.where(f"not ({_FIRST_HALF})"), first)


@query("findings_upsert", sql("""SELECT fingerprint, min(detector_id) AS detector_id,
  min(occurred_at_ns) AS first_seen_ns, max(occurred_at_ns) AS last_seen_ns,
  CAST(count(DISTINCT occurred_at_ns < 1705276800000000000) AS INTEGER) AS entity_version
  FROM records GROUP BY fingerprint""", RECORD_CTES))
def findings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)[1].select(
        "fingerprint", "detector_id", "first_seen_ns", "last_seen_ns", "entity_version")


@query("finding_id", sql("""SELECT fingerprint, concat_ws('-', d[1:8], d[9:12], '5' || d[14:16],
    translate(d[17:17], '0123456789abcdef', repeat('89ab', 4)) || d[18:20], d[21:32]) AS finding_id
  FROM (SELECT DISTINCT fingerprint, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')
    || encode('tracefold:' || fingerprint)) AS d FROM records)""", RECORD_CTES))
def finding_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir)[1].select("fingerprint", "finding_id")


@query("finding_membership", sql("""SELECT fingerprint, observation_id,
  membership_explanation AS rationale FROM records
  WHERE occurred_at_ns >= 1705276800000000000""", RECORD_CTES))
def finding_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    stored = observations.finding_membership(rows.where(_FIRST_HALF))
    new = observations.finding_membership(rows, stored)
    return new.join(rows.select("fingerprint", "observation_id"), "observation_id").select(
        "fingerprint", "observation_id", "rationale")


@query("finding_occurrences", sql("""SELECT f.fingerprint, r.observation_id, r.occurred_at_ns,
  r.task_identity FROM (SELECT DISTINCT fingerprint FROM records) f LEFT JOIN records r
  ON r.fingerprint = f.fingerprint AND r.occurred_at_ns >= 1706054400000000000""", RECORD_CTES))
def finding_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    findings = _findings(spark, sf_dir)[1]
    found = observations.finding_occurrences(
        findings, observations.finding_membership(rows), rows, 1706054400000000000)
    return found.join(findings.select("finding_id", "fingerprint"), "finding_id").select(
        "fingerprint", "observation_id", "occurred_at_ns", "task_identity")


_TREND = RECORD_CTES + """
evaluated AS (
  SELECT fingerprint, count(*) AS occurrence_count,
    count(DISTINCT task_identity) AS canonical_task_count,
    count(DISTINCT CAST(timezone('Europe/London', timezone('UTC',
      make_timestamp(occurred_at_ns // 1000))) AS DATE)) AS local_day_count
  FROM records WHERE occurred_at_ns BETWEEN {lo} AND {hi} GROUP BY fingerprint),
judged AS (
  SELECT *, CASE WHEN (occurrence_count >= 3 AND canonical_task_count >= 2
    AND local_day_count >= 2) OR (occurrence_count >= 5 AND canonical_task_count >= 3)
    THEN 'actionable' WHEN occurrence_count <= 1 THEN 'isolated' ELSE 'emerging' END AS trend_state
  FROM evaluated),
"""
def _window(lo: int, hi: int) -> str:
    return _TREND.replace("{lo}", str(lo)).replace("{hi}", str(hi))


_WEEK3 = _window(1704672000000000000, 1705276800000000000)
_LAST = _window(1706054400000000000, 1706659200000000000)
_TWO_RUNS = _LAST.replace("evaluated AS", "now_counts AS").replace("judged AS", "now_judged AS"
    ).replace("FROM evaluated", "FROM now_counts") + """
before_counts AS (
  SELECT fingerprint, count(*) AS occurrence_count,
    count(DISTINCT task_identity) AS canonical_task_count,
    count(DISTINCT CAST(timezone('Europe/London', timezone('UTC',
      make_timestamp(occurred_at_ns // 1000))) AS DATE)) AS local_day_count
  FROM records WHERE occurred_at_ns BETWEEN 1704672000000000000 AND 1705276800000000000
  GROUP BY fingerprint),
prior AS (
  SELECT fingerprint FROM before_counts WHERE (occurrence_count >= 3
    AND canonical_task_count >= 2 AND local_day_count >= 2)
    OR (occurrence_count >= 5 AND canonical_task_count >= 3)),
both_runs AS (
  SELECT coalesce(n.fingerprint, p.fingerprint) AS fingerprint,
    p.fingerprint IS NOT NULL AS was_actionable, coalesce(occurrence_count, 0)
      AS occurrence_count, coalesce(canonical_task_count, 0) AS canonical_task_count,
    coalesce(local_day_count, 0) AS local_day_count, coalesce(trend_state, 'dormant')
      AS trend_state
  FROM now_judged n FULL JOIN prior p USING (fingerprint)),
"""
_MIDDLE_NS = 1_705_276_800_000_000_000


@query("trend_evaluation", sql("""SELECT fingerprint, occurrence_count, canonical_task_count,
  local_day_count, 1706054400000000000 AS window_started_at_ns,
  1706659200000000000 AS window_ended_at_ns FROM evaluated""", _LAST))
def trend_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.trend_evaluation(records(spark, sf_dir), views.NOW_NS, key="fingerprint")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    none = rows.select("fingerprint").where("false")
    before = observations.trend_states(rows, none, _MIDDLE_NS, key="fingerprint")
    prior = observations.previously_actionable(before, "fingerprint")
    return observations.trend_states(rows, prior, views.NOW_NS, key="fingerprint")


@query("trend_states", sql("SELECT * FROM both_runs", _TWO_RUNS))
def trend_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).drop("window_started_at_ns", "window_ended_at_ns")


@query("previously_actionable", sql(
    "SELECT fingerprint FROM judged WHERE trend_state = 'actionable'", _WEEK3))
def previously_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return observations.previously_actionable(observations.trend_states(
        rows, rows.select("fingerprint").where("false"), _MIDDLE_NS, key="fingerprint"),
        "fingerprint")


@query("trend_append", sql("""SELECT sha256(fingerprint || chr(31) || 'run-1') AS evaluation_id,
  'run-1' AS scan_run_id, fingerprint AS finding_id, trend_state, occurrence_count,
  1706054400000000000 AS window_started_at_ns, 1706659200000000000 AS window_ended_at_ns,
  canonical_task_count, local_day_count, 'deterministic seven-day trend thresholds' AS rationale
  FROM both_runs""", _TWO_RUNS))
def trend_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.trend_append(
        _states(spark, sf_dir).withColumnRenamed("fingerprint", "finding_id"), "run-1")


@query("promotions", sql("""SELECT fingerprint FROM both_runs
  WHERE trend_state = 'actionable' AND NOT was_actionable""", _TWO_RUNS))
def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.promotions(_states(spark, sf_dir)).select("fingerprint")


@query("promotion_history", f"""WITH {DERIVED_SQL}, s AS (
  SELECT entity_id, event_id, state, lag(state) OVER (PARTITION BY entity_id
    ORDER BY entity_version, timestamp_ns, event_id) AS previous_state
  FROM derived WHERE event_name <> 'introspection.observation.detected')
SELECT entity_id, event_id, previous_state FROM s
WHERE state = 'actionable' AND coalesce(previous_state, '') <> 'actionable'""")
def promotion_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = finding_events(spark, sf_dir).where(
        F.col("event_name") != "introspection.observation.detected").withColumn(
        "trend_state", F.col("attributes_string")["trend.state"])
    return observations.promotion_history(
        states, "entity_id", ["entity_version", "timestamp_ns", "event_id"]).select(
        "entity_id", "event_id", "previous_state")


@query("finding_update", sql("""SELECT r.fingerprint, coalesce(b.trend_state, 'isolated')
    AS trend_state, b.occurrence_count, b.canonical_task_count, b.local_day_count,
  CAST(versions + CASE WHEN b.fingerprint IS NOT NULL THEN 1 ELSE 0 END AS INTEGER)
    AS entity_version
  FROM (SELECT fingerprint, count(DISTINCT occurred_at_ns < 1705276800000000000) AS versions
    FROM records GROUP BY fingerprint) r LEFT JOIN both_runs b USING (fingerprint)""", _TWO_RUNS))
def finding_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _findings(spark, sf_dir)[1]
    evaluated = _states(spark, sf_dir).withColumn(
        "finding_id", C.finding_id(F.col("fingerprint"))).drop("fingerprint")
    updated = observations.finding_update(findings, evaluated)
    return updated.select("fingerprint", "trend_state", "occurrence_count",
                          "canonical_task_count", "local_day_count", "entity_version")


@query("failure_trends", sql("""SELECT fingerprint, occurrence_count, canonical_task_count,
  local_day_count, trend_state FROM judged JOIN (SELECT DISTINCT fingerprint FROM records
    WHERE detector_id = 'tool_failure') USING (fingerprint)""", _LAST))
def failure_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.failure_trends(views.events_plan(spark, sf_dir), views.NOW_NS).select(
        "fingerprint", "occurrence_count", "canonical_task_count", "local_day_count",
        "trend_state")
