"""Review sessions, proposals, audits and display gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.detection import records
from checks.prelude import RECORD_CTES, sql
from checks.registry import query
from checks.tables import (
    DERIVED_SQL, HISTORY_SQL, OUTBOX_SQL, REVIEW_SQL, RUNS_SQL, finding_events, model_runs,
    outbox, proposal_history, proposals, review_sessions, runs,
)
from tracefold.functions import constants as K
from tracefold.operators import audit, proposals as P, review
from tracefold.plans import gates


@query("classification_candidates", sql("""SELECT observation_id, occurred_at_ns FROM records
  WHERE detector_id <> 'tool_failure' ORDER BY occurred_at_ns, observation_id LIMIT 10""",
    RECORD_CTES))
def classification_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    done = rows.where("detector_id = 'tool_failure'").select(
        F.col("observation_id").alias("candidate_id"))
    return review.classification_candidates(rows, done).select("observation_id",
                                                               "occurred_at_ns")


@query("proposal_candidates", f"""WITH {DERIVED_SQL} SELECT event_id AS finding_id,
  timestamp_ns AS last_seen_ns FROM derived WHERE state = 'actionable' AND entity_version > 1
ORDER BY timestamp_ns, event_id LIMIT 1""")
def proposal_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finding_events(spark, sf_dir)
    findings = rows.select(
        F.col("event_id").alias("finding_id"), F.col("timestamp_ns").alias("last_seen_ns"),
        F.col("attributes_string")["trend.state"].alias("trend_state"))
    proposed = rows.where("entity_version = 1").select(F.col("event_id").alias("finding_id"))
    return review.proposal_candidates(findings, proposed).select("finding_id", "last_seen_ns")


_BATCHES = """WITH c AS (
  SELECT 'c' || o_orderkey AS candidate_id, CASE WHEN o_custkey % 5 = 0 THEN 'proposal'
      ELSE 'classification' END AS purpose, epoch_us(o_orderdate) * 1000 AS created_ns,
    '{"id":"c' || o_orderkey || '","note":"' || repeat('x', CASE WHEN o_orderkey % 97 = 0
      THEN 3000 ELSE 5 END * CASE WHEN o_custkey % 5 = 0 THEN 20 ELSE 1 END) || '"}' AS payload
  FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY created_ns, candidate_id) - 1
    AS nth, CASE purpose WHEN 'proposal' THEN 1 ELSE 10 END AS per FROM c),
s AS (SELECT purpose, nth // per AS session_no, string_agg(candidate_id, ',' ORDER BY nth) AS ids,
    CAST(count(*) AS INTEGER) AS candidate_count, '{"candidates":[' || string_agg(payload, ','
      ORDER BY nth) || '],"purpose":"' || purpose || '"}' AS body FROM n GROUP BY 1, 2)
SELECT purpose, session_no, session_no // CASE purpose WHEN 'proposal' THEN 8 ELSE 4 END
    AS batch_no, ids, candidate_count, CAST(length(body) AS INTEGER) AS characters,
  sha256(body) AS payload_hash, CASE WHEN length(body) > CASE purpose WHEN 'proposal' THEN 48000
    ELSE 24000 END THEN 'review payload exceeds input character limit' END AS fault FROM s"""


@query("review_batches", _BATCHES)
def review_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("c"), key.cast("string"))
    size = F.when(key % 97 == 0, 3000).otherwise(5) * F.when(cust % 5 == 0, 20).otherwise(1)
    candidates = views.table(spark, sf_dir, "orders").select(
        name.alias("candidate_id"),
        F.when(cust % 5 == 0, F.lit("proposal")).otherwise(F.lit("classification"))
        .alias("purpose"), views.ns("o_orderdate").alias("created_ns"),
        F.concat(F.lit('{"id":"'), name, F.lit('","note":"'), F.repeat(F.lit("x"), size),
                 F.lit('"}')).alias("payload"))
    return review.review_batches(candidates).select(
        "purpose", "session_no", "batch_no",
        F.array_join("ordered_candidate_ids", ",").alias("ids"), "candidate_count", "characters",
        "payload_hash", "fault")


@query("duplicate_candidates", """SELECT purpose, candidate_id, count(*) AS n FROM (
  SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'proposal' ELSE 'classification' END AS purpose,
    'c' || l_orderkey || '-' || l_linenumber AS candidate_id FROM lineitem)
GROUP BY purpose, candidate_id HAVING count(*) > 1""")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.duplicate_candidates(views.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 2 == 0, F.lit("proposal")).otherwise(
            F.lit("classification")).alias("purpose"),
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("candidate_id")))


@query("batch_faults", f"""WITH {REVIEW_SQL}, p AS (
  SELECT batch_id, purpose, count(*) AS n, sum(candidate_count) AS items FROM (
    SELECT * REPLACE ('b' || (conv_id // 24) AS batch_id) FROM sessions) GROUP BY ALL)
SELECT batch_id, CASE WHEN n > CASE purpose WHEN 'classification' THEN 4 WHEN 'proposal' THEN 8 END
    THEN purpose || ' model call limit exhausted'
  ELSE purpose || ' candidate limit exhausted' END AS fault FROM p
WHERE n > CASE purpose WHEN 'classification' THEN 4 WHEN 'proposal' THEN 8 END
  OR items > CASE purpose WHEN 'classification' THEN 40 WHEN 'proposal' THEN 8 END
UNION ALL SELECT batch_id, 'combined model call limit exhausted' FROM p GROUP BY batch_id
HAVING sum(n) > 12""")
def batch_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = review_sessions(spark, sf_dir).withColumn("batch_id", F.concat(
        F.lit("b"), F.call_function("div", F.col("conv_id"), F.lit(24)).cast("string")))
    return review.batch_faults(wide)


_VALIDATE = f"""WITH {REVIEW_SQL}, docs AS (
  SELECT *, conv_id % 16 AS m FROM sessions),
judged AS (
  SELECT id AS session_id, purpose, ids, m, conv_id, reserved_model_budget,
    CASE WHEN m = 1 THEN 'missing model output fields' WHEN m = 2 THEN 'unknown review session'
      WHEN m = 3 THEN 'model output nonce mismatch'
      WHEN m = 4 THEN 'model output payload_hash mismatch'
      WHEN status <> 'exported' AND m <> 15 THEN 'review session has already been imported'
      WHEN m = 7 THEN 'model provenance mismatch'
      WHEN m = 11 THEN 'model output candidate IDs or ordering mismatch'
      WHEN purpose = 'capability_probe' THEN 'review session purpose cannot import results'
    END AS reject_reason FROM docs)"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned documents with one planted fault per session number, and their verdicts."""
    s = review_sessions(spark, sf_dir)
    m = F.col("conv_id") % 16
    text = F.lit
    sessions = s.withColumns({
        "nonce": F.concat(text("n"), "id"), "schema_version": text(1),
        "requested_model": text("model-a"), "requested_effort": text("high"),
        "payload_hash": F.sha2("id", 256),
        "status": F.when(m == 15, text("exported")).otherwise(F.col("status"))})
    results = sessions.select(
        F.when(m == 2, F.concat(text("other-"), "id")).otherwise(F.col("id"))
        .alias("session_id"), "conv_id",
        F.when(m == 3, text("x")).when(m != 1, F.col("nonce")).alias("nonce"), "schema_version",
        F.when(m == 4, text("x")).otherwise(F.col("payload_hash")).alias("payload_hash"),
        "requested_model", "requested_effort",
        F.when(m == 11, F.reverse("ordered_candidate_ids")).otherwise(
            F.col("ordered_candidate_ids")).alias("result_ids"),
        text(100).alias("document_characters"))
    provenance = sessions.select(
        F.col("id").alias("session_id"),
        F.when(m == 7, text("model-b")).otherwise(text("model-a")).alias("model"),
        text("high").alias("effort"), text("tr").alias("trace_id"),
        (F.col("reserved_model_budget") - 1).alias("token_count"))
    return review.validate_results(results, sessions, provenance)


@query("validate_results", _VALIDATE + """ SELECT conv_id, reject_reason FROM judged""")
def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("conv_id", "reject_reason")


@query("import_results", _VALIDATE + """ SELECT CASE purpose WHEN 'classification'
  THEN 'semantic_classification' ELSE 'proposal_draft' END AS fact,
  session_id AS review_session_id, unnest(string_split(ids, ',')) AS candidate_id
FROM judged WHERE reject_reason IS NULL""")
def import_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.import_results(_validated(spark, sf_dir))


@query("budget_balance", _VALIDATE + """ SELECT s.id AS review_session_id,
  s.reserved_model_budget - CASE WHEN j.reject_reason IS NULL THEN s.reserved_model_budget - 1
    ELSE 0 END AS remaining FROM sessions s JOIN judged j ON j.session_id = s.id""")
def budget_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _validated(spark, sf_dir).where("reject_reason is null")
    return review.budget_balance(review.budget_ledger(review_sessions(spark, sf_dir), accepted))


@query("token_usage", f"""WITH {REVIEW_SQL}, g AS (
  SELECT *, (input_tokens IS NOT NULL)::INT + (output_tokens IS NOT NULL)::INT
    + (reasoning_tokens IS NOT NULL)::INT AS given FROM model_runs)
SELECT id, CASE given WHEN 3 THEN 'complete' WHEN 0 THEN 'unavailable' ELSE 'partial' END
    AS token_availability,
  CASE WHEN given = 3 THEN input_tokens + output_tokens + reasoning_tokens END AS known_total,
  CASE WHEN given = 3 AND total_tokens <> input_tokens + output_tokens + reasoning_tokens
      THEN 'total_tokens must equal known token components'
    WHEN given IN (1, 2) AND total_tokens IS NOT NULL
      THEN 'total_tokens is unavailable when token components are partial'
    WHEN given = 0 AND total_tokens IS NOT NULL
      THEN 'total_tokens is unavailable without token components' END AS fault FROM g""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.token_usage(model_runs(spark, sf_dir)).select(
        "id", "token_availability", "known_total", "fault")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_runs(spark, sf_dir).select("review_session_id")


@query("review_activity", f"""WITH {REVIEW_SQL} SELECT purpose,
  count(DISTINCT s.id) AS session_count, count(*) AS result_count
FROM sessions s JOIN turns t ON t.session_id = s.id
WHERE status = 'imported' AND purpose <> 'capability_probe' GROUP BY purpose""")
def review_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_activity(review_sessions(spark, sf_dir), _results(spark, sf_dir))


_SNAPSHOT_ID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4)
  || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) FROM (SELECT sha256('review' || chr(31)
  || 'review-activity' || chr(31) || entity_version || chr(31) || entity_version || chr(31)
  || 'introspection.review.activity_snapshot') AS h))"""


@query("activity_snapshots", f"""WITH {REVIEW_SQL}, t AS (
  SELECT id AS trigger_id, created_ns, row_number() OVER (ORDER BY created_ns, id) + 99
    AS entity_version FROM sessions WHERE conv_id % 5 <> 0)
SELECT trigger_id, entity_version, {_SNAPSHOT_ID} AS id,
  (SELECT count(*) FROM sessions WHERE status = 'imported' AND purpose = 'classification')
    AS classification_session_count,
  (SELECT count(*) FROM sessions s JOIN turns u ON u.session_id = s.id
    WHERE status = 'imported' AND purpose = 'proposal') AS proposal_result_count FROM t""")
def activity_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = review_sessions(spark, sf_dir)
    triggers = sessions.select(
        F.lit("review_session").alias("trigger_kind"), F.col("id").alias("trigger_id"),
        F.lit(1).alias("trigger_version"), "created_ns", "conv_id")
    stored = triggers.where("conv_id % 5 = 0").withColumn(
        "entity_version", F.lit(99).cast("bigint"))
    totals = review.activity_totals(review.review_activity(sessions, _results(spark, sf_dir)))
    return review.activity_snapshots(triggers.drop("conv_id"), totals, stored).select(
        "trigger_id", "entity_version", "id", "classification_session_count",
        "proposal_result_count")


@query("session_events", f"""WITH {REVIEW_SQL}
SELECT id AS entity_id, CAST(1 AS BIGINT) AS entity_version, created_ns AS timestamp_ns,
  'exported' AS status, 'not_applicable' AS availability, CAST(NULL AS DOUBLE) AS total
FROM sessions
UNION ALL SELECT s.id, 2, imported_ns, 'imported', CASE WHEN input_tokens IS NULL
    THEN 'unavailable' WHEN output_tokens IS NULL THEN 'partial' ELSE 'complete' END,
  CAST(input_tokens + output_tokens + reasoning_tokens AS DOUBLE)
FROM sessions s JOIN model_runs r ON r.review_session_id = s.id AND ends_with(r.id, '-1')
WHERE s.status = 'imported'""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = model_runs(spark, sf_dir).where("id like '%-1'")
    text, number = F.col("attributes_string"), F.col("attributes_number")
    return review.session_events(review_sessions(spark, sf_dir), second).select(
        "entity_id", "entity_version", "timestamp_ns", text["review.status"].alias("status"),
        text["review.token.availability"].alias("availability"),
        number["review.token.total"].alias("total"))


@query("capability_gaps", """WITH proofs AS (
  SELECT 'model-' || (c_custkey % 40) AS model, CASE c_custkey % 3 WHEN 0 THEN 'high'
    ELSE 'medium' END AS effort, 'v' || (c_custkey % 2) AS tool_version,
    c_custkey * 86400000000000 AS proven_ns FROM customer),
required AS (SELECT DISTINCT 'model-' || (s_suppkey % 50) AS model, 'high' AS effort
  FROM supplier)
SELECT model, effort FROM required ANTI JOIN (SELECT * FROM proofs WHERE tool_version = 'v1'
  AND proven_ns + 30 * 86400000000000 > 100 * 86400000000000) USING (model, effort)""")
def capability_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("c_custkey"), lambda c: c.cast("string")
    proofs = views.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("model-"), text(key % 40)).alias("model"),
        F.when(key % 3 == 0, F.lit("high")).otherwise(F.lit("medium")).alias("effort"),
        F.concat(F.lit("v"), text(key % 2)).alias("tool_version"),
        F.lit("f").alias("schema_fingerprint"),
        # a day per key passes the range of a long within 107,000 keys
        (key.cast("decimal(20,0)") * K.NS_PER_DAY).alias("proven_ns"))
    required = views.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("model-"), text(F.col("s_suppkey") % 50)).alias("model"),
        F.lit("high").alias("effort")).distinct()
    return review.capability_gaps(proofs, required, 100 * K.NS_PER_DAY, "v1", "f")


# ---- proposals --------------------------------------------------------------------------------

@query("proposal_state", f"""WITH {HISTORY_SQL} SELECT proposal_id, CASE event_type
  WHEN 'created' THEN 'pending' ELSE event_type END AS state, sequence AS entity_version,
  created_ns AS updated_ns FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id
    ORDER BY sequence DESC) AS r FROM history) WHERE r = 1""")
def proposal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.proposal_state(proposal_history(spark, sf_dir))


@query("invalid_transitions", f"""WITH {HISTORY_SQL}, h AS (
  SELECT a.*, CASE a.event_type WHEN 'created' THEN 'pending' ELSE a.event_type END AS state,
    CASE b.event_type WHEN 'created' THEN 'pending' ELSE b.event_type END AS from_state
  FROM history a LEFT JOIN history b ON b.proposal_id = a.proposal_id
    AND b.sequence = a.sequence - 1),
f AS (SELECT proposal_id, sequence, from_state, state,
    CASE WHEN sequence > 1 AND from_state IS NULL THEN 'sequence gap'
      WHEN sequence > 1 AND (from_state, state) NOT IN (('pending', 'approved'),
        ('pending', 'rejected'), ('approved', 'applying'), ('applying', 'applied'),
        ('applying', 'implementation_failed')) THEN 'invalid proposal transition'
      WHEN state = 'applying' AND NOT explicit_request
        THEN 'entering applying requires a separate explicit user request'
      WHEN state = 'applied' AND NOT validation
        THEN 'validation evidence is required before marking applied' END AS fault FROM h)
SELECT * FROM f WHERE fault IS NOT NULL""")
def invalid_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.invalid_transitions(proposal_history(spark, sf_dir))


def _tiers(flags: list, labels: tuple[str, ...]) -> F.Column:
    return F.array(*(
        F.struct(F.lit(label).alias("tier"), can.alias("can_enforce"),
                 reason.alias("reason_unavailable"))
        for label, (can, reason) in zip(labels, flags, strict=True)))


@query("proposal_eligibility", """WITH p AS (SELECT o_orderkey, o_custkey, o_orderkey % 8 AS m,
    CASE o_orderstatus WHEN 'F' THEN 'actionable' WHEN 'O' THEN 'emerging' END AS state
  FROM orders)
SELECT 'p' || o_orderkey AS proposal_id, CASE
  WHEN m = 1 THEN 'established-tool audit must evaluate the canonical tier order'
  WHEN m = 2 THEN 'each deterministic enforcement tier requires can_enforce'
  WHEN m = 3 THEN 'an available enforcement tier cannot be unavailable'
  WHEN m = 4 THEN 'each unavailable enforcement tier requires a recorded reason'
  WHEN m = 5 THEN 'a proposal can select only one deterministic enforcement tier'
  WHEN state IS NULL THEN 'unknown finding'
  WHEN state <> 'actionable' THEN 'only actionable findings can produce proposals' END AS fault
FROM p""")
def proposal_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, m = F.col("o_orderkey"), F.col("o_orderkey") % 8
    orders = views.table(spark, sf_dir, "orders")
    yes, no, why = F.lit(True), F.lit(False), F.lit("not expressible")
    none = F.lit(None).cast("string")
    flags = [
        (F.when(m == 2, F.lit(None)).otherwise(yes), F.when(m == 3, why).otherwise(none)),
        (F.when(m == 5, yes).otherwise(no), F.when(m == 5, none).when(m == 4, F.lit(""))
         .otherwise(why)), (no, why)]
    tiers = F.when(m == 1, _tiers(flags, K.TIER_LABELS[::-1])).otherwise(
        _tiers(flags, K.TIER_LABELS))
    rows = orders.select(
        F.concat(F.lit("p"), key.cast("string")).alias("proposal_id"), key.alias("finding_id"),
        tiers.alias("tiers"))
    findings = orders.where("o_orderstatus in ('F', 'O')").select(
        key.alias("finding_id"), F.when(F.col("o_orderstatus") == "F", F.lit("actionable"))
        .otherwise(F.lit("emerging")).alias("trend_state"))
    return P.proposal_eligibility(rows, findings).select("proposal_id", "fault")


@query("select_intervention", """WITH d AS (SELECT o_orderkey, o_orderkey % 9 AS m, o_custkey % 4
    AS s FROM orders)
SELECT o_orderkey AS decision_id, CASE m WHEN 0 THEN 'established_tool' WHEN 1 THEN 'new_tool'
    WHEN 2 THEN 'bespoke_script' WHEN 3 THEN 'improve_skill' WHEN 4 THEN 'create_skill'
    ELSE CASE WHEN s < 3 THEN 'agents_guidance' END END AS intervention_type,
  CASE WHEN m = 3 THEN 'owner-' || s WHEN m > 4 THEN CASE s WHEN 0 THEN 'folder guidance'
    WHEN 1 THEN 'project guidance' WHEN 2 THEN '~/.codex/AGENTS.md' END END AS guidance_scope,
  CASE m WHEN 0 THEN 'Established tools of a project first. can represent the behavior deterministically'
    WHEN 1 THEN 'New tools second. can represent the behavior deterministically'
    WHEN 2 THEN 'Bespoke scripts third. can represent the behavior deterministically'
    WHEN 3 THEN 'the owning workflow skill must be improved through $create-skill'
    WHEN 4 THEN 'the repeated ordered workflow has no owner and requires $create-skill'
    ELSE 'cross-workflow behavior belongs in ' || CASE s WHEN 0 THEN 'folder guidance'
      WHEN 1 THEN 'project guidance' WHEN 2 THEN '~/.codex/AGENTS.md' END END AS rationale
FROM d""")
def select_intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = F.col("o_orderkey") % 9, F.col("o_custkey") % 4
    scopes = F.array(*map(F.lit, ("folder", "project", "cross-project", "other")))
    decisions = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("decision_id"),
        F.array(m == 0, m.isin(0, 1), m.isin(0, 1, 2)).alias("can_enforce"),
        F.when(m == 3, F.concat(F.lit("owner-"), s.cast("string")))
        .alias("workflow_owner_skill"), m.isin(3, 4).alias("repeated_ordered_workflow"),
        F.element_at(scopes, (s + 1).cast("int")).alias("recurrence_scope"))
    return P.select_intervention(decisions).select(
        "decision_id", "intervention_type", "guidance_scope", "rationale")


@query("proposal_list", f"""WITH {HISTORY_SQL}, s AS (
  SELECT proposal_id, max_by(CASE event_type WHEN 'created' THEN 'pending' ELSE event_type END,
    sequence) AS state, max_by(created_ns, sequence) AS updated_ns FROM history
  GROUP BY proposal_id)
SELECT proposal_id, finding_id, state, p.created_ns, updated_ns
FROM proposals p JOIN s USING (proposal_id)""")
def proposal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.proposal_list(proposal_history(spark, sf_dir), proposals(spark, sf_dir))


@query("proposal_history", f"""WITH {HISTORY_SQL} SELECT a.*, b.event_type AS previous_event
FROM history a LEFT JOIN history b ON b.proposal_id = a.proposal_id
  AND b.sequence = a.sequence - 1""")
def proposal_history_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.proposal_history(proposal_history(spark, sf_dir))


@query("proposal_events", f"""WITH {HISTORY_SQL} SELECT proposal_id AS entity_id,
  sequence AS entity_version, h.created_ns AS timestamp_ns, CASE event_type WHEN 'created'
    THEN 'pending' ELSE event_type END AS state, proposal_scope AS scope, intervention_type,
  finding_id, detector_id FROM history h JOIN proposals p USING (proposal_id)""")
def proposal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("attributes_string")
    made = P.proposal_events(proposal_history(spark, sf_dir), proposals(spark, sf_dir))
    return made.select(
        "entity_id", "entity_version", "timestamp_ns", text["proposal.state"].alias("state"),
        text["proposal.scope"].alias("scope"), text["intervention.type"]
        .alias("intervention_type"), text["finding.id"].alias("finding_id"),
        text["detector.id"].alias("detector_id"))


# ---- audits -------------------------------------------------------------------------------------

_SLOT_NOW = 907_374_000 * K.NS_PER_SECOND  # 1998-10-03 00:20:00


@query("slot_status", f"""WITH {RUNS_SQL} SELECT id AS run_id, started_ns,
  {_SLOT_NOW} // 3600000000000 * 3600 AS slot_start FROM runs
WHERE status IN ('succeeded', 'no_data') AND started_ns // 3600000000000
  = {_SLOT_NOW} // 3600000000000 ORDER BY started_ns DESC, id DESC LIMIT 1""")
def slot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.slot_status(runs(spark, sf_dir), _SLOT_NOW)


@query("slot_coverage", f"""WITH {RUNS_SQL} SELECT started_ns // 3600000000000 * 3600
    AS slot_start, count(*) AS n_runs,
  count(*) FILTER (status IN ('succeeded', 'no_data')) AS n_completed,
  bool_or(status IN ('succeeded', 'no_data')) AS covered FROM runs GROUP BY 1""")
def slot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.slot_coverage(runs(spark, sf_dir))


@query("interrupted_runs", f"""WITH {RUNS_SQL} SELECT id, sequence,
  CASE status WHEN 'running' THEN 'failed' ELSE status END AS status, started_ns,
  CASE status WHEN 'running' THEN {views.NOW_NS} ELSE completed_ns END AS completed_ns,
  rows_processed, CASE status WHEN 'running' THEN 'interrupted' ELSE error_code END AS error_code
FROM runs""")
def interrupted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interrupted_runs(runs(spark, sf_dir), views.NOW_NS)


@query("latest_terminal_run", f"""WITH {RUNS_SQL} SELECT id, status, started_ns, completed_ns,
  error_code FROM runs WHERE status <> 'running'
ORDER BY completed_ns DESC, started_ns DESC, id DESC LIMIT 1""")
def latest_terminal_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latest_terminal_run(runs(spark, sf_dir))


@query("referential_audit", """SELECT 'labels.doc_id' AS reference, count(DISTINCT doc_id)
    AS orphan_keys, count(*) AS orphan_rows FROM labels
  WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')
UNION ALL SELECT 'lineitem.l_orderkey', count(DISTINCT l_orderkey), count(*) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'orders.o_custkey', count(DISTINCT o_custkey), count(*) FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def referential_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: views.table(spark, sf_dir, n) for n in (
        "labels", "documents", "lineitem", "orders", "customer")}
    return audit.referential_audit({
        "labels.doc_id": (t["labels"], "doc_id", t["documents"].where("lang <> 'en'"), "doc_id"),
        "lineitem.l_orderkey": (t["lineitem"], "l_orderkey",
                                t["orders"].where("o_orderstatus <> 'P'"), "o_orderkey"),
        "orders.o_custkey": (t["orders"], "o_custkey", t["customer"], "c_custkey")})


@query("immutability_audit", """SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n_rows
FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1""")
def immutability_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "lineitem").withColumn(
        "key", F.col("l_orderkey").cast("string"))
    return audit.immutability_audit(rows, "key", ["l_returnflag", "l_linestatus"])


@query("domain_audit", f"""WITH {RUNS_SQL}, {OUTBOX_SQL}
SELECT 'runs.' || rule AS rule, violations FROM (SELECT 'status' AS rule, count(*) FILTER (NOT
    status IN ('running', 'succeeded', 'no_data', 'failed')) AS violations FROM runs
  UNION ALL SELECT 'rows_processed', count(*) FILTER (rows_processed - 100 < 0) FROM runs
  UNION ALL SELECT 'completed_after_start', count(*) FILTER (completed_ns < started_ns) FROM runs)
UNION ALL SELECT 'outbox.' || rule, violations FROM (SELECT 'status' AS rule, 0 AS violations
  UNION ALL SELECT 'attempt_count', count(*) FILTER (attempt_count - 2 < 0) FROM outbox
  UNION ALL SELECT 'payload_json', count(*) FILTER (attempt_count = 3) FROM outbox
  UNION ALL SELECT 'delivered_has_time', 0)""")
def domain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = runs(spark, sf_dir).withColumn("rows_processed", F.col("rows_processed") - 100)
    ours = audit.domain_audit(shifted, audit.scan_run_rules())
    broken = outbox(spark, sf_dir).withColumn("payload_json", F.when(
        F.col("attempt_count") == 3, F.lit('{"a":')).otherwise(F.lit('{"a":1}'))).withColumn(
        "attempt_count", F.col("attempt_count") - 2)
    theirs = audit.domain_audit(broken, audit.outbox_rules())
    label = lambda df, p: df.withColumn("rule", F.concat(F.lit(p), "rule"))
    return label(ours, "runs.").unionByName(label(theirs, "outbox."))


# ---- display gates ----------------------------------------------------------------------------

@query("project_concentration", sql("""SELECT project_identity_id, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(project_identity_id) FROM records), 2) AS share_pct
  FROM records WHERE project_identity_id IS NOT NULL GROUP BY project_identity_id
  HAVING (SELECT count(project_identity_id) * 100 >= count(*) * 80 FROM records)""", RECORD_CTES))
def project_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.project_concentration(records(spark, sf_dir))


@query("pending_reviews", f"""WITH {REVIEW_SQL} SELECT purpose, count(*) AS pending,
  (1000000000000 - min(created_ns)) / 3600000000000::DOUBLE AS oldest_hours,
  count(*) >= 3 OR (1000000000000 - min(created_ns)) / 3600000000000::DOUBLE > 168 AS shown
FROM sessions WHERE status = 'exported' GROUP BY purpose""")
def pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.pending_reviews(review_sessions(spark, sf_dir), 1_000_000_000_000)


@query("outcomes_by_intervention", f"""WITH {HISTORY_SQL}, s AS (
  SELECT proposal_id, max_by(event_type, sequence) AS state FROM history GROUP BY proposal_id)
SELECT intervention_type, state, count(*) AS n FROM proposals JOIN s USING (proposal_id)
WHERE state IN ('applied', 'rejected', 'implementation_failed') GROUP BY ALL""")
def outcomes_by_intervention(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = P.proposal_state(proposal_history(spark, sf_dir)).select("proposal_id", "state")
    return gates.outcomes_by_intervention(proposals(spark, sf_dir).join(state, "proposal_id"))


@query("token_ledger", f"""WITH {REVIEW_SQL} SELECT review_session_id, count(*) AS runs,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM model_runs GROUP BY review_session_id""")
def token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.token_ledger(model_runs(spark, sf_dir))


@query("application_change", sql("""SELECT application_id, baseline_slots, follow_up_slots,
  baseline_count, follow_up_count, baseline_slots >= 152 AND follow_up_slots >= 152 AS evaluable
FROM (SELECT a.fingerprint AS application_id,
  (SELECT count(DISTINCT slot) FROM slots s WHERE s.slot >= a.at - 168 AND s.slot < a.at)
    AS baseline_slots,
  (SELECT count(DISTINCT slot) FROM slots s WHERE s.slot >= a.at AND s.slot < a.at + 168)
    AS follow_up_slots,
  (SELECT count(*) FROM records r WHERE r.fingerprint = a.fingerprint
    AND r.occurred_at_ns // 3600000000000 >= a.at - 168
    AND r.occurred_at_ns // 3600000000000 < a.at) AS baseline_count,
  (SELECT count(*) FROM records r WHERE r.fingerprint = a.fingerprint
    AND r.occurred_at_ns // 3600000000000 >= a.at
    AND r.occurred_at_ns // 3600000000000 < a.at + 168) AS follow_up_count
  FROM apps a)""", RECORD_CTES + """
slots AS (SELECT DISTINCT timestamp_ns // 3600000000000 AS slot FROM ev WHERE k < 95),
apps AS (SELECT fingerprint, max(occurred_at_ns) // 3600000000000 AS at FROM records
  GROUP BY fingerprint),"""))
def application_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    hour = 3600 * K.NS_PER_SECOND
    applications = rows.groupBy("fingerprint").agg(
        (F.call_function("div", F.max("occurred_at_ns"), F.lit(hour)) * hour)
        .alias("applied_ns")).withColumn("application_id", F.col("fingerprint"))
    done = views.ev(spark, sf_dir).where("k < 95").select(
        F.lit("succeeded").alias("status"), F.col("timestamp_ns").alias("started_ns"))
    return gates.application_change(applications, rows, done)
