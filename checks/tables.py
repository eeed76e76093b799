"""Adapter tables for runs, outbox, sessions, proposals and derived events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import ns, once, table
from tracefold.functions import constants as K

_S = K.NS_PER_SECOND

RUNS_SQL = """runs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS sequence,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'failed'
      WHEN '3-MEDIUM' THEN 'no_data' ELSE 'succeeded' END AS status,
    epoch_us(o_orderdate) * 1000 + o_orderkey % 1440 * 60000000000 AS started_ns,
    CASE WHEN o_orderpriority <> '1-URGENT' THEN epoch_us(o_orderdate) * 1000
      + (o_orderkey % 1440 + o_custkey % 90) * 60000000000 END AS completed_ns,
    o_custkey AS rows_processed,
    CASE WHEN o_orderpriority = '2-HIGH' THEN 'processing' END AS error_code FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    day, minute = ns("o_orderdate"), 60 * _S
    started = day + F.col("o_orderkey") % 1440 * minute
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("sequence"),
        F.when(priority == "1-URGENT", F.lit("running")).when(
            priority == "2-HIGH", F.lit("failed")).when(
            priority == "3-MEDIUM", F.lit("no_data")).otherwise(F.lit("succeeded"))
        .alias("status"), started.alias("started_ns"),
        F.when(priority != "1-URGENT", started + F.col("o_custkey") % 90 * minute)
        .alias("completed_ns"), F.col("o_custkey").alias("rows_processed"),
        F.when(priority == "2-HIGH", F.lit("processing")).alias("error_code"))


OUTBOX_SQL = """outbox AS (
  SELECT 'e' || o_orderkey AS event_id,
    CASE WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'pending' END AS status,
    CAST(o_orderkey % 13 AS BIGINT) AS attempt_count,
    (epoch_us(o_orderdate) + o_custkey % 5 * 86400000000) * 1000 AS next_attempt_ns,
    epoch_us(o_orderdate) * 1000 AS created_ns,
    CASE WHEN o_orderstatus = 'F' THEN (epoch_us(o_orderdate) + 86400000000) * 1000 END
      AS delivered_ns FROM orders)"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = ns("o_orderdate")
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("event_id"),
        F.when(done, F.lit("delivered")).otherwise(F.lit("pending")).alias("status"),
        (F.col("o_orderkey") % 13).alias("attempt_count"),
        (day + F.col("o_custkey") % 5 * K.NS_PER_DAY).alias("next_attempt_ns"),
        day.alias("created_ns"), F.when(done, day + K.NS_PER_DAY).alias("delivered_ns"))


# Derived events: findings and observations from lineitem, snapshots from orders, review
# snapshots and activation markers from customer.
DERIVED_SQL = """li AS (
  SELECT *, epoch_us(l_shipdate) * 1000 + l_suppkey * 60000000000 AS timestamp_ns,
    'x' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
      || CAST(CAST(l_extendedprice * 100 AS BIGINT) AS VARCHAR) AS event_id FROM lineitem),
derived AS (
  SELECT event_id, CASE WHEN l_linenumber = 1 THEN 'introspection.observation.detected'
      WHEN l_linenumber = 2 THEN 'introspection.trend.promoted'
      ELSE 'introspection.trend.evaluated' END AS event_name,
    CASE WHEN l_linenumber = 1 THEN 'obs-' ELSE 'finding-' END || l_orderkey AS entity_id,
    CAST(l_linenumber AS BIGINT) AS entity_version, timestamp_ns,
    'gen-' || (l_orderkey % 3) AS generation,
    CASE l_returnflag WHEN 'A' THEN 'actionable' WHEN 'N' THEN 'emerging' ELSE 'isolated' END
      AS state,
    'detector-' || (l_suppkey % 11) AS detector,
    CASE WHEN l_partkey % 5 = 0 THEN 'unresolved' ELSE 'git:' || (l_partkey % 5) END AS project_id,
    CASE WHEN l_partkey % 5 = 0 THEN 'unresolved' WHEN l_partkey % 7 = 0 THEN ''
      ELSE 'p' || (l_partkey % 5) END AS project_name,
    'category-' || (l_partkey % 3) AS category, l_quantity AS occurrences FROM li),
active AS (
  SELECT 'gen-' || (c_custkey % 3) AS generation FROM customer
  ORDER BY c_custkey DESC LIMIT 1),
bounds AS (SELECT min(timestamp_ns) AS lo, max(timestamp_ns) AS hi FROM li),
visible AS (
  SELECT d.* FROM derived d JOIN active USING (generation)
  WHERE timestamp_ns BETWEEN 883612800000000000 AND 978307200000000000)"""
PANEL_START, PANEL_END = 883_612_800 * _S, 978_307_200 * _S


def _texts(**pairs) -> F.Column:
    entries = F.array(*(F.struct(F.lit(k.replace("__", ".")).alias("key"), v.alias("value"))
                        for k, v in pairs.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _derived(df: DataFrame, event_id, name, entity, version, at, text, numbers) -> DataFrame:
    empty = F.create_map().cast("map<string,double>")
    return df.select(
        event_id.alias("event_id"), F.lit("operational").alias("scope"),
        entity.alias("entity_id"), version.cast("bigint").alias("entity_version"),
        version.cast("bigint").alias("event_sequence"), name.alias("event_name"),
        at.cast("bigint").alias("timestamp_ns"), text.alias("attributes_string"),
        (empty if numbers is None else numbers).alias("attributes_number"),
        (F.call_function("div", at, F.lit(1800 * _S)) * 1800).alias("ts_bucket_start"))


def finding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    cents = (F.col("l_extendedprice") * 100).cast("decimal(20,4)")
    event_id = F.concat(F.lit("x"), text("l_orderkey"), F.lit("-"), text("l_linenumber"),
                        F.lit("-"), text("l_partkey"), F.lit("-"), text("l_suppkey"), F.lit("-"),
                        F.round(cents, 0).cast("bigint").cast("string"))
    name = F.when(line == 1, F.lit(K.OBSERVATION_EVENT)).when(
        line == 2, F.lit(K.TREND_PROMOTED_EVENT)).otherwise(F.lit(K.TREND_EVALUATED_EVENT))
    entity = F.concat(F.when(line == 1, F.lit("obs-")).otherwise(F.lit("finding-")),
                      text("l_orderkey"))
    fifth = (part % 5).cast("string")
    attributes = {
        "analysis__generation": F.concat(F.lit("gen-"), (F.col("l_orderkey") % 3).cast("string")),
        "trend__state": F.when(F.col("l_returnflag") == "A", F.lit("actionable")).when(
            F.col("l_returnflag") == "N", F.lit("emerging")).otherwise(F.lit("isolated")),
        "detector__id": F.concat(F.lit("detector-"), (F.col("l_suppkey") % 11).cast("string")),
        "project__id": F.when(part % 5 == 0, F.lit("unresolved")).otherwise(
            F.concat(F.lit("git:"), fifth)),
        "project__name": F.when(part % 5 == 0, F.lit("unresolved")).when(
            part % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), fifth)),
        "finding__category": F.concat(F.lit("category-"), (part % 3).cast("string")),
    }
    return _derived(
        table(spark, sf_dir, "lineitem"), event_id, name, entity, line,
        ns("l_shipdate") + F.col("l_suppkey") * 60 * _S, _texts(**attributes),
        F.create_map(F.lit("occurrence.count"), F.col("l_quantity")))


def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    attributes = {
        "pipeline__state": F.concat(F.lit("state-"), status),
        "scan__terminal_status": F.col("o_orderpriority"),
        "pipeline__freshness": F.when(F.col("o_custkey") % 2 == 0, F.lit("fresh")).otherwise(
            F.lit("late")),
        "logs__query_status": F.lit("available"), "logs__data_state": status,
        "traces__query_status": F.lit("available"),
        "traces__data_state": (F.col("o_custkey") % 4).cast("string"),
    }
    key = F.col("o_orderkey")
    return _derived(
        table(spark, sf_dir, "orders"), F.concat(F.lit("s"), key.cast("string")),
        F.lit(K.PIPELINE_EVENT), key.cast("string"), F.lit(1),
        ns("o_orderdate") + key % 1440 * 60 * _S, _texts(**attributes),
        F.create_map(F.lit("scan.duration_ms"), F.col("o_totalprice")))


def customer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    markers = _derived(
        customers, F.concat(F.lit("a"), key.cast("string")), F.lit(K.ACTIVATION_EVENT),
        key.cast("string"), key, key * _S,
        _texts(analysis__generation=F.concat(F.lit("gen-"), (key % 3).cast("string"))), None)
    number = lambda m: (key % m).cast("double")
    activity = _derived(
        customers, F.concat(F.lit("r"), key.cast("string")), F.lit(K.REVIEW_ACTIVITY_EVENT),
        F.lit("review-activity"), key, key * _S,
        _texts(review__activity__availability=F.when(key % 10 == 9, F.lit("unavailable"))
               .otherwise(F.lit("available")),
               snapshot__trigger__kind=F.when(key % 4 == 0, F.lit("")).otherwise(
                   F.lit("scan_run"))),
        F.create_map(F.lit("review.classification.session_count"), number(5),
                     F.lit("review.proposal.session_count"), number(3),
                     F.lit("review.classification.result_count"), number(50)))
    return markers.unionByName(activity)


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived-event table the panels read, written once like any stored table."""
    return once(spark, sf_dir, "derived", lambda s, d: finding_events(s, d).unionByName(
        snapshot_events(s, d)).unionByName(customer_events(s, d)))


REVIEW_SQL = """turns AS (
  SELECT 's' || conv_id AS session_id, conv_id, turn, length(text) AS n FROM conversations),
sessions AS (
  SELECT session_id AS id, conv_id, 'b' || (conv_id // 8) AS batch_id,
    CASE conv_id % 3 WHEN 0 THEN 'classification' WHEN 1 THEN 'proposal'
      ELSE 'capability_probe' END AS purpose,
    CASE WHEN conv_id % 4 = 3 THEN 'exported' ELSE 'imported' END AS status,
    CAST(count(*) AS INTEGER) AS candidate_count, CAST(conv_id AS BIGINT) * 1000000000
      AS created_ns,
    CASE WHEN conv_id % 4 <> 3 THEN CAST(conv_id + 60 AS BIGINT) * 1000000000 END AS imported_ns,
    CAST(sum(n) AS BIGINT) AS reserved_model_budget,
    string_agg('c' || turn, ',' ORDER BY turn) AS ids
  FROM turns GROUP BY session_id, conv_id),
model_runs AS (
  SELECT session_id || '-' || turn AS id, session_id AS review_session_id, 'accepted' AS status,
    CASE WHEN turn % 4 <> 3 THEN n END AS input_tokens,
    CASE WHEN turn % 4 < 2 THEN n // 2 END AS output_tokens,
    CASE WHEN turn % 4 < 2 THEN turn END AS reasoning_tokens,
    CASE WHEN turn = 0 THEN n + n // 2 WHEN turn = 4 THEN 1 WHEN turn = 6 THEN 5 END
      AS total_tokens FROM turns)"""


def review_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).cast("int").alias("candidate_count"),
        F.sum(F.length("text")).cast("bigint").alias("reserved_model_budget"),
        F.transform(F.sequence(F.lit(0), F.max("turn")),
                    lambda t: F.concat(F.lit("c"), t.cast("string")))
        .alias("ordered_candidate_ids"),
    ).select(
        F.concat(F.lit("s"), conv.cast("string")).alias("id"), "conv_id",
        F.concat(F.lit("b"), F.call_function("div", conv, F.lit(8)).cast("string"))
        .alias("batch_id"),
        F.when(conv % 3 == 0, F.lit("classification")).when(
            conv % 3 == 1, F.lit("proposal")).otherwise(F.lit("capability_probe"))
        .alias("purpose"),
        F.when(conv % 4 == 3, F.lit("exported")).otherwise(F.lit("imported")).alias("status"),
        "candidate_count", (conv * _S).alias("created_ns"),
        F.when(conv % 4 != 3, (conv + 60) * _S).alias("imported_ns"), "reserved_model_budget",
        "ordered_candidate_ids")


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, n = F.col("turn"), F.length("text").cast("bigint")
    session = F.concat(F.lit("s"), F.col("conv_id").cast("string"))
    half = F.call_function("div", n, F.lit(2))
    return table(spark, sf_dir, "conversations").select(
        F.concat(session, F.lit("-"), turn.cast("string")).alias("id"),
        session.alias("review_session_id"), F.lit("accepted").alias("status"),
        F.when(turn % 4 != 3, n).alias("input_tokens"),
        F.when(turn % 4 < 2, half).alias("output_tokens"),
        F.when(turn % 4 < 2, turn).alias("reasoning_tokens"),
        F.when(turn == 0, n + half).when(turn == 4, 1).when(turn == 6, 5).cast("bigint")
        .alias("total_tokens"))


# Proposal histories: one per order; line numbers are sequences, so gaps and wrong steps occur.
HISTORY_SQL = """history AS (
  SELECT 'p' || l_orderkey AS proposal_id, CAST(l_linenumber AS BIGINT) AS sequence,
    CASE l_linenumber WHEN 1 THEN 'created' WHEN 2 THEN CASE min(l_returnflag) WHEN 'R'
        THEN 'rejected' ELSE 'approved' END WHEN 3 THEN 'applying'
      ELSE CASE min(l_returnflag) WHEN 'A' THEN 'applied' ELSE 'implementation_failed' END END
      AS event_type,
    min(l_suppkey) % 2 = 0 AS explicit_request, min(l_partkey) % 3 = 0 AS validation,
    min(epoch_us(l_shipdate)) * 1000 AS created_ns
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
proposals AS (
  SELECT 'p' || o_orderkey AS proposal_id, 'f' || o_custkey AS finding_id,
    CASE o_custkey % 2 WHEN 0 THEN 'project' ELSE 'folder' END AS proposal_scope,
    CASE o_custkey % 3 WHEN 0 THEN 'new_tool' WHEN 1 THEN 'improve_skill'
      ELSE 'create_skill' END AS intervention_type,
    'detector-' || (o_custkey % 11) AS detector_id, epoch_us(o_orderdate) * 1000 AS created_ns
  FROM orders)"""


def proposal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, flag = F.col("l_linenumber"), F.min("l_returnflag")
    step = (
        F.when(line == 1, F.lit("created"))
        .when(line == 2, F.when(flag == "R", F.lit("rejected")).otherwise(F.lit("approved")))
        .when(line == 3, F.lit("applying"))
        .otherwise(F.when(flag == "A", F.lit("applied")).otherwise(
            F.lit("implementation_failed"))))
    return table(spark, sf_dir, "lineitem").groupBy(
        "l_orderkey", "l_linenumber").agg(
        step.alias("event_type"), (F.min("l_suppkey") % 2 == 0).alias("explicit_request"),
        (F.min("l_partkey") % 3 == 0).alias("validation"),
        F.min(ns("l_shipdate")).alias("created_ns")).select(
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("proposal_id"),
        F.col("l_linenumber").cast("bigint").alias("sequence"), "event_type",
        "explicit_request", "validation", "created_ns")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("proposal_id"),
        F.concat(F.lit("f"), cust.cast("string")).alias("finding_id"),
        F.when(cust % 2 == 0, F.lit("project")).otherwise(F.lit("folder"))
        .alias("proposal_scope"),
        F.when(cust % 3 == 0, F.lit("new_tool")).when(cust % 3 == 1, F.lit("improve_skill"))
        .otherwise(F.lit("create_skill")).alias("intervention_type"),
        F.concat(F.lit("detector-"), (cust % 11).cast("string")).alias("detector_id"),
        ns("o_orderdate").alias("created_ns"))
