"""Derived events, delivery bookkeeping and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators.ordering import hot_keys, salted_join, split_rank
from tracefold.sources.telemetry import time_range

EVENT_COLUMNS = ["event_id", "scope", "entity_id", "entity_version", "event_sequence",
                 "event_name", "timestamp_ns", "attributes_string", "attributes_number"]


def _text_map(pairs: dict[str, Column]) -> Column:
    return F.create_map(*(c for k, v in pairs.items() for c in (F.lit(k), v)))


def derived_events(df: DataFrame, scope: Column, entity: Column, version: Column,
                   sequence: Column, name: Column, ns: Column, text: dict[str, Column],
                   numbers: dict[str, Column] | None = None) -> DataFrame:
    """Versioned events with a deterministic id; one per input row."""
    empty = F.create_map().cast("map<string,double>")
    return df.select(
        C.event_id(scope, entity, version, sequence, name).alias("event_id"),
        scope.alias("scope"), entity.alias("entity_id"), version.cast("bigint").alias(
            "entity_version"), sequence.cast("bigint").alias("event_sequence"),
        name.alias("event_name"), ns.alias("timestamp_ns"),
        _text_map(text).alias("attributes_string"),
        (_text_map({k: v.cast("double") for k, v in numbers.items()}) if numbers else empty)
        .alias("attributes_number"))


def payload_json(event: DataFrame) -> Column:
    """Canonical JSON of an event: all fields and attributes, keys sorted."""
    def entry(key: Column, value: Column) -> Column:
        return F.struct(key.alias("k"), F.concat(C.json_string(key), F.lit(":"), value).alias("t"))

    fixed = F.array(*(
        entry(F.lit(k), v) for k, v in {
            "event.id": C.json_string(F.col("event_id")),
            "event.scope": C.json_string(F.col("scope")),
            "entity.id": C.json_string(F.col("entity_id")),
            "entity.version": F.col("entity_version").cast("string"),
            "event.sequence": F.col("event_sequence").cast("string"),
            "event.name": C.json_string(F.col("event_name")),
            "timestamp_ns": F.col("timestamp_ns").cast("string")}.items()))
    text = F.transform(F.map_entries("attributes_string"),
                       lambda e: entry(e["key"], C.json_string(e["value"])))
    numbers = F.transform(F.map_entries("attributes_number"),
                          lambda e: entry(e["key"], C.json_number(e["value"])))
    entries = F.array_sort(F.concat(fixed, text, numbers))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: e["t"]), ","),
                    F.lit("}"))


def with_project_names(df: DataFrame, projects: DataFrame, row_id: Column,
                       hot: DataFrame | None = None) -> DataFrame:
    names = projects.select(F.col("id").alias("project_identity_id"),
                            C.last_path_part(F.col("canonical_path")).alias("project_name"))
    return salted_join(df, names, ["project_identity_id"], row_id, hot=hot).withColumn(
        "project_name", F.coalesce("project_name", F.lit("unresolved")))


def _project_attributes() -> dict[str, Column]:
    return {"project.id": F.coalesce("project_identity_id", F.lit("unresolved")),
            "project.name": F.col("project_name")}


def observation_events(records: DataFrame, projects: DataFrame, generation: str) -> DataFrame:
    """One projection event per observation."""
    one = F.lit(1)
    named = with_project_names(records, projects, F.col("observation_id"))
    return derived_events(
        named, F.lit(f"generation:{generation}"), F.col("observation_id"), one, one,
        F.lit(K.OBSERVATION_EVENT), F.col("occurred_at_ns"),
        {"analysis.generation": F.lit(generation), "detector.id": F.col("detector_id"),
         **_project_attributes(), "finding.id": F.col("fingerprint")})


def trend_events(evaluated: DataFrame, projects: DataFrame, generation: str,
                 name: Column | None = None, ns: str = "window_ended_at_ns") -> DataFrame:
    """One event per evaluated finding: promoted when it has just become actionable.

    ``evaluated`` carries the finding's category, detector and project next to the
    evaluation.
    """
    promoted = (F.col("trend_state") == "actionable") & ~F.col("was_actionable")
    event_name = name if name is not None else F.when(
        promoted, F.lit(K.TREND_PROMOTED_EVENT)).otherwise(F.lit(K.TREND_EVALUATED_EVENT))
    version = F.col("entity_version")
    named = with_project_names(evaluated, projects, F.col("finding_id"))
    return derived_events(
        named, F.lit(f"generation:{generation}"), F.col("finding_id"), version, version,
        event_name, F.col(ns),
        {"analysis.generation": F.lit(generation), "trend.state": F.col("trend_state"),
         "finding.category": F.col("category"), **_project_attributes(),
         "detector.id": F.col("detector_id"), "finding.id": F.col("finding_id")},
        {"occurrence.count": F.col("occurrence_count")})


# ---- pipeline snapshot -----------------------------------------------------------

def lag_ms(latest: Column, finished: Column) -> Column:
    """Whole milliseconds behind; negative whenever the raw difference is."""
    return C.floor_div(finished - latest, 1_000_000)


def stream_lag_state(latest: Column, finished: Column) -> Column:
    return F.when(latest.isNull(), F.lit("not_applicable")).when(
        latest > finished, F.lit("clock_skew")).otherwise(F.lit("available"))


def stream_lag_ms(latest: Column, finished: Column) -> Column:
    return F.when(latest <= finished, lag_ms(latest, finished))


def freshness(status: Column, logs_latest: Column, traces_latest: Column,
              finished: Column) -> Column:
    newest = F.greatest(logs_latest, traces_latest)
    lag = lag_ms(newest, finished)
    return (
        F.when(status == "failed", F.lit("missing")).when(newest.isNull(), F.lit("fresh"))
        .when(newest > finished, F.lit("clock_skew"))
        .when(lag <= K.FRESH_LAG_MS, F.lit("fresh")).when(lag <= K.LATE_LAG_MS, F.lit("late"))
        .otherwise(F.lit("stale")))


def pipeline_state(status: Column, fresh: Column, *query_status: Column) -> Column:
    failed = status == "failed"
    for q in query_status:
        failed = failed | ~q.eqNullSafe(F.lit("available"))
    return F.when(failed, F.lit("unhealthy")).when(fresh == "fresh", F.lit("healthy")).when(
        fresh == "late", F.lit("degraded")).otherwise(F.lit("unhealthy"))


def pipeline_snapshots(runs: DataFrame) -> DataFrame:
    """State, freshness and per-stream lag of each run.

    ``runs``: run_id, terminal_status, finished_ns, and for logs/traces/hydration
    ``*_query_status``, ``*_data_state`` and (logs, traces) ``*_latest_ns``.
    """
    done = F.col("finished_ns")
    logs, traces = F.col("logs_latest_ns"), F.col("traces_latest_ns")
    fresh = freshness(F.col("terminal_status"), logs, traces, done)
    return runs.withColumns({
        "freshness": fresh,
        "pipeline_state": pipeline_state(
            F.col("terminal_status"), fresh,
            *(F.col(f"{s}_query_status") for s in ("logs", "traces", "hydration"))),
        "logs_lag_state": stream_lag_state(logs, done),
        "logs_lag_ms": stream_lag_ms(logs, done),
        "traces_lag_state": stream_lag_state(traces, done),
        "traces_lag_ms": stream_lag_ms(traces, done)})


def pipeline_events(snapshots: DataFrame, end_ns: int, error_class: str | None,
                    generation: str | None, duration_ms: float, rows_processed: int,
                    pending: int = 0) -> DataFrame:
    """The pipeline snapshot event of each run; attributes without a value are left out."""
    one = F.lit(1)
    streams = ("logs", "traces", "hydration")
    text = {"pipeline.state": F.col("pipeline_state"),
            "scan.terminal_status": F.col("terminal_status"),
            "pipeline.freshness": F.col("freshness")}
    for s in streams:
        text |= {f"{s}.query_status": F.col(f"{s}_query_status"),
                 f"{s}.data_state": F.col(f"{s}_data_state")}
    text |= {f"{s}.lag_state": F.col(f"{s}_lag_state") for s in streams[:2]}
    text |= {"pipeline.error_class": F.lit(error_class).cast("string"),
             "analysis.generation": F.lit(generation).cast("string")}
    numbers = {"scan.duration_ms": F.lit(duration_ms), "rows.processed": F.lit(rows_processed),
               "outbox.pending_after_drain_excluding_terminal_event": F.lit(pending)}
    for s in streams[:2]:
        numbers |= {f"{s}.latest_timestamp_ns": F.col(f"{s}_latest_ns"),
                    f"{s}.lag_ms": F.col(f"{s}_lag_ms")}
    made = derived_events(snapshots, F.lit(K.OPERATIONAL_SCOPE), F.col("run_id"), one, one,
                          F.lit(K.PIPELINE_EVENT), F.lit(end_ns).cast("bigint"), text, numbers)
    return made.withColumns({c: F.map_filter(c, lambda _, v: v.isNotNull()) for c in (
        "attributes_string", "attributes_number")})


# ---- outbox ------------------------------------------------------------------------

def delivery_batch(outbox: DataFrame, now_ns: int, limit: int = 500) -> DataFrame:
    """The oldest pending events that are due: a top-k, not a full sort."""
    due = (F.col("status") == "pending") & (F.col("next_attempt_ns") <= now_ns)
    return outbox.where(due).orderBy("created_ns", "event_id").limit(limit)


def retry_backoff(outbox: DataFrame, attempts: DataFrame, now_ns: int) -> DataFrame:
    """Next outbox state after a delivery round.

    ``attempts`` is (event_id, delivered): delivered events are closed, failed ones
    wait 2^attempt seconds, at most an hour; the rest are untouched.
    """
    tried = outbox.join(attempts.select("event_id", "delivered"), "event_id", "left")
    wait = F.least(F.lit(3600), F.pow(F.lit(2.0), F.least(F.lit(11), F.col("attempt_count")))
                   .cast("bigint"))
    ok, failed = F.col("delivered"), ~F.col("delivered")
    return tried.select(
        "event_id",
        F.when(ok, F.lit("delivered")).otherwise(F.col("status")).alias("status"),
        (F.col("attempt_count") + F.coalesce(failed, F.lit(False)).cast("int"))
        .alias("attempt_count"),
        F.when(failed, F.lit(now_ns) + wait * K.NS_PER_SECOND)
        .otherwise(F.col("next_attempt_ns")).alias("next_attempt_ns"), "created_ns",
        F.when(ok, F.lit(now_ns).cast("bigint")).otherwise(F.col("delivered_ns"))
        .alias("delivered_ns"))


def outbox_status(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- reconciliation ------------------------------------------------------------------

def failed_run_faults(requested: DataFrame, runs: DataFrame) -> DataFrame:
    """Requested run ids that are blank, repeated, unknown or not failed."""
    counted = requested.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    known = runs.select(F.col("id").alias("run_id"), "status")
    fault = (
        F.when(C.blank_to_null(F.col("run_id")).isNull(), F.lit("blank"))
        .when(F.col("n") > 1, F.lit("repeated")).when(F.col("status").isNull(), F.lit("unknown"))
        .when(F.col("status") != "failed", F.lit("not failed")))
    return counted.join(known, "run_id", "left").withColumn("fault", fault).where(
        "fault is not null").select("run_id", "fault")


def local_event_entities(outbox_events: DataFrame,
                         name: str = K.OBSERVATION_EVENT) -> DataFrame:
    return outbox_events.where(F.col("event_name") == name).select("entity_id").distinct()


def reconciliation_ordinals(observations: DataFrame) -> DataFrame:
    """Rank of each observation in its run by (detector, project, first member).

    Within a detector the first member already decides the order of the member lists.
    """
    project = F.coalesce("project_identity_id", F.concat(F.lit("unresolved:"), "task_identity"))
    return split_rank(
        observations.withColumn("_project", project), ["scan_run_id"],
        ["detector_id", "_project", "first_event_id", "observation_id"], "ordinal"
    ).drop("_project")


def reconciliation_plan(observations: DataFrame, failed_runs: DataFrame, projects: DataFrame,
                        outbox_events: DataFrame) -> DataFrame:
    """Original events of the failed runs' observations that the outbox lacks."""
    rows = observations.join(failed_runs.select(F.col("run_id").alias("scan_run_id")),
                             "scan_run_id", "left_semi")
    # Counted on the stored observations, so that ranking is not evaluated twice.
    hot = hot_keys(observations, ["project_identity_id"])
    ranked = with_project_names(reconciliation_ordinals(rows), projects,
                                F.col("observation_id"), hot)
    rebuilt = derived_events(
        ranked, F.lit(K.OPERATIONAL_SCOPE), F.col("observation_id"), F.lit(1), F.col("ordinal"),
        F.lit(K.OBSERVATION_EVENT), F.col("occurred_at_ns"),
        {"detector.id": F.col("detector_id"), **_project_attributes(),
         "finding.id": F.col("fingerprint")})
    return rebuilt.join(local_event_entities(outbox_events), "entity_id", "left_anti").select(
        *EVENT_COLUMNS)


def remote_presence(references: DataFrame, store: DataFrame,
                    service: str = K.DERIVED_SERVICE) -> DataFrame:
    """Referenced events the store holds under the same id, name and time.

    The store is read in the references' time range only; where it is laid out by time bucket,
    buckets outside it are not opened.
    """
    first, last = references.agg(F.min("timestamp_ns"), F.max("timestamp_ns")).first()
    if first is None:
        return references
    if "ts_bucket_start" in store.columns:
        store = time_range(store, first, last, closed=True)
    held = store.where((F.col("resource")["service.name"] == service) & F.col(
        "timestamp_ns").between(first, last)).select(
        F.col("attributes_string")["event.id"].alias("event_id"),
        F.col("attributes_string")["event.name"].alias("event_name"), "timestamp_ns")
    return references.join(held, ["event_id", "event_name", "timestamp_ns"], "left_semi")


def unexpected_remote(plan: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote ids outside the plan; any row is an error."""
    return remote.select("event_id").distinct().join(plan.select("event_id"), "event_id",
                                                     "left_anti")


def reconciliation_enqueue(plan: DataFrame, remote: DataFrame) -> DataFrame:
    return plan.join(remote.select("event_id").distinct(), "event_id", "left_anti")


def reconciliation_counts(observations: DataFrame, plan: DataFrame,
                          remote: DataFrame) -> DataFrame:
    """The four counts of a reconciliation, as one row."""
    remote_ids = remote.select("event_id").distinct()
    tagged = (
        observations.select(F.lit("observation").alias("k"))
        .unionByName(plan.select(F.lit("planned").alias("k")))
        .unionByName(remote_ids.select(F.lit("remote").alias("k")))
        .unionByName(reconciliation_enqueue(plan, remote).select(F.lit("queued").alias("k"))))
    n = {k: F.count_if(F.col("k") == k) for k in ("observation", "planned", "remote", "queued")}
    return tagged.agg(
        n["observation"].alias("observations"),
        (n["observation"] - n["planned"]).alias("existing_local_observation_events"),
        n["remote"].alias("existing_remote_observation_events"),
        n["queued"].alias("queued_observation_events"))
