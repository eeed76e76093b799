"""The eight dashboard panels over the derived-event table.

Latest-per-entity values use ``max_by`` on (version, timestamp, event id), which
aggregates partially, instead of a window over the entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.sources.telemetry import time_range

TREND_EVENTS = (K.TREND_EVALUATED_EVENT, K.TREND_PROMOTED_EVENT)


def text(key: str) -> Column:
    return F.coalesce(F.col("attributes_string")[key], F.lit(""))


def number(key: str) -> Column:
    return F.coalesce(F.col("attributes_number")[key], F.lit(0.0))


def from_raw(logs: DataFrame, service: str = K.DERIVED_SERVICE) -> DataFrame:
    """Derived events out of the shared raw log table they were delivered to."""
    text, numbers = F.col("attributes_string"), F.col("attributes_number")
    return logs.where(F.col("resource")["service.name"] == service).select(
        text["event.id"].alias("event_id"), text["event.scope"].alias("scope"),
        text["entity.id"].alias("entity_id"),
        numbers["entity.version"].cast("bigint").alias("entity_version"),
        numbers["event.sequence"].cast("bigint").alias("event_sequence"),
        text["event.name"].alias("event_name"), "timestamp_ns", "attributes_string",
        "attributes_number", "ts_bucket_start")


def _latest(value: Column) -> Column:
    return F.max_by(value, F.struct("entity_version", "timestamp_ns", "event_id"))


def _minute_text(ns: Column) -> Column:
    return F.date_format(C.timestamp_of(ns), "dd MMM HH:mm")


def in_window(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return time_range(events, start_ns, end_ns, closed=True)


def active_generation(events: DataFrame) -> DataFrame:
    """Generation of the latest activation marker; no row when there is none."""
    return events.where(F.col("event_name") == K.ACTIVATION_EVENT).agg(
        _latest(text("analysis.generation")).alias("generation")
    ).where("generation is not null and generation <> ''")


#: Events of which only the latest counts, whatever its time.
LATEST_EVENTS = (K.ACTIVATION_EVENT, K.REVIEW_ACTIVITY_EVENT)


def latest_rows(events: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The newest activation marker and review snapshot, as event rows: at most one of each.

    ``held`` is the table of the run before; merged with the new events of a run it says what
    ``active_generation`` and ``review_activity`` would say over all events ever.
    """
    columns = ["event_id", "scope", "entity_id", "entity_version", "event_sequence",
               "event_name", "timestamp_ns", "attributes_string", "attributes_number"]
    rows = events.select(*columns)
    if held is not None:
        rows = rows.unionByName(held.select(*columns))
    reviewed = F.col("event_name") == K.REVIEW_ACTIVITY_EVENT
    valid = ~reviewed | _valid_review()
    order = F.struct("entity_version", F.when(reviewed, F.col("event_sequence")).otherwise(
        F.col("timestamp_ns")).alias("then"), "event_id")
    return rows.where(F.col("event_name").isin(*LATEST_EVENTS) & valid).groupBy(
        F.col("event_name").alias("_name")).agg(
        F.max_by(F.struct(*columns), order).alias("row")).select("row.*")


def projections(events: DataFrame, start_ns: int, end_ns: int, *names: str,
                latest: DataFrame | None = None) -> DataFrame:
    """Window events of the active generation (a one-row semi join).

    ``latest`` (``latest_rows``) spares the search for the pointer in all events.
    """
    rows = in_window(events, start_ns, end_ns).where(F.col("event_name").isin(*names))
    return rows.withColumn("generation", text("analysis.generation")).join(
        active_generation(events if latest is None else latest), "generation", "left_semi")


def pipeline_health(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    rows = in_window(events, start_ns, end_ns).where(F.col("event_name") == K.PIPELINE_EVENT)
    pair = lambda s: F.concat(
        text(f"{s}.query_status"), F.lit(" / "), text(f"{s}.data_state"))
    return rows.agg(
        _latest(text("pipeline.state")).alias("pipeline_state"),
        _latest(text("scan.terminal_status")).alias("terminal_status"),
        _latest(text("pipeline.freshness")).alias("freshness"),
        _latest(pair("logs")).alias("logs"), _latest(pair("traces")).alias("traces"),
        _minute_text(F.max("timestamp_ns")).alias("last_snapshot"),
        F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")


def scan_duration(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return in_window(events, start_ns, end_ns).where(
        F.col("event_name") == K.PIPELINE_EVENT).select(
        C.timestamp_of(F.col("timestamp_ns")).alias("ts"),
        number("scan.duration_ms").alias("value")).orderBy("ts")


def _share(part: str, whole: str) -> Column:
    return F.round(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1.0)), 2)


def identity_coverage(events: DataFrame, start_ns: int, end_ns: int,
                      latest: DataFrame | None = None) -> DataFrame:
    resolved = F.lit(True)
    for key in ("project.id", "project.name"):
        resolved = resolved & ~text(key).isin("", "unresolved")
    entities = projections(
        events, start_ns, end_ns, K.OBSERVATION_EVENT, latest=latest).groupBy("entity_id").agg(
        F.bool_or(resolved).alias("resolved"))
    counted = entities.agg(F.count_if("resolved").cast("double").alias("resolved_observations"),
                           F.count(F.lit(1)).cast("double").alias("observed_observations"))
    return counted.where("observed_observations > 0").select(
        _share("resolved_observations", "observed_observations").alias("identity_coverage_pct"),
        "resolved_observations", "observed_observations")


def actionable_trends(events: DataFrame, start_ns: int, end_ns: int,
                      latest: DataFrame | None = None) -> DataFrame:
    project = F.when(text("project.name") == "", F.lit("unresolved")).otherwise(
        text("project.name"))
    return projections(
        events, start_ns, end_ns, *TREND_EVENTS, latest=latest).groupBy("entity_id").agg(
        _latest(text("finding.category")).alias("category"),
        _latest(text("detector.id")).alias("detector"), _latest(project).alias("project"),
        _latest(number("occurrence.count")).alias("occurrences"),
        _latest(text("trend.state")).alias("_state"), F.max("timestamp_ns").alias("_last"),
    ).where("_state = 'actionable'").orderBy(F.desc("occurrences"), F.desc("_last")).select(
        F.left("entity_id", F.lit(8)).alias("finding"), "category", "detector", "project",
        "occurrences", _minute_text(F.col("_last")).alias("last_evaluated"))


def trend_context(events: DataFrame, start_ns: int, end_ns: int,
                  latest: DataFrame | None = None) -> DataFrame:
    latest = projections(
        events, start_ns, end_ns, *TREND_EVENTS, latest=latest).groupBy("entity_id").agg(
        _latest(text("trend.state")).alias("trend_state"), F.max("timestamp_ns").alias("_last"))
    return latest.groupBy("trend_state").agg(
        F.date_trunc("minute", C.timestamp_of(F.max("_last"))).alias("ts"),
        F.count(F.lit(1)).cast("double").alias("value")).orderBy("trend_state")


def signal_mix(events: DataFrame, start_ns: int, end_ns: int,
               latest: DataFrame | None = None) -> DataFrame:
    return projections(events, start_ns, end_ns, K.OBSERVATION_EVENT, latest=latest).groupBy(
        F.date_trunc("day", C.timestamp_of(F.col("timestamp_ns"))).alias("ts"),
        text("detector.id").alias("detector")).agg(
        F.count_distinct("entity_id").cast("double").alias("value")).orderBy("ts", "detector")


def detector_yield(events: DataFrame, start_ns: int, end_ns: int,
                   latest: DataFrame | None = None) -> DataFrame:
    latest = projections(
        events, start_ns, end_ns, *TREND_EVENTS, latest=latest).groupBy("entity_id").agg(
        _latest(text("detector.id")).alias("detector"),
        _latest(text("trend.state")).alias("trend_state"))
    return latest.groupBy("detector").agg(
        F.count_if(F.col("trend_state") == "actionable").cast("double")
        .alias("actionable_findings"),
        F.count(F.lit(1)).cast("double").alias("all_findings"),
    ).withColumn("actionable_yield_pct", _share("actionable_findings", "all_findings")).orderBy(
        F.desc("actionable_yield_pct"), "detector")


def _valid_review() -> Column:
    return (text("review.activity.availability") == "available") & (
        text("snapshot.trigger.kind") != "")


def review_activity(events: DataFrame) -> DataFrame:
    """Latest available review snapshot, out of all events or of ``latest_rows``."""
    rows = events.where((F.col("event_name") == K.REVIEW_ACTIVITY_EVENT) & _valid_review())
    order = F.struct("entity_version", "event_sequence", "event_id")
    counts = {
        f"{purpose}_{what}s": number(f"review.{purpose}.{what}_count")
        for what in ("session", "result") for purpose in ("classification", "proposal")}
    return rows.agg(*(F.max_by(v, order).alias(k) for k, v in counts.items()),
                    F.count(F.lit(1)).alias("_n")).where("_n > 0").drop("_n")
