"""Analysis generations: immutable snapshots with one current pointer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.functions import constants as K
from tracefold.operators import events


def generation_projection(records: DataFrame, findings: DataFrame, projects: DataFrame,
                          generation: str, start_ns: int, end_ns: int) -> DataFrame:
    """Observation and finding events of the closed window, from stored facts only."""
    inside = lambda c: F.col(c).between(start_ns, end_ns)
    observed = events.observation_events(records.where(inside("occurred_at_ns")), projects,
                                         generation)
    trends = events.trend_events(findings.where(inside("last_seen_ns")), projects, generation,
                                 name=F.lit(K.TREND_EVALUATED_EVENT), ns="last_seen_ns")
    return observed.unionByName(trends)


def linked_references(links: DataFrame, outbox: DataFrame, role: str) -> DataFrame:
    """Outbox events linked to a generation in ``role``, ordered by event id."""
    return links.where(F.col("role") == role).select("generation_id", "event_id").join(
        outbox, "event_id").orderBy("generation_id", "event_id")


def blocking_events(links: DataFrame, outbox: DataFrame, remote: DataFrame) -> DataFrame:
    """Linked projection events that keep a generation from being activated."""
    projected = links.where("role = 'projection'").select("generation_id", "event_id")
    stated = projected.join(outbox.select("event_id", "status"), "event_id", "left").join(
        remote.select("event_id").distinct().withColumn("present", F.lit(True)), "event_id",
        "left")
    reason = (
        F.when(F.col("status").isNull(), F.lit("unavailable"))
        .when(F.col("status") != "delivered", F.lit("undelivered"))
        .when(F.col("present").isNull(), F.lit("not remotely verifiable")))
    return stated.withColumn("reason", reason).where("reason is not null").select(
        "generation_id", "event_id", "reason")


def activation_ready(generations: DataFrame, links: DataFrame, outbox: DataFrame,
                     remote: DataFrame) -> DataFrame:
    """Generations without any blocking event."""
    blocked = blocking_events(links, outbox, remote).select("generation_id").distinct()
    return generations.join(blocked, "generation_id", "left_anti")


def activations(ready: DataFrame, stored: DataFrame, now_ns: int) -> DataFrame:
    """New activation facts; a generation already active yields none.

    The marker event id is the id every repeat of the activation would produce.
    """
    one = F.lit(1)
    marker = events.derived_events(
        ready, F.lit(K.OPERATIONAL_SCOPE), F.col("generation_id"), one, one,
        F.lit(K.ACTIVATION_EVENT), F.lit(now_ns).cast("bigint"),
        {"analysis.generation": F.col("generation_id")})
    return marker.select(
        F.col("entity_id").alias("generation_id"), F.col("event_id").alias("activation_event_id"),
        F.col("timestamp_ns").alias("activated_ns")
    ).join(stored.select("generation_id"), "generation_id", "left_anti")


def current_generation(activated: DataFrame) -> DataFrame:
    """The pointer: the latest activation, as at most one row."""
    latest = F.max_by(F.struct("generation_id", "activation_event_id", "activated_ns"),
                      F.struct("activated_ns", "generation_id"))
    return activated.agg(latest.alias("c")).where("c is not null").select("c.*")
