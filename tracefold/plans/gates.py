"""Documented display gates: aggregates shown only once enough evidence exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators import audit


def project_concentration(observations: DataFrame) -> DataFrame:
    """Share of resolved observations per project; empty below the coverage gate.

    Needs 80 % coverage, 100 resolved observations and three projects.
    """
    per = observations.groupBy("project_identity_id").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("project_identity_id").isNotNull()
    gate = per.agg(
        F.sum("n").alias("total"), F.sum(F.when(named, F.col("n"))).alias("resolved"),
        F.count_if(named).alias("projects")
    ).where("resolved * 100 >= total * 80 and resolved >= 100 and projects >= 3")
    resolved = gate.select("resolved").scalar()
    return per.where(named & resolved.isNotNull()).select(
        "project_identity_id", "n",
        F.round(100.0 * F.col("n") / resolved, 2).alias("share_pct"))


def pending_reviews(sessions: DataFrame, now_ns: int) -> DataFrame:
    """Concurrent exported sessions and their age, per snapshot purpose."""
    age = (F.lit(now_ns) - F.min("created_ns")) / F.lit(3600 * K.NS_PER_SECOND)
    return sessions.where("status = 'exported'").groupBy("purpose").agg(
        F.count(F.lit(1)).alias("pending"), age.alias("oldest_hours")).withColumn(
        "shown", (F.col("pending") >= 3) | (F.col("oldest_hours") > 168))


def outcomes_by_intervention(proposals: DataFrame) -> DataFrame:
    """Terminal proposal outcomes; empty below ten of them over two types."""
    ended = proposals.where(F.col("state").isin("applied", "rejected", "implementation_failed"))
    per = ended.groupBy("intervention_type", "state").agg(F.count(F.lit(1)).alias("n"))
    gate = per.agg(F.sum("n").alias("n"),
                   F.count_distinct("intervention_type").alias("types")).where(
        "n >= 10 and types >= 2").select("n").scalar()
    return per.where(gate.isNotNull())


def token_ledger(runs: DataFrame) -> DataFrame:
    """Token totals per session; empty below five accepted runs over two sessions."""
    per = runs.where("status = 'accepted'").groupBy("review_session_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("total_tokens").alias("total_tokens"))
    gate = per.agg(F.sum("runs").alias("n"), F.count(F.lit(1)).alias("sessions")).where(
        "n >= 5 and sessions >= 2").select("n").scalar()
    return per.where(gate.isNotNull())


def application_change(applications: DataFrame, observations: DataFrame,
                       runs: DataFrame) -> DataFrame:
    """Observations in the week before and after each application.

    A window is evaluable with at least 152 of its 168 hourly slots completed.
    ``applications``: application_id, fingerprint, applied_ns (on an hour). Slots are enumerated
    once for each hour of an application, not for each application; observations meet
    applications by the two or three weeks that their windows touch.
    """
    hour, week = 3600, 168 * 3600
    placed = applications.select("application_id", "fingerprint", C.floor_div(
        F.col("applied_ns"), K.NS_PER_SECOND).alias("at"))

    def per_window(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
        before = F.col("slot_start") < F.col("at")
        return df.groupBy(key).agg(F.sum(F.when(before, value)).alias(f"baseline_{name}"),
                                   F.sum(F.when(~before, value)).alias(f"follow_up_{name}"))

    covered = audit.slot_coverage(runs).where("covered").select("slot_start")
    slots = placed.select("at").distinct().withColumn("slot_start", F.explode(F.sequence(
        F.col("at") - week, F.col("at") + week - hour, F.lit(hour))))
    slots = per_window(slots.join(covered, "slot_start"), "at", F.lit(1), "slots")
    slots = placed.join(slots, "at", "left").groupBy("application_id").agg(*(
        F.sum(c).alias(c) for c in ("baseline_slots", "follow_up_slots")))
    hits = observations.groupBy("fingerprint", audit.slot_of(F.col("occurred_at_ns")).alias(
        "slot_start")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "week", C.floor_div(F.col("slot_start"), week))
    counts = placed.withColumn("week", F.explode(F.sequence(
        C.floor_div(F.col("at") - week, week), C.floor_div(F.col("at") + week - hour, week)))
    ).join(hits, ["fingerprint", "week"]).where(
        (F.col("slot_start") >= F.col("at") - week) & (F.col("slot_start") < F.col("at") + week))
    counts = per_window(counts, "application_id", F.col("n"), "count")
    per = slots.join(counts, "application_id", "left").select("application_id", *(
        F.coalesce(f"{w}_{name}", F.lit(0)).alias(f"{w}_{name}")
        for w in ("baseline", "follow_up") for name in ("slots", "count")))
    return per.withColumn("evaluable", (F.col("baseline_slots") >= 152)
                          & (F.col("follow_up_slots") >= 152))
