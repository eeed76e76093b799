"""Observation records, evidence, findings and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators.ordering import ordered_digest, salted_join, sliced

RESOLVED_PREFIXES = ("git:", "non_git:")


def _with_fingerprint(first: DataFrame) -> DataFrame:
    return first.withColumn("fingerprint", C.fingerprint(
        *(F.col(c) for c in ("project_id", "detector_id", "operation_kind", "target_kind",
                             "normalized_target", "failure_class"))))


def observation_records(single: DataFrame | None, grouped: DataFrame | None) -> DataFrame:
    """One record per observation, taken from its first member.

    The id is the SHA-256 over the fingerprint and the hash tree of the ordered member
    ids, for one member as for many.
    """
    parts = []
    if single is not None:
        alone = _with_fingerprint(single)
        parts.append(alone.withColumn(
            "observation_id", C.stable_id(F.col("fingerprint"), F.sha2(
                "event_id", 256))))
    if grouped is not None:
        named = grouped.withColumn("_group", F.concat_ws(C.SEP, "detector_id", "group_id"))
        digest = ordered_digest(named, "_group")
        first = _with_fingerprint(named.where("ordinal = 1")).join(digest, "_group")
        parts.append(first.withColumn(
            "observation_id", C.stable_id(F.col("fingerprint"), F.col("members_text"))
        ).drop("members_text", "_group"))
    records = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    resolved = F.col("project_id").startswith(RESOLVED_PREFIXES[0]) | F.col(
        "project_id").startswith(RESOLVED_PREFIXES[1])
    return records.select(
        "observation_id", "detector_id", F.lit(K.DETECTOR_VERSION).alias("detector_version"),
        F.col("detector_id").alias("category"), "group_id",
        F.when(resolved, F.col("project_id")).alias("project_identity_id"),
        F.col("task_id").alias("task_identity"), F.lit(None).cast("string").alias("turn_identity"),
        F.col("timestamp_ns").alias("occurred_at_ns"), "fingerprint", "operation_kind",
        "target_kind", "normalized_target", F.col("failure_class").alias(
            "normalized_failure_class"),
        F.lit(K.NORMALIZATION_VERSION).alias("normalization_version"),
        F.col("explanation").alias("membership_explanation"), "member_count",
        F.col("event_id").alias("first_event_id"),
    )


def dedupe_observations(records: DataFrame) -> DataFrame:
    """Unique by detector, fingerprint and members; the id covers the last two."""
    return records.dropDuplicates(["detector_id", "observation_id"])


def observation_members(records: DataFrame, members: DataFrame) -> DataFrame:
    """(observation_id, ordinal, event_id) for every member."""
    keys = records.select("observation_id", "detector_id", "group_id")
    return salted_join(
        members.select("detector_id", "group_id", "ordinal", "event_id", "timestamp_ns"),
        keys, ["detector_id", "group_id"], F.col("event_id"), "inner",
    ).select("observation_id", "ordinal", "event_id", "timestamp_ns")


def append_new(records: DataFrame, stored: DataFrame, key: str = "observation_id") -> DataFrame:
    """Rows whose id is not stored yet, once each."""
    return records.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def content_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def replay_conflicts(records: DataFrame, stored: DataFrame, content: list[str],
                     key: str = "observation_id") -> DataFrame:
    """Ids replayed with different content."""
    new = records.select(key, content_hash(*content).alias("new_hash"))
    old = stored.select(key, content_hash(*content).alias("stored_hash"))
    return new.join(old, key).where("new_hash <> stored_hash")


def watermark_audit(log: DataFrame, sequence: str = "sequence", span: int = 10_000) -> DataFrame:
    """Entries whose (timestamp, row id) is lower than the entry before them.

    The log is cut into sequence spans; each span also reads the last entry of the one
    before it, so a source with a very long log is not sorted in one task.
    """
    seen = sliced(log, ["source"], [C.floor_div(F.col(sequence), span)], [sequence],
                  running={}, previous={"prev_ns": F.col("timestamp_ns"),
                                        "prev_row_id": F.col("row_id")})
    return seen.where(F.struct("timestamp_ns", "row_id") < F.struct(
        F.col("prev_ns").alias("timestamp_ns"), F.col("prev_row_id").alias("row_id"))).where(
        "prev_ns is not null")


# ---- evidence ------------------------------------------------------------------



def hydrate_evidence(df: DataFrame, fields: dict[str, Column],
                     json_keys: bool = False) -> DataFrame:
    """Allowlist, redact and hash; content the scanner refuses is quarantined."""
    raw = C.allowlisted_json(fields)
    clean = F.col("redacted_content")
    return df.withColumn("redacted_content", C.redact(raw, json_keys)).withColumns({
        "correlation_status": F.when(clean.isNull(), F.lit("quarantined")).otherwise(
            F.lit("correlated")),
        "content_hash": F.sha2(F.coalesce(clean, F.lit("quarantined")), 256),
    })


def evidence_rows(members: DataFrame, hydration: DataFrame,
                  reference_prefix: str = "log:") -> DataFrame:
    """One row per (observation, member): correlated content or a pending reference."""
    fields = {c: F.col(c) for c in K.EVIDENCE_FIELDS}
    content = hydrate_evidence(hydration, fields).select(
        F.col("log_id").alias("event_id"), "redacted_content", "content_hash",
        "correlation_status")
    # An event can be a member of very many observations only through hot groups, whose
    # members are distinct events, so the event key itself does not concentrate rows.
    joined = members.join(content, "event_id", "left")
    kind = F.when(F.col("content_hash").isNull(), F.lit("source_reference")).otherwise(
        F.lit("hydrated_log"))
    return joined.withColumn("evidence_kind", kind).select(
        C.stable_id(F.col("observation_id"), F.col("event_id"), F.col("evidence_kind"))
        .alias("evidence_id"),
        "observation_id", "event_id", "evidence_kind",
        F.concat(F.lit(reference_prefix), "event_id").alias("source_reference"),
        "redacted_content",
        F.coalesce("content_hash", F.sha2(F.lit("pending"), 256)).alias("content_hash"),
        F.coalesce("correlation_status", F.lit("pending")).alias("correlation_status"))


# ---- findings -------------------------------------------------------------------

def finding_membership(records: DataFrame, stored: DataFrame | None = None,
                       prefix: str = K.FINDING_NAME_PREFIX) -> DataFrame:
    rows = records.select(
        C.finding_id(F.col("fingerprint"), prefix).alias("finding_id"), "observation_id",
        F.col("membership_explanation").alias("rationale")
    ).dropDuplicates(["finding_id", "observation_id"])
    if stored is None:
        return rows
    return rows.join(stored.select("finding_id", "observation_id"),
                     ["finding_id", "observation_id"], "left_anti")


def findings_upsert(records: DataFrame, previous: DataFrame | None = None,
                    prefix: str = K.FINDING_NAME_PREFIX) -> DataFrame:
    """Next snapshot of findings, one version step per run that sees them."""
    origin = F.struct("occurred_at_ns", "observation_id")
    new = records.groupBy("fingerprint").agg(
        F.min_by(F.struct("category", "project_identity_id", "detector_id", "detector_version"),
                 origin).alias("first"),
        F.min("occurred_at_ns").alias("first_seen_ns"),
        F.max("occurred_at_ns").alias("last_seen_ns"),
    ).select("fingerprint", "first.*", "first_seen_ns", "last_seen_ns")
    if previous is None:
        merged = new.withColumns({"trend_state": F.lit("isolated"), "entity_version": F.lit(1)})
    else:
        keep = ["category", "project_identity_id", "detector_id", "detector_version",
                "first_seen_ns"]
        old = previous.select("fingerprint", *(F.col(c).alias(f"old_{c}") for c in keep),
                              F.col("last_seen_ns").alias("old_last"), "trend_state",
                              F.col("entity_version").alias("old_version"))
        known = F.col("old_version").isNotNull()
        merged = new.join(old, "fingerprint", "full_outer").select(
            "fingerprint",
            *(F.when(known, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in keep),
            F.greatest("last_seen_ns", "old_last").alias("last_seen_ns"),
            F.coalesce("trend_state", F.lit("isolated")).alias("trend_state"),
            (F.coalesce("old_version", F.lit(0))
             + F.col("last_seen_ns").isNotNull().cast("int")).alias("entity_version"))
    return merged.withColumn("finding_id", C.finding_id(F.col("fingerprint"), prefix))


def finding_occurrences(findings: DataFrame, membership: DataFrame, records: DataFrame,
                        cutoff_ns: int) -> DataFrame:
    """Findings with their observations since ``cutoff_ns``; null when there are none.

    The time bound belongs to the join, so findings without recent observations stay.
    """
    recent = records.where(F.col("occurred_at_ns") >= cutoff_ns).select(
        "observation_id", "occurred_at_ns", "task_identity")
    held = membership.select("finding_id", "observation_id").join(recent, "observation_id")
    return salted_join(held, findings.select("finding_id", "trend_state"), ["finding_id"],
                       F.col("observation_id"), "inner").unionByName(
        findings.select("finding_id", "trend_state").join(
            held.select("finding_id").distinct(), "finding_id", "left_anti"),
        allowMissingColumns=True)


# ---- trends ----------------------------------------------------------------------

def trend_cells(occurrences: DataFrame, key: str = "finding_id", *also: str) -> DataFrame:
    """Occurrences per (finding, task, local day), and per ``also``: partial facts that add up."""
    return occurrences.groupBy(
        key, "task_identity", C.local_day(F.col("occurred_at_ns")).alias("day"), *also).agg(
        F.count(F.lit(1)).alias("n"))


def cell_counts(cells: DataFrame, key: str = "finding_id") -> DataFrame:
    """Counts per finding, from the cells of one window."""
    return cells.groupBy(key).agg(
        F.sum("n").alias("occurrence_count"),
        F.count_distinct("task_identity").alias("canonical_task_count"),
        F.count_distinct("day").alias("local_day_count"))


def trend_evaluation(occurrences: DataFrame, now_ns: int,
                     days: int = K.TREND_WINDOW_DAYS, key: str = "finding_id") -> DataFrame:
    """Counts per finding over the closed window that ends at ``now_ns``.

    Occurrences are first counted per (finding, task, day), so the distinct counts
    never see raw rows and a hot finding is spread over its tasks and days.
    """
    start = now_ns - days * K.NS_PER_DAY
    inside = occurrences.where(F.col("occurred_at_ns").between(start, now_ns))
    return cell_counts(trend_cells(inside, key), key).withColumns({
        "window_started_at_ns": F.lit(start).cast("bigint"),
        "window_ended_at_ns": F.lit(now_ns).cast("bigint")})


def previously_actionable(findings: DataFrame, key: str = "finding_id") -> DataFrame:
    return findings.where("trend_state = 'actionable'").select(key)


def trend_states(occurrences: DataFrame, prior: DataFrame, now_ns: int,
                 key: str = "finding_id") -> DataFrame:
    """Evaluated state of every finding seen in the window or actionable before it."""
    return judged(trend_evaluation(occurrences, now_ns, key=key).drop(
        "window_started_at_ns", "window_ended_at_ns"), prior, now_ns, key)


def judged(counts: DataFrame, prior: DataFrame, now_ns: int,
           key: str = "finding_id") -> DataFrame:
    """States from the counts of the window that ends at ``now_ns``."""
    start = now_ns - K.TREND_WINDOW_DAYS * K.NS_PER_DAY
    both = counts.join(prior.select(key).distinct().withColumn("was_actionable", F.lit(True)),
                       key, "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in (
        "occurrence_count", "canonical_task_count", "local_day_count")}
    return both.withColumns(zero).withColumn(
        "was_actionable", F.coalesce("was_actionable", F.lit(False))
    ).withColumns({
        "trend_state": C.trend_state(*(F.col(c) for c in (
            "occurrence_count", "canonical_task_count", "local_day_count", "was_actionable"))),
        "window_started_at_ns": F.lit(start).cast("bigint"),
        "window_ended_at_ns": F.lit(now_ns).cast("bigint"),
    })


def trend_append(evaluations: DataFrame, run_id: str) -> DataFrame:
    """Immutable evaluation facts of one run, keyed by (finding, run)."""
    return evaluations.select(
        C.stable_id(F.col("finding_id"), F.lit(run_id)).alias("evaluation_id"),
        F.lit(run_id).alias("scan_run_id"), "finding_id", "trend_state",
        "window_started_at_ns", "window_ended_at_ns", "occurrence_count",
        "canonical_task_count", "local_day_count",
        F.lit("deterministic seven-day trend thresholds").alias("rationale"))


def promotions(evaluations: DataFrame) -> DataFrame:
    return evaluations.where("trend_state = 'actionable' and not was_actionable")


def promotion_history(states: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Entries of a state log that enter 'actionable' from another state.

    ``states`` holds one entry per finding and run, so a group is as long as the number
    of runs kept.
    """
    before = F.lag("trend_state").over(Window.partitionBy(key).orderBy(*order))
    return states.withColumn("previous_state", before).where(
        "trend_state = 'actionable' and coalesce(previous_state, '') <> 'actionable'")


def finding_update(findings: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Findings with the counts and state of this run's evaluation written over."""
    counts = ["occurrence_count", "canonical_task_count", "local_day_count"]
    new = evaluations.select("finding_id", F.col("trend_state").alias("new_state"), *counts)
    base = findings.drop(*counts)
    return base.join(new, "finding_id", "left").withColumns({
        "trend_state": F.coalesce("new_state", "trend_state"),
        "entity_version": F.col("entity_version")
        + F.col("new_state").isNotNull().cast("int"),
    }).drop("new_state")
