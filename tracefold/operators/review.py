"""Review sessions, model results and their accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators.events import derived_events
from tracefold.operators.ordering import split_rank

PURPOSES = ("classification", "proposal")


def _limit(purpose: Column, field: int) -> Column:
    """One of the fixed limits of the row's purpose."""
    out = F.when(purpose == PURPOSES[0], F.lit(K.REVIEW_LIMITS[PURPOSES[0]][field]))
    return out.when(purpose == PURPOSES[1], F.lit(K.REVIEW_LIMITS[PURPOSES[1]][field]))


def classification_candidates(observations: DataFrame, classified: DataFrame,
                              k: int = 10) -> DataFrame:
    """The k oldest observations without a classification."""
    done = classified.select(F.col("candidate_id").alias("observation_id")).distinct()
    return observations.join(done, "observation_id", "left_anti").orderBy(
        "occurred_at_ns", "observation_id").limit(k)


def proposal_candidates(findings: DataFrame, proposals: DataFrame, k: int = 1) -> DataFrame:
    """The k longest-standing actionable findings without a proposal."""
    return findings.where("trend_state = 'actionable'").join(
        proposals.select("finding_id").distinct(), "finding_id", "left_anti").orderBy(
        "last_seen_ns", "finding_id").limit(k)


def duplicate_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("purpose", "candidate_id").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")


def review_batches(candidates: DataFrame) -> DataFrame:
    """Sessions planned from all candidates, oldest first, under the fixed limits.

    ``candidates``: purpose, candidate_id, created_ns, payload (canonical JSON). A
    session holds at most ten candidates, so its payload list is bounded; a session
    whose payload is too long keeps a ``fault`` instead of being dropped.
    """
    ranked = split_rank(candidates, ["purpose"], ["created_ns", "candidate_id"], "nth")
    purpose = F.col("purpose")
    session = F.call_function("div", F.col("nth") - 1, _limit(purpose, 0))
    grouped = ranked.withColumn("session_no", session).groupBy("purpose", "session_no").agg(
        F.array_sort(F.collect_list(F.struct("nth", "candidate_id", "payload"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda c: c["payload"]), ",")
    payload = F.concat(F.lit('{"candidates":['), joined, F.lit('],"purpose":"'), purpose,
                       F.lit('"}'))
    return grouped.withColumn("payload", payload).select(
        "purpose", F.call_function("div", F.col("session_no"), _limit(purpose, 1))
        .alias("batch_no"), "session_no",
        F.transform("c", lambda c: c["candidate_id"]).alias("ordered_candidate_ids"),
        F.size("c").alias("candidate_count"), F.length("payload").alias("characters"),
        F.octet_length("payload").alias("byte_count"),
        F.sha2("payload", 256).alias("payload_hash"),
        F.when(F.length("payload") > _limit(purpose, 3),
               F.lit("review payload exceeds input character limit")).alias("fault"))


def batch_faults(sessions: DataFrame) -> DataFrame:
    """Batches over the session, item or combined limits."""
    per = sessions.groupBy("batch_id", "purpose").agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("candidate_count").alias("n_items"))
    purpose = F.col("purpose")
    own = F.when(F.col("n_sessions") > _limit(purpose, 1), F.concat(
        purpose, F.lit(" model call limit exhausted"))).when(
        F.col("n_items") > _limit(purpose, 2), F.concat(
            purpose, F.lit(" candidate limit exhausted")))
    combined = per.groupBy("batch_id").agg(F.sum("n_sessions").alias("n_sessions")).where(
        F.col("n_sessions") > K.REVIEW_SESSIONS_PER_BATCH).select(
        "batch_id", F.lit("combined model call limit exhausted").alias("fault"))
    return per.withColumn("fault", own).where("fault is not null").select(
        "batch_id", "fault").unionByName(combined)


def validate_results(results: DataFrame, sessions: DataFrame,
                     provenance: DataFrame) -> DataFrame:
    """First failing reason per returned document; null when it may be imported.

    ``results``: session_id, nonce, schema_version, payload_hash, requested_model,
    requested_effort, result_ids, document_characters. ``sessions``: the exported rows.
    ``provenance``: session_id, model, effort, trace_id, token_count.
    """
    exact = ["nonce", "schema_version", "requested_model", "requested_effort", "payload_hash"]
    expected = sessions.select(
        F.col("id").alias("session_id"), *(F.col(c).alias(f"expected_{c}") for c in exact),
        "ordered_candidate_ids", "purpose", F.col("status").alias("session_status"),
        "reserved_model_budget")
    joined = results.join(expected, "session_id", "left").join(provenance, "session_id", "left")
    missing = F.col("session_id").isNull() | F.col("result_ids").isNull()
    for c in exact:
        missing = missing | F.col(c).isNull()
    reason = F.when(missing, F.lit("missing model output fields")).when(
        F.col("session_status").isNull(), F.lit("unknown review session"))
    for c in exact:
        reason = reason.when(F.col(c) != F.col(f"expected_{c}"), F.lit(f"model output {c} mismatch"))
    purpose, tokens = F.col("purpose"), F.col("token_count")
    reason = (
        reason.when(F.col("session_status") != "exported",
                    F.lit("review session has already been imported"))
        .when(~F.col("model").eqNullSafe(F.col("requested_model"))
              | ~F.col("effort").eqNullSafe(F.col("requested_effort")),
              F.lit("model provenance mismatch"))
        .when(C.blank_to_null(F.col("trace_id")).isNull() | tokens.isNull() | (tokens == 0),
              F.lit("model provenance is incomplete"))
        .when(tokens > F.col("reserved_model_budget"), F.lit("model token budget exceeded"))
        .when(F.col("result_ids") != F.col("ordered_candidate_ids"),
              F.lit("model output candidate IDs or ordering mismatch"))
        .when(~purpose.isin(*PURPOSES), F.lit("review session purpose cannot import results"))
        .when(F.col("document_characters") > _limit(purpose, 4),
              F.lit("model output exceeds accepted character limit")))
    return joined.withColumn("reject_reason", reason).select(
        *results.columns, "purpose", "token_count", "reject_reason")


def token_usage(runs: DataFrame) -> DataFrame:
    """Availability and total of each run's token parts, with the fault if any."""
    parts = [F.col(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens")]
    total, given = F.lit(0).cast("bigint"), F.lit(0)
    for p in parts:
        total, given = total + p, given + p.isNotNull().cast("int")
    negative = F.lit(False)
    for p in (*parts, F.col("total_tokens")):
        negative = negative | F.coalesce(p < 0, F.lit(False))
    stated = F.col("total_tokens").isNotNull()
    fault = (
        F.when(negative, F.lit("token fields must be non-negative integers"))
        .when((given == 3) & (F.col("total_tokens") != total),
              F.lit("total_tokens must equal known token components"))
        .when(given.between(1, 2) & stated,
              F.lit("total_tokens is unavailable when token components are partial"))
        .when((given == 0) & stated,
              F.lit("total_tokens is unavailable without token components")))
    return runs.withColumns({
        "token_availability": F.when(given == 3, F.lit("complete")).when(
            given > 0, F.lit("partial")).otherwise(F.lit("unavailable")),
        "known_total": F.when(given == 3, total), "fault": fault})


def review_activity(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Imported sessions and their results per purpose; probes are left out."""
    imported = sessions.where((F.col("status") == "imported") & F.col("purpose").isin(*PURPOSES))
    counts = results.groupBy(F.col("review_session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_results"))
    return imported.select("id", "purpose").join(counts, "id", "left").groupBy("purpose").agg(
        F.count(F.lit(1)).alias("session_count"),
        F.coalesce(F.sum("n_results"), F.lit(0)).alias("result_count"))


def activity_totals(activity: DataFrame) -> DataFrame:
    """The four snapshot numbers as one row, zero when nothing was imported."""
    return activity.agg(*(
        F.coalesce(F.sum(F.when(F.col("purpose") == p, F.col(f"{what}_count"))), F.lit(0))
        .cast("bigint").alias(f"{p}_{what}_count")
        for what in ("session", "result") for p in PURPOSES))


TRIGGER = ["trigger_kind", "trigger_id", "trigger_version"]


def activity_snapshots(triggers: DataFrame, totals: DataFrame, stored: DataFrame) -> DataFrame:
    """New snapshots, one per trigger not recorded yet, numbered after the stored ones."""
    new = triggers.dropDuplicates(TRIGGER).join(stored.select(*TRIGGER), TRIGGER, "left_anti")
    ranked = split_rank(new, [], ["created_ns", *TRIGGER], "nth")
    last = stored.agg(F.coalesce(F.max("entity_version"), F.lit(0)).alias("v")).scalar()
    numbered = ranked.withColumn("entity_version", (last + F.col("nth")).cast("bigint"))
    for column in totals.columns:
        numbered = numbered.withColumn(column, totals.select(column).scalar())
    version = F.col("entity_version")
    return numbered.withColumn("id", C.event_id(
        F.lit(K.REVIEW_SCOPE), F.lit(K.REVIEW_ACTIVITY_ENTITY), version, version,
        F.lit(K.REVIEW_ACTIVITY_EVENT))).drop("nth")


def snapshot_events(snapshots: DataFrame) -> DataFrame:
    """The derived event of each recorded activity snapshot."""
    version = F.col("entity_version")
    return derived_events(
        snapshots, F.lit(K.REVIEW_SCOPE), F.lit(K.REVIEW_ACTIVITY_ENTITY), version, version,
        F.lit(K.REVIEW_ACTIVITY_EVENT), F.col("created_ns"),
        {"review.activity.availability": F.lit("available"),
         "snapshot.trigger.kind": F.col("trigger_kind")},
        {f"review.{p}.{what}_count": F.col(f"{p}_{what}_count")
         for what in ("session", "result") for p in PURPOSES})


def session_events(sessions: DataFrame, runs: DataFrame) -> DataFrame:
    """Change events: every export, and every import with its known token fields."""
    def event(df: DataFrame, version: int, status: str, ns: str, availability: Column,
              numbers: dict[str, Column]) -> DataFrame:
        v = F.lit(version)
        made = derived_events(
            df, F.lit(K.REVIEW_SCOPE), F.col("id"), v, v, F.lit(K.REVIEW_SESSION_EVENT),
            F.col(ns), {"review.purpose": F.col("purpose"), "review.status": F.lit(status),
                        "review.token.availability": availability}, numbers)
        return made.withColumn("attributes_number", F.map_filter(
            "attributes_number", lambda _, value: value.isNotNull()))

    count = {"review.candidate.count": F.col("candidate_count")}
    exported = event(sessions, 1, "exported", "created_ns", F.lit("not_applicable"), count)
    usage = token_usage(runs).select(
        F.col("review_session_id").alias("id"), "input_tokens", "output_tokens",
        "reasoning_tokens", "known_total", "token_availability")
    done = sessions.where("status = 'imported'").join(usage, "id")
    imported = event(done, 2, "imported", "imported_ns", F.col("token_availability"), {
        **count, "review.result.count": F.col("candidate_count"),
        "review.token.input": F.col("input_tokens"),
        "review.token.output": F.col("output_tokens"),
        "review.token.reasoning": F.col("reasoning_tokens"),
        "review.token.total": F.col("known_total")})
    return exported.unionByName(imported)


def budget_ledger(sessions: DataFrame, imports: DataFrame) -> DataFrame:
    """Ledger entries: reserved on export, consumed (negative) on import."""
    reserved = sessions.select(
        F.col("id").alias("review_session_id"), F.lit("reserved").alias("entry_type"),
        F.col("reserved_model_budget").alias("amount"))
    consumed = imports.select(
        F.col("session_id").alias("review_session_id"), F.lit("consumed").alias("entry_type"),
        (-F.col("token_count")).alias("amount"))
    return reserved.unionByName(consumed)


def budget_balance(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("review_session_id").agg(F.sum("amount").alias("remaining"))


def import_results(validated: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One fact per (session, candidate) of the accepted documents."""
    facts = validated.where("reject_reason is null").select(
        F.when(F.col("purpose") == "classification", F.lit("semantic_classification"))
        .otherwise(F.lit("proposal_draft")).alias("fact"),
        F.col("session_id").alias("review_session_id"),
        F.explode("result_ids").alias("candidate_id")
    ).dropDuplicates(["review_session_id", "candidate_id"])
    if stored is None:
        return facts
    keys = ["review_session_id", "candidate_id"]
    return facts.join(stored.select(*keys), keys, "left_anti")


def capability_gaps(proofs: DataFrame, required: DataFrame, now_ns: int, tool_version: str,
                    schema_fingerprint: str) -> DataFrame:
    """Required (model, effort) pairs without a proof younger than thirty days."""
    valid = proofs.where(
        (F.col("tool_version") == tool_version)
        & (F.col("schema_fingerprint") == schema_fingerprint)
        & (F.col("proven_ns") > now_ns - 30 * K.NS_PER_DAY)).select("model", "effort").distinct()
    return required.join(valid, ["model", "effort"], "left_anti")
