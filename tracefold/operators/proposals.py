"""Proposals: state history, audits and intervention choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import constants as K
from tracefold.operators.events import derived_events


def proposal_state(history: DataFrame) -> DataFrame:
    """Current state per proposal: the one of its highest sequence."""
    latest = history.groupBy("proposal_id").agg(
        F.max_by(F.struct("event_type", "sequence", "created_ns"), F.col("sequence")).alias("l"))
    return latest.select(
        "proposal_id", F.when(F.col("l.event_type") == "created", F.lit("pending")).otherwise(
            F.col("l.event_type")).alias("state"), F.col("l.sequence").alias("entity_version"),
        F.col("l.created_ns").alias("updated_ns"))


def allowed(source: Column, target: Column) -> Column:
    pairs = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, b in K.PROPOSAL_TRANSITIONS]
    return F.concat_ws(">", source, target).isin(*pairs)


def invalid_transitions(history: DataFrame) -> DataFrame:
    """History entries that break the allowed state graph.

    ``history``: proposal_id, sequence, event_type, explicit_request, validation. A
    proposal's history is as short as its state graph when valid; an entry is checked
    against the one before it through the sequence, which needs no ordered group.
    """
    state = F.when(F.col("event_type") == "created", F.lit("pending")).otherwise(
        F.col("event_type"))
    now = history.withColumn("state", state)
    before = now.select("proposal_id", (F.col("sequence") + 1).alias("sequence"),
                        F.col("state").alias("from_state"))
    fault = (
        F.when((F.col("sequence") == 1) & (F.col("event_type") != "created"),
               F.lit("history must start with created"))
        .when((F.col("sequence") > 1) & F.col("from_state").isNull(), F.lit("sequence gap"))
        .when((F.col("sequence") > 1) & ~allowed(F.col("from_state"), F.col("state")),
              F.lit("invalid proposal transition"))
        .when((F.col("state") == "applying") & ~F.coalesce("explicit_request", F.lit(False)),
              F.lit("entering applying requires a separate explicit user request"))
        .when((F.col("state") == "applied") & ~F.coalesce("validation", F.lit(False)),
              F.lit("validation evidence is required before marking applied")))
    return now.join(before, ["proposal_id", "sequence"], "left").withColumn(
        "fault", fault).where("fault is not null").select(
        "proposal_id", "sequence", "from_state", "state", "fault")


def proposal_eligibility(proposals: DataFrame, findings: DataFrame) -> DataFrame:
    """First reason a proposal may not be created; null when it may.

    ``proposals``: proposal_id, finding_id, tiers array<struct<tier, can_enforce,
    reason_unavailable>>.
    """
    joined = proposals.join(findings.select("finding_id", "trend_state"), "finding_id", "left")
    tiers = F.col("tiers")
    labels = F.transform(tiers, lambda t: t["tier"])
    blank = lambda t: F.coalesce(t["reason_unavailable"], F.lit("")) == ""
    fault = (
        F.when(labels != F.array(*map(F.lit, K.TIER_LABELS)),
               F.lit("established-tool audit must evaluate the canonical tier order"))
        .when(F.exists(tiers, lambda t: t["can_enforce"].isNull()),
              F.lit("each deterministic enforcement tier requires can_enforce"))
        .when(F.exists(tiers, lambda t: t["can_enforce"] & t["reason_unavailable"].isNotNull()),
              F.lit("an available enforcement tier cannot be unavailable"))
        .when(F.exists(tiers, lambda t: ~t["can_enforce"] & blank(t)),
              F.lit("each unavailable enforcement tier requires a recorded reason"))
        .when(F.size(F.filter(tiers, lambda t: t["can_enforce"])) > 1,
              F.lit("a proposal can select only one deterministic enforcement tier"))
        .when(F.col("trend_state").isNull(), F.lit("unknown finding"))
        .when(F.col("trend_state") != "actionable",
              F.lit("only actionable findings can produce proposals")))
    return joined.withColumn("fault", fault)


def select_intervention(decisions: DataFrame) -> DataFrame:
    """Exactly one intervention per decision, deterministic tiers first.

    ``decisions``: can_enforce array<boolean> in tier order, workflow_owner_skill,
    repeated_ordered_workflow, recurrence_scope.
    """
    kinds = ("established_tool", "new_tool", "bespoke_script")
    tier = F.array_position("can_enforce", F.lit(True))
    place = lambda i: F.element_at(F.array(*map(F.lit, i)), F.greatest(tier, F.lit(1)).cast("int"))
    enforce, owner = tier > 0, F.col("workflow_owner_skill")
    guidance = (
        F.when(F.col("recurrence_scope") == "folder", F.lit("folder guidance"))
        .when(F.col("recurrence_scope") == "project", F.lit("project guidance"))
        .when(F.col("recurrence_scope") == "cross-project", F.lit("~/.codex/AGENTS.md")))
    repeated = F.coalesce("repeated_ordered_workflow", F.lit(False))
    return decisions.withColumns({
        "intervention_type": F.when(enforce, place(kinds))
        .when(owner.isNotNull(), F.lit("improve_skill"))
        .when(repeated, F.lit("create_skill"))
        .when(guidance.isNotNull(), F.lit("agents_guidance")),
        "guidance_scope": F.when(enforce, F.lit(None)).when(owner.isNotNull(), owner)
        .when(repeated, F.lit(None)).otherwise(guidance),
        "rationale": F.when(enforce, F.concat(place(K.TIER_LABELS), F.lit(
            " can represent the behavior deterministically")))
        .when(owner.isNotNull(),
              F.lit("the owning workflow skill must be improved through $create-skill"))
        .when(repeated, F.lit(
            "the repeated ordered workflow has no owner and requires $create-skill"))
        .otherwise(F.concat(F.lit("cross-workflow behavior belongs in "), guidance)),
    })


def proposal_list(history: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals with current state, oldest first."""
    return proposals.join(proposal_state(history), "proposal_id").select(
        "proposal_id", "finding_id", "state", "created_ns", "updated_ns").orderBy(
        "created_ns", "proposal_id")


def proposal_history(history: DataFrame) -> DataFrame:
    """Every entry next to the one before it, in order per proposal."""
    before = history.select("proposal_id", (F.col("sequence") + 1).alias("sequence"),
                            F.col("event_type").alias("previous_event"))
    return history.join(before, ["proposal_id", "sequence"], "left").orderBy(
        "proposal_id", "sequence")


def proposal_events(history: DataFrame, proposals: DataFrame) -> DataFrame:
    """One derived event per state change."""
    state = F.when(F.col("event_type") == "created", F.lit("pending")).otherwise(
        F.col("event_type"))
    joined = history.join(proposals.drop("created_ns"), "proposal_id")
    version = F.col("sequence")
    return derived_events(
        joined, F.lit(K.REVIEW_SCOPE), F.col("proposal_id"), version, version,
        F.lit(K.PROPOSAL_EVENT), F.col("created_ns"),
        {"proposal.state": state, "proposal.scope": F.col("proposal_scope"),
         "intervention.type": F.col("intervention_type"), "finding.id": F.col("finding_id"),
         "detector.id": F.col("detector_id")})
