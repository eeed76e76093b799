"""One complete run: scan a window, extend the stored facts, publish them together.

A run passes gates in this order, and fails closed at the first that does not hold: the source
contract is approved, an analysis generation is active, the watermark does not go back, no
stored observation comes again with other content. Every ending, a failed one as well, closes
the attempt in the journal and leaves a pipeline and a review snapshot; facts, trends and
projections are published only by a run that ended well.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators import events as E
from tracefold.operators import generations, identity, observations, review
from tracefold.plans import panels, scan
from tracefold.sources import contract as source_contract
from tracefold.sources import files, journal, sinks

SOURCE = "logs"
#: Tables laid out by the day of a time, in buckets of a key.
BY_DAY = {"observations": ("occurred_at_ns", "observation_id"),
          "events": ("timestamp_ns", "event_id")}
_ACTIVATIONS = "generation_id string, activation_event_id string, activated_ns long"
_CONTENT = ["detector_id", "fingerprint", "task_identity", "project_identity_id",
            "occurred_at_ns", "member_count", "first_event_id"]


class RunStopped(RuntimeError):
    """A gate of the run does not hold; ``error_class`` names it."""

    def __init__(self, error_class: str, message: str) -> None:
        super().__init__(message)
        self.error_class = error_class


@dataclass
class Progress:
    """What is known of a run when it ends, wherever that is."""
    phase: str = "processing"
    logs: dict = field(default_factory=dict)
    traces: dict = field(default_factory=dict)
    hydration: dict = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def stream(self, name: str) -> dict:
        unknown = {"query_status": "failed" if self.phase == _PHASES[name] else "unknown",
                   "data_state": "unknown", "latest_ns": None}
        return getattr(self, name) or unknown


_PHASES = {"logs": "logs_query", "traces": "traces_query", "hydration": "hydration"}


def next_bounds(spark: SparkSession, store: str, end_ns: int) -> tuple[int, int]:
    """Window of the next run: from the published watermark, else seven days back."""
    state = sinks.read_latest(spark, store, "watermark")
    row = None if state is None else state.where(F.col("source") == SOURCE).first()
    start = max(0, end_ns - K.TREND_WINDOW_DAYS * K.NS_PER_DAY) if row is None else (
        row.timestamp_ns)
    if row is not None and end_ns < start:
        raise RunStopped("watermark", f"the source watermark would go back from {start}")
    return (start if start < end_ns else max(0, end_ns - 1)), end_ns


# ---- the active generation --------------------------------------------------------

def activated(spark: SparkSession, store: str) -> DataFrame:
    held = sinks.read_results(spark, f"{store}/generations", "activations")
    return spark.createDataFrame([], _ACTIVATIONS) if held is None else held.drop("run_id")


def activate(spark: SparkSession, store: str, generation: str, now_ns: int) -> None:
    """Make ``generation`` the one that runs project into; repeating it changes nothing."""
    ready = spark.createDataFrame([(generation,)], "generation_id string")
    facts = generations.activations(ready, activated(spark, store), now_ns)
    sinks.write_results({"activations": facts}, f"{store}/generations", generation, now_ns)


def pointer(spark: SparkSession, store: str) -> str | None:
    row = generations.current_generation(activated(spark, store)).first()
    return None if row is None else row["generation_id"]


def _checked_contract(raw_logs: DataFrame, raw_spans: DataFrame, required: DataFrame,
                      approvals: DataFrame) -> None:
    spark = raw_logs.sparkSession
    observed = source_contract.table_columns(
        spark, {"logs": raw_logs.schema, "spans": raw_spans.schema})
    missing = source_contract.contract_check(observed, required).first()
    if missing is not None:
        raise RunStopped("source_contract", f"the source has no {missing['table']}."
                                            f"{missing['name']}")
    prints = source_contract.contract_fingerprint(observed, required)
    if not source_contract.unapproved(prints, approvals).isEmpty():
        raise RunStopped("source_contract", "the source contract is not approved")


# ---- endings ------------------------------------------------------------------------

def _state(rows: DataFrame, latest: str | None = None) -> dict:
    newest = F.max(latest) if latest else F.lit(None).cast("bigint")
    n, last = rows.agg(F.count("*"), newest).first()
    return {"query_status": "available", "data_state": "records" if n else "no_data",
            "latest_ns": last, "rows": n}


def _snapshots(spark: SparkSession, store: str, attempt: str, end_ns: int, status: str,
               error_class: str | None, progress: Progress, started_ns: int, finished_ns: int,
               generation: str | None, reviews: tuple[DataFrame, DataFrame] | None,
               pending: int = 0) -> tuple[DataFrame, DataFrame | None]:
    """The pipeline event of an attempt, and its review snapshot if there are reviews."""
    row = {"run_id": attempt, "terminal_status": status, "finished_ns": finished_ns}
    for name in _PHASES:
        row |= {f"{name}_{k}": v for k, v in progress.stream(name).items() if k != "rows"}
    schema = "run_id string, terminal_status string, finished_ns long, " + ", ".join(
        f"{n}_query_status string, {n}_data_state string, {n}_latest_ns long" for n in _PHASES)
    names = [c.split()[0] for c in schema.split(", ")]
    shot = E.pipeline_snapshots(spark.createDataFrame([tuple(row[n] for n in names)], schema))
    processed = progress.logs.get("rows", 0) + progress.traces.get("rows", 0)
    made = E.pipeline_events(shot, end_ns, error_class, generation,
                             (finished_ns - started_ns) / 1e6, processed, pending)
    if reviews is None:
        return made, None
    held = spark.createDataFrame([], "trigger_kind string, trigger_id string, "
                                     "trigger_version int, entity_version long")
    before = read_snapshots(spark, store, "review_snapshots")
    if before is not None:
        held = before.select(*held.columns)
    trigger = spark.createDataFrame([("scan_run", attempt, 1, finished_ns)],
                                    "trigger_kind string, trigger_id string, "
                                    "trigger_version int, created_ns long")
    totals = review.activity_totals(review.review_activity(*reviews))
    shots = sinks.stored(review.activity_snapshots(trigger, totals, held), "review-snapshot")
    return made.unionByName(review.snapshot_events(shots)), shots


def read_snapshots(spark: SparkSession, store: str, name: str = "snapshots") -> DataFrame | None:
    """Snapshots of every attempt that has ended, failed ones included."""
    table = sinks.table_at(spark, f"{store}/{name}")
    ended = journal.runs(spark, store)
    if table is None or ended is None:
        return None
    return table.join(ended.where("status <> 'running'").select(F.col("id").alias("attempt")),
                      "attempt", "left_semi").drop("attempt")


def _markers(spark: SparkSession, store: str) -> DataFrame:
    one = F.lit(1)
    return E.derived_events(
        activated(spark, store), F.lit(K.OPERATIONAL_SCOPE), F.col("generation_id"), one, one,
        F.lit(K.ACTIVATION_EVENT), F.col("activated_ns"),
        {"analysis.generation": F.col("generation_id")})


def read_latest_rows(spark: SparkSession, store: str) -> DataFrame | None:
    """The latest pointer and review rows as of the last attempt that ended: for the panels."""
    ended = journal.runs(spark, store)
    row = None if ended is None else ended.where("completed_ns is not null").orderBy(
        F.desc("completed_ns"), F.desc("id")).first()
    return None if row is None else sinks.table_at(spark, f"{store}/latest/attempt={row['id']}")


def read_events(spark: SparkSession, store: str) -> DataFrame | None:
    """Derived events for the panels: projections, snapshots and activation markers."""
    parts = [read_snapshots(spark, store), sinks.read_results(spark, store, "events")]
    parts = [p.select(*E.EVENT_COLUMNS) for p in parts if p is not None]
    parts.append(_markers(spark, store))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("ts_bucket_start", C.floor_div(
        F.col("timestamp_ns"), 1800 * K.NS_PER_SECOND) * 1800)


# ---- delivery ---------------------------------------------------------------------------

#: Rounds of one run, and events of one round.
ROUNDS, ROUND_EVENTS = 20, 500
_STATE = ["status", "attempt_count", "next_attempt_ns", "created_ns", "delivered_ns"]


def outbox(spark: SparkSession, store: str, now_ns: int) -> DataFrame:
    """Events that still have to be delivered, with their delivery state.

    The last attempt that ended and delivered left what was pending then. Events of attempts
    that it did not know, its own snapshots and theirs are added as due; what earlier attempts
    wrote is not read again.
    """
    ended = journal.runs(spark, store)
    last, done = None, spark.createDataFrame([], "attempt string, completed_ns long")
    if ended is not None:
        held = {n.removeprefix("attempt=") for n in files.names(spark, f"{store}/outbox")}
        done = ended.where("completed_ns is not null").select(
            F.col("id").alias("attempt"), "completed_ns")
        newest_first = done.orderBy(F.desc("completed_ns"), F.desc("attempt"))
        last = next((r for r in newest_first.toLocalIterator() if r["attempt"] in held), None)
    until = -1 if last is None else last["completed_ns"]
    covered = done.where(F.col("completed_ns") <= until).select("attempt")
    parts = [_markers(spark, store)]
    events, runs = sinks.table_at(spark, f"{store}/events"), sinks.published_runs(spark, store)
    if events is not None and runs is not None:
        new = runs.select("attempt").join(covered, "attempt", "left_anti")
        parts.append(events.join(new, "attempt").select(*E.EVENT_COLUMNS))
    shots = sinks.table_at(spark, f"{store}/snapshots")
    if shots is not None:
        new = done.where(F.col("completed_ns") >= until).select("attempt")
        parts.append(shots.join(new, "attempt").select(*E.EVENT_COLUMNS))
    fresh = parts[0]
    for part in parts[1:]:
        fresh = fresh.unionByName(part)
    fresh = fresh.withColumns({
        "status": F.lit("pending"), "attempt_count": F.lit(0),
        "next_attempt_ns": F.lit(0).cast("bigint"), "created_ns": F.lit(now_ns).cast("bigint"),
        "delivered_ns": F.lit(None).cast("bigint")})
    if last is None:
        return fresh
    known = spark.read.parquet(f"{store}/outbox/attempt={last['attempt']}")
    return known.unionByName(fresh.join(known.select("event_id"), "event_id", "left_anti"))


def deliver_pending(spark: SparkSession, store: str, deliver: Callable[[DataFrame], DataFrame],
                    now_ns: int) -> tuple[DataFrame, int]:
    """Send what is due, round by round, until nothing is due or nothing arrives.

    Returns what the next run has to know and how many events are pending: the pending ones,
    and the few markers delivered (one a generation), which every run lists again.
    """
    box = sinks.stored(outbox(spark, store, now_ns), "outbox")
    for _ in range(ROUNDS):
        batch = sinks.stored(E.delivery_batch(box, now_ns, ROUND_EVENTS), "delivery")
        if batch.isEmpty():
            break
        tried = sinks.stored(deliver(batch).select("event_id", "delivered"), "delivered")
        state = E.retry_backoff(box, tried, now_ns).select("event_id", *_STATE)
        box = sinks.stored(box.drop(*_STATE).join(state, "event_id"), "outbox")
        if tried.where("delivered").isEmpty():
            break
    pending = box.where("status <> 'delivered'")
    marks = box.where((F.col("status") == "delivered") & (
        F.col("event_name") == K.ACTIVATION_EVENT))
    return pending.unionByName(marks), pending.count()


# ---- the run ---------------------------------------------------------------------------

def run_scan(raw_logs: DataFrame, raw_spans: DataFrame, roots: DataFrame, store: str,
             run_id: str, end_ns: int, generation: str | None = None,
             aliases: DataFrame | None = None, extras: DataFrame | None = None,
             verified: bool = True, policy: str = "quarantine",
             contract: tuple[DataFrame, DataFrame] | None = None,
             reviews: tuple[DataFrame, DataFrame] | None = None,
             deliver: Callable[[DataFrame], DataFrame] | None = None,
             clock: Callable[[], int] = time.time_ns) -> str | None:
    """Detect, merge with the published facts and publish this run's tables.

    Returns the status of the run, None if it is published already. Tables are written into the
    attempt's own folders and appear with its manifest, so a lost job leaves no partial results
    and can simply be repeated, and of two attempts at once one is published. ``generation``
    None takes the active one; without one the run ends as failed and projects nothing.
    ``verified`` is the rule of ``tool_loop``; ``policy`` says whether rejected rows go to the
    table ``rejects`` or fail the run. ``contract`` is (required columns, approved
    fingerprints), ``reviews`` (sessions, results) of the review store. ``deliver`` sends a
    batch of events and says which arrived (event_id, delivered); see ``deliver_pending``.
    """
    spark = raw_logs.sparkSession
    if sinks.is_published(spark, store, run_id):
        return None
    scan.utc_session(spark)
    with sinks.scratch(spark):
        return _run(raw_logs, raw_spans, roots, store, run_id, end_ns, generation, aliases,
                    extras, verified, policy, contract, reviews, deliver, clock)


def _run(raw_logs: DataFrame, raw_spans: DataFrame, roots: DataFrame, store: str, run_id: str,
         end_ns: int, generation: str | None, aliases: DataFrame | None,
         extras: DataFrame | None, verified: bool, policy: str,
         contract: tuple[DataFrame, DataFrame] | None,
         reviews: tuple[DataFrame, DataFrame] | None,
         deliver: Callable[[DataFrame], DataFrame] | None, clock: Callable[[], int]) -> str:
    spark = raw_logs.sparkSession
    started_ns = clock()
    journal.recover(spark, store, started_ns)
    attempt, progress = sinks.new_attempt(), Progress()
    failure: BaseException | None = None
    error_class, status, start_ns = None, "failed", end_ns
    try:
        try:
            start_ns, end_ns = next_bounds(spark, store, end_ns)
        finally:
            journal.start(spark, store, attempt, run_id, started_ns, start_ns, end_ns)
        if contract is not None:
            _checked_contract(raw_logs, raw_spans, *contract)
        generation = generation or pointer(spark, store)
        if generation is None:
            raise RunStopped("generation_unavailable", "no analysis generation is active")
        tables = _facts(raw_logs, raw_spans, roots, store, run_id, start_ns, end_ns, generation,
                        aliases, extras, verified, policy, progress)
        days = sinks.write_attempt(tables, store, attempt, BY_DAY)
        empty = not progress.logs["rows"] and not progress.traces["rows"]
        status = "no_data" if empty else "succeeded"
        if not sinks.publish(spark, store, run_id, attempt, end_ns, days):
            raise RunStopped("superseded", f"another attempt of {run_id} was published")
    except BaseException as error:
        failure, status, generation = error, "failed", None
        error_class = getattr(error, "error_class", progress.phase)
    pending, rest = 0, None
    if deliver is not None:
        try:
            rest, pending = deliver_pending(spark, store, deliver, clock())
        except BaseException as error:
            failure, status, generation, error_class = error, "failed", None, "telemetry"
    finished_ns = clock()
    shots, review_shots = _snapshots(spark, store, attempt, end_ns, status, error_class, progress,
                                     started_ns, finished_ns, generation, reviews,
                                     pending)
    if rest is not None:
        rest.write.parquet(f"{store}/outbox/attempt={attempt}")
    shots = sinks.stored(shots, "snapshots")
    latest = sinks.stored(panels.latest_rows(shots.unionByName(_markers(spark, store)),
                                             read_latest_rows(spark, store)), "latest")
    latest.write.parquet(f"{store}/latest/attempt={attempt}")
    shots.write.parquet(f"{store}/snapshots/attempt={attempt}")
    if review_shots is not None:
        review_shots.write.parquet(f"{store}/review_snapshots/attempt={attempt}")
    journal.end(spark, store, attempt, status, finished_ns,
                progress.logs.get("rows", 0) + progress.traces.get("rows", 0), error_class,
                progress.counts)
    if failure is not None and error_class not in ("generation_unavailable", "superseded"):
        raise failure
    return status


def _facts(raw_logs: DataFrame, raw_spans: DataFrame, roots: DataFrame, store: str, run_id: str,
           start_ns: int, end_ns: int, generation: str, aliases: DataFrame | None,
           extras: DataFrame | None, verified: bool, policy: str, progress: Progress
           ) -> dict[str, DataFrame]:
    """The tables of one run. Of the stored observations only the days are read that the new
    ones or the trend window can touch."""
    spark = raw_logs.sparkSession

    def entered(phase: str) -> None:
        progress.phase = phase

    linked, placed, hydration, rejects = scan.scan_window(
        raw_logs, raw_spans, roots, start_ns, end_ns, aliases, policy, entered)
    progress.logs = _state(linked, "timestamp_ns")
    progress.traces = _state(placed, "ended_at_ns")
    hydration = sinks.stored(hydration, "hydration")
    progress.hydration = _state(hydration)
    progress.phase = "processing"
    events = sinks.stored(scan.detector_events(linked, placed, hydration, extras), "events")
    records, members = scan.observe(events, verified=verified)
    records = sinks.stored(records, "observations")
    days, buckets = sinks.places(records, "occurred_at_ns", "observation_id")
    earlier = sinks.read_results(spark, store, "observations", days, buckets) if days else None
    if earlier is not None:
        conflict = observations.replay_conflicts(records, earlier, _CONTENT).first()
        if conflict is not None:
            raise RunStopped("processing", "observation " + conflict["observation_id"]
                             + " is stored with other content")
        records = sinks.stored(observations.append_new(records, earlier), "new-observations")
    projects = identity.project_dimension(identity.resolve_projects(placed, roots, aliases))
    known = sinks.read_results(spark, store, "projects")
    new_projects = projects if known is None else projects.join(
        known.select("id"), "id", "left_anti")
    all_projects = projects if known is None else known.select(*projects.columns).unionByName(
        new_projects)
    member_rows = observations.observation_members(records, members)

    previous = sinks.read_latest(spark, store, "findings")
    findings = observations.findings_upsert(records, previous)
    window = sinks.days_between(end_ns - K.TREND_WINDOW_DAYS * K.NS_PER_DAY, end_ns)
    recent = sinks.read_results(spark, store, "observations", window)
    needed = ["fingerprint", "occurred_at_ns", "task_identity"]
    observed = records.select(*needed)
    if recent is not None:
        observed = observed.unionByName(recent.select(*needed))
    occurrences = observed.withColumn("finding_id", C.finding_id(F.col("fingerprint")))
    prior = observations.previously_actionable(
        findings.where("false") if previous is None else previous)
    evaluations = sinks.stored(
        observations.trend_states(occurrences, prior, end_ns), "evaluations")
    findings = sinks.stored(observations.finding_update(findings, evaluations), "findings")
    described = evaluations.join(findings.select(
        "finding_id", "category", "detector_id", "project_identity_id", "entity_version"),
        "finding_id")
    derived = E.observation_events(records, all_projects, generation).unionByName(
        E.trend_events(described, all_projects, generation))
    watermark = spark.range(1).select(
        F.lit(SOURCE).alias("source"), F.lit(end_ns).cast("bigint").alias("timestamp_ns"))
    progress.counts = {
        "logs": progress.logs["rows"], "traces": progress.traces["rows"],
        "hydrated": progress.hydration["rows"], "observations": records.count(),
        "trends": evaluations.count()}
    return {
        "projects": new_projects, "observations": records, "members": member_rows,
        "evidence": observations.evidence_rows(member_rows, hydration),
        "membership": observations.finding_membership(records), "findings": findings,
        "trends": observations.trend_append(evaluations, run_id), "events": derived,
        "watermark": watermark, "rejects": rejects,
    }
