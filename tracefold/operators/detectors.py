"""Behaviour detectors: events in, observation members out.

Every detector returns one row per (observation, member) with ``MEMBER_COLUMNS``.
The row with ordinal 1 is the first member and carries the fields the observation
takes from it, so no operator needs the members of a group in one array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators.ordering import (
    DEFAULT_SLICE_NS, RANGE_SIZES, blocked, range_members, salted_join, sliced, time_slice,
)
from tracefold.sources.sinks import stored

ORDER = ["timestamp_ns", "event_id"]
TASK = ["project_id", "task_id"]
MEMBER_COLUMNS = [
    "detector_id", "group_id", "ordinal", "member_count", "event_id", "timestamp_ns",
    "project_id", "task_id", "operation_kind", "target_kind", "normalized_target",
    "failure_class", "explanation",
]


def member_rows(df: DataFrame, detector: str, group: Column, failure_class: Column,
             explanation: Column, ordinal: Column | None = None,
             count: Column | None = None) -> DataFrame:
    kind, target = F.col("op_kind"), F.col("op_target")
    one = F.lit(1).cast("bigint")
    return df.select(
        F.lit(detector).alias("detector_id"), group.alias("group_id"),
        (one if ordinal is None else ordinal.cast("bigint")).alias("ordinal"),
        (one if count is None else count.cast("bigint")).alias("member_count"),
        "event_id", "timestamp_ns", "project_id", "task_id",
        C.operation_kind(kind).alias("operation_kind"),
        C.target_kind(kind, target).alias("target_kind"),
        C.operation_target(kind, target, F.col("op_executable"), F.col("event_name"))
        .alias("normalized_target"),
        failure_class.alias("failure_class"), explanation.alias("explanation"),
    )


def _one(df: DataFrame, detector: str, failure_class: Column, explanation: Column) -> DataFrame:
    return member_rows(df, detector, F.col("event_id"), failure_class, explanation)


def _failure_class() -> Column:
    return C.tool_failure_class(F.col("event_name"), F.col("success_string"),
                                F.col("success_bool"), F.col("status_code"))


def tool_failure(events: DataFrame) -> DataFrame:
    hit = events.withColumn("_class", _failure_class()).where("_class is not null")
    return _one(hit, "tool_failure", F.col("_class"), F.concat(
        "event_name", F.lit(" satisfies the explicit "), "_class", F.lit(" predicate")))


def transport_instability(events: DataFrame) -> DataFrame:
    failed = ~F.col("success_bool") | (F.col("status_code") >= 400)
    hit = events.where(F.col("event_name").isin(*K.TRANSPORT_EVENTS) & failed)
    return _one(hit, "transport_instability",
                F.coalesce(_failure_class(), F.lit("transport_failure")),
                F.lit("API or WebSocket telemetry records an explicit transport failure"))


def sandbox_friction(events: DataFrame) -> DataFrame:
    hit = events.where(F.col("event_name") == "codex.sandbox_outcome")
    return _one(hit, "sandbox_friction",
                F.coalesce(C.blank_to_null(F.col("outcome")), F.lit("sandbox_outcome")),
                F.lit("event is an observed codex.sandbox_outcome"))


def turn_correction(events: DataFrame) -> DataFrame:
    turn = F.col("event_name").isin("turn/interrupt", "turn/steer")
    user = C.user_decision(F.col("event_name"), F.col("decision_source"))
    return _one(
        events.where(turn | user), "turn_correction",
        F.when(turn, F.col("event_name")).otherwise(F.lit("user_tool_decision")),
        F.when(turn, F.concat(F.lit("trace contains "), "event_name")).otherwise(
            F.lit("codex.tool_decision records an explicit user-sourced decision")))


def skill_adherence(events: DataFrame) -> DataFrame:
    hit = events.where(F.col("skill_required").isNotNull() & ~F.col("skill_used"))
    return _one(hit, "skill_adherence", F.lit("required_skill_not_used"), F.concat(
        F.lit("required skill '"), "skill_required", F.lit("' was explicitly not used")))


def _group_id(*keys: str) -> Column:
    return C.stable_id(*(F.col(k) for k in keys))


def repeated_attempt(events: DataFrame, slice_ns: int = DEFAULT_SLICE_NS) -> DataFrame:
    keys = [*TASK, "op_key"]
    rows = sliced(events.where("op_key is not null"), keys, [time_slice(width_ns=slice_ns)], ORDER,
                  running={"nth": F.lit(1)}, totals={"n": "nth"}, keep=F.col("n") >= 2)
    return member_rows(rows, "repeated_attempt", _group_id(*keys),
                    F.lit("same_normalized_operation"),
                    F.concat(F.lit("the same normalized operation occurred "),
                             F.col("n").cast("string"), F.lit(" times in one task")),
                    F.col("nth"), F.col("n"))


def command_churn(events: DataFrame, slice_ns: int = DEFAULT_SLICE_NS) -> DataFrame:
    keys = [*TASK, "op_target"]
    shell = events.where((F.col("op_kind") == "shell") & (F.col("op_target") != ""))
    groups = (
        shell.groupBy(*keys, "op_key").agg(F.lit(1).alias("one"))
        .groupBy(*keys).agg(F.count("one").alias("n_commands")).where("n_commands >= 3")
    )
    rows = sliced(shell, keys, [time_slice(width_ns=slice_ns)], ORDER, running={"nth": F.lit(1)},
                  totals={"n": "nth"}, groups=groups)
    return member_rows(rows, "command_churn", _group_id(*keys),
                    F.lit("three_distinct_commands_same_target"),
                    F.concat(F.col("n_commands").cast("string"), F.lit(
                        " distinct normalized shell commands targeted the same path")),
                    F.col("nth"), F.col("n"))


def scope_recurrence(events: DataFrame, slice_ns: int = DEFAULT_SLICE_NS) -> DataFrame:
    keys = ["project_id", "op_target"]
    scoped = events.where(F.col("op_target") != "")
    groups = (
        scoped.where("counts_as_distinct_task").groupBy(*keys, "task_id")
        .agg(F.lit(1).alias("one"))
        .groupBy(*keys).agg(F.count("one").alias("n_tasks")).where("n_tasks >= 2")
    )
    rows = sliced(scoped, keys, [time_slice(width_ns=slice_ns)], ORDER, running={"nth": F.lit(1)},
                  totals={"n": "nth"}, groups=groups)
    return member_rows(rows, "scope_recurrence", _group_id(*keys),
                    F.lit("same_scope_multiple_canonical_tasks"),
                    F.concat(F.lit("the normalized target recurred across "),
                             F.col("n_tasks").cast("string"), F.lit(" canonical tasks")),
                    F.col("nth"), F.col("n"))


def quality_gate_bypass(events: DataFrame, slice_ns: int = DEFAULT_SLICE_NS) -> DataFrame:
    """A gate fails, files change, and the same gate then passes in one task."""
    gate = C.is_quality_gate(F.col("op_kind"), F.col("op_executable"),
                             F.col("is_quality_gate")) & F.col("op_exit_code").isNotNull()
    timeline = events.withColumn("_gate", gate).where("_gate or is_mutation")
    timeline = sliced(
        timeline, TASK, [time_slice(width_ns=slice_ns)], ORDER,
        running={"edits": F.when(F.col("_gate"), 0).otherwise(1)},
        totals={"task_edits": "edits"}, keep=F.col("task_edits") > 0)
    gates = sliced(
        timeline.where("_gate"), [*TASK, "op_key"], [time_slice(width_ns=slice_ns)], ORDER,
        running={"gates": F.lit(1)}, totals={"n_gates": "gates"}, keep=F.col("n_gates") >= 2,
        previous={"prev_exit": F.col("op_exit_code"), "prev_edits": F.col("edits"),
                  "prev_event_id": F.col("event_id")})
    passed = gates.where("op_exit_code = 0 and prev_exit <> 0 and edits > prev_edits")
    count = F.col("edits") - F.col("prev_edits") + 2
    hits = passed.select(
        *TASK, F.col("event_id").alias("group_id"), F.col("prev_event_id").alias("failed_id"),
        (F.col("prev_edits") + 1).alias("first_pos"), F.col("edits").alias("last_pos"),
        count.alias("n"))
    changes = range_members(hits, timeline.where("not _gate"), TASK, "edits",
                            RANGE_SIZES).withColumn(
        "nth", F.col("edits") - F.col("first_pos") + 2)
    opened = timeline.where("_gate and op_exit_code <> 0").join(
        hits.select("group_id", "n", F.col("failed_id").alias("event_id")), "event_id"
    ).withColumn("nth", F.lit(1))
    closed = passed.withColumns({"group_id": F.col("event_id"), "n": count, "nth": count})
    return reduce(DataFrame.unionByName, (
        member_rows(part, "quality_gate_bypass", F.col("group_id"),
                 F.lit("mutation_between_failed_and_passing_gate"),
                 F.lit("a failed quality command was followed by mutation before "
                       "same normalized command passed"),
                 F.col("nth"), F.col("n"))
        for part in (opened, changes, closed)))


def _stretches(same: DataFrame, block: int) -> DataFrame:
    """Maximal runs of consecutive positions per (task, lag), joined across blocks."""
    inside = Window.partitionBy(*TASK, "lag", "block").orderBy("pos")
    # written once: both branches below would compute the windows of ``same`` again
    local = stored(same.withColumn("_island", F.col("pos") - F.row_number().over(
        inside)).groupBy(*TASK, "lag", "block", "_island").agg(
            F.min("pos").alias("first_pos"), F.max("pos").alias("stop_pos")), "loop-islands")
    # Only runs touching a block border can continue in another block.
    touches = (F.pmod(F.col("first_pos") - 1, F.lit(block)) == 0) | (
        F.pmod(F.col("stop_pos"), F.lit(block)) == 0)
    across = Window.partitionBy(*TASK, "lag").orderBy("first_pos")
    broken = F.coalesce(F.lag("stop_pos").over(across) + 1 != F.col("first_pos"), F.lit(True))
    merged = local.where(touches).withColumn("_new", broken.cast("int")).withColumn(
        "_run", F.sum("_new").over(across)).groupBy(*TASK, "lag", "_run").agg(
            F.min("first_pos").alias("first_pos"), F.max("stop_pos").alias("stop_pos"))
    columns = [*TASK, "lag", "first_pos", "stop_pos"]
    return local.where(~touches).select(*columns).unionByName(merged.select(*columns))


def _lag_runs(ranked: DataFrame, max_cycle: int, block: int) -> DataFrame:
    """Runs of positions whose operation equals the one ``lag`` places later."""
    cut = blocked(ranked.select(*TASK, "pos", "op_key"), "pos", block, ahead=max_cycle)
    ahead = Window.partitionBy(*TASK, "block").orderBy("pos")
    lags = F.array(*(
        F.when(F.lead("op_key", n).over(ahead) == F.col("op_key"), F.lit(n))
        for n in range(1, max_cycle + 1)))
    same = cut.withColumn("lags", lags).where("not halo").select(
        *TASK, "block", "pos", F.explode("lags").alias("lag")).where("lag is not null")
    return _stretches(same, block)


def _next_grams(grams: DataFrame, width: int, block: int) -> DataFrame:
    """Hashes of 2 * ``width`` operations from those of ``width``: a position's own and the one
    ``width`` places later; positions too near the end of their task fall out."""
    cut = blocked(grams, "pos", max(block, 2 * width), ahead=width)
    later = F.lead("gram", width).over(Window.partitionBy(*TASK, "block").orderBy("pos"))
    return cut.withColumn("_later", later).where("not halo and _later is not null").select(
        *TASK, "n_ops", "pos", F.xxhash64("gram", "_later").alias("gram"))


def anchor_matches(grams: DataFrame, low: int, step: int) -> DataFrame:
    """(task, at, lag): blocks of ``step`` operations at every ``step``-th position that come
    again ``lag`` places later, for lags in (low, 2 * low]. ``grams`` hashes ``step`` operations.
    """
    long_enough = grams.where(F.col("n_ops") >= 2 * (low + 1))
    anchors = long_enough.where(F.pmod(F.col("pos") - 1, F.lit(step)) == 0).select(
        *TASK, "gram", F.col("pos").alias("at"), F.explode(F.sequence(
            C.floor_div(F.col("pos") + low, low), C.floor_div(F.col("pos") + 2 * low, low))
        ).alias("near"))
    later = long_enough.select(*TASK, "gram", F.col("pos").alias("again"),
                               C.floor_div(F.col("pos"), low).alias("near"))
    return anchors.join(later, [*TASK, "gram", "near"]).select(
        *TASK, "at", (F.col("again") - F.col("at")).alias("lag")).where(
        F.col("lag").between(low + 1, 2 * low))


def _lifted(found: DataFrame, grams: dict[int, DataFrame], step: int) -> DataFrame:
    """Stretches grown to where they end, by halving widths; each is short of its end by less
    than ``step`` places on either side. What can no longer reach its lag is dropped on the way.
    """
    def reachable(df: DataFrame, slack: int) -> DataFrame:
        return df.where(F.col("stop_pos") - F.col("first_pos") + 1 + slack >= F.col("lag"))

    found, width = reachable(found, 2 * (step - 1)), step // 2
    while width:
        found = stored(found.withColumn("_id", F.monotonically_increasing_id()), "loop-stretches")
        right, left = F.col("stop_pos") + 1, F.col("first_pos") - width
        asked = found.select(*TASK, "_id", F.explode(F.array(*(
            F.struct(F.lit(side).alias("side"), place.alias("pos")) for side, place in (
                ("right", right), ("right", right + F.col("lag")),
                ("left", left), ("left", left + F.col("lag")))))).alias("p")
        ).select(*TASK, "_id", "p.*")
        same = asked.join(grams[width].select(*TASK, "pos", "gram"), [*TASK, "pos"]).groupBy(
            "_id").agg(*(((F.count_if(F.col("side") == side) == 2) & (
                F.min(F.when(F.col("side") == side, F.col("gram")))
                == F.max(F.when(F.col("side") == side, F.col("gram"))))).alias(f"_{side}")
                for side in ("left", "right")))
        moved = found.join(same, "_id", "left")
        found = reachable(moved.select(
            *TASK, "lag",
            (F.col("first_pos") - F.when(F.col("_left"), width).otherwise(0)).alias("first_pos"),
            (F.col("stop_pos") + F.when(F.col("_right"), width).otherwise(0)).alias("stop_pos")),
            2 * (width - 1))
        width //= 2
    return reachable(found, 0)


def _long_lag_runs(grams: dict[int, DataFrame], runs: DataFrame, low: int, step: int,
                   block: int) -> DataFrame:
    """Runs of at least ``lag`` positions for lags in (low, 2 * low].

    Such a run covers seven blocks of ``step`` (an eighth of ``low``) or more in a row, so
    matching blocks are joined into stretches, and the hashes of shorter and shorter blocks say
    where a stretch ends. No position of a task is compared on its own. Stretches inside a known
    run whose own lag divides theirs are skipped: that shorter cycle is at least as long there.
    """
    pairs = anchor_matches(grams[step], low, step)
    index = C.floor_div(F.col("at") - 1, step)
    joined = _stretches(pairs.select(
        *TASK, "lag", C.floor_div(index, block).alias("block"), (index + 1).alias("pos")), block)
    found = joined.select(
        *TASK, "lag", ((F.col("first_pos") - 1) * step + 1).alias("first_pos"),
        (F.col("stop_pos") * step).cast("bigint").alias("stop_pos"))
    known = runs.where(F.col("stop_pos") - F.col("first_pos") + 1 >= low).select(
        *TASK, F.col("lag").alias("period"), "first_pos", "stop_pos", F.explode(F.sequence(
            C.floor_div(F.col("first_pos"), block), C.floor_div(F.col("stop_pos"), block))
        ).alias("area"))
    f = found.withColumn("area", C.floor_div(F.col("first_pos"), block)).alias("f")
    k = known.alias("k")
    inside = (
        (F.col("f.lag") % F.col("k.period") == 0)
        & (F.col("k.first_pos") <= F.col("f.first_pos"))
        & (F.col("f.stop_pos") + F.col("f.lag") <= F.col("k.stop_pos") + F.col("k.period")))
    same_area = [F.col(f"f.{c}") == F.col(f"k.{c}") for c in (*TASK, "area")]
    return _lifted(f.join(k, [*same_area, inside], "left_anti").drop("area"), grams, step)


def _longest_task(ops: DataFrame) -> int:
    counts = ops.groupBy(*TASK).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def longer_runs(ranked: DataFrame, runs: DataFrame, longest: int, low: int,
                block: int = 4096) -> DataFrame:
    """``runs`` (lags up to ``low``) and those of all longer lags that are a cycle or more.

    Such cycles are possible only in tasks of more than 2 * ``low`` operations; ``longest`` is
    the size of the largest. They are found in doubling bands whose runs are written between
    bands. ``ranked`` has n_ops, pos and op_key.
    """
    if longest < 2 * (low + 1):
        return runs
    runs, width = stored(runs, "loop-runs"), 1
    grams = {1: stored(ranked.select(*TASK, "n_ops", "pos", F.xxhash64("op_key").alias(
        "gram")), "loop-grams")}
    while longest >= 2 * (low + 1):
        while 16 * width <= low:  # blocks of an eighth of the cycle length or less
            grams[2 * width] = stored(_next_grams(grams[width], width, block), "loop-grams")
            width *= 2
        runs = stored(runs.unionByName(
            _long_lag_runs(grams, runs, low, width, block)), "loop-runs")
        low *= 2
    return runs


def best_loops(runs: DataFrame) -> DataFrame:
    """The longest loop of each task (first_pos, n), the earliest of equal ones."""
    length = F.expr("((stop_pos - first_pos + 1) div lag + 1) * lag")
    return runs.withColumn("total", length).where(
        "total >= 2 * lag and ((lag = 1 and total >= 3) or (lag > 1 and total >= 4))"
    ).groupBy(*TASK).agg(
        F.max(F.struct("total", (-F.col("first_pos")).alias("back"))).alias("b")
    ).select(*TASK, (-F.col("b.back")).alias("first_pos"), F.col("b.total").alias("n"))


def tool_loop(events: DataFrame, slice_ns: int = DEFAULT_SLICE_NS, verified: bool = True,
              max_cycle: int = 32, block: int = 4096) -> DataFrame:
    """The longest contiguous repeated operation cycle of each task.

    ``verified`` requires every repetition to be equal; otherwise the second one is
    taken for granted, as the literal rule does. Cycles up to ``max_cycle`` are found
    in one window; longer ones, possible only in tasks of more than twice as many
    operations, in doubling bands whose runs are written between bands.
    """
    ops = events.where("op_key is not null")
    ranked = sliced(ops, TASK, [time_slice(width_ns=slice_ns)], ORDER,
                    running={"pos": F.lit(1)}, totals={"n_ops": "pos"},
                    keep=F.col("n_ops") >= 3)
    if not verified:
        best = _assumed_loops(ranked)
    else:
        best = best_loops(longer_runs(ranked, _lag_runs(ranked, max_cycle, block),
                                      _longest_task(ops), max_cycle, block))
    best = best.withColumn("last_pos", F.col("first_pos") + F.col("n") - 1)
    rows = range_members(best, ranked, TASK, "pos", [block])
    return member_rows(rows, "tool_loop", _group_id(*TASK),
                    F.lit("repeating_contiguous_operation_cycle"),
                    F.lit("contiguous normalized operations form a repeated cycle"),
                    F.col("pos") - F.col("first_pos") + 1, F.col("n"))


def _assumed_loops(ranked: DataFrame) -> DataFrame:
    """Best loop per task when the second repetition is not compared.

    Any half of the task is then a cycle, so an even task is one loop from its start
    and an odd one loses its last operation unless some odd division of it repeats.
    """
    sizes = ranked.groupBy(*TASK).agg(F.max("n_ops").alias("n_ops"))
    odd = sizes.where("n_ops % 2 = 1").withColumn("lag", F.explode(F.filter(
        F.sequence(F.lit(1), F.expr("cast(floor(sqrt(n_ops)) as bigint)")),
        lambda d: F.pmod(F.col("n_ops"), d) == 0)))
    divisors = odd.select(*TASK, "n_ops", F.explode(F.array_distinct(F.array(
        F.col("lag"), F.expr("n_ops div lag")))).alias("lag")).where("lag * 3 <= n_ops")
    compared = salted_join(ranked.select(*TASK, "pos", "op_key", "event_id"),
                           divisors, TASK, F.col("event_id"), "inner").where(
        "pos <= lag or pos > 2 * lag")
    whole = compared.groupBy(*TASK, "n_ops", "lag", F.expr("(pos - 1) % lag").alias("phase")).agg(
        (F.min("op_key") == F.max("op_key")).alias("same")
    ).groupBy(*TASK, "n_ops", "lag").agg(F.bool_and("same").alias("same")).where(
        "same").select(*TASK).distinct().withColumn("whole", F.lit(True))
    return sizes.join(whole, TASK, "left").select(
        *TASK, F.lit(1).cast("bigint").alias("first_pos"),
        F.when((F.col("n_ops") % 2 == 0) | F.col("whole"), F.col("n_ops"))
        .otherwise(F.col("n_ops") - 1).alias("n")).where("n >= 3")


def nearest_rank(df: DataFrame, keys: list[str], value: str, quantile: float = 0.95,
                 excluded: int = 0, slice_width: int = 1024) -> DataFrame:
    """Value at ceil(quantile * n) of each group's sorted values, with n.

    Counts per distinct value are summed in value order slice by slice, so a group
    is never sorted or hashed in one task. ``excluded`` = 1 gives the threshold each
    member sees when it is left out of its own baseline.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_c"))
    cumulated = sliced(counts, keys, [C.floor_div(F.col(value), slice_width)], [value],
                       running={"_cum": F.col("_c")}, totals={"_n": "_cum"})
    size = F.col("_n") - excluded
    return cumulated.where(F.col("_cum") >= F.ceil(F.lit(quantile) * size)).groupBy(*keys).agg(
        F.min(value).alias("p95"), F.min(size).alias("n_values"))


def project_token_baselines(events: DataFrame, exclude_self: bool = False) -> DataFrame:
    """Baseline per project over the token counts of the events at hand."""
    return nearest_rank(events, ["project_id"], "token_count", excluded=int(exclude_self)).select(
        F.lit("project").alias("origin"), F.col("project_id").alias("scope_key"),
        "p95", "n_values")


def baseline_lookup(measures: DataFrame, baselines: DataFrame) -> DataFrame:
    """Attach the first baseline found along the scope order.

    ``measures`` has event_id, project_id, task_id, metric ('token' or 'tool_call').
    Task-scoped baselines are tried with every key before project-scoped ones; a bare
    project key serves tokens only.
    """
    token = F.col("metric") == "token"
    suffix = F.when(token, F.lit(":token")).otherwise(F.lit(":tool_calls"))
    keys = [F.concat("task_id", suffix), F.col("task_id"), F.concat("project_id", suffix),
            F.when(token, F.col("project_id"))]
    tries = F.array(*(
        F.struct(F.lit(i).alias("priority"), F.lit(origin).alias("origin"), k.alias("scope_key"))
        for i, (origin, k) in enumerate((o, k) for o in ("task", "project") for k in keys)))
    wanted = measures.select("event_id", "metric", F.explode(tries).alias("t")).select(
        "event_id", "metric", "t.*").where("scope_key is not null")
    found = salted_join(wanted, baselines, ["origin", "scope_key"], F.col("event_id"), "inner")
    best = found.groupBy("event_id", "metric").agg(
        F.min_by(F.struct("origin", "scope_key", "p95", "n_values"), "priority").alias("b"))
    return measures.join(best, ["event_id", "metric"]).select(*measures.columns, "b.*")


def token_outlier(events: DataFrame, baselines: DataFrame) -> DataFrame:
    measured = F.explode(F.array(
        F.struct(F.lit("token").alias("metric"), F.col("token_count").alias("value")),
        F.struct(F.lit("tool_call").alias("metric"), F.col("tool_call_count").alias("value"))))
    measures = events.where("token_count is not null or tool_call_count is not null").withColumn(
        "_m", measured).select("*", "_m.*").drop("_m").where("value is not null")
    hit = baseline_lookup(measures, baselines).where(
        (F.col("n_values") >= K.OUTLIER_MIN_BASELINE) & (F.col("value") > F.col("p95")))
    text = lambda c: F.col(c).cast("string")
    return member_rows(
        hit, "token_outlier", F.concat_ws(":", "event_id", "metric"),
        F.concat("metric", F.lit("_above_project_p95")),
        F.concat("metric", F.lit(" count "), text("value"), F.lit(" exceeds p95 "), text("p95"),
                 F.lit(" from "), text("n_values"), F.lit(" comparable episodes")))


SINGLE_EVENT_DETECTORS = (
    tool_failure, transport_instability, sandbox_friction, turn_correction, skill_adherence,
)
GROUP_DETECTORS = (
    repeated_attempt, command_churn, tool_loop, quality_gate_bypass, scope_recurrence,
)


def detect_all(events: DataFrame, baselines: DataFrame | None = None,
               slice_ns: int = DEFAULT_SLICE_NS, verified: bool = True
               ) -> tuple[DataFrame, DataFrame]:
    """Members of single-event observations and of group observations.

    ``verified`` is the rule of ``tool_loop``.

    ``events`` is read by every detector: pass a stored table. ``fitting_slice_ns``
    gives the slice width for data with very dense seconds.
    """
    base = project_token_baselines(events) if baselines is None else baselines
    single = [d(events) for d in SINGLE_EVENT_DETECTORS] + [token_outlier(events, base)]
    grouped = [d(events, slice_ns, verified) if d is tool_loop else d(events, slice_ns)
               for d in GROUP_DETECTORS]
    return reduce(DataFrame.unionByName, single), reduce(DataFrame.unionByName, grouped)
