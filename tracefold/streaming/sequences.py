"""Sequence detectors on a stream, with keyed state in two steps.

``closed_cells`` keeps the events of each (task, time cell) as state of their own and lets them
go, in order, when the watermark has passed the cell, so late rows within the lateness take
their place and no task's history is one state row. ``carried`` then keeps a summary for each
task: counts per operation and target, the last outcome of each quality gate, and of the
operation sequence only what a cycle of up to ``MAX_CYCLE`` operations can reach back to. A
micro-batch reads its own rows and the summaries of the tasks in it, nothing else.

Both steps append to files. ``sequence_members`` reads them as the members that the batch
detectors give for the same events. Loops of more than ``MAX_CYCLE`` operations a cycle do not
fit a summary: ``long_loops`` finds them there, all of them, from the numbered operations of the
tasks long enough to hold one. Rows later than the lateness are dropped by the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracefold.functions import columns as C
from tracefold.operators import detectors
from tracefold.operators.detectors import TASK
from tracefold.operators.ordering import RANGE_SIZES, range_members, salted_join
from tracefold.sources.sinks import stored
from tracefold.streaming.streams import LATENESS, run_to_files

CELL = "1 hour"
MAX_CYCLE = 32
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EVENT = ("timestamp_ns long, event_id string, event_name string, op_kind string, "
          "op_executable string, op_target string, op_key string, op_exit_code long, "
          "gate boolean, is_mutation boolean")
_EVENT_NAMES = [c.split()[0] for c in _EVENT.split(", ")]
CLOSED = "project_id string, task_id string, " + _EVENT
#: kind 'event' (a row of a task with its numbers), 'gate' (a passed gate with its edits) or
#: 'loop' (the longest loop so far of a cycle up to ``MAX_CYCLE``, first_pos and n).
CARRIED = "kind string, " + CLOSED + (", pos long, nth_key long, nth_target long, edits long, "
                                      "failed_id string, first_pos long, last_pos long, n long")
_CARRIED_NAMES = [c.split()[0] for c in CARRIED.split(", ")]
_CARRIED_ROW = Row(*_CARRIED_NAMES)


def closed_cells(events: DataFrame, lateness: str = LATENESS, cell: str = CELL) -> DataFrame:
    """Operations and edits of every (task, cell) that the watermark has passed."""
    gate = C.is_quality_gate(F.col("op_kind"), F.col("op_executable"), F.col(
        "is_quality_gate")) & F.col("op_exit_code").isNotNull()
    rows = events.where("op_key is not null or is_mutation").select(
        *TASK, C.timestamp_of(F.col("timestamp_ns")).alias("ts"), "timestamp_ns", "event_id",
        "event_name", "op_kind", "op_executable", "op_target", "op_key",
        F.col("op_exit_code").cast("long").alias("op_exit_code"),
        F.coalesce(gate, F.lit(False)).alias("gate"), "is_mutation")
    cells = rows.withWatermark("ts", lateness).groupBy(*TASK, F.window("ts", cell)).agg(
        F.array_sort(F.collect_list(F.struct(*_EVENT_NAMES))).alias("rows"))
    return cells.select(*TASK, F.explode("rows").alias("row")).select(*TASK, "row.*")


def _longest(equal: np.ndarray, open_run: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(length of the run still open at the end, starts, lengths) of the runs of True; the first
    may go on from ``open_run`` places before."""
    edges = np.flatnonzero(np.diff(np.concatenate([[open_run > 0], equal, [False]]).astype(int)))
    if open_run > 0:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[::2], edges[1::2]
    lengths = stops - starts
    if open_run > 0:
        starts = np.concatenate([[-open_run], starts[1:]])
        lengths = np.concatenate([[lengths[0] + open_run], lengths[1:]])
    still = int(lengths[-1]) if len(stops) and stops[-1] == len(equal) else 0
    return still, starts, lengths


def extend_loops(tail: list[str], open_runs: list[int], done: int, best: tuple[int, int],
                 new: list[str], max_cycle: int = MAX_CYCLE
                 ) -> tuple[list[str], list[int], tuple[int, int]]:
    """Next (tail, open runs, best) after ``new`` operations, for cycles up to ``max_cycle``;
    ``long_loops`` has the longer ones.

    ``tail``: the last ``max_cycle`` operations of the ``done`` before; ``open_runs``: for each
    cycle length how many positions at the end equal the one that length later; ``best``:
    (operations, -first position) of the longest loop.
    """
    code: dict[str, int] = {}
    codes = np.array([code.setdefault(op, len(code)) for op in (*tail, *new)], np.int64)
    out = []
    for lag in range(1, max_cycle + 1):
        first = max(0, len(tail) - lag)  # earlier positions are settled already
        if len(codes) - lag <= first:
            out.append(open_runs[lag - 1])
            continue
        equal = codes[first:len(codes) - lag] == codes[first + lag:]
        if not open_runs[lag - 1] and not equal.any():
            out.append(0)
            continue
        still, starts, lengths = _longest(equal, open_runs[lag - 1])
        out.append(still)
        total = (lengths // lag + 1) * lag
        total[(lengths < lag) | (total < (3 if lag == 1 else 4))] = 0
        if len(total) and total.max() > 0:
            at = int(total.argmax())
            position = done - len(tail) + first + int(starts[at]) + 1
            best = max(best, (int(total[at]), -position))
    return [*tail, *new][-max_cycle:], out, best


class TaskCarry(StatefulProcessor):
    """Summary of one task, extended by the closed cells of each micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState(
            "carry", "ops long, edits long, tail string, runs string, total long, back long, "
                     "last_ns long, last_id string")
        self.keys = handle.getMapState(
            "keys", "op_key string", "n long, exit long, edits long, event_id string")
        self.targets = handle.getMapState("targets", "op_target string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        part = sorted(rows, key=lambda r: (r.timestamp_ns, r.event_id))
        held = self.carry.get() if self.carry.exists() else None
        if held is not None:
            ops, edits, tail, runs, total, back, last_ns, last_id = held
            tail, runs = json.loads(tail), json.loads(runs)
        else:
            ops, edits, tail, runs, total, back = 0, 0, [], [0] * MAX_CYCLE, 0, 0
            last_ns, last_id = -1, ""
        if (part[0].timestamp_ns, part[0].event_id) <= (last_ns, last_id):
            raise ValueError(f"a closed cell of {key} comes before one that is done")

        def known(state, name: str, nothing: tuple) -> list:
            # a new task has no state to ask for
            found = None if held is None else state.getValue((name,))
            return list(nothing if found is None else found)

        def out(kind: str, **fields) -> Row:
            at = {"kind": kind, "project_id": key[0], "task_id": key[1]} | fields
            return _CARRIED_ROW(*(at.get(c) for c in _CARRIED_NAMES))

        keys: dict[str, list] = {}
        targets: dict[str, list] = {}
        new: list[str] = []
        for row in part:
            numbers = {}
            edits += bool(row.is_mutation and not row.gate)
            if row.op_key is not None:
                if row.op_key not in keys:
                    keys[row.op_key] = known(self.keys, row.op_key, (0, None, None, None))
                at = keys[row.op_key]
                at[0] += 1
                new.append(row.op_key)
                numbers |= {"pos": ops + len(new), "nth_key": at[0]}
            if row.op_kind == "shell" and row.op_target:
                if row.op_target not in targets:
                    targets[row.op_target] = known(self.targets, row.op_target, (0,))
                targets[row.op_target][0] += 1
                numbers["nth_target"] = targets[row.op_target][0]
            yield out("event", **{c: row[c] for c in _EVENT_NAMES}, edits=edits, **numbers)
            if row.gate and row.op_key is not None:
                if row.op_exit_code == 0 and at[1] not in (None, 0) and edits > at[2]:
                    yield out("gate", event_id=row.event_id, timestamp_ns=row.timestamp_ns,
                              failed_id=at[3], first_pos=at[2] + 1, last_pos=edits,
                              n=edits - at[2] + 2)
                at[1:] = [row.op_exit_code, edits, row.event_id]
        tail, runs, (best, best_back) = extend_loops(tail, runs, ops, (total, back), new)
        for name, value in keys.items():
            self.keys.updateValue((name,), tuple(value))
        for name, value in targets.items():
            self.targets.updateValue((name,), tuple(value))
        self.carry.update((ops + len(new), edits, json.dumps(tail), json.dumps(runs), best,
                           best_back, part[-1].timestamp_ns, part[-1].event_id))
        if (best, best_back) != (total, back):
            yield out("loop", first_pos=-best_back, last_pos=best - best_back - 1, n=best)

    def close(self) -> None:
        pass


def carried(cells: DataFrame) -> DataFrame:
    """Closed cells (a stream) -> rows of CARRIED, from the tasks' summaries."""
    return cells.groupBy(*TASK).transformWithState(
        statefulProcessor=TaskCarry(), outputStructType=CARRIED, outputMode="append",
        timeMode="none")


def run_sequences(events: DataFrame, out: str, checkpoint: str, lateness: str = LATENESS,
                  cell: str = CELL) -> None:
    """Drain what is available through both steps into ``out``."""
    spark = events.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)  # the one that holds map state
    try:
        run_to_files(closed_cells(events, lateness, cell), f"{out}/cells",
                     f"{checkpoint}/cells").awaitTermination()
        cells = spark.readStream.schema(T.StructType.fromDDL(CLOSED)).parquet(f"{out}/cells")
        run_to_files(carried(cells), f"{out}/carried", f"{checkpoint}/carried"
                     ).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def long_loops(ops: DataFrame, max_cycle: int = MAX_CYCLE, block: int = 4096) -> DataFrame:
    """The longest loop (first_pos, n) of each task among those of a cycle above ``max_cycle``.

    ``ops`` are the operations of the tasks with their ``pos``. Only tasks that hold two such
    cycles are read further; their cycles of every length are found in the batch detector's bands.
    """
    sizes = stored(ops.groupBy(*TASK).agg(F.max("pos").alias("n_ops")).where(
        F.col("n_ops") >= 2 * (max_cycle + 1)), "long-tasks")
    ranked = salted_join(ops.select(*TASK, "event_id", "pos", "op_key"), sizes, TASK,
                         F.col("event_id"), "inner")
    none = ops.where("false").select(*TASK, F.col("pos").alias("lag"), F.col("pos").alias(
        "first_pos"), F.col("pos").alias("stop_pos"))
    longest = sizes.agg(F.max("n_ops")).first()[0] or 0
    return detectors.best_loops(detectors.longer_runs(ranked, none, longest, max_cycle, block))


def sequence_members(spark: SparkSession, out: str) -> DataFrame:
    """Members of the sequence detectors over all closed cells."""
    rows = spark.read.schema(T.StructType.fromDDL(CARRIED)).parquet(f"{out}/carried")
    events = rows.where("kind = 'event'")
    by_key = [*TASK, "op_key"]
    repeats = events.where("op_key is not null").groupBy(*by_key).agg(
        F.max("nth_key").alias("count")).where("count >= 2")
    repeated = salted_join(events, repeats, by_key, F.col("event_id"), "inner")
    by_target = [*TASK, "op_target"]
    aimed = events.where("nth_target is not null")
    churns = aimed.groupBy(*by_target, "op_key").agg(F.max("nth_target").alias("top")).groupBy(
        *by_target).agg(F.max("top").alias("count"), F.count("*").alias("n_commands")).where(
        "n_commands >= 3")
    churned = salted_join(aimed, churns, by_target, F.col("event_id"), "inner")
    loops = rows.where("kind = 'loop'").select(*TASK, "first_pos", "n").unionByName(
        long_loops(events.where("pos is not null")))
    best = loops.groupBy(*TASK).agg(F.max(F.struct(
        "n", (-F.col("first_pos")).alias("back"))).alias("b")).select(
        *TASK, F.col("b.n").alias("count"), (-F.col("b.back")).alias("start"),
        (F.col("b.n") - F.col("b.back") - 1).alias("stop"))
    plain = events.drop("first_pos", "last_pos", "n", "failed_id")
    looped = range_members(best.withColumnsRenamed({"start": "first_pos", "stop": "last_pos"}),
                           plain.where("pos is not null"), TASK, "pos", RANGE_SIZES)
    hits = rows.where("kind = 'gate'").select(
        *TASK, F.col("event_id").alias("group_id"), "failed_id", "first_pos", "last_pos",
        F.col("n").alias("count"))
    changed = range_members(hits, plain.where("is_mutation and not gate"), TASK, "edits",
                            RANGE_SIZES).withColumn(
        "nth", F.col("edits") - F.col("first_pos") + 2)
    ends = hits.select("group_id", "count", F.explode(F.array(
        F.struct(F.col("failed_id").alias("event_id"), F.lit(1).cast("long").alias("nth")),
        F.struct(F.col("group_id").alias("event_id"), F.col("count").alias("nth")))).alias("e")
    ).select("group_id", "count", "e.*")
    bounds = plain.where("gate").join(ends, "event_id")
    bypassed = changed.select(*plain.columns, "group_id", "count", "nth").unionByName(
        bounds.select(*plain.columns, "group_id", "count", "nth"))
    text = F.col("count").cast("string")
    group = lambda *c: C.stable_id(*(F.col(k) for k in c))
    return reduce(DataFrame.unionByName, (
        detectors.member_rows(
            repeated, "repeated_attempt", group(*by_key), F.lit("same_normalized_operation"),
            F.concat(F.lit("the same normalized operation occurred "), text, F.lit(
                " times in one task")), F.col("nth_key"), F.col("count")),
        detectors.member_rows(
            churned, "command_churn", group(*by_target),
            F.lit("three_distinct_commands_same_target"),
            F.concat(F.col("n_commands").cast("string"), F.lit(
                " distinct normalized shell commands targeted the same path")),
            F.col("nth_target"), F.col("count")),
        detectors.member_rows(
            looped, "tool_loop", group(*TASK), F.lit("repeating_contiguous_operation_cycle"),
            F.lit("contiguous normalized operations form a repeated cycle"),
            F.col("pos") - F.col("first_pos") + 1, F.col("count")),
        detectors.member_rows(
            bypassed, "quality_gate_bypass", F.col("group_id"),
            F.lit("mutation_between_failed_and_passing_gate"),
            F.lit("a failed quality command was followed by mutation before "
                  "same normalized command passed"), F.col("nth"), F.col("count"))))
