"""Stateful streams against the batch detectors, over several micro-batches."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tests.test_detectors import brute_loop, task_sequences
from tracefold.functions import constants as K
from tracefold.operators import detectors, observations
from tracefold.sources.sinks import new_path
from tracefold.streaming import sequences, streams

HOUR = 3600 * K.NS_PER_SECOND
EVENT = ("event_id string, timestamp_ns long, project_id string, task_id string, "
         "counts_as_distinct_task boolean, event_name string, op_kind string, "
         "op_executable string, op_target string, op_key string, op_exit_code long, "
         "is_quality_gate boolean, is_mutation boolean")
SHOWN = ["detector_id", "group_id", "ordinal", "member_count", "event_id", "explanation"]


def made_events(rng, n):
    """One hot task with long stretches of cycles, and small ones."""
    rows = []
    for i in range(n):
        task = "hot" if rng.random() < 0.5 else f"t{rng.randint(0, 6)}"
        kind = rng.choice(["gate", "edit", "loop", "loop", "none"])
        at = int(i * 0.3 * HOUR) + rng.randint(0, HOUR // 2)
        exe, target = rng.choice(["pytest", "ruff"]), rng.choice(["a.py", "b.py"])
        if kind == "none":
            op = (None, None, None, None, None)
        elif kind == "edit":
            op = ("tool", "apply_patch", target, f"patch|{target}", None)
        elif kind == "gate":
            op = ("shell", exe, target, f"{exe}|{target}", rng.randint(0, 1))
        else:
            exe = "xyz"[i // 3 % 3 if i % 60 < 30 else rng.randint(0, 2)]
            op = ("shell", exe, "c.py", f"{exe}|c.py", None)
        rows.append((f"e{i:05d}", at, "p", task, True, "codex.tool_result", *op, None,
                     kind == "edit"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_sequences_equal_the_batch_detectors(spark, seed):
    rows = made_events(random.Random(seed), 500)
    path = new_path(spark, "events")
    rows.sort(key=lambda r: r[1] + int(r[0][1:]) % 3 * HOUR // 2)  # late by up to an hour
    for i in range(5):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], EVENT).coalesce(1).write.mode(
            "append").parquet(path)
    out = new_path(spark, "sequences")
    stream = streams.stream_files(spark, path, spark.read.parquet(path).schema, 1)
    sequences.run_sequences(stream, out, new_path(spark, "log"))
    kept = [r for r in rows if r[9] is not None or r[12]]
    passed = (max(r[1] for r in kept) - 2 * HOUR) // HOUR
    closed = spark.createDataFrame([r for r in rows if r[1] // HOUR < passed], EVENT)
    got = Counter(map(tuple, sequences.sequence_members(spark, out).select(*SHOWN).collect()))
    want = Counter()
    for detector in (detectors.repeated_attempt, detectors.command_churn, detectors.tool_loop,
                     detectors.quality_gate_bypass):
        want.update(map(tuple, detector(closed).select(*SHOWN).collect()))
    assert {k[0] for k in want} == {"repeated_attempt", "command_churn", "tool_loop",
                                    "quality_gate_bypass"}
    assert got == want


def test_loops_do_not_depend_on_how_operations_are_cut():
    rng = random.Random(5)

    def brute(ops):
        best = (0, 0)
        for lag in range(1, 33):
            run = 0
            for i in range(len(ops) - lag + 1):
                if i + lag < len(ops) and ops[i] == ops[i + lag]:
                    run += 1
                    continue
                total = (run // lag + 1) * lag
                if run >= lag and total >= (3 if lag == 1 else 4):
                    best = max(best, (total, -(i - run + 1)))
                run = 0
        return best

    for _ in range(40):
        ops = [rng.choice("abc" if rng.random() < 0.3 else "a") for _ in range(rng.randint(1, 90))]
        tail, runs, best, done = [], [0] * 32, (0, 0), 0
        while done < len(ops):
            part = ops[done:done + rng.randint(1, 20)]
            tail, runs, best = sequences.extend_loops(tail, runs, done, best, part)
            done += len(part)
        assert best == brute(ops) or best[0] == brute(ops)[0] == 0


def long_cycles():
    """Operations of tasks whose longest loops have cycles above 32 operations, or nearly so."""
    def ops(n, name="o"):
        return [f"{name}{i}" for i in range(n)]

    rng = random.Random(8)
    return {
        "forty": ops(3, "x") + (ops(40) * 3)[:97] + ops(2, "y"),
        "hundred": ops(5, "x") + ops(100) * 2,
        "edge": ops(33) * 2, "one_short": ops(33) + ops(32), "short": ops(32) * 3,
        "beaten": ops(35) * 2 + ["a", "b"] * 40,
        "tied": ops(33) * 2 + ["a", "b"] * 33, "tied_after": ["a", "b"] * 33 + ops(33) * 2,
        "nested": (["a", "b"] * 20 + ["c"]) * 3, "same": ["a"] * 80,
        "noise": [rng.choice("ab") for _ in range(120)], "none": ops(70),
    }


def test_stream_finds_loops_of_cycles_of_any_length(spark):
    tasks = long_cycles()
    rows = [(f"{t}-{i:04d}", i * HOUR // 6, "p", t, True, "codex.tool_result", "shell", key, None,
             key, None, None, False) for t, keys in tasks.items() for i, key in enumerate(keys)]
    rows.append(("end", 60 * HOUR, "p", "end", True, "codex.tool_result", "shell", "z", None, "z",
                 None, None, False))
    rows.sort(key=lambda r: r[1])
    path, out = new_path(spark, "events"), new_path(spark, "sequences")
    for i in range(4):  # cycles go on over files and cells
        part = rows[i * len(rows) // 4:(i + 1) * len(rows) // 4]
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(path)
    stream = streams.stream_files(spark, path, spark.read.parquet(path).schema, 1)
    sequences.run_sequences(stream, out, new_path(spark, "log"))
    found = sequences.sequence_members(spark, out).where("detector_id = 'tool_loop'")
    got = sorted(map(tuple, found.select("task_id", "ordinal", "event_id", "member_count"
                                         ).collect()))
    best = {t: brute_loop(keys) for t, keys in tasks.items()}
    assert best["forty"] == (80, 3) and best["hundred"] == (200, 5) and best["edge"] == (66, 0)
    assert got == sorted((t, k + 1, f"{t}-{b[1] + k:04d}", b[0])
                         for t, b in best.items() if b for k in range(b[0]))


def test_summary_and_long_loops_together_are_every_loop(spark):
    tasks = task_sequences(12, 45, 70, "abcd") | {"same": ["a"] * 60}
    rows, want, got = [], {}, {}
    for task, keys in tasks.items():
        tail, runs, best, done = [], [0] * 4, (0, 0), 0
        while done < len(keys):
            part = keys[done:done + 7]
            tail, runs, best = sequences.extend_loops(tail, runs, done, best, part, max_cycle=4)
            done += len(part)
        got[task] = best
        total, start = brute_loop(keys) or (0, -1)
        want[task] = (total, -start - 1)
        rows += [("p", task, f"{task}-{i}", i + 1, key) for i, key in enumerate(keys)]
    ops = spark.createDataFrame(
        rows, "project_id string, task_id string, event_id string, pos long, op_key string")
    longer = sequences.long_loops(ops, max_cycle=4, block=16).collect()
    assert any((r.n, -r.first_pos) > got[r.task_id] for r in longer)
    for r in longer:
        got[r.task_id] = max(got[r.task_id], (r.n, -r.first_pos))
    assert got == want


def test_trends_move_with_the_batches_and_read_eight_days(spark, monkeypatch):
    day = K.NS_PER_DAY
    rng = random.Random(7)
    batches, rows = [], []
    for b in range(4):
        base = b * 4 * day + 20 * day
        part = [(f"o{b}-{i}", f"f{rng.randint(0, 5)}", f"t{rng.randint(0, 3)}",
                 base - rng.randint(0, 9 * day)) for i in range(60)]
        batches.append(part + batches[-1][:5] if batches else part)  # some rows come again
    schema = "observation_id string, finding_id string, task_identity string, occurred_at_ns long"
    path, store, out = (new_path(spark, n) for n in ("in", "store", "out"))
    opened = []
    real = streams.sinks.read_days
    monkeypatch.setattr(streams.sinks, "read_days", lambda s, p, d: (
        opened.append((p, len(d))), real(s, p, d))[1])
    body = streams.trend_batches(store, out)
    for b, part in enumerate(batches):
        body(spark.createDataFrame(part, schema), b)
        if b == 2:
            body(spark.createDataFrame(part, schema), b)  # a repeated micro-batch
    prior = spark.createDataFrame([], "finding_id string")
    for b, part in enumerate(batches):
        rows += [r for r in part if r not in rows]
        now = max(r[3] for r in rows)
        want = observations.trend_states(spark.createDataFrame(rows, schema), prior, now)
        got = spark.read.parquet(f"{out}/batch_id={b}")
        names = sorted(want.columns)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(
            map(tuple, want.select(*names).collect()))
        prior = observations.previously_actionable(want)
    assert max(n for _, n in opened) <= 8
    files = [f for f in spark.read.parquet(f"{store}/rows").inputFiles()]
    assert len(files) == len(set(files))
