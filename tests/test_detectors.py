from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.cases import event, frame, groups
from tracefold.operators import detectors as D


def brute_loop(keys, verified=True):
    """Longest repeated cycle by trying every start and length: (total, start)."""
    best = None
    for start in range(len(keys)):
        for size in range(1, (len(keys) - start) // 2 + 1):
            cycle = keys[start:start + size]
            reps = 1
            while keys[start + reps * size:start + (reps + 1) * size] == cycle:
                reps += 1
            if not verified and reps == 1:
                reps = 2
                while keys[start + reps * size:start + (reps + 1) * size] == cycle:
                    reps += 1
            total = reps * size
            if reps < 2 or total < (3 if size == 1 else 4):
                continue
            if best is None or (total, -start) > (best[0], -best[1]):
                best = (total, start)
    return best


def brute_literal(keys):
    best = None
    for start in range(len(keys)):
        for size in range(1, (len(keys) - start) // 2 + 1):
            cycle, reps = keys[start:start + size], 2
            while keys[start + reps * size:start + (reps + 1) * size] == cycle:
                reps += 1
            total = reps * size
            if total >= (3 if size == 1 else 4) and (
                    best is None or (total, -start) > (best[0], -best[1])):
                best = (total, start)
    return best


def task_sequences(seed, n_tasks, longest, alphabet):
    rng = random.Random(seed)
    out = {}
    for i in range(n_tasks):
        n = rng.randint(3, longest)
        if i % 3 == 0:  # plant a long cycle between noise
            size = rng.randint(2, max(2, n // 2))
            cycle = [rng.choice(alphabet) for _ in range(size)]
            keys = [rng.choice(alphabet) for _ in range(rng.randint(0, 4))] + cycle * 2 + cycle[
                : rng.randint(0, size)]
        else:
            keys = [rng.choice(alphabet[: 1 + i % len(alphabet)]) for _ in range(n)]
        out[f"t{i}"] = keys
    return out


def loop_events(spark, tasks):
    rows, n = [], 0
    for task, keys in tasks.items():
        for key in keys:
            n += 1
            rows.append(event(n, key, task_id=task))
            if n % 5 == 0:
                n += 1
                rows.append(event(n, task_id=task))  # no operation: skipped in the order
    return frame(spark, rows)


def found_loops(members):
    firsts = members.groupBy("task_id").agg(
        F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"),
        F.max("member_count").alias("m"))
    return {r.task_id: (r.n, r["first"]) for r in firsts.collect() if r.n == r.m}


def expected_loops(spark_events, tasks, rule):
    ids = {}
    for r in sorted(spark_events.collect(), key=lambda r: r.timestamp_ns):
        if r.op_key is not None:
            ids.setdefault(r.task_id, []).append(r.event_id)
    best = {t: rule(keys) for t, keys in tasks.items()}
    return {t: (b[0], ids[t][b[1]]) for t, b in best.items() if b}


def test_loop_matches_brute_force_with_tiny_blocks_and_long_cycles(spark):
    tasks = task_sequences(7, 45, 60, "abcd")
    events = loop_events(spark, tasks).cache()
    got = found_loops(D.tool_loop(events, max_cycle=4, block=8))
    assert got == expected_loops(events, tasks, brute_loop)
    assert max(len(k) for k in tasks.values()) > 40


def test_loop_defaults_match_brute_force(spark):
    tasks = task_sequences(11, 30, 40, "abc")
    events = loop_events(spark, tasks).cache()
    assert found_loops(D.tool_loop(events)) == expected_loops(events, tasks, brute_loop)


def test_long_loops_match_brute_force(spark):
    """Cycles of 9 to 40 operations, in tasks long enough for several widths of blocks."""
    rng = random.Random(4)
    tasks = {}
    for i in range(8):
        size = rng.randint(9, 40)
        cycle = [rng.choice("abcd") for _ in range(size)]
        noise = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        tasks[f"t{i}"] = noise + cycle * 2 + cycle[:rng.randint(0, size)] + noise[::-1]
    tasks["runs"] = [k for n in (30, 17, 29, 30, 31) for k in "a" * n + "b"]
    tasks["nested"] = (list("ab" * 12 + "c") * 3)[:70]
    events = loop_events(spark, tasks).cache()
    assert found_loops(D.tool_loop(events, max_cycle=4, block=16)) == expected_loops(
        events, tasks, brute_loop)


def test_loop_candidates_grow_with_the_operations(spark):
    """Runs of one operation, broken at random places: matching blocks stay linear in them."""
    rng = random.Random(6)
    counts = []
    for n in (1000, 2000, 4000):
        keys = []
        while len(keys) < n:
            keys += ["a"] * rng.randint(20, 60) + [rng.choice("bcd")]
        grams = {1: spark.createDataFrame(
            [("p", "t", n, i + 1, ord(k)) for i, k in enumerate(keys[:n])],
            "project_id string, task_id string, n_ops long, pos long, gram long")}
        width, low, total = 1, 32, 0
        while n >= 2 * (low + 1):
            while 16 * width <= low:
                grams[2 * width] = D._next_grams(grams[width], width, 4096).cache()
                width *= 2
            total += D.anchor_matches(grams[width], low, width).count()
            low *= 2
        counts.append(total)
    assert counts[1] < 2.8 * counts[0] and counts[2] < 2.8 * counts[1]
    assert counts[2] < 40 * 4000


def test_literal_loop_rule(spark):
    tasks = task_sequences(3, 30, 16, "ab")
    tasks |= {"nine": list("abcxbcabc"), "odd": list("axa"), "fifteen": list("abcdefabcdeabc")}
    events = loop_events(spark, tasks).cache()
    got = found_loops(D.tool_loop(events, verified=False))
    assert got == expected_loops(events, tasks, brute_literal)


def test_loop_of_interleaved_commands(spark):
    rows = [event(1, "a"), event(2, "b"), event(3), event(4, "a"), event(5, "b"), event(6, "c")]
    assert list(groups(D.tool_loop(frame(spark, rows))).values()) == [
        ["e00001", "e00002", "e00004", "e00005"]]
    none = [event(i, k) for i, k in enumerate("abcd")]
    assert groups(D.tool_loop(frame(spark, none))) == {}


def brute_bypass(rows):
    """Sequential restatement of the gate rule for one task list."""
    hits, failed, edits = [], {}, {}
    for r in rows:
        gate = r["op_kind"] == "shell" and r["op_executable"] in ("pytest", "ruff")
        if gate and r["op_exit_code"] is not None:
            key = r["op_key"]
            if r["op_exit_code"] != 0:
                failed[key], edits[key] = r["event_id"], []
            elif key in failed:
                if edits[key]:
                    hits.append([failed[key], *edits[key], r["event_id"]])
                del failed[key], edits[key]
        elif r["is_mutation"]:
            for key in failed:
                edits[key].append(r["event_id"])
    return hits


def test_bypass_matches_sequential_rule(spark):
    rng = random.Random(5)
    rows, expected = [], []
    for task in range(25):
        mine = []
        for i in range(rng.randint(5, 40)):
            n = task * 100 + i
            pick = rng.random()
            if pick < 0.5:
                mine.append(event(n, rng.choice(["pytest", "ruff", "rg"]), task_id=f"t{task}",
                                  op_exit_code=rng.choice([0, 1, None]),
                                  is_mutation=rng.random() < 0.1))
            else:
                mine.append(event(n, task_id=f"t{task}", is_mutation=pick < 0.85))
        rows += mine
        expected += brute_bypass(mine)
    got = groups(D.quality_gate_bypass(frame(spark, rows)))
    assert sorted(got.values()) == sorted(expected) and expected


def test_bypass_needs_a_mutation_and_the_latest_failure(spark):
    fail, ok = {"op_exit_code": 1}, {"op_exit_code": 0}
    rows = [event(1, "pytest", **fail), event(2, is_mutation=True), event(3, "pytest", **fail),
            event(4, "pytest", **ok), event(5, "ruff", **fail), event(6, is_mutation=True),
            event(7, "ruff", **ok)]
    got = D.quality_gate_bypass(frame(spark, rows))
    assert list(groups(got).values()) == [["e00005", "e00006", "e00007"]]


def test_failure_predicates(spark):
    rows = [
        event(1, success_string="false"), event(2, success_string="true"),
        event(3, event_name="codex.api_request", success_bool=False, status_code=503),
        event(4, event_name="codex.websocket_response", status_code=429),
        event(5, event_name="codex.api_request", status_code=200),
        event(6, event_name="codex.api_request", success_bool=True, status_code=500),
    ]
    events = frame(spark, rows)
    got = {r.event_id: r.failure_class for r in D.tool_failure(events).collect()}
    assert got == {"e00001": "tool_result_false", "e00003": "transport_success_false",
                   "e00004": "http_4xx", "e00006": "http_5xx"}
    assert {r.event_id for r in D.transport_instability(events).collect()} == {
        "e00003", "e00004", "e00006"}


def test_single_event_detectors(spark):
    rows = [
        event(1, event_name="codex.sandbox_outcome", outcome=""),
        event(2, event_name="codex.sandbox_outcome", outcome="denied"),
        event(3, event_name="turn/interrupt"),
        event(4, event_name="codex.tool_decision", decision_source="user"),
        event(5, event_name="codex.tool_decision", decision_source="config"),
        event(6, skill_required="review", skill_used=False),
        event(7, skill_required="review"), event(8, skill_used=False),
    ]
    events = frame(spark, rows)
    classes = lambda df: {r.event_id: r.failure_class for r in df.collect()}
    assert classes(D.sandbox_friction(events)) == {
        "e00001": "sandbox_outcome", "e00002": "denied"}
    assert classes(D.turn_correction(events)) == {
        "e00003": "turn/interrupt", "e00004": "user_tool_decision"}
    assert classes(D.skill_adherence(events)) == {"e00006": "required_skill_not_used"}


def test_repeats_churn_and_recurrence(spark):
    same = {"op_target": "src/x.py"}
    rows = [event(1, "a", **same), event(2, "b", **same), event(3, "a", **same),
            event(4, "c", **same), event(5, "d", task_id="u", **same),
            event(6, "a", project_id="q", **same),
            event(7, "e", task_id="v", counts_as_distinct_task=False, **same)]
    events = frame(spark, rows)
    assert list(groups(D.repeated_attempt(events)).values()) == [["e00001", "e00003"]]
    assert list(groups(D.command_churn(events)).values()) == [
        ["e00001", "e00002", "e00003", "e00004"]]
    assert list(groups(D.scope_recurrence(events)).values()) == [
        ["e00001", "e00002", "e00003", "e00004", "e00005", "e00007"]]


def test_outlier_is_strict_and_needs_twenty_values(spark):
    def hits(values, **options):
        events = frame(spark, [event(i, token_count=v) for i, v in enumerate(values)])
        base = D.project_token_baselines(events, **options)
        return {r.event_id for r in D.token_outlier(events, base).collect()}

    assert hits([10] * 18 + [50]) == set()
    assert hits([10] * 19 + [50]) == {"e00019"}
    assert hits([10] * 20) == set()
    assert hits([10] * 19 + [50], exclude_self=True) == set()
    assert hits([10] * 20 + [50], exclude_self=True) == {"e00020"}


def test_nearest_rank_is_exact(spark):
    import math

    rng = random.Random(1)
    values = {g: [rng.randint(0, 5000) for _ in range(g)] for g in (1, 2, 19, 20, 21, 100, 217)}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g int, v long")
    got = {r.g: (r.p95, r.n_values) for r in D.nearest_rank(df, ["g"], "v").collect()}
    assert got == {g: (sorted(v)[math.ceil(0.95 * g) - 1], g) for g, v in values.items()}
