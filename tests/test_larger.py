"""Queries on rows that the given tables hold only at larger sizes."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.compare import differences
from tracefold.operators import review
from tracefold.streaming import sequences


def test_half_prices_round_as_the_sql_casts(spark, tmp_path):
    import duckdb

    rows = [(supplier, price) for supplier, price in ((1, 20178.5), (2, 38137.5), (3, 7.25))]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double").coalesce(
        1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    df = entry.queries()["nearest_rank_p95"](spark, str(tmp_path))
    assert differences(df, con, entry.oracle_sql()["nearest_rank_p95"]) == []


def test_proofs_of_large_keys_do_not_overflow(spark, tmp_path):
    # a day a key: beyond key 106,751 the nanoseconds pass the range of a long
    spark.createDataFrame([(3,), (900_003,)], "c_custkey long").write.parquet(
        f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3,), (4,)], "s_suppkey long").write.parquet(
        f"{tmp_path}/supplier.parquet")
    gaps = entry.queries()["capability_gaps"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in gaps] == [("model-4", "high")]


def test_proofs_near_the_end_of_time_do_not_overflow(spark):
    proofs = spark.createDataFrame(
        [("m", "high", "v1", "f", 2**63 - 1)], "model string, effort string, "
        "tool_version string, schema_fingerprint string, proven_ns long")
    required = spark.createDataFrame([("m", "high")], "model string, effort string")
    assert review.capability_gaps(proofs, required, 100, "v1", "f").count() == 0


def test_license_scores_read_each_text_once(spark):
    from tracefold.llm import licenses

    parts = spark.createDataFrame([(1, 0, "mit license"), (2, 0, "none")],
                                  "key long, part int, text string")
    weights = spark.createDataFrame(
        [(0, "MIT", "mit", 1, 2.0), (0, "MIT", "license", 1, 1.0)],
        "tid int, license string, term string, tf long, idf double")
    best = licenses.cosine(parts, weights, F.lit(3.0))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(regexp_extract_all") == 1
    assert [tuple(r) for r in best.collect()] == [(1, 0, licenses.SCALE, "MIT")]


def test_hydrated_rows_are_stored_for_both_branches(spark):
    from checks import views
    from tracefold.plans import scan

    sf_dir = "/root/testdata/sf0.001"
    hydration = scan.scan_window(
        views.logs_table(spark, sf_dir), views.spans_table(spark, sf_dir),
        views.project_roots(spark), views.START_NS, views.NOW_NS)[2]
    assert hydration.inputFiles()
    assert all("/hydration-" in name for name in hydration.inputFiles())


def test_a_gate_without_an_operation_key_does_not_stop_the_stream():
    class Held:
        def __init__(self):
            self.value, self.asked = {}, 0

        def exists(self):
            return bool(self.value)

        def getValue(self, key):
            self.asked += 1
            return self.value.get(key)

        def updateValue(self, key, value):
            self.value[key] = value

        def update(self, value):
            self.value = value

    carry = sequences.TaskCarry()
    carry.carry, carry.keys, carry.targets = Held(), Held(), Held()
    cell = Row(*sequences._EVENT_NAMES)
    rows = [cell(1, "e1", "n", "shell", "ruff", "a.py", "k", 1, True, False),
            cell(2, "e2", "n", "tool", "apply_patch", "a.py", None, None, False, True),
            cell(3, "e3", "n", None, None, None, None, 0, True, True),
            cell(4, "e4", "n", "shell", "ruff", "a.py", "k", 0, True, False)]
    out = list(carry.handleInputRows(("p", "t"), iter(rows), None))
    assert [(r.event_id, r.failed_id, r.n) for r in out if r.kind == "gate"] == [("e4", "e1", 3)]
    assert carry.keys.asked == carry.targets.asked == 0  # a new task has no state to ask for


def test_application_windows_are_not_enumerated_for_each_application(spark):
    """Counts of windows that cross weeks, and no row per slot of every application."""
    from tracefold.plans import gates

    hour = 3600 * 10**9
    at = 480_000 * hour
    apps = spark.createDataFrame([(f"a{i}", f"f{i % 3}", at + i % 2 * 5 * hour) for i in range(
        40)], "application_id string, fingerprint string, applied_ns long")
    seen = [(f"f{i % 2}", at + o * hour + 7) for i, o in enumerate(
        (-169, -168, -1, -1, 0, 4, 5, 167, 168, 172, 173))]
    observations = spark.createDataFrame(seen, "fingerprint string, occurred_at_ns long")
    runs = spark.createDataFrame([("succeeded", at + o * hour) for o in range(-160, 100)],
                                 "status string, started_ns long")
    out = gates.application_change(apps, observations, runs)
    rows = {r["application_id"]: r for r in out.collect()}
    assert len(rows) == 40
    for i in range(40):
        place, own = at + i % 2 * 5 * hour, [o for f, o in seen if f == f"f{i % 3}"]
        r, week = rows[f"a{i}"], 168 * hour
        assert r["baseline_count"] == sum(place - week <= o < place for o in own)
        assert r["follow_up_count"] == sum(place <= o < place + week for o in own)
        assert (r["baseline_slots"], r["follow_up_slots"]) == ((160, 100), (165, 95))[i % 2]
    # the slots are generated above the distinct hours, not above the applications
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    slots = plan[plan.index("explode(sequence(("):]
    assert "Aggregate [at" in plan and "application_id" not in slots.split("Aggregate [at")[0]


def test_raw_logs_are_dealt_before_their_maps_are_built(spark, monkeypatch):
    from checks import views

    plans = []

    def spy(df, name, path=None):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(views, "stored", spy)
    monkeypatch.setattr(views, "_STORED", {})
    monkeypatch.setattr(views, "_PATHS", {})
    for build in (views.logs_table, views.spans_table):
        build(spark, "/root/testdata/sf0.001")
        above, dealt = plans.pop().split("Repartition", 1)
        assert "map_from_entries" in above and "map_from_entries" not in dealt


def test_lag_windows_of_the_loop_are_computed_once(spark):
    from tracefold.operators import detectors

    rows = spark.range(1, 41).selectExpr(
        "'p' as project_id", "'t' as task_id", "id as pos", "string(id % 3) as op_key")
    runs = detectors._lag_runs(rows, 4, 16)
    assert "lead(" not in runs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.lag, r.first_pos, r.stop_pos) for r in runs.collect()} == {(3, 1, 37)}
