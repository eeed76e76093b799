"""Streams drained over the given tables, compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import views
from checks.detection import _SHOWN, records
from checks.prelude import DETECT_CTES, DETECTOR_SQL, RECORD_CTES, WEEK, sql
from checks.registry import query
from checks.tables import RUNS_SQL, runs
from tracefold.sources.sinks import new_path
from tracefold.sources.telemetry import RAW_LOGS
from tracefold.streaming import sequences, streams


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    out = new_path(spark, name)
    streams.run_to_files(stream, out, new_path(spark, f"{name}-log")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_events", """SELECT 'log-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS id,
  epoch_us(ts) * 1000 AS timestamp_ns FROM events""")
def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = views.folder(spark, sf_dir, "raw_logs_twice", lambda s, d: (
        views.logs_table(s, d).unionByName(views.logs_table(s, d))))
    stream = streams.stream_events(streams.stream_files(spark, path, RAW_LOGS))
    return _drain(spark, stream.select("id", "timestamp_ns"), "stream-events")


_SINGLE = ("tool_failure", "transport_instability", "sandbox_friction", "turn_correction",
           "skill_adherence")


@query("stream_event_detectors", sql(" UNION ALL ".join(
    f"SELECT {', '.join(_SHOWN)} FROM ({DETECTOR_SQL[d]})" for d in _SINGLE), DETECT_CTES))
def stream_event_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = views.folder(spark, sf_dir, "events", views.events_plan)
    schema = views.events(spark, sf_dir).schema
    stream = streams.stream_event_detectors(streams.stream_files(spark, path, schema))
    return _drain(spark, stream.select(*_SHOWN), "stream-detectors")


def _in_order(spark: SparkSession, rows: DataFrame, name: str, part: Column, parts: int) -> str:
    """Folder with one file for every value of ``part``, written one after the other."""
    path = new_path(spark, name)
    for i in range(parts):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return path


_BATCHES = 4
_SPAN = 650_000_000_000_000  # four batches over the thirty days


def _trend_sql() -> str:
    """The states after every micro-batch, each from all rows that have arrived by then."""
    day = ("CAST(timezone('Europe/London', timezone('UTC', make_timestamp(occurred_at_ns // 1000)"
           ")) AS DATE)")
    ctes = RECORD_CTES.replace("\nrecords AS (", "\nrecords AS MATERIALIZED (") + f"""
arrived AS MATERIALIZED (SELECT fingerprint, task_identity, occurred_at_ns,
  least((occurred_at_ns - {views.START_NS}) // {_SPAN}
    + CASE WHEN substr(observation_id, 1, 1) < '4' THEN 1 ELSE 0 END, {_BATCHES - 1}) AS batch
  FROM records),"""
    for b in range(_BATCHES):
        prior = f"(SELECT fingerprint FROM s{b - 1} WHERE trend_state = 'actionable')" if b else (
            "(SELECT fingerprint FROM arrived WHERE false)")
        ctes += f"""
c{b} AS (SELECT fingerprint, count(*) AS n, count(DISTINCT task_identity) AS t,
    count(DISTINCT {day}) AS d FROM arrived,
    (SELECT max(occurred_at_ns) AS top FROM arrived WHERE batch <= {b})
  WHERE batch <= {b} AND occurred_at_ns BETWEEN top - {WEEK} AND top GROUP BY fingerprint),
s{b} AS MATERIALIZED (SELECT {b} AS batch_id, coalesce(c.fingerprint, p.fingerprint)
    AS fingerprint, coalesce(n, 0) AS occurrence_count, coalesce(t, 0) AS canonical_task_count,
    coalesce(d, 0) AS local_day_count, CASE WHEN (n >= 3 AND t >= 2 AND d >= 2)
      OR (n >= 5 AND t >= 3) THEN 'actionable' WHEN n IS NULL THEN 'dormant'
      WHEN n <= 1 THEN 'isolated' ELSE 'emerging' END AS trend_state
  FROM c{b} c FULL JOIN {prior} p USING (fingerprint)),"""
    return sql(" UNION ALL ".join(f"SELECT * FROM s{b}" for b in range(_BATCHES)), ctes)


@query("stream_trends", _trend_sql())
def stream_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four micro-batches, some rows one batch late; the states after each of them."""
    rows = records(spark, sf_dir)
    late = (F.substring("observation_id", 1, 1) < "4").cast("int")
    batch = F.least(F.floor((F.col("occurred_at_ns") - views.START_NS) / _SPAN) + late,
                    F.lit(_BATCHES - 1))
    path = _in_order(spark, rows, "observations-in-order", batch, _BATCHES)
    store, out = new_path(spark, "trend-store"), new_path(spark, "trend-states")
    stream = streams.stream_files(spark, path, rows.schema, files_per_batch=1)
    streams.run_batches(stream, streams.trend_batches(store, out, key="fingerprint"),
                        new_path(spark, "trend-log")).awaitTermination()
    return spark.read.parquet(out).select(
        "batch_id", "fingerprint", "occurrence_count", "canonical_task_count", "local_day_count",
        "trend_state")


_SEQUENCE = ("repeated_attempt", "command_churn", "tool_loop", "quality_gate_bypass")
_HOUR = 3_600_000_000_000
#: Only events of hours that the watermark (two hours behind the newest row) has passed.
_CLOSED = DETECT_CTES.replace("FROM detector_events),", f"""FROM detector_events
  WHERE timestamp_ns // {_HOUR} < (SELECT (max(timestamp_ns) - {2 * _HOUR}) // {_HOUR}
    FROM detector_events WHERE op_key IS NOT NULL OR is_mutation)),""")
for _cte in ("detector_events", "fields", "stamped", "keyed"):
    _CLOSED = _CLOSED.replace(f"\n{_cte} AS (", f"\n{_cte} AS MATERIALIZED (")


@query("stream_sequence_detectors", sql(" UNION ALL ".join(
    f"SELECT {', '.join(_SHOWN)} FROM ({DETECTOR_SQL[d]})" for d in _SEQUENCE), _CLOSED))
def stream_sequence_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events arrive in four files, a week each; rows out of order by an hour cross them."""
    week = 7 * 24 * _HOUR
    rows = views.events(spark, sf_dir)
    arrival = F.col("timestamp_ns") + F.pmod(F.xxhash64("event_id"), F.lit(3)) * (_HOUR // 2)
    file = F.least(F.floor((arrival - views.START_NS) / week), F.lit(3))
    path = _in_order(spark, rows, "events-in-order", file, 4)
    stream = streams.stream_files(spark, path, rows.schema, files_per_batch=1)
    out = new_path(spark, "sequences")
    sequences.run_sequences(stream, out, new_path(spark, "sequences-log"))
    return sequences.sequence_members(spark, out).select(*_SHOWN)


@query("stream_slots", f"""WITH {RUNS_SQL}, r AS (SELECT *, started_ns // 3600000000000 AS h
  FROM runs), top AS (SELECT max(started_ns) - 7200000000000 AS late FROM runs)
SELECT h * 3600 AS slot_start, count(*) AS n_runs,
  count(*) FILTER (status IN ('succeeded', 'no_data')) AS n_completed FROM r, top
GROUP BY h, late HAVING (h + 1) * 3600000000000 <= late""")
def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: slots the watermark has not passed yet stay open."""
    path = views.folder(spark, sf_dir, "runs", runs)
    schema = runs(spark, sf_dir).schema
    return _drain(spark, streams.stream_slots(streams.stream_files(spark, path, schema)),
                  "stream-slots")
