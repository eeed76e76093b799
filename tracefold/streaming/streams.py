"""Structured Streaming forms of the scan, the detectors, the trends and the slots.

The column functions and detectors are those of the batch plans. Event-at-a-time
detectors run as plain streaming projections; ``sequences`` holds the detectors that need
the order inside a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators import audit, detectors, observations
from tracefold.sources import sinks

LATENESS = "2 hours"


def stream_files(spark: SparkSession, path: str, schema: T.StructType,
                 files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_events(raw: DataFrame, key: str = "id", lateness: str = LATENESS) -> DataFrame:
    """Each event once, admitting rows up to ``lateness`` behind the newest."""
    timed = raw.withColumn("ts", C.timestamp_of(F.col("timestamp_ns")))
    return timed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def stream_event_detectors(events: DataFrame) -> DataFrame:
    """Members of the stateless detectors, in append mode."""
    return reduce(DataFrame.unionByName,
                  (d(events) for d in detectors.SINGLE_EVENT_DETECTORS))


def stream_slots(runs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Runs and completed runs per hourly slot."""
    timed = runs.withColumn("started_at", C.timestamp_of(F.col("started_ns")))
    done = F.col("status").isin(*audit.COMPLETED)
    return timed.withWatermark("started_at", lateness).groupBy(
        F.window("started_at", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(done).alias("n_completed")).select(
        F.unix_seconds("w.start").alias("slot_start"), "n_runs", "n_completed")


def _newest(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """Clock row of the last micro-batch before ``before``; batches are numbered without gaps."""
    if before == 0:
        return None
    return spark.read.parquet(f"{path}/batch_id={before - 1}")


def trend_batches(store: str, out: str, key: str = "finding_id",
                  id_column: str = "observation_id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: trends over the seven days up to the newest occurrence so far.

    The window moves with the batches. Each batch adds its new rows to the days they belong to,
    as rows and as counts per (finding, task, local day). An evaluation reads the counts of the
    whole days in the window and the rows of its first day, so no day older than eight is
    opened; rows already behind the window are left out, as it never moves back. A batch that
    is repeated overwrites its own part of every day it wrote.
    """
    def put(rows: DataFrame, path: str, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(sinks.DAY, "batch_id").parquet(path)

    def earlier(spark: SparkSession, path: str, days: list[str], batch_id: int
                ) -> DataFrame | None:
        rows = sinks.read_days(spark, path, days) if days else None
        return None if rows is None else rows.where(F.col("batch_id") < batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = _newest(spark, f"{store}/clock", batch_id)
        newest = batch.agg(F.max("occurred_at_ns")).first()[0]
        before = None if clock is None else clock.first()[0]
        if newest is None and before is None:
            now_ns = 0
        else:
            now_ns = max(n for n in (newest, before) if n is not None)
        spark.range(1).select(F.lit(now_ns).cast("bigint").alias("now_ns")).write.mode(
            "overwrite").parquet(f"{store}/clock/batch_id={batch_id}")
        start = now_ns - K.TREND_WINDOW_DAYS * K.NS_PER_DAY
        days = sinks.days_between(start, now_ns)
        inside = batch.where(F.col("occurred_at_ns") >= start).select(
            id_column, key, "task_identity", "occurred_at_ns").dropDuplicates([id_column])
        inside = inside.withColumn(sinks.DAY, sinks.day_of(F.col("occurred_at_ns")))
        touched = [r[0] for r in inside.select(sinks.DAY).distinct().collect()]
        held = earlier(spark, f"{store}/rows", touched, batch_id)
        new = inside if held is None else inside.join(
            held.select(id_column), id_column, "left_anti")
        put(new, f"{store}/rows", batch_id)
        up_to = batch_id + 1
        written = sinks.read_days(spark, f"{store}/rows", touched)
        if written is not None:
            put(observations.trend_cells(
                written.where(F.col("batch_id") == batch_id), key, sinks.DAY),
                f"{store}/cells", batch_id)
        rows = earlier(spark, f"{store}/rows", days[:1], up_to)
        whole = earlier(spark, f"{store}/cells", days[1:], up_to)
        columns = [key, "task_identity", "day", "n"]
        parts = [] if rows is None else [observations.trend_cells(
            rows.where(F.col("occurred_at_ns") >= start), key).select(*columns)]
        parts += [] if whole is None else [whole.select(*columns)]
        if not parts:
            parts = [observations.trend_cells(inside.where("false"), key).select(*columns)]
        prior = inside.select(key).where("false")
        if batch_id > 0:
            prior = observations.previously_actionable(
                spark.read.parquet(f"{out}/batch_id={batch_id - 1}"), key)
        counts = observations.cell_counts(reduce(DataFrame.unionByName, parts), key)
        observations.judged(counts, prior, now_ns, key).write.mode(
            "overwrite").parquet(f"{out}/batch_id={batch_id}")
    return run


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Drain what is available into a parquet folder."""
    return stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_batches(stream: DataFrame, body: Callable[[DataFrame, int], None],
                checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(body).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
