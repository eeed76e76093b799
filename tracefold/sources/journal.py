"""The run journal: what every attempt of a run came to.

An attempt has one file when it starts and one when it ends, each put only if there is none, so
an attempt ends once: succeeded, no_data or failed. An attempt that started long ago and did not
end is closed by the next run, as published if its manifest is there and as interrupted if not.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import constants as K
from tracefold.sources import files, sinks

#: An attempt that runs longer than this is taken for lost.
LEASE_NS = 900 * K.NS_PER_SECOND
_STARTED = ("id string, run_id string, started_ns long, source_start_ns long, "
            "source_end_ns long")
_ENDED = ("id string, status string, completed_ns long, rows_processed long, "
          "error_code string, details string")


def start(spark: SparkSession, store: str, attempt: str, run_id: str, started_ns: int,
          start_ns: int, end_ns: int) -> None:
    row = {"id": attempt, "run_id": run_id, "started_ns": started_ns,
           "source_start_ns": start_ns, "source_end_ns": end_ns}
    if not files.put_new(spark, f"{store}/_started/{attempt}.json", json.dumps(row)):
        raise RuntimeError(f"attempt {attempt} has started before")


def end(spark: SparkSession, store: str, attempt: str, status: str, completed_ns: int,
        rows_processed: int = 0, error_code: str | None = None,
        details: dict | None = None) -> bool:
    """Close an attempt; False if it is closed already."""
    row = {"id": attempt, "status": status, "completed_ns": completed_ns,
           "rows_processed": rows_processed, "error_code": error_code,
           "details": json.dumps(details or {}, sort_keys=True)}
    return files.put_new(spark, f"{store}/_ended/{attempt}.json", json.dumps(row))


def runs(spark: SparkSession, store: str) -> DataFrame | None:
    """One row an attempt; those without an end are running."""
    if not files.names(spark, f"{store}/_started"):
        return None
    started = spark.read.schema(_STARTED).json(f"{store}/_started")
    if files.names(spark, f"{store}/_ended"):
        ended = spark.read.schema(_ENDED).json(f"{store}/_ended")
    else:
        ended = spark.createDataFrame([], _ENDED)
    return started.join(ended, "id", "left").withColumn(
        "status", F.coalesce("status", F.lit("running")))


def recover(spark: SparkSession, store: str, now_ns: int, lease_ns: int = LEASE_NS) -> int:
    """Close the attempts whose lease has run out; returns how many there were."""
    all_runs = runs(spark, store)
    if all_runs is None:
        return 0
    lost = all_runs.where((F.col("status") == "running") & (
        F.col("started_ns") <= now_ns - lease_ns)).select("id", "run_id")
    manifests = sinks.published_runs(spark, store)
    if manifests is None:
        marked = lost.withColumn("published", F.lit(False))
    else:
        marked = lost.join(manifests.select(F.col("attempt").alias("id"), F.lit(True).alias(
            "published")), "id", "left")
    closed = 0
    for row in marked.collect():  # runs that were cut short, not all runs
        done = bool(row["published"])
        closed += end(spark, store, row["id"], "succeeded" if done else "failed", now_ns,
                      error_code=None if done else "interrupted")
    return closed
