"""Result sinks: idempotent appends, and runs that appear all at once through a commit log.

A run is written by attempts. Each attempt writes its tables into folders of its own, so two
attempts of one run never touch each other's files. The run is published by one manifest file
named after the run and put only if there is none: the first attempt to end wins, the folders
of the others stay unread. Readers follow the manifests, and with ``up_to`` those of runs up to
an order only, so what they read does not change under them.

Tables with a time column are laid out by day and hash bucket; their manifest lists the days,
so that a reader of some days opens the folders of those days alone.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import constants as K
from tracefold.functions.columns import floor_div
from tracefold.sources import files

PUBLISHED = "_published"
#: Partition columns of a table laid out by day, and the hash buckets of a day.
DAY, BUCKET = "of_day", "of_bucket"
BUCKETS = 16
_MANIFEST = "run_id string, run_order long, attempt string, days map<string,array<string>>"
_LOCAL_WORK: dict[str, str] = {}
#: Tables of each open scratch scope. The scope of a thread is a local property of the context,
#: so this stays a plain dictionary that can travel with functions of this package.
_SCRATCH: dict[str, list[str]] = {}
_SCOPE = "tracefold.scratch"


def work_folder(spark: SparkSession) -> str:
    """Shared folder the cluster names for intermediate tables.

    Only a local session without one falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_WORK:
        _LOCAL_WORK[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_WORK[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once under the work folder and read it back.

    Cuts the lineage with a table that outlives lost executors.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    scope = spark.sparkContext.getLocalProperty(_SCOPE)
    if scope in _SCRATCH:
        _SCRATCH[scope].append(path)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``stored`` writes inside, at the end: nothing read from them may
    be used afterwards."""
    context, scope = spark.sparkContext, uuid.uuid4().hex
    before = context.getLocalProperty(_SCOPE)
    _SCRATCH[scope] = []
    context.setLocalProperty(_SCOPE, scope)
    try:
        yield
    finally:
        context.setLocalProperty(_SCOPE, before)
        for path in _SCRATCH.pop(scope):
            files.remove(spark, path)


def table_at(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame | None:
    """The parquet table at the paths, or None while nothing has been written there."""
    reader = spark.read if base is None else spark.read.option("basePath", base)
    try:
        return reader.parquet(*paths)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# ---- days and buckets ------------------------------------------------------------

def day_of(ns: Column) -> Column:
    """UTC day of a time, as text."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ns, K.NS_PER_DAY).cast(
        "int")).cast("string")


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def days_between(start_ns: int, end_ns: int) -> list[str]:
    """All UTC days of a closed time range."""
    import datetime

    first, last = start_ns // K.NS_PER_DAY, end_ns // K.NS_PER_DAY
    epoch = datetime.date(1970, 1, 1)
    return [str(epoch + datetime.timedelta(days=d)) for d in range(first, last + 1)]


def places(rows: DataFrame, ns: str, key: str) -> tuple[list[str], list[int]]:
    """Days and buckets that ``rows`` can be in: at most a bucket count of numbers a day."""
    held = rows.select(day_of(F.col(ns)).alias("day"), bucket_of(key).alias("bucket")).distinct()
    found = held.agg(F.collect_set("day"), F.collect_set("bucket")).first()
    return sorted(found[0]), sorted(found[1])


# ---- events ----------------------------------------------------------------------

def new_events(events: DataFrame, target: DataFrame | None) -> DataFrame:
    """Events whose id the target does not hold yet, once each."""
    unique = events.dropDuplicates(["event_id"])
    return unique if target is None else unique.join(
        target.select("event_id"), "event_id", "left_anti")


def emit_events(events: DataFrame, path: str) -> None:
    """Append the events that ``path`` does not hold yet (usable in foreachBatch).

    An event id stands for one time, so an event can only be held under its own day: the target
    is laid out by day, and no other day of it is opened.
    """
    spark = events.sparkSession
    timed = stored(events.withColumn(DAY, day_of(F.col("timestamp_ns"))), "emitted")
    days = [r[0] for r in timed.select(DAY).distinct().collect()]
    new_events(timed, read_days(spark, path, days)).write.mode("append").partitionBy(
        DAY).parquet(path)


def read_days(spark: SparkSession, path: str, days: Sequence[str]) -> DataFrame | None:
    """Rows of a table laid out by day, from the folders of those days alone."""
    there = [f"{path}/{DAY}={d}" for d in days if files.exists(spark, f"{path}/{DAY}={d}")]
    return table_at(spark, *there, base=path) if there else None


# ---- runs ------------------------------------------------------------------------

def new_attempt() -> str:
    return f"a-{uuid.uuid4().hex}"


def write_attempt(results: dict[str, DataFrame], path: str, attempt: str,
                  by_day: dict[str, tuple[str, str]] | None = None) -> dict[str, list[str]]:
    """Write the tables of one attempt; the days of those laid out by (time, key) column."""
    days = {}
    for name, df in results.items():
        folder = f"{path}/{name}/attempt={attempt}"
        if by_day and name in by_day:
            ns, key = by_day[name]
            df.withColumns({DAY: day_of(F.col(ns)), BUCKET: bucket_of(key)}).write.partitionBy(
                DAY, BUCKET).parquet(folder)
            days[name] = [n.removeprefix(f"{DAY}=") for n in files.names(
                df.sparkSession, folder) if n.startswith(f"{DAY}=")]
        else:
            df.write.parquet(folder)
    return days


def publish(spark: SparkSession, path: str, run_id: str, attempt: str, order: int = 0,
            days: dict[str, list[str]] | None = None) -> bool:
    """Make an attempt the run's result, unless another one is already."""
    return files.put_new(spark, f"{path}/{PUBLISHED}/{quote(run_id, safe='')}.json", json.dumps(
        {"run_id": run_id, "run_order": order, "attempt": attempt, "days": days or {}}))


def write_results(results: dict[str, DataFrame], path: str, run_id: str, order: int = 0,
                  by_day: dict[str, tuple[str, str]] | None = None) -> bool:
    """Write all tables of one run and publish it; False if it was published before.

    ``order`` ranks the published runs.
    """
    spark = next(iter(results.values())).sparkSession
    if is_published(spark, path, run_id):
        return False
    attempt = new_attempt()
    days = write_attempt(results, path, attempt, by_day)
    return publish(spark, path, run_id, attempt, order, days)


def published_runs(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame | None:
    """Manifests of the published runs (one row a run)."""
    if not files.names(spark, f"{path}/{PUBLISHED}"):
        return None
    runs = spark.read.schema(_MANIFEST).json(f"{path}/{PUBLISHED}")
    return runs if up_to is None else runs.where(F.col("run_order") <= up_to)


def is_published(spark: SparkSession, path: str, run_id: str) -> bool:
    return files.exists(spark, f"{path}/{PUBLISHED}/{quote(run_id, safe='')}.json")


def read_results(spark: SparkSession, path: str, name: str, days: Sequence[str] | None = None,
                 buckets: Sequence[int] | None = None, up_to: int | None = None
                 ) -> DataFrame | None:
    """Rows of ``name`` from published runs only, with their run_id; None before the first one.

    With ``days`` (of a table laid out by day) only the folders of those days are opened, with
    ``buckets`` only those buckets of them.
    """
    runs = published_runs(spark, path, up_to)
    if runs is None:
        return None
    if days is None:
        # the manifests are joined by attempt, which is a folder: those of no run are not read
        table = table_at(spark, f"{path}/{name}")
    else:
        held = F.array_intersect(F.col("days")[name], F.array(*map(F.lit, days)))
        wanted = runs.select("attempt", F.explode(held).alias("day")).collect()
        paths = [f"{path}/{name}/attempt={r['attempt']}/{DAY}={r['day']}" for r in wanted]
        table = table_at(spark, *paths, base=f"{path}/{name}") if paths else None
        if table is not None and buckets is not None:
            table = table.where(F.col(BUCKET).isin(*buckets))
    if table is None:
        return None
    return table.join(runs.select("attempt", "run_id"), "attempt").drop("attempt", DAY, BUCKET)


def read_latest(spark: SparkSession, path: str, name: str, up_to: int | None = None
                ) -> DataFrame | None:
    """Rows of ``name`` from the last published run (for snapshot tables)."""
    runs = published_runs(spark, path, up_to)
    if runs is None:
        return None
    last = runs.agg(F.max_by("attempt", F.struct("run_order", "run_id"))).first()[0]
    return None if last is None else table_at(spark, f"{path}/{name}/attempt={last}")
