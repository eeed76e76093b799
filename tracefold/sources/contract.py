"""Schema inventory and contract checks over the raw telemetry tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions import constants as K

INVENTORY_DAYS = 15


def _names(df: DataFrame, source: str, event_name: Column, maps: Sequence[str]) -> DataFrame:
    """Event names and map keys of one table, from a single pass over it."""
    def named(field: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.lit(field).alias("field"),
                                                     n.alias("name")))

    found = [named("event_name", F.array(event_name))]
    found += [named(m, F.coalesce(F.map_keys(m), F.array().cast("array<string>"))) for m in maps]
    return df.select(F.lit(source).alias("source"), F.explode(F.concat(*found)).alias("_found")
                     ).select("source", "_found.*").distinct()


def schema_inventory(logs: DataFrame, spans: DataFrame, now_ns: int,
                     services: tuple[str, ...] = K.SOURCE_SERVICES) -> DataFrame:
    """Distinct event names and attribute keys seen over the last fifteen days."""
    since = now_ns - INVENTORY_DAYS * K.NS_PER_DAY
    recent_logs = logs.where(
        (F.col("ts_bucket_start") >= since // K.NS_PER_SECOND)
        & F.col("resource")["service.name"].isin(*services))
    recent_spans = spans.where(
        (F.col("timestamp_ns") >= since)
        & (F.col("ts_bucket_start") >= since // K.NS_PER_SECOND - K.BUCKET_SLACK_SECONDS)
        & F.col("serviceName").isin(*services))
    maps = ("attributes_string", "attributes_number", "attributes_bool")
    return _names(
        recent_logs, "logs", F.coalesce(F.col("attributes_string")["event.name"], F.lit("")), maps
    ).unionByName(_names(recent_spans, "spans", F.col("name"), maps[:2]))


def inventory_lists(inventory: DataFrame) -> DataFrame:
    """One sorted name list per source and field (names are schema sized)."""
    return inventory.groupBy("source", "field").agg(
        F.array_sort(F.collect_set("name")).alias("names"))


def table_columns(spark: SparkSession, tables: dict[str, T.StructType]) -> DataFrame:
    """Observed columns (table, name, type) of the given schemas."""
    rows = [(t, f.name, f.dataType.simpleString()) for t, s in tables.items() for f in s]
    return spark.createDataFrame(rows, "table string, name string, type string")


def contract_check(observed: DataFrame, required: DataFrame,
                   on: tuple[str, ...] = ("table", "name")) -> DataFrame:
    """Required entries that were not observed; empty when the contract holds."""
    return required.join(observed.select(*on).distinct(), list(on), "left_anti")


def contract_fingerprint(observed: DataFrame, required: DataFrame,
                         on: tuple[str, ...] = ("table", "name")) -> DataFrame:
    """SHA-256 of the sorted required entries as observed, types included.

    The list is as long as the contract, which is fixed by the required entries.
    """
    held = observed.join(required.select(*on).distinct(), list(on), "left_semi")
    return held.distinct().agg(F.sha2(F.to_json(F.array_sort(F.collect_list(
        F.struct(*observed.columns)))), 256).alias("fingerprint"))


def unapproved(fingerprints: DataFrame, approvals: DataFrame) -> DataFrame:
    """Observed fingerprints lacking an approval; a scan stops unless this is empty."""
    return fingerprints.join(approvals.where("approved_at is not null").select("fingerprint"),
                             "fingerprint", "left_anti")
