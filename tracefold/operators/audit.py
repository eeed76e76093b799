"""Run slots, recovery and data-quality audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K

COMPLETED = ("succeeded", "no_data")
TERMINAL = (*COMPLETED, "failed")


def slot_of(ns: Column, interval_seconds: int = 3600) -> Column:
    """Start (epoch seconds) of the UTC slot holding ``ns``."""
    return C.floor_div(ns, interval_seconds * K.NS_PER_SECOND) * interval_seconds


def slot_status(runs: DataFrame, now_ns: int, interval_seconds: int = 3600) -> DataFrame:
    """The latest completed run started in the current slot; no row when there is none."""
    width = interval_seconds * K.NS_PER_SECOND
    start = now_ns // width * width
    inside = (F.col("started_ns") >= start) & (F.col("started_ns") < start + width)
    latest = F.max_by(F.struct("id", "started_ns"), F.struct("started_ns", "id"))
    return runs.where(F.col("status").isin(*COMPLETED) & inside).agg(latest.alias("r")).where(
        "r is not null").select(
        F.col("r.id").alias("run_id"), F.col("r.started_ns").alias("started_ns"),
        F.lit(start // K.NS_PER_SECOND).cast("bigint").alias("slot_start"))


def slot_coverage(runs: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """Runs per slot and whether one of them completed."""
    done = F.col("status").isin(*COMPLETED)
    return runs.groupBy(slot_of(F.col("started_ns"), interval_seconds).alias("slot_start")).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(done).alias("n_completed"),
        F.bool_or(done).alias("covered"))


def interrupted_runs(runs: DataFrame, completed_ns: int) -> DataFrame:
    """Next run snapshot with every still running row closed as interrupted."""
    running = F.col("status") == "running"
    return runs.withColumns({
        "completed_ns": F.when(running, F.lit(completed_ns)).otherwise(F.col("completed_ns")),
        "error_code": F.when(running, F.lit("interrupted")).otherwise(F.col("error_code")),
        "status": F.when(running, F.lit("failed")).otherwise(F.col("status"))})


def latest_terminal_run(runs: DataFrame) -> DataFrame:
    columns = ["id", "status", "started_ns", "completed_ns", "error_code"]
    return runs.where(F.col("status").isin(*TERMINAL)).agg(F.max_by(
        F.struct(*columns), F.struct("completed_ns", "started_ns", "id")).alias("r")
    ).where("r is not null").select("r.*")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent, counted per key before the join."""
    keys = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    return keys.join(parent.select(F.col(parent_key).alias("key")).distinct(), "key",
                     "left_anti")


def referential_audit(
    references: dict[str, tuple[DataFrame, str, DataFrame, str]]
) -> DataFrame:
    """Orphan keys and rows of every declared reference, one row per reference."""
    return reduce(DataFrame.unionByName, (
        orphans(*spec).agg(
            F.lit(name).alias("reference"), F.count(F.lit(1)).alias("orphan_keys"),
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_rows"))
        for name, spec in references.items()))


def immutability_audit(df: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Ids of an append-only table that were written with different content.

    Distinct contents are reduced to their smallest and largest hash, so a much
    rewritten id stays one small partial aggregate.
    """
    digest = F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256)
    return df.select(F.col(key).alias("id"), digest.alias("_h")).groupBy("id").agg(
        F.min("_h").alias("_a"), F.max("_h").alias("_b"), F.count(F.lit(1)).alias("n_rows")
    ).where("_a <> _b").select("id", "n_rows")


def domain_audit(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule, all rules counted in one pass.

    A rule that evaluates to null holds, as in a SQL check.
    """
    counts = df.agg(*(F.count_if(~rule).alias(name) for name, rule in rules.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations"))
                      for n in rules))
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def scan_run_rules() -> dict[str, Column]:
    return {
        "status": F.col("status").isin("running", *TERMINAL),
        "rows_processed": F.col("rows_processed") >= 0,
        "completed_after_start": F.col("completed_ns") >= F.col("started_ns"),
    }


def finding_rules() -> dict[str, Column]:
    return {
        "fingerprint_length": F.length("fingerprint") == 64,
        "trend_state": F.col("trend_state").isin("isolated", "emerging", "actionable",
                                                 "dormant"),
        "seen_order": F.col("last_seen_ns") >= F.col("first_seen_ns"),
        "first_seen": F.col("first_seen_ns") >= 0,
        "entity_version": F.col("entity_version") > 0,
    }


def outbox_rules() -> dict[str, Column]:
    return {
        "status": F.col("status").isin("pending", "delivered"),
        "attempt_count": F.col("attempt_count") >= 0,
        "payload_json": F.try_parse_json("payload_json").isNotNull(),
        "delivered_has_time": (F.col("status") != "delivered")
        | F.col("delivered_ns").isNotNull(),
    }
