"""Task, turn, project and target identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.operators.ordering import salted_join

PROJECT_KINDS = ("git", "non_git")


class IdentityConflict(ValueError):
    """A conversation is tied to more than one thread."""


def _conversation_threads(logs: DataFrame, traces: DataFrame) -> DataFrame:
    seen = logs.where(
        C.blank_to_null(F.col("conversation_id")).isNotNull() & F.col("trace_id").isNotNull()
    ).select("conversation_id", "trace_id").distinct()
    threads = traces.where(C.blank_to_null(F.col("thread_id")).isNotNull()).select(
        "trace_id", "thread_id")
    return _thread_range(salted_join(seen, threads, ["trace_id"], F.col("conversation_id"),
                                     "inner"))


def _thread_range(pairs: DataFrame) -> DataFrame:
    """Smallest and largest thread per conversation; equal when there is only one."""
    return pairs.groupBy("conversation_id").agg(
        F.min("thread_id").alias("thread_id"), F.max("thread_id").alias("other_thread_id"))


def linked_thread_map(linked: DataFrame) -> DataFrame:
    """The lenient map from logs that already carry their trace's thread."""
    pairs = linked.where(
        C.blank_to_null(F.col("conversation_id")).isNotNull()
        & C.blank_to_null(F.col("thread_id")).isNotNull())
    return _thread_range(pairs).where(
        F.col("thread_id") == F.col("other_thread_id")).drop("other_thread_id")


def conversation_thread_map(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Conversations that share traces with exactly one thread."""
    return _conversation_threads(logs, traces).where(
        F.col("thread_id") == F.col("other_thread_id")).drop("other_thread_id")


def conversation_conflicts(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Conversations tied to several threads, with the two extreme ones."""
    return _conversation_threads(logs, traces).where(
        F.col("thread_id") != F.col("other_thread_id"))


def strict_conversation_thread_map(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Same map, failing at run time on the first conflicting conversation."""
    checked = F.when(F.col("thread_id") == F.col("other_thread_id"), F.col("thread_id")).otherwise(
        F.raise_error(F.concat(F.lit("conversation maps to conflicting threads: "),
                               F.col("conversation_id"))))
    return _conversation_threads(logs, traces).select(
        "conversation_id", checked.alias("thread_id"))


def has_whitespace(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\s"), F.lit(False))


def identity_fault(thread_id: Column, conversation_id: Column, fallback: Column) -> Column:
    """Name of the identity that holds whitespace, null for a usable row."""
    thread, conversation = C.blank_to_null(thread_id), C.blank_to_null(conversation_id)
    return (
        F.when(has_whitespace(thread), F.lit("thread_id"))
        .when(has_whitespace(conversation), F.lit("conversation_id"))
        .when(thread.isNull() & conversation.isNull() & has_whitespace(fallback),
              F.lit("trace_id"))
    )


def with_canonical_task(events: DataFrame, conversation_map: DataFrame,
                        fallback: Column, row_id: Column) -> DataFrame:
    """Add task kind, task id and the distinct-task flag.

    Precedence: thread, mapped thread, conversation, episode (``fallback``). Any
    identity holding whitespace yields a null task and ``identity_error``.
    """
    mapped = conversation_map.select(
        "conversation_id", F.col("thread_id").alias("mapped_thread_id"))
    thread = C.blank_to_null(F.col("thread_id"))
    conversation = C.blank_to_null(F.col("conversation_id"))
    error = identity_fault(F.col("thread_id"), F.col("conversation_id"), fallback)
    kind = (
        F.when(F.col("identity_error").isNotNull(), F.lit(None))
        .when(thread.isNotNull() | C.blank_to_null(F.col("mapped_thread_id")).isNotNull(),
              F.lit("thread"))
        .when(conversation.isNotNull(), F.lit("conversation"))
        .when(C.blank_to_null(fallback).isNotNull(), F.lit("episode"))
    )
    value = F.coalesce(thread, C.blank_to_null(F.col("mapped_thread_id")), conversation, fallback)
    return (
        salted_join(events, mapped, ["conversation_id"], row_id)
        .withColumn("identity_error", error)
        .withColumn("task_kind", kind)
        .withColumn("task_id", F.concat("task_kind", F.lit(":"), value))
        .withColumn("counts_as_distinct_task", F.col("task_kind") != "episode")
        .drop("mapped_thread_id")
    )


def canonical_turn(task: Column, turn_dot_id: Column, turn_id: Column) -> Column:
    """Turn identity under its task; null when neither id is present or one is malformed."""
    value = F.coalesce(C.blank_to_null(turn_dot_id), C.blank_to_null(turn_id))
    return F.when(~has_whitespace(value), F.concat(task, F.lit("/turn:"), value))


def resolve_projects(cwds: DataFrame, roots: DataFrame,
                     aliases: DataFrame | None = None) -> DataFrame:
    """One row per resolvable ``cwd``: kind, root, project_id, alias_source.

    ``roots`` is (root, kind); the longest root that is the cwd or one of its
    ancestors wins. Ancestors are enumerated, so this is an equi-join.
    """
    parts = F.filter(F.split(C.clean_path(F.col("cwd")), "/"), lambda p: p != "")
    steps = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    found = (
        cwds.where(F.col("cwd").startswith("/")).select("cwd").distinct()
        .withColumn("root", F.explode(steps))
        .join(roots.select("root", "kind"), "root")
        .groupBy("cwd")
        .agg(F.max_by(F.struct("kind", "root"),
                      F.struct(F.length("root"), F.col("kind") == "git")).alias("p"))
        .select("cwd", "p.kind", "p.root")
    )
    if aliases is None:
        found = found.withColumn("alias_source", F.lit(None).cast("string"))
    else:
        valid = valid_aliases(aliases).select("kind", "root", "target_root")
        found = found.join(valid, ["kind", "root"], "left").select(
            "cwd", "kind", F.coalesce("target_root", "root").alias("root"),
            F.when(F.col("target_root") != F.col("root"),
                   F.concat("kind", F.lit(":"), "root")).alias("alias_source"))
    return found.withColumn("project_id", C.project_id(F.col("kind"), F.col("root")))


def _alias_fault() -> Column:
    plain = r"\A/(?:[^/]+(?:/[^/]+)*)?\z"
    dotted = r"(?:/|\A)\.{1,2}(?:/|\z)"
    bad_path = [~F.col(c).rlike(plain) | F.col(c).rlike(dotted) for c in ("root", "target_root")]
    return (
        F.when(~F.col("kind").isin(*PROJECT_KINDS) | ~F.col("target_kind").isin(*PROJECT_KINDS),
               F.lit("unknown kind"))
        .when(bad_path[0] | bad_path[1], F.lit("path is not normalized and absolute"))
        .when(F.col("kind") != F.col("target_kind"), F.lit("alias changes the kind"))
    )


def valid_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.where(_alias_fault().isNull())


def rejected_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.withColumn("fault", _alias_fault()).where("fault is not null")


def project_or_unresolved(project: Column, task: Column) -> Column:
    return F.coalesce(project, F.concat(F.lit("unresolved:"), task))


def project_dimension(resolved: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New dimension rows, one per project id."""
    rows = resolved.select(
        F.col("project_id").alias("id"), F.col("kind").alias("identity_kind"),
        F.col("root").alias("canonical_path"),
        F.when(F.col("kind") == "git", F.concat("root", F.lit("/.git"))).alias("git_common_dir"),
    ).dropDuplicates(["id"])
    return rows if existing is None else rows.join(existing.select("id"), "id", "left_anti")
