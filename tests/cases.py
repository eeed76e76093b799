"""Small builders for detector events."""

from __future__ import annotations

SCHEMA = (
    "event_id string, timestamp_ns long, project_id string, task_id string, "
    "counts_as_distinct_task boolean, event_name string, op_kind string, op_executable string, "
    "op_subcommand string, op_target string, op_exit_code long, op_key string, "
    "success_string string, success_bool boolean, status_code long, outcome string, "
    "is_mutation boolean, token_count long, skill_required string, skill_used boolean, "
    "decision_source string, is_quality_gate boolean, tool_call_count long"
)
COLUMNS = [part.split()[0] for part in SCHEMA.split(", ")]


def event(number: int, key: str | None = None, **fields):
    """One event; ``key`` names a shell operation with that executable and target."""
    row = dict.fromkeys(COLUMNS)
    row.update(event_id=f"e{number:05d}", timestamp_ns=number * 300_000_000, project_id="p",
               task_id="t", counts_as_distinct_task=True, event_name="codex.tool_result",
               is_mutation=False)
    if key is not None:
        row.update(op_kind="shell", op_executable=key, op_target=f"src/{key}.py", op_key=key)
    row.update(fields)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA)


def groups(members):
    """{group_id: [event ids in order]} of collected member rows."""
    out = {}
    for r in sorted(members.collect(), key=lambda r: (r.group_id, r.ordinal)):
        out.setdefault(r.group_id, []).append(r.event_id)
        assert len(out[r.group_id]) == r.ordinal <= r.member_count
    return out
