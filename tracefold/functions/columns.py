"""Column functions shared by the batch and the streaming plans.

Everything here is a built-in expression, so it stays inside the JVM and, where
the surrounding plan allows it, inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracefold.functions import constants as K

SEP = K.UNIT_SEPARATOR
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


# ---- typed text -----------------------------------------------------------

def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def full_match(col: Column, pattern: str) -> Column:
    return col.rlike(rf"\A(?:{pattern})\z")


def parse_duration_ms(col: Column) -> Column:
    """Milliseconds from plain decimal text; null for blank and for rejected text."""
    value = F.when(full_match(col, K.DECIMAL_PATTERN), col.try_cast("double"))
    return F.when(value < F.lit(float("inf")), value)


def duration_rejected(col: Column) -> Column:
    return blank_to_null(col).isNotNull() & parse_duration_ms(col).isNull()


def parse_uint(col: Column) -> Column:
    return F.when(full_match(col, K.UINT_PATTERN), col.try_cast("bigint"))


# ---- time -----------------------------------------------------------------

def floor_div(col: Column, unit: int | Column) -> Column:
    """Integer division rounding towards minus infinity (SQL ``div`` truncates)."""
    return F.call_function("div", col - F.pmod(col, F.lit(unit)), F.lit(unit))


def timestamp_of(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def ns_of(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def local_day(ns: Column, zone: str = K.LOCAL_ZONE) -> Column:
    """Calendar day of an epoch-ns value in ``zone`` (session zone is UTC)."""
    return F.to_date(F.from_utc_timestamp(timestamp_of(ns), zone))


# ---- identities and digests -----------------------------------------------

def stable_id(*parts: Column) -> Column:
    """SHA-256 hex of the parts joined by the unit separator."""
    return F.sha2(F.concat_ws(SEP, *parts), 256)


def uuid_text(hex_digits: Column) -> Column:
    """8-4-4-4-12 form of the first 32 hex digits."""
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(hex_digits, a, n) for a, n in cuts))


def event_id(scope: Column, entity: Column, version: Column, sequence: Column,
             name: Column) -> Column:
    """UUID from the leading 128 bits of the event's SHA-256."""
    return uuid_text(
        stable_id(scope, entity, version.cast("string"), sequence.cast("string"), name)
    )


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID of ``name`` in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return uuid_text(F.concat(
        F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3),
        variant, F.substring(digest, 18, 15),
    ))


def finding_id(fingerprint: Column, prefix: str = K.FINDING_NAME_PREFIX) -> Column:
    return uuid5_url(F.concat(F.lit(prefix), fingerprint))


def project_id(kind: Column, root: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.sha2(F.concat(kind, F.lit("\0"), root), 256))


def last_path_part(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


# ---- JSON text --------------------------------------------------------------

def _escape_plain(col: Column) -> Column:
    doubled = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit('"'), F.replace(doubled, F.lit('"'), F.lit('\\"')), F.lit('"'))


def _escape_char(char: Column) -> Column:
    units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
    return (
        F.when(char == '"', F.lit('\\"')).when(char == "\\", F.lit("\\\\"))
        .when(char == "\n", F.lit("\\n")).when(char == "\r", F.lit("\\r"))
        .when(char == "\t", F.lit("\\t")).when(char == "\b", F.lit("\\b"))
        .when(char == "\f", F.lit("\\f")).when(char.rlike("^[ -~]$"), char)
        .otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))
    )


def json_string(col: Column) -> Column:
    """ASCII JSON string literal; non-ASCII text becomes UTF-16 escapes."""
    by_char = F.concat(
        F.lit('"'),
        F.array_join(F.transform(F.split(col, ""), _escape_char), ""),
        F.lit('"'),
    )
    return F.when(full_match(col, "[ -~]*"), _escape_plain(col)).otherwise(by_char)


def json_number(col: Column) -> Column:
    """Whole doubles print as integers, others in their shortest form."""
    whole = (col == F.floor(col)) & (F.abs(col) < F.lit(1e15))
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def json_object(fields: dict[str, Column]) -> Column:
    """Compact JSON object from already rendered values, keys in order."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "{") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def fingerprint(project: Column, detector: Column, operation_kind: Column,
                target_kind: Column, target: Column, failure_class: Column,
                version: int = K.DETECTOR_VERSION) -> Column:
    return F.sha2(json_object({
        "detector_version": F.lit(str(version)),
        "category": json_string(detector),
        "project_identity": json_string(project),
        "operation_kind": json_string(operation_kind),
        "target_kind": json_string(target_kind),
        "normalized_target": json_string(target),
        "normalized_failure_class": json_string(failure_class),
    }), 256)


def allowlisted_json(fields: dict[str, Column]) -> Column:
    """Canonical JSON of the permitted fields, absent values kept as null."""
    return F.to_json(
        F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}
    )


# ---- normalisation of one value ----------------------------------------------

def clean_path(col: Column) -> Column:
    """Forward slashes, no empty or ``.`` components, no trailing slash."""
    path = F.replace(col, F.lit("\\"), F.lit("/"))
    body = F.regexp_replace(path, r"(?<=/|^)\.(?=/|$)", "")
    body = F.regexp_replace(F.regexp_replace(body, "/{2,}", "/"), r"\A/+|/+\z", "")
    lead = (
        F.when(path.rlike(r"\A//(?:[^/]|\z)"), F.lit("//"))
        .when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    )
    return F.regexp_replace(F.concat(lead, body), r"\A\z", ".")


def is_uri(col: Column) -> Column:
    return col.startswith("http://") | col.startswith("https://") | col.startswith("file://")


def clean_target(col: Column) -> Column:
    return F.when(is_uri(col), col).otherwise(clean_path(col))


def mask_volatile(value: Column, key: Column | None = None,
                  keys: tuple[str, ...] = K.VOLATILE_KEYS,
                  roots: tuple[str, ...] = K.TEMPORARY_ROOTS) -> Column:
    """Replace declared volatile text by a stable placeholder."""
    position = r"\A(.+?):[0-9]+(?::[0-9]+)?\z"
    temporary = reduce(
        lambda a, b: a | b,
        ((value == r.rstrip("/")) | value.startswith(r.rstrip("/") + "/") for r in roots),
    )
    masked = (
        F.when(full_match(value, K.TIMESTAMP_PATTERN), F.lit("<timestamp>"))
        .when(full_match(value, K.UUID_PATTERN), F.lit("<generated-id>"))
        .when(temporary, F.lit("<temporary-path>"))
        .when(value.rlike(position), clean_path(F.regexp_extract(value, position, 1)))
        .otherwise(value)
    )
    if key is None:
        return masked
    return F.when(key.isin(*keys), F.concat(F.lit("<"), key, F.lit(">"))).otherwise(masked)


def _path_parts(path: Column) -> Column:
    named = F.filter(
        F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != ".")
    )
    empty = F.array().cast("array<string>")
    return F.aggregate(named, empty, lambda acc, p: F.when(
        p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    ).otherwise(F.concat(acc, F.array(p))))


def relative_target(target: Column, root: Column) -> Column:
    """Project-relative path by lexical resolution; null when it leaves the root."""
    absolute = F.when(target.rlike(r"\A[\\/]"), target).otherwise(
        F.concat(root, F.lit("/"), target)
    )
    parts, base = _path_parts(absolute), _path_parts(root)
    n = F.size(base)
    inside = F.slice(parts, F.lit(1), n) == base
    rest = F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")
    return F.when(inside, F.when(rest == "", F.lit(".")).otherwise(rest))


# ---- evidence ----------------------------------------------------------------

def redact(col: Column, json_keys: bool = False) -> Column:
    """Mask secrets; text over the scanner limit becomes null (quarantine)."""
    out = F.regexp_replace(col, K.NAMED_SECRET_PATTERN, "$1=[REDACTED]")
    if json_keys:
        out = F.regexp_replace(out, K.QUOTED_KEY_SECRET_PATTERN, '"$1":"[REDACTED]"')
    # The bare shapes never overlap, so one pass replaces all three, and only where a
    # cheap substring test says one of them can occur.
    bare = F.regexp_replace(out, "|".join(K.BARE_SECRET_PATTERNS), "[REDACTED]")
    likely = col.contains("sk-") | col.contains("AKIA") | col.contains("gh")
    return F.when(F.length(col) <= K.EVIDENCE_CHARACTER_LIMIT,
                  F.when(likely, bare).otherwise(out))


# ---- event classes -------------------------------------------------------------

def tool_failure_class(name: Column, success_text: Column, success: Column,
                       status: Column) -> Column:
    transport = name.isin(*K.TRANSPORT_EVENTS)
    return (
        F.when((name == "codex.tool_result") & (success_text == "false"),
               F.lit("tool_result_false"))
        .when(transport & ~success, F.lit("transport_success_false"))
        .when(transport & (status >= 400),
              F.concat(F.lit("http_"), floor_div(status, 100).cast("string"), F.lit("xx")))
    )


def outcome_event_name(name: Column, source: Column) -> Column:
    return F.when(user_decision(name, source), F.lit("turn/steer")).otherwise(name)


def outcome_value(name: Column, source: Column, decision: Column, hydrated: Column) -> Column:
    return F.when(user_decision(name, source), decision).otherwise(hydrated)


def user_decision(name: Column, source: Column) -> Column:
    return F.coalesce((name == "codex.tool_decision") & (source == "user"), F.lit(False))


def operation_kind(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("event"))


def target_kind(kind: Column, target: Column) -> Column:
    return (
        F.when(kind.isNull(), F.lit("none")).when(target.isNull(), F.lit("executable"))
        .when(is_uri(target), F.lit("uri")).otherwise(F.lit("path"))
    )


def operation_target(kind: Column, target: Column, executable: Column, name: Column) -> Column:
    return F.when(kind.isNull(), name).otherwise(
        F.coalesce(blank_to_null(target), executable)
    )


def is_quality_gate(kind: Column, executable: Column, flag: Column) -> Column:
    allowed = F.coalesce(flag, F.lit(False)) | executable.isin(*K.QUALITY_TOOLS)
    return F.coalesce((kind == "shell") & F.coalesce(flag, F.lit(True)) & allowed, F.lit(False))


def is_mutation(tool: Column) -> Column:
    return F.coalesce(tool.isin(*K.MUTATION_TOOLS), F.lit(False))


def trend_state(count: Column, tasks: Column, days: Column, was_actionable: Column) -> Column:
    return (
        F.when(((count >= 3) & (tasks >= 2) & (days >= 2)) | ((count >= 5) & (tasks >= 3)),
               F.lit("actionable"))
        .when((count == 0) & was_actionable, F.lit("dormant"))
        .when(count <= 1, F.lit("isolated"))
        .otherwise(F.lit("emerging"))
    )
