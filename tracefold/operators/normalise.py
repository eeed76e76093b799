"""Tool calls to comparable operations.

The common shapes never leave the JVM: a JSON command array, and a JSON command text, which a
fold over its characters splits as a POSIX shell would. Only calls of other shapes (nested
generic arguments, very long texts) are sent to Python, by a branch of their own, where one
Arrow UDF parses them. Masking, positionals and metadata are expressions.
"""

from __future__ import annotations

import json
import math
import re
import shlex
from pathlib import PurePosixPath

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tracefold
from tracefold.functions import columns as C
from tracefold.functions import constants as K

# Ship the small parsing helpers with the UDF, so executors need no package install.
cloudpickle.register_pickle_by_value(tracefold)

OPERATION_TYPE = (
    "struct<kind:string,executable:string,subcommand:string,target:string,argv:array<string>>"
)
_PARSED_TYPE = T.StructType([
    T.StructField("argv", T.ArrayType(T.StringType())),
    T.StructField("canonical", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("target_is_uri", T.BooleanType()),
])
#: Longer arguments are parsed in Python, with the same result.
_PLAIN_LIMIT = 8192
_PLAIN_TEXT = (
    r'\s*\{\s*"(?:argv|cmd|command)"\s*:\s*'
    r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt])*+"\s*\}\s*'
)
_PLAIN_ARRAY = (
    r'\s*\{\s*"(?:argv|cmd|command)"\s*:\s*'
    r'\[\s*"[^"\\\x00-\x1f]*+"(?:\s*,\s*"[^"\\\x00-\x1f]*+")*+\s*\]\s*\}\s*'
)
_MASKS = (
    (re.compile(K.TIMESTAMP_PATTERN, re.ASCII), "<timestamp>"),
    (re.compile(K.UUID_PATTERN), "<generated-id>"),
)
_POSITION = re.compile(r"(.+?):[0-9]+(?::[0-9]+)?")


def _bad_constant(name: str) -> object:
    raise ValueError(name)


def _mask(value: object, key: str | None) -> object:
    if key in K.VOLATILE_KEYS:
        return f"<{key}>"
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("non-finite number")
    if not isinstance(value, str):
        return value
    for pattern, placeholder in _MASKS:
        if pattern.fullmatch(value):
            return placeholder
    if any(value == r or value.startswith(r + "/") for r in K.TEMPORARY_ROOTS):
        return "<temporary-path>"
    position = _POSITION.fullmatch(value)
    return PurePosixPath(position[1].replace("\\", "/")).as_posix() if position else value


def mask_structure(value: object, key: str | None = None) -> object:
    """Mask volatile scalars of a decoded JSON value, keeping its structure."""
    if isinstance(value, dict):
        return {k: mask_structure(value[k], k) for k in sorted(value)}
    if isinstance(value, list):
        return [mask_structure(item) for item in value]
    return _mask(value, key)


def parse_call(tool: str | None, text: str | None) -> dict | None:
    """Decode one call's arguments; None when they cannot be compared safely."""
    if not tool or text is None:
        return None
    try:
        decoded = json.loads(text, parse_constant=_bad_constant)
        if tool in K.SHELL_TOOLS:
            command = decoded
            if isinstance(decoded, dict):
                present = [k for k in ("argv", "cmd", "command") if k in decoded]
                command = decoded[present[0]] if present else None
                if isinstance(command, str):
                    command = shlex.split(command)
            if isinstance(command, list) and command and all(
                isinstance(item, str) for item in command
            ):
                return {"argv": command}
            return None
        if not isinstance(decoded, (dict, list)):
            return None
        masked = mask_structure(decoded)
    except (ValueError, RecursionError):
        return None
    named = [k for k in ("path", "file", "target", "uri")
             if isinstance(masked, dict) and isinstance(masked.get(k), str)]
    return {
        "canonical": json.dumps(masked, sort_keys=True, separators=(",", ":"),
                                ensure_ascii=False),
        "target": masked[named[0]] if named else None,
        "target_is_uri": bool(named) and named[0] == "uri",
    }


@F.pandas_udf(_PARSED_TYPE)
def _parse_calls(tool: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [parse_call(t, x) or {} for t, x in zip(tool, text, strict=True)]
    return pd.DataFrame(
        {k: pd.Series([r.get(k) for r in rows], dtype=object)
         for k in ("argv", "canonical", "target", "target_is_uri")}
    )


def _lookup(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    pairs = [c for k, v in table.items() for c in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.coalesce(F.create_map(*pairs)[key], F.array().cast("array<string>"))


def executable_name(first: Column) -> Column:
    path = C.clean_path(first)
    return F.when(path.isin(".", "/", "//"), F.lit("")).otherwise(C.last_path_part(path))


def positionals(args: Column, executable: Column) -> Column:
    """Arguments left after dropping options and the values options take."""
    takes_value = _lookup(K.VALUE_OPTIONS, executable)
    start = F.struct(F.lit(False).alias("skip"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        option = item.startswith("-") & (item != "-")
        skips = option & ~item.contains("=") & F.array_contains(takes_value, item)
        return F.struct(
            (~state["skip"] & skips).alias("skip"),
            F.when(state["skip"] | option, state["kept"])
            .otherwise(F.concat(state["kept"], F.array(item))).alias("kept"),
        )

    return F.aggregate(args, start, step, lambda state: state["kept"])


def shell_operation(argv: Column, executable: Column, found: Column) -> Column:
    """Operation struct of a masked argument vector and its positionals."""
    n = F.size(found)
    known = F.array_contains(_lookup(K.SUBCOMMANDS, executable), F.get(found, F.lit(0)))
    subcommand = F.when((n > 0) & (known | (n > 1)), F.get(found, F.lit(0)))
    target = F.when((n > 1) | ((n == 1) & ~known), C.clean_target(F.get(found, n - 1)))
    return F.struct(
        F.lit("shell").alias("kind"), executable.alias("executable"),
        subcommand.alias("subcommand"), target.alias("target"), argv.alias("argv"),
    )


def tail(argv: Column) -> Column:
    return F.slice(argv, F.lit(2), F.greatest(F.size(argv) - 1, F.lit(0)))


def is_plain_array(tool: Column, arguments: Column) -> Column:
    """Calls whose command is a JSON array of unescaped strings."""
    return _plain(tool, arguments, _PLAIN_ARRAY)


def is_plain_text(tool: Column, arguments: Column) -> Column:
    """Calls whose command is one JSON string (without numeric escapes)."""
    return _plain(tool, arguments, _PLAIN_TEXT)


def _plain(tool: Column, arguments: Column, pattern: str) -> Column:
    return F.coalesce(
        tool.isin(*K.SHELL_TOOLS) & (F.length(arguments) <= _PLAIN_LIMIT)
        & C.full_match(arguments, pattern), F.lit(False))


def plain_array(arguments: Column) -> Column:
    shape = "struct<argv:array<string>,cmd:array<string>,command:array<string>>"
    decoded = F.from_json(arguments, shape)
    return F.coalesce(decoded["argv"], decoded["cmd"], decoded["command"])


def plain_text(arguments: Column) -> Column:
    decoded = F.from_json(arguments, "struct<argv:string,cmd:string,command:string>")
    return F.coalesce(decoded["argv"], decoded["cmd"], decoded["command"])


def shell_words(text: Column) -> Column:
    """Words of a command as a POSIX shell splits them; null if a quote or escape stays open.

    One state machine over the characters: between words, in a word, in single or double quotes,
    and after a backslash outside or inside double quotes.
    """
    start = F.struct(F.lit("between").alias("mode"), F.lit("").alias("word"),
                     F.array().cast("array<string>").alias("words"))

    def step(state: Column, char: Column) -> Column:
        mode, word = state["mode"], state["word"]
        free = mode.isin("between", "word")
        ends = free & char.isin(" ", "\t", "\r", "\n")
        next_mode = (
            F.when(ends, F.lit("between"))
            .when(free & (char == "'"), F.lit("single")).when(free & (char == '"'), F.lit("double"))
            .when(free & (char == "\\"), F.lit("escaped"))
            .when((mode == "single") & (char != "'"), mode)
            .when((mode == "double") & (char == "\\"), F.lit("escaped in double"))
            .when((mode == "double") & (char != '"'), mode)
            .when(mode == "escaped in double", F.lit("double"))
            .otherwise(F.lit("word")))
        quoting = (
            (free & char.isin("'", '"', "\\")) | ((mode == "single") & (char == "'"))
            | ((mode == "double") & char.isin('"', "\\")))
        kept = F.when(quoting | ends, F.lit("")).when(
            (mode == "escaped in double") & ~char.isin('"', "\\"),
            F.concat(F.lit("\\"), char)).otherwise(char)
        return F.struct(
            next_mode.alias("mode"),
            F.when(ends, F.lit("")).otherwise(F.concat(word, kept)).alias("word"),
            F.when(ends & (mode == "word"), F.concat(state["words"], F.array(word)))
            .otherwise(state["words"]).alias("words"))

    def finish(state: Column) -> Column:
        return F.when(state["mode"] == "word", F.concat(
            state["words"], F.array(state["word"]))).when(
            state["mode"] == "between", state["words"])

    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), start, step, finish)


def _native_words(tool: Column, arguments: Column) -> Column:
    """Argument vector of the shapes read without Python; null for no words."""
    words = F.when(is_plain_array(tool, arguments), plain_array(arguments)).otherwise(
        shell_words(plain_text(arguments)))
    return F.when(F.size(words) > 0, words)


def normalise_operations(calls: DataFrame, tool: str = "tool_name",
                         arguments: str = "arguments") -> DataFrame:
    """Add ``operation`` to every call; null (row kept) when not comparable.

    ``calls`` is read by two branches, so it should be a stored table.
    """
    name, text = F.col(tool), F.col(arguments)
    native = is_plain_array(name, text) | is_plain_text(name, text) | name.isNull() | (
        name == "") | text.isNull()
    quick = calls.where(native).withColumns({
        "_argv": F.when(name.isNotNull() & text.isNotNull() & (name != ""),
                        _native_words(name, text)),
        "_parsed": F.lit(None).cast(_PARSED_TYPE)})
    parsed = calls.where(~native).withColumns({
        "_argv": F.lit(None).cast("array<string>"), "_parsed": _parse_calls(name, text)})
    staged = quick.unionByName(parsed).withColumn("_argv", F.transform(
        F.coalesce("_argv", "_parsed.argv"), lambda a: C.mask_volatile(a))
    ).withColumn("_exe", executable_name(F.get("_argv", F.lit(0)))
    ).withColumn("_found", positionals(tail(F.col("_argv")), F.col("_exe")))
    target = F.col("_parsed.target")
    generic = F.struct(
        F.lit("tool").alias("kind"), name.alias("executable"),
        F.lit(None).cast("string").alias("subcommand"),
        F.when(F.col("_parsed.target_is_uri"), target).otherwise(C.clean_target(target))
        .alias("target"),
        F.array("_parsed.canonical").alias("argv"),
    )
    return staged.withColumn(
        "operation",
        F.when(F.col("_argv").isNotNull(), shell_operation(
            F.col("_argv"), F.col("_exe"), F.col("_found")))
        .when(F.col("_parsed.canonical").isNotNull(), generic).cast(OPERATION_TYPE),
    ).drop("_argv", "_parsed", "_exe", "_found")


def membership_key(operation: Column) -> Column:
    """Digest of kind, executable, subcommand, target and argv."""
    return F.when(operation.isNotNull(), F.sha2(F.to_json(F.struct(
        *(operation[f].alias(f)
          for f in ("kind", "executable", "subcommand", "target", "argv"))
    ), {"ignoreNullFields": "false"}), 256))
