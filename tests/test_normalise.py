from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from tracefold.functions import columns as C
from tracefold.functions import constants as K
from tracefold.operators import identity, normalise, validate

CALLS = [
    # tool, arguments, expected (kind, executable, subcommand, target, argv) or None
    ("shell", '{"cmd":["git","-C","/r","status","src/a.py"]}',
     ("shell", "git", "status", "src/a.py", ["git", "-C", "/r", "status", "src/a.py"])),
    ("bash", '{"command":"pytest -k \'a b\' tests/x.py:12"}',
     ("shell", "pytest", None, "tests/x.py", ["pytest", "-k", "a b", "tests/x.py"])),
    ("exec", '["/usr/bin/rg","-g","*.py","pat","src"]',
     ("shell", "rg", "pat", "src", ["/usr/bin/rg", "-g", "*.py", "pat", "src"])),
    ("shell", '{"argv":["ls"]}', ("shell", "ls", None, None, ["ls"])),
    ("shell", '{"argv":["cat","/tmp/x/1"]}',
     ("shell", "cat", None, "<temporary-path>", ["cat", "<temporary-path>"])),
    ("shell", '{"cmd":["curl","https://h/a//b"]}',
     ("shell", "curl", None, "https://h/a//b", ["curl", "https://h/a//b"])),
    ("shell", '{"argv":null,"cmd":"ls"}', None), ("shell", '{"cmd":""}', None),
    ("shell", '{"cmd":"unclosed \'"}', None), ("shell", '{"cmd":[1,"a"]}', None),
    ("shell", '"ls"', None), ("shell", "not json", None), ("shell", None, None),
    ("write_file", '{"b":{"nonce":"q","k":[1,2.0,null]},"path":"./x//y","call_id":"c"}',
     ("tool", "write_file", None, "x/y",
      ['{"b":{"k":[1,2.0,null],"nonce":"<nonce>"},"call_id":"<call_id>","path":"./x//y"}'])),
    ("open", '{"uri":"file:///a/./b"}', ("tool", "open", None, "file:///a/./b",
                                         ['{"uri":"file:///a/./b"}'])),
    ("open", '{"target":7,"note":"é"}', ("tool", "open", None, None,
                                         ['{"note":"é","target":7}'])),
    ("open", '{"x":1e999}', None), ("open", '{"x":NaN}', None), ("open", "3", None),
]


def test_operations(spark):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(CALLS)],
                               "i int, tool_name string, arguments string")
    got = {r.i: r.operation for r in normalise.normalise_operations(df).collect()}
    for i, (_, _, want) in enumerate(CALLS):
        found = None if got[i] is None else (
            got[i].kind, got[i].executable, got[i].subcommand, got[i].target, got[i].argv)
        assert found == want, CALLS[i]


def test_membership_key_ignores_nothing_but_the_outcome(spark):
    df = spark.createDataFrame(
        [("shell", '{"cmd":["rg","a"]}'), ("shell", '{"argv":["rg","a"]}'),
         ("shell", '{"cmd":"rg a"}'), ("shell", '{"cmd":"rg b"}')],
        "tool_name string, arguments string")
    keys = [r.k for r in normalise.normalise_operations(df).select(
        normalise.membership_key(F.col("operation")).alias("k")).collect()]
    assert len(set(keys[:3])) == 1 and keys[3] != keys[0]


def test_positionals_equal_a_sequential_scan(spark):
    rng = random.Random(4)
    words = ["-C", "-m", "--format", "--format=x", "-", "--", "-x", "a", "b", "status"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(0, 8))]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, args array<string>")
    got = {r.i: r.p for r in df.select("i", normalise.positionals(
        F.col("args"), F.lit("git")).alias("p")).collect()}
    for i, args in rows:
        kept, skip = [], False
        for item in args:
            if skip:
                skip = False
            elif item.startswith("-") and item != "-":
                skip = "=" not in item and item in K.VALUE_OPTIONS["git"]
            else:
                kept.append(item)
        assert got[i] == kept, args


def test_masks(spark):
    cases = {
        "2024-01-01T00:00:00Z": "<timestamp>", "2024-01-01T00:00:00.5+0100": "<timestamp>",
        "2024-01-01 00:00:00": "2024-01-01 00",  # reads as path:line:column
        "123e4567-e89b-42d3-a456-426614174000": "<generated-id>",
        "123e4567-e89b-92d3-a456-426614174000": "123e4567-e89b-92d3-a456-426614174000",
        "/tmp": "<temporary-path>", "/var/folders/a": "<temporary-path>", "/tmpfile": "/tmpfile",
        "src/./a.py:10:2": "src/a.py", "C:\\a\\b.py:3": "C:/a/b.py", ":5": ":5",
    }
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    got = {r.v: r.m for r in df.select("v", C.mask_volatile(F.col("v")).alias("m")).collect()}
    assert got == cases


def test_paths(spark):
    from pathlib import PurePosixPath

    texts = ["", ".", "/", "//", "///", "a", "a/", "./a", "a/./b", "a//b", "//a/b", "///a/b",
             "a/..", "../a/.", "/./", "a\\b\\.\\c", ".a/b.", "/.hidden/."]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for r in df.select("v", C.clean_path(F.col("v")).alias("p")).collect():
        assert r.p == PurePosixPath(r.v.replace("\\", "/")).as_posix(), r.v


def test_durations(spark):
    good = {"0": 0.0, "1": 1.0, "1.5": 1.5, "0.25": 0.25, "123456": 123456.0}
    bad = ["01", "+1", "-1", "1e3", " 1", "1 ", ".5", "1.", "1ms", "NaN", "inf", "1\n", "٣"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad, ""]], "v string")
    got = {r.v: (r.d, r.b) for r in df.select(
        "v", C.parse_duration_ms(F.col("v")).alias("d"),
        C.duration_rejected(F.col("v")).alias("b")).collect()}
    assert got == {**{k: (v, False) for k, v in good.items()},
                   **{b: (None, True) for b in bad}, "": (None, False)}


def test_projects_and_turns(spark):
    roots = spark.createDataFrame([("/work", "non_git"), ("/work/p1", "git")],
                                  "root string, kind string")
    cwds = spark.createDataFrame([("/work/p1/src",), ("/work/p10",), ("/work/p1/../p2",),
                                  ("/other",), ("relative",)], "cwd string")
    got = {r.cwd: r.root for r in identity.resolve_projects(cwds, roots).collect()}
    assert got == {"/work/p1/src": "/work/p1", "/work/p10": "/work",
                   "/work/p1/../p2": "/work/p1"}
    turn = spark.range(1).select(
        identity.canonical_turn(F.lit("thread:a"), F.lit("d"), F.lit("u")).alias("a"),
        identity.canonical_turn(F.lit("thread:a"), F.lit(""), F.lit("u")).alias("b"),
        identity.canonical_turn(F.lit("thread:a"), F.lit(None).cast("string"),
                                F.lit("")).alias("c")).first()
    assert (turn.a, turn.b, turn.c) == ("thread:a/turn:d", "thread:a/turn:u", None)


def test_london_day_across_the_clock_change(spark):
    df = spark.createDataFrame([(1774827000,), (1711843200 - 1800,)], "s long")
    got = [str(r.d) for r in df.select(C.local_day(F.col("s") * 10**9).alias("d")).collect()]
    assert got == ["2026-03-30", "2024-03-30"]


def test_enforced_policy_stops_the_job(spark):
    raw = spark.createDataFrame([(1, "", "x", "1")],
                                "timestamp_ns long, id string, event_name string, "
                                "duration_ms string")
    parsed = validate.parse_logs(raw)
    assert validate.rejected(parsed).first().reject_reason == "id is required"
    try:
        validate.enforced(parsed).collect()
    except Exception as error:
        assert "id is required" in str(error)
    else:
        raise AssertionError("a rejected row must stop the job")


def test_shell_words_split_as_a_posix_shell_does(spark):
    import random
    import shlex

    rng = random.Random(3)
    texts = ["", " ", "a", "''", "a '' b", '"', "'", "\\", "a\\", '"a\\"', "a\\ b", "x\u00a0y z",
             "git commit -m \"fix it\" src/a.py", "\U0001f600 'b c'd\"e\"", "a\tb\r\nc"]
    texts += ["".join(rng.choice("ab \t'\"\\$é") for _ in range(rng.randint(0, 14)))
              for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", normalise.shell_words(F.col("t")).alias("w")).collect()
    for row in got:
        try:
            want = shlex.split(row.t)
        except ValueError:
            want = None
        assert row.w == want, row.t


def test_plain_calls_are_parsed_without_python(spark, monkeypatch):
    """Both branches agree, on either side of the length limit; Python sees the rest only."""
    commands = ["ls", "git commit -m \\\"fix it\\\" a.py", "echo 'open", "", "a \\u0062", "x\\ny",
                "rg -g '*.py' needle ./src//m.py", "a\\\\b c"]
    rows = [("exec_command", '{"cmd": "%s"}' % c) for c in commands]
    rows += [("shell", '{"argv":["a","b c"]}'), ("shell", '{"argv":[]}'), (None, "{}"),
             ("exec_command", None), ("", "{}"), ("exec_command", '{"cmd": "%s"}' % ("y " * 5000)),
             ("write_file", '{"path":"a"}'), ("exec_command", '{"cmd":"a","cmd":"b"}')]
    calls = spark.createDataFrame(rows, "tool_name string, arguments string")

    def result():
        op = F.col("operation")
        return sorted(map(str, normalise.normalise_operations(calls).select(
            "tool_name", F.md5("arguments"), op["argv"], op["executable"], op["target"]).collect()))

    native = result()
    monkeypatch.setattr(normalise, "_PLAIN_LIMIT", 0)
    assert result() == native
    monkeypatch.undo()

    @F.pandas_udf(normalise._PARSED_TYPE)
    def fail(tool: pd.Series, text: pd.Series) -> pd.DataFrame:
        if len(tool):
            raise ValueError("a plain call came to Python")
        return pd.DataFrame({"argv": [], "canonical": [], "target": [], "target_is_uri": []})

    monkeypatch.setattr(normalise, "_parse_calls", fail)
    plain = calls.where("length(arguments) < 50 and tool_name = 'exec_command' and arguments not "
                        "like '%u0062%' and arguments not like '%,%'")
    assert normalise.normalise_operations(plain).count() >= 6
