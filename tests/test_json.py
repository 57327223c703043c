"""What is read as JSON, by rules as strict as the types it stands for, and handlers that get it."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import messages as C
from tracemill.operators import tools as T

GOOD = "struct<a:string,n:decimal(20,0),raw:binary,l:array<struct<b:string>>>"


@pytest.mark.parametrize(
    ("text", "ok", "value"),
    [
        ('{"a":"x","n":3,"raw":{"q":1,"q":2},"l":[{"b":"y"},null]}', True, ("x", 3, '{"q":1,"q":2}', ["y", None])),
        (' {"a":null,"z":[1,{}]} \n', True, (None, None, None, None)),
        ('{"a":"x","a":"y"}', True, ("y", None, None, None)),
        ("null", True, None),
        ('{"a":7}', False, None),
        ('{"a":true}', False, None),
        ('{"a":{"b":1}}', False, None),
        ('{"n":"3"}', False, None),
        ('{"n":-3}', False, None),
        ('{"n":1.5}', False, None),
        ('{"l":[{"b":[]}]}', False, None),
        ('{"l":{}}', False, None),
        ('{"a":"x"} junk', False, None),
        ('{"a":"x"}{}', False, None),
        ('{"a":"x"},"end":1', False, None),
        ('{"a":"x"}],[{}', False, None),
        ('{"raw":NaN}', False, None),
        ("{'a':'x'}", False, None),
        ('["a"]', False, None),
        ('"a"', False, None),
        ("", False, None),
        (None, False, None),
    ],
)
def test_strict_json(spark, text, ok, value):
    got = spark.createDataFrame([(text,)], "t string").select(X.strict_json(F.col("t"), GOOD).alias("r")).first().r
    v = got.value
    assert bool(got.ok) is ok and (v if v is None else (v.a, v.n, v.raw, v.l and [x and x.b for x in v.l])) == value


@pytest.mark.parametrize(
    ("text", "ok", "value"),
    [
        ('{"a":1,"a":2,"b":"x","a":3}', True, {"a": 3, "b": "x"}),
        ('{"a":{"c":[1,null]},"é":""}', True, {"a": {"c": [1, None]}, "é": ""}),
        ("{}", True, {}),
        ("null", True, None),
        ('{"a":1} x', False, None),
        ('{"a":1}{"a":2}', False, None),
        ('{"a":NaN}', False, None),
        ("[1]", False, None),
        ("", False, None),
        (None, False, None),
    ],
)
def test_arguments_as_values(spark, text, ok, value):
    row = T.parse_arguments(spark.createDataFrame([(text,)], "arguments string")).select("ok", F.to_json("args").alias("args")).first()
    assert row.ok is ok and (row.args and json.loads(row.args)) == value


def test_checks_agree_with_the_parser(spark):
    """The last of two keys counts, and what the parser refuses is refused, for commands, files and provider messages."""
    calls = spark.createDataFrame([(1, '{"command":"ls","command":"pwd"}'), (2, '{"command":"ls"} x'), (3, "null"), (4, '{"path":"a","path":"b"}')], "k int, arguments string")
    got = {r.k: (r.command, r.error) for r in T.check_arguments(calls).collect()}
    missing = (None, "command must be a non-empty string")
    assert got == {1: ("pwd", None), 2: (None, T.NOT_AN_OBJECT), 3: missing, 4: missing}
    assert [(r.k, r.path, r.error) for r in T.check_file_arguments(calls, default=".").orderBy("k").collect()] == [(1, ".", None), (2, None, T.NOT_AN_OBJECT), (3, ".", None), (4, "b", None)]
    call = F.array(F.struct(F.lit("c").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("f").alias("name"), F.col("arguments")).alias("function")))
    said = C.to_claude_messages(calls.select("k", F.lit("assistant").alias("role"), F.lit("").alias("content"), F.lit("").alias("name"), call.alias("tool_calls"), F.array().alias("tool_results")))
    assert {r.k: json.loads(r.content)[0].get("input") for r in said.collect()} == {1: {"command": "pwd"}, 2: None, 3: None, 4: {"path": "b"}}


BODIES = {
    "chat": (C.parse_chat_responses, '{"choices":[{"message":{"role":"assistant","content":%s}}]}'),
    "claude": (C.from_claude_responses, '{"content":[{"type":"text","text":%s}]}'),
    "gemini": (C.from_gemini_responses, '{"candidates":[{"content":{"parts":[{"text":%s}]}}]}'),
}


@pytest.mark.parametrize("name", BODIES)
def test_bodies(spark, name):
    parse, body = BODIES[name]
    good, number, nan = body % '"x"', body % "7", body % "NaN"
    rows = [good, good + " \n", good + " junk", good + good, number, nan, "{bad", "", None, "null"]
    got = [(r.error, r.content) for r in parse(spark.createDataFrame(list(enumerate(rows)), "k int, body string")).orderBy("k").collect()]
    assert got[:2] == [(None, "x")] * 2 and {e for e, _ in got[2:9]} == {C.BAD_JSON} and not any(c for _, c in got[2:9])
    assert got[9][0] == ("empty choices" if name == "chat" else None)


def test_handlers_by_batch(spark):
    """Only calls of Python tools cross to a worker; a failure stays with its call; a batch is asked as a whole first."""
    rows = [(i, "sum" if i % 3 == 0 else "upper" if i % 3 == 1 else "native", '{"v": %d}' % i) for i in range(60)]
    rows += [(100, "sum", '{"v": "x"}'), (101, "sum", "bad"), (102, "sum", "null"), (103, "upper", '{"v": "x"}'), (104, None, "{}"), (105, "other", "{}"), (106, "lone", "{}")]
    calls = spark.createDataFrame([("s", i, f"c{i}", n, a) for i, n, a in rows], "session_id string, seq long, call_id string, name string, arguments string")
    registry = spark.createDataFrame([("sum",), ("upper",), ("native",), ("lone",)], "name string")

    def sums(batch):
        return [ValueError("odd") if a["v"] == 9 else [len(batch) > 1, a["v"] + 0] for a in batch]

    handlers = {"sum": T.Batch(sums), "upper": lambda a: {"u": a["v"] * 2}, "native": F.to_json("args")}
    frame = T.execute_calls(calls.coalesce(1), registry, handlers)
    got = {r.seq: (r.content, r.is_error) for r in frame.collect()}
    assert len(got) == len(rows) and got[0] == ("[false, 0]", False) and got[9] == ('{"error": "odd"}', True) and got[4] == ('{"u": 8}', False) and got[5] == ('{"v":5}', False)
    assert got[100][1] and got[101] == (T.BAD_ARGUMENTS, True) and got[102][1] and got[103] == ('{"u": "xx"}', False)
    assert got[104][1] and "not found" in got[105][0] and got[106] == ('{"error": "no handler"}', True)
    fine = T.execute_calls(calls.filter("seq < 9").coalesce(1), registry, handlers)
    assert {r.seq: r.content for r in fine.filter("seq % 3 = 0").collect()} == {0: "[true, 0]", 3: "[true, 3]", 6: "[true, 6]"}
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty_calls(spark):
    none = spark.createDataFrame([], "session_id string, seq long, call_id string, name string, arguments string")
    assert T.execute_calls(none, spark.createDataFrame([("f",)], "name string"), {"f": lambda a: a}).count() == 0
