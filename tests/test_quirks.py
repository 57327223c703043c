"""The special cases of the operators, on tiny frames."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators import memory as M
from tracemill.operators import messages as C
from tracemill.operators import plans as P
from tracemill.operators import streams as S
from tracemill.operators import tools as T
from tracemill.sources import files, tables
from tracemill.streaming import assemble

MSG = "id string, session_id string, seq long, role string, content string, reasoning_content string, ts long"


def msgs(spark, rows):
    return spark.createDataFrame([(f"s_{i}", "s", i, role, content, "", 5) for i, (role, content) in enumerate(rows)], MSG)


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,query,hit", [("a\\b", "\\b", True), ("100%", "0%", True), ("abc", "a_c", True), ("ABC", "abc", True), ("É", "é", False), ("x", "", True), ("a\nb", "a%b", True), ("ab", "ba", False)])
def test_like(spark, text, query, hit):
    row = spark.createDataFrame([(text, query)], "t string, q string")
    assert one(row, X.contains_like(F.col("t"), F.col("q"))) is hit


@pytest.mark.parametrize("text,kind", [('{"a":1,}', "invalid"), ('{"a":NaN}', "invalid"), ("{'a':1}", "invalid"), ('{"a":1} x', "invalid"), ("", "invalid"), ("null", "null"), ('{"a":1,"a":2}', "object"), ("[1]", "array"), ("5", "number"), ("true", "boolean"), (None, None), ("1,2", "invalid"), ('1,"end":1}', "invalid"), ("1],[2", "invalid"), ('"\x01"', "invalid"), (" {} ", "object")])
def test_json_kind(spark, text, kind):
    assert one(spark.createDataFrame([(text,)], "t string"), X.json_kind(F.col("t"))) == kind


@pytest.mark.parametrize("raw,body", [("```JSON\n{\"a\": 1}\n```", '{"a": 1}'), ("", ""), ("    ", ""), ("Here {a} and } done", "{a} and }"), ("x [1] y", "[1]"), ("plain", "plain"), ("} {", "} {"), ("```\n[1, 2]```", "[1, 2]"), ("\u00a0```json\u2003x \u3000```\n", "x"), ("```````", "`"), ("```", ""), ("a```b", "a```b"), (None, None)])
def test_trim_json(spark, raw, body):
    assert one(spark.createDataFrame([(raw,)], "t string"), X.trim_json_wrapper(F.col("t"))) == body


@pytest.mark.parametrize("raw,status", [('{"tasks": []}', "ok"), ('{"tasks": "x"}', "error"), ('{"tasks": null} {}', "error"), ('{"tasks": [], "n": NaN}', "error"), ('{"tasks": []},"end":1}', "error"), ('[{"tasks": []}]', "ok"), ("[1]", "empty"), (None, "empty")])
def test_plan_texts(spark, raw, status):
    plans = P.parse_plans(spark.createDataFrame([("p", "g", raw)], "plan_id string, goal string, raw string"))
    assert [(r["status"], r["tasks"]) for r in plans.collect()] == [(status, [])]


def test_task_outputs_keep_keys(spark):
    answers = spark.createDataFrame([(1, "b", 2, "w", 'so {"a": 1, "b": null}'), (2, "c", 3, "v", "[1]"), (3, None, None, None, None), (4, "d", 5, "u", "{}")], "id long, body string, p long, wrong string, raw string")
    rows = P.parse_task_outputs(answers).orderBy("id", "slot").collect()
    assert [tuple(r) for r in rows] == [(1, "b", 2, "w", "a", "1", None), (1, "b", 2, "w", "b", None, None), (2, "c", 3, "v", None, None, "not a JSON object"), (3, None, None, None, None, None, "not a JSON object")]


def test_recall_ties_and_limit(spark):
    m = msgs(spark, [("user", "aa"), ("assistant", "ab"), ("user", "ba"), ("user", "zz"), ("user", "a")])
    q = spark.createDataFrame([("s", 9, "a"), ("none", 1, "a")], "session_id string, q_seq long, q string")
    assert [(r["rn"], r["content"]) for r in M.recall_topk(m, q, 2).orderBy("rn").collect()] == [(1, "a"), (2, "ba")]


def context(spark, rows, prompt):
    prompts = spark.createDataFrame([("s", prompt)] if prompt else [], "session_id string, prompt string")
    return [(r["role"], r["content"]) for r in M.build_context(msgs(spark, rows), prompts).orderBy("pos").collect()]


def test_context(spark):
    rows = [("user", "1"), ("system", "S"), ("user", "2"), ("system", "T")]
    assert context(spark, rows, "P") == [("system", "S"), ("system", "P"), ("user", "2"), ("system", "T")]
    assert context(spark, rows, None) == rows
    assert context(spark, [("user", "1")], "P") == [("system", "P"), ("user", "1")]
    assert context(spark, [], "P") == [("system", "P")]


def test_save_last_write_wins(spark):
    old = msgs(spark, [("user", "a"), ("user", "b")])
    new = old.filter("seq = 0").withColumn("content", F.lit("x")).withColumn("write_seq", F.lit(1)).unionByName(old.filter("seq = 0").withColumn("content", F.lit("y")).withColumn("write_seq", F.lit(2)))
    assert sorted(r["content"] for r in M.save_turns(old, new).collect()) == ["b", "y"]


def lines(spark, *data):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(data)], "stream_id string, seq long, line string")


def chunk(**delta):
    return "data: " + json.dumps({"choices": [{"delta": delta}]})


def test_stream_rules(spark):
    feed = lines(spark, ": ping", chunk(content="a"), "data: {bad", "data:no", chunk(role="assistant", content="b"), 'data: {"choices":[]}', chunk(content="c", role="") + "\r", "data: [DONE]", chunk(content="LATE"))
    chunks = S.parse_sse(feed)
    assert [(r["role"], r["content"]) for r in S.sticky_role(chunks).orderBy("seq").collect()] == [("", "a"), ("assistant", "b"), ("assistant", "c")]
    out = S.assemble_messages(chunks, feed.union(lines(spark, "").withColumn("stream_id", F.lit("empty")))).orderBy("stream_id").collect()
    assert [tuple(r) for r in out] == [("empty", "assistant", "", "", [], 0, 0), ("s", "assistant", "abc", "", [], 3, 0)]


def test_tool_parts(spark):
    calls = [{"index": 2, "id": "x", "function": {"name": "f", "arguments": "{"}}, {"index": 2, "function": {"arguments": "}"}}]
    feed = lines(spark, chunk(tool_calls=calls), chunk(tool_calls=[{"index": 2, "id": "y", "function": {"arguments": "!"}}]))
    merged = S.merge_tool_deltas(S.tool_parts(S.parse_sse(feed))).orderBy("idx").collect()
    assert [(r["idx"], r["id"], r["name"], r["args"]) for r in merged] == [(0, "", "", ""), (1, "", "", ""), (2, "y", "f", "{}!")]
    states = S.chunk_states(S.parse_sse(lines(spark, chunk(content="a"), chunk(tool_calls=calls), chunk(content="b")))).orderBy("seq").collect()
    assert [r["is_tool_call"] for r in states] == [False, True, True]


def test_usage_and_cut(spark):
    u = 'data: {"choices":[{"delta":{"content":"x"},"usage":{"prompt_tokens":1,"completion":2,"total_tokens":3}}]}'
    chunks = S.parse_sse(lines(spark, u, chunk(content="y"), chunk(content="z")))
    assert tuple(S.stream_usage(chunks).first())[1:] == (1, 2, 3)
    cut = S.cut_stream(chunks, F.col("content") == "y").orderBy("seq").collect()
    assert [(r["content"], r["cancelled"]) for r in cut] == [("x", True), ("y", True)]


def test_execute_order(spark):
    calls = spark.createDataFrame([("s", 0, "a", "nope", "bad"), ("s", 1, "b", "f", ""), ("s", 2, "c", "f", "null"), ("s", 3, "d", "f", '{"x": 0}'), ("s", 4, "e", None, "{}")], "session_id string, seq long, call_id string, name string, arguments string")
    registry = spark.createDataFrame([("f",)], "name string")
    got = {r["call_id"]: (r["content"], r["is_error"]) for r in T.execute_calls(calls, registry, {"f": lambda a: {"q": 1 / (a or {"x": 1})["x"]}}).collect()}
    assert got["a"] == ('{"error": "tool nope not found"}', True) and got["b"] == (T.BAD_ARGUMENTS, True)
    assert got["c"] == ('{"q": 1.0}', False) and got["d"] == ('{"error": "division by zero"}', True) and got["e"][1]
    with pytest.raises(ValueError):
        T.resolve_calls(calls, registry.union(registry))


def test_screen_and_paths(spark):
    rows = spark.createDataFrame([("sudo rm -rf /",), ("RM   -rf x",), ("a || b",), ("",), (None,)], "command string")
    assert [(r["rule"], r["blocked"]) for r in T.screen_commands(rows).collect()] == [(None, False), (1, True), (8, True), (None, False), (None, False)]
    paths = spark.createDataFrame([("a/./b",), ("../x",), ("..x",), ("/base/dir",), ("/other",), ("",), ("a/../..",)], "path string")
    got = [(r["relative"], r["denied"]) for r in T.confine_paths(paths, "/base/dir").collect()]
    assert got == [("a/b", False), ("../x", True), ("..x", True), (".", False), ("../../other", True), (".", False), ("..", True)]


def test_arguments_types(spark):
    rows = spark.createDataFrame([('{"command":"ls","timeout":0.5,"cwd":""}',), ('{"command":5}',), ("not json",), ('{"command":"x","timeout":-1,"cwd":"/t"}',)], "arguments string")
    got = [(r["command"], r["timeout_s"], r["cwd"], r["error"] is None) for r in T.check_arguments(rows).collect()]
    assert got == [("ls", 0, None, True), (None, 30, None, False), (None, 30, None, False), ("x", 30, "/t", True)]


def full(spark):
    call = [("c1", "function", ("f", '{"a": 1}')), ("c2", "function", ("g", "bad"))]
    rows = [("s", 0, "user", 'say "hi"\n', "", "n", False, [], []), ("s", 1, "assistant", "", "why", "n", True, call, []), ("s", 2, "tool", "own", "", "c1", False, [], [("c1", "first", True)])]
    return spark.createDataFrame(rows, tables.CHAT)


def test_provider_messages(spark):
    claude = {r["seq"]: (r["role"], json.loads(r["content"])) for r in C.to_claude_messages(full(spark)).collect()}
    assert claude[0] == ("user", 'say "hi"\n')
    assert claude[1] == ("assistant", [{"type": "tool_use", "id": "c1", "name": "f", "input": {"a": 1}}, {"type": "tool_use", "id": "c2", "name": "g"}])
    assert claude[2] == ("user", [{"type": "tool_result", "id": "c1", "text": "own"}])
    api = C.to_openai_messages(full(spark))
    assert [(r["content"], r["tool_call_id"]) for r in api.orderBy("seq").collect()] == [('say "hi"\n', ""), ("", ""), ("first", "c1")]
    request = json.loads(C.build_chat_requests(api, "m", [{"name": "f", "description": "d", "parameters": '{"type": "object"}'}], stream=True, max_tokens=5, temperature=0).first()["request"])
    assert request["model"] == "m" and request["stream"] and request["max_tokens"] == 5 and "temperature" not in request and request["thinking"] == {}
    assert [m["role"] for m in request["messages"]] == ["user", "assistant", "tool"] and "name" not in request["messages"][0] and request["messages"][1]["tool_calls"][0]["function"]["arguments"] == '{"a": 1}'
    assert request["tools"] == [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object"}}}]


def test_transcript_and_round_trip(spark):
    text = C.format_transcript(full(spark)).first()["transcript"]
    assert text.count(C.RULE) == 7 and "#3" in text and "❌ 是" in text and "      bad" in text and "⏳" in text and text.endswith(C.RULE)
    back = tables.from_chat_json(tables.chat_json(full(spark)))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, full(spark).select(*back.columns).collect()))
    assert "name" not in json.loads(tables.chat_json(full(spark).withColumn("name", F.lit(""))).first()["value"])


def test_plans(spark):
    rows = [("1", "g", '{"goal":"x","tasks":[{"id":"a"}]}'), ("2", "g", "no plan"), ("3", "g", '{"tasks": [{"id": 1}'), ("4", "g", '{"tasks": broken} }'), ("5", "g", '{"tasks":[]}'), ("6", "g", None)]
    got = {r["plan_id"]: (r["status"], len(r["tasks"])) for r in P.parse_plans(spark.createDataFrame(rows, "plan_id string, goal string, raw string")).collect()}
    assert got["1"] == ("ok", 1) and got["2"] == ("empty", 0) and got["4"] == ("error", 0) and got["5"] == ("ok", 0) and got["6"][0] == "empty"
    status = P.plan_status(spark.createDataFrame([("p",)], "plan_id string"), spark.createDataFrame([], "plan_id string, ord int, id string, state string")).first()
    assert status["completed"] and status["first_failed"] is None


def test_waves_and_stuck(spark):
    tasks = [("p", "a", [], ["x"]), ("p", "b", ["x"], ["y"]), ("p", "c", ["x", "y"], ["z"]), ("p", "d", ["w"], ["v"]), ("p", "e", ["v"], []), ("p", "f", ["h"], ["g"]), ("p", "h", ["g"], ["h"])]
    frame = spark.createDataFrame(tasks, "plan_id string, id string, inputs array<string>, outputs array<string>")
    assert {(r["id"], r["level"]) for r in P.execution_levels(frame).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r["id"], r["reason"]) for r in P.stuck_tasks(frame).collect()} == {("d", "missing input"), ("e", "blocked"), ("f", "blocked"), ("h", "blocked")}
    audit = P.audit_plans(frame.withColumn("ord", F.lit(1))).first().asDict()
    assert audit == {"plan_id": "p", "n_tasks": 7, "ids_ok": False, "size_ok": True, "n_missing": 1, "n_blocked": 3}
    # null keys are given by nothing, null plans are one plan, plan_id keeps its type
    odd = spark.createDataFrame([(1, "a", None, [None]), (1, "b", [None, "q"], []), (None, "c", ["z"], None), (None, "d", [], ["z"]), (None, None, ["no"], [])], "plan_id long, id string, inputs array<string>, outputs array<string>")
    assert {tuple(r) for r in P.stuck_tasks(odd).collect()} == {(1, "b", "missing input"), (None, None, "missing input")}
    assert {tuple(r) for r in P.execution_levels(odd).collect()} == {(1, "a", 0), (None, "d", 0), (None, "c", 1)}
    assert P.stuck_tasks(odd.limit(0)).collect() == [] and P.audit_plans(odd.withColumn("ord", F.lit(1)).limit(0)).collect() == []


def test_replan_and_slots(spark):
    old = [("p", "g", [("a", "d", [], [], "failed", None, "boom"), ("b", "d", [], [], "success", None, "")], "a", raw) for raw in ("garbage", '{"tasks":[{"id":"a"},{"id":"n","state":"success"}]}')]
    plans = spark.createDataFrame(old, f"plan_id string, goal string, tasks array<{P.TASK}>, failed_id string, raw string")
    kept, new = ([(t["id"], t["state"], t["error"] or "") for t in r["tasks"]] for r in P.merge_replan(plans).collect())
    assert kept == [("a", "pending", ""), ("b", "success", "")] and new == [("a", "pending", ""), ("n", "success", "")]
    writes = spark.createDataFrame([("w", "k", "bad", 0, "err"), ("w", "k", "one", 1, None), ("w", "k", "two", 2, None)], "workflow_id string, slot string, value string, write_seq long, err string")
    assert P.resolve_slots(writes).first()["value"] == "one"
    routed = P.route_rows(spark.createDataFrame([(1,), (None,)], "v int"), F.col("v") > 0, "t", "f").collect()
    assert [r["route"] for r in routed] == ["t", "f"]


def test_bounded_files(spark, tmp_path):
    (tmp_path / "small.txt").write_text("abc")
    (tmp_path / "large.txt").write_text("x" * 50)
    got = {r["path"].rsplit("/", 1)[1]: (r["content"], r["error"]) for r in files.read_bounded_text(spark, str(tmp_path), 10).collect()}
    assert got == {"small.txt": ("abc", None), "large.txt": (None, "file too large")}
    assert {(r["name"], r["size"]) for r in files.file_inventory(spark, str(tmp_path)).collect()} == {("small.txt", "3"), ("large.txt", "50")}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = [chunk(content=str(i) + ",") for i in range(40)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        feed = lines(spark, *rng).orderBy(F.rand(3)).repartition(5)
        assert S.assemble_messages(S.parse_sse(feed)).first()["content"] == "".join(f"{i}," for i in range(40))
        m = msgs(spark, [("user", f"x{i}") for i in range(30)]).orderBy(F.rand(4)).repartition(6)
        assert [r["content"] for r in M.get_sessions(m).orderBy("pos").collect()] == [f"x{i}" for i in range(30)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_folded_calls_live_and_batch(spark, tmp_path):
    """Parts with bad indexes are counted, gaps are empty calls, the latest id and name win, and the live fold is the batch fold."""
    parts = [
        [{"index": 1, "id": "a", "type": "function", "function": {"name": "f", "arguments": "{"}}, {"index": -1, "id": "bad"}],
        [{"index": 2_000_000_000, "id": "bad"}, {"index": 1, "id": "b", "function": {"arguments": "}"}}],
    ]
    feed = lines(spark, chunk(role="assistant", reasoning_content="hm"), chunk(content="x", tool_calls=parts[0]), chunk(tool_calls=parts[1], reasoning_content="m"), "data:  [DONE] ", chunk(content="y"), "data: [DONE]", chunk(content="late"))
    chunks = S.parse_sse(feed)
    want = [("", "", ("", "")), ("b", "function", ("f", "{}"))]
    plain = lambda calls: [(c["id"], c["type"], tuple(c["function"])) for c in calls]
    out = S.assemble_messages(chunks).first()
    assert plain(out["tool_calls"]) == want and (out["role"], out["content"], out["reasoning_content"], out["n_chunks"]) == ("assistant", "xy", "hmm", 4)
    states = S.chunk_states(chunks).orderBy("seq").collect()
    assert [plain(r["tool_calls"])[1:] for r in states] == [[], [("a", "function", ("f", "{"))], want[1:], want[1:]] and [r["is_tool_call"] for r in states] == [False, True, True, True]
    assert [(r["idx"], r["args"]) for r in S.merge_tool_deltas(S.tool_parts(chunks)).orderBy("idx").collect()] == [(0, ""), (1, "{}")]
    assert out["refused"] == 2 and [tuple(r)[3:4] + (r["error"],) for r in S.refused_parts(S.tool_parts(chunks)).orderBy("seq").collect()] == [(-1, "negative index of a call"), (2_000_000_000, "more than 1024 calls")]
    tables.write_sse_lines(feed, f"file://{tmp_path}/feed")
    assemble.run_once(assemble.assemble_messages_streaming(tables.read_sse_lines(spark, f"file://{tmp_path}/feed", live=True)), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    live = spark.read.schema(assemble.OUT).parquet(f"file://{tmp_path}/out").first()
    assert plain(live["tool_calls"]) == want and [live[c] for c in out.asDict() if c != "tool_calls"] == [out[c] for c in out.asDict() if c != "tool_calls"] and live["complete"]


def test_event_text(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("s\t1\tdata: x\ty\nno number\ns\tq\tz\ns\t0\t\n")
    assert sorted(tuple(r)[:3] for r in tables.read_sse_lines(spark, str(tmp_path / "log")).collect()) == [("s", 0, ""), ("s", 1, "data: x\ty")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "r1").write_text(f"{chunk(content='a')}\r\n\n{chunk(content='b')}\ndata: [DONE]\n")
    (tmp_path / "one" / "r2").write_text(f"{chunk(content='c')}\n{chunk(content='d' * (2 << 20))}\n{chunk(content='e')}")
    out = S.assemble_messages(S.parse_sse(tables.read_sse_files(spark, str(tmp_path / "one"))))
    assert {r["stream_id"]: r["content"] for r in out.collect()} == {"r1": "ab", "r2": "c" + "d" * (2 << 20) + "e"}


def test_transcripts_of_nothing(spark):
    rows = spark.createDataFrame([("s", 0, None, None), ("s", 1, "user", "hi"), ("n", 0, None, None)], "session_id string, seq long, role string, content string")
    got = {r["session_id"]: r["transcript"] for r in C.format_transcript(rows, spark.createDataFrame([("s",), ("n",), ("e",)], "session_id string")).collect()}
    assert C.NUMBER + "2" in got["s"] and C.NUMBER + "1" not in got["s"] and got["n"] == C.RULE and got["e"] == C.NONE


def test_saved_metadata(spark):
    old = msgs(spark, [("user", "a")]).withColumn("metadata", F.lit("null"))
    call = F.array(F.struct(F.lit("i").alias("id")))
    new = msgs(spark, [("user", "b"), ("assistant", "c")]).withColumns({"write_seq": F.lit(1), "tool_calls": F.when(F.col("seq") == 1, call)})
    assert sorted((r["content"], r["metadata"]) for r in M.save_turns(old, new).collect()) == [("b", "null"), ("c", '[{"id":"i"}]')]


def test_bounded_replay(spark):
    m = msgs(spark, [("user" if i % 2 == 0 else "assistant", f"x{i}") for i in range(9)])
    whole, some = M.replay_prompts(m), M.replay_prompts(m, max_history=100)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, some.collect()))
    last = M.replay_prompts(m, max_history=3).filter("turn_seq = 8").orderBy("pos").collect()
    assert [r["content"] for r in last] == ["x5", "x6", "x7", "x8", "x8"]


def test_requested_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("abc")
    (tmp_path / "in" / "b.txt").write_text("x" * 50)
    (tmp_path / "out.txt").write_text("secret")
    asked = spark.createDataFrame([("a.txt",), ("./q/../a.txt",), ("b.txt",), ("../out.txt",), ("none",)], "path string")
    got = {r["path"]: (r["content"], r["error"]) for r in files.read_requested(spark, asked, f"file://{tmp_path}/in", 10).collect()}
    assert got == {"a.txt": ("abc", None), "./q/../a.txt": ("abc", None), "b.txt": (None, "file too large: 50 bytes (max 10 bytes)"), "../out.txt": (None, "path access denied: ../out.txt"), "none": (None, "file not found: none")}
