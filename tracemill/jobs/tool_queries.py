"""Queries of the tool and message operators, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.jobs.fixtures import ctes, frame
from tracemill.operators import messages as C
from tracemill.operators import tools as T
from tracemill.sources import tables


def _calls(spark, d):
    return frame(spark, d, "tool_calls")


def _registry(spark):
    return spark.createDataFrame([("click",), ("view",), ("purchase",)], "name string")


def t1_explode_tool_calls(spark, d):
    call = F.struct("call_id", "name")
    grouped = _calls(spark, d).groupBy("session_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", call.alias("c")))), lambda x: x["c"]).alias("tool_calls"))
    return T.explode_tool_calls(grouped).select("session_id", F.col("ord").cast("long").alias("ord"), "call.call_id", "call.name")


def t3_resolve_calls(spark, d):
    return T.resolve_calls(_calls(spark, d), _registry(spark)).select("session_id", "call_id", "found", "content", "is_error")


def t4_parse_arguments(spark, d):
    """Every seventh call has a key twice."""
    twice = F.concat(F.lit('{"n": 1, "s": "a", "n": '), "seq", F.lit("}"))
    calls = _calls(spark, d).withColumn("arguments", F.when(F.col("seq") % 7 == 4, twice).otherwise(F.col("arguments")))
    return T.parse_arguments(calls).select("session_id", "call_id", "ok", F.to_json("args").alias("args"), F.try_variant_get("args", "$.n", "long").alias("n"))


def t5_execute_calls(spark, d):
    handlers = {"click": F.concat(F.lit('{"got": '), "arguments", F.lit("}")), "view": F.lit('"seen"'), "purchase": lambda args: {"n": len(args or {})}}
    return T.execute_calls(_calls(spark, d), _registry(spark), handlers)


def t6_screen_commands(spark, d):
    return T.screen_commands(frame(spark, d, "commands")).select("call_id", "command", F.coalesce("rule", F.lit(0)).alias("rule"), "blocked", "error")


def t7_confine_paths(spark, d):
    return T.confine_paths(frame(spark, d, "paths"), "/w")


def t8_check_arguments(spark, d):
    body = F.to_json(F.struct("command", F.when(F.col("timeout") > -15, F.col("timeout")).alias("timeout"), F.when(F.col("command") == "ls", "/tmp").otherwise("").alias("cwd")))
    number = F.concat(F.lit('{"command": 5, "timeout": "9", "cwd": '), F.col("timeout").cast("string"), F.lit("}"))
    twice = '{"command": "x", "command": "a && b"}'
    arguments = F.when(F.col("command") == "a; b", number).when(F.col("command") == "a && b", twice).when(F.col("command") == "a || b", F.concat(body, F.lit(" x"))).otherwise(body)
    calls = frame(spark, d, "commands").select("call_id", arguments.alias("arguments"))
    return T.check_arguments(calls).select("call_id", "command", "timeout_s", "cwd", "error")


def t8_check_file_arguments(spark, d):
    """Paths and contents of every type, for a read, a write and a list call each."""
    k = F.col("page_id") % 6
    body = (
        F.when(k == 0, F.to_json(F.struct("path", F.lit("text").alias("content"))))
        .when(k == 1, F.to_json(F.struct("path", F.lit("").alias("content"))))
        .when(k == 2, '{"path": "", "content": "x"}')
        .when(k == 3, F.concat(F.lit('{"path": 7, "content": '), F.to_json(F.struct("path")), F.lit("}")))
        .when(k == 4, F.concat(F.regexp_replace(F.to_json(F.struct("path")), "[}]$", ""), F.lit(', "content": 5}')))
        .otherwise("not json")
    )
    calls = frame(spark, d, "paths").select("page_id", body.alias("arguments"))
    read, write, listed = T.check_file_arguments(calls), T.check_file_arguments(calls, content=True), T.check_file_arguments(calls, default=".")
    none = F.lit(None).cast("string").alias("content")
    return (
        read.select("page_id", F.lit("read").alias("tool"), "path", none, "error")
        .union(write.select("page_id", F.lit("write"), "path", "content", "error"))
        .union(listed.select("page_id", F.lit("list"), "path", none, "error"))
    )


def t9_join_calls_results(spark, d):
    return T.join_calls_results(_calls(spark, d), frame(spark, d, "tool_results"))


def t10_reconstruct_turns(spark, d):
    n = F.when((F.col("role") == "assistant") & (F.col("seq") % 3 == 1), F.col("seq")).otherwise(0).cast("long")
    return T.reconstruct_turns(frame(spark, d, "messages").withColumn("n_calls", n))


def _one_call(id_):
    return F.struct(id_.alias("id"), F.lit("function").alias("type"), F.struct(F.lit("f").alias("name"), F.lit('{"a":1}').alias("arguments")).alias("function"))


def _call_columns(call):
    return call["id"].alias("call_id"), call["type"].alias("call_type"), call["function"]["name"].alias("call_name"), call["function"]["arguments"].alias("arguments")


def _full(spark, d):
    """Messages with roles, names, calls and results of every kind."""
    role = F.when(F.col("seq") % 4 == 3, "tool").otherwise(F.col("role"))
    call = F.array(_one_call(F.concat(F.lit("c"), "seq")))
    result = F.array(F.struct(F.lit("c").alias("call_id"), F.lit("first").alias("content"), F.lit(False).alias("is_error")))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    m = frame(spark, d, "messages").withColumn("role", role)
    return m.withColumns({"name": F.concat(F.lit("n"), "seq"), "tool_calls": F.when(F.col("seq") % 2 == 1, call.cast(f"array<{tables.CALL}>")).otherwise(none(tables.CALL)), "tool_results": F.when(F.col("seq") % 8 == 3, result).otherwise(none(tables.RESULT))})


def c1_to_openai_messages(spark, d):
    return C.to_openai_messages(_full(spark, d)).select("session_id", "seq", "role", "content", "reasoning_content", "tool_call_id", F.coalesce(F.size("tool_calls"), F.lit(-1)).cast("long").alias("n_calls"))


def c3_build_chat_requests(spark, d):
    tools = [{"name": "f", "description": "does f", "parameters": '{"type":"object"}'}]
    return C.build_chat_requests(C.to_openai_messages(_full(spark, d)), "some-model", tools, max_tokens=512, temperature=0.0)


def _said(spark, d):
    return frame(spark, d, "messages").filter("role = 'assistant'")


def _spoiled(body, path):
    """Bodies of a third of the sessions as a strict reader doesn't take them; ``path`` is a text field of a body."""
    k = F.col("session_id").cast("long") % 12
    return F.when(k == 0, F.concat(body, F.lit(" junk"))).when(k == 1, F.concat(body, body)).when(k == 2, path.replace("?", "7")).when(k == 3, path.replace("?", "NaN")).otherwise(body)


def c4_parse_chat_responses(spark, d):
    calls = F.when(F.col("seq") % 3 == 1, F.array(_one_call(F.concat(F.lit("t"), "seq"))))
    message = F.struct("role", "content", F.when(F.col("seq") % 2 == 1, F.col("reasoning_content")).alias("reasoning_content"), calls.alias("tool_calls"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), F.lit("stop").alias("finish_reason"))
    choices = F.when(F.col("seq") % 5 == 1, F.array(choice)).otherwise(F.filter(F.array(choice), lambda x: F.lit(False)))
    usage = F.struct(F.lit(1).alias("prompt_tokens"), F.length("content").alias("completion"), (F.length("content") + 1).alias("total_tokens"))
    body = F.to_json(F.struct("id", F.lit("m").alias("model"), F.col("ts").alias("created"), choices.alias("choices"), usage.alias("usage")))
    body = _spoiled(body, '{"id":"x","choices":[{"message":{"role":"assistant","content":?}}]}')
    out = C.parse_chat_responses(_said(spark, d).select(body.alias("body")))
    first = F.get("tool_calls", F.lit(0))
    return out.select("id", "model", "created", "role", "content", "reasoning_content", *_call_columns(first), "finish_reason", "prompt_tokens", "completion", "total_tokens", "error")


def c5_to_claude_messages(spark, d):
    return C.to_claude_messages(_full(spark, d)).select("session_id", "seq", "role", "content")


def c6_from_claude_responses(spark, d):
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    half = F.floor(F.length("content") / 2).cast("int")
    one, two = F.to_json(text(F.substr("content", F.lit(1), half))), F.to_json(text(F.substr("content", half + 1)))
    use = F.concat(F.lit('{"type":"tool_use","id":"t'), "seq", F.lit('","name":"f","input":{"n":'), "seq", F.lit("}}"))
    body = F.concat(F.lit('{"content":['), one, F.lit(',{"type":"other"},'), use, F.lit(","), two, F.lit("]}"))
    body = _spoiled(body, '{"content":[{"type":"text","text":?}]}')
    out = C.from_claude_responses(_said(spark, d).select("id", body.alias("body")))
    return out.select("id", "role", "content", *_call_columns(F.get("tool_calls", F.lit(0))), F.size("tool_calls").cast("long").alias("n_calls"), "error")


def c7_from_gemini_responses(spark, d):
    part = F.to_json(F.struct(F.col("content").alias("text")))
    call = F.concat(F.lit('{"functionCall":{"name":"f","args":{"n":'), "seq", F.lit("}}}"))
    full = F.concat(F.lit('{"candidates":[{"content":{"role":"model","parts":['), call, F.lit(","), part, F.lit(","), call, F.lit("]}}]}"))
    body = _spoiled(F.when(F.col("seq") % 5 == 1, full).otherwise('{"candidates":[]}'), '{"candidates":[{"content":{"parts":[{"text":?}]}}]}')
    out = C.from_gemini_responses(_said(spark, d).select("id", body.alias("body")))
    return out.select("id", "role", "content", *_call_columns(F.get("tool_calls", F.lit(1))), "error")


def c8_tool_results_to_messages(spark, d):
    out = C.tool_results_to_messages(frame(spark, d, "tool_results"))
    return out.select("session_id", "role", "name", "content", F.col("tool_results")[0]["is_error"].alias("is_error"))


def c10_format_transcript(spark, d):
    """Every optional part; a null message in front of some sessions, and sessions without messages."""
    n = F.length("content")
    usage = F.when(F.col("seq") % 3 == 1, F.struct(F.lit(2).alias("prompt_tokens"), n.alias("completion"), (n + 2).alias("total_tokens")))
    name = F.when(F.col("seq") % 2 == 0, F.col("name")).otherwise("")
    full = _full(spark, d).select("session_id", "seq", "role", "content", "reasoning_content", name.alias("name"), (F.col("seq") % 5 == 4).alias("partial"), "tool_calls", "tool_results", usage.alias("usage"))
    nulls = full.filter("seq = 0 and cast(session_id as bigint) % 7 = 0").select("session_id", F.lit(-1).cast("long").alias("seq"), *[F.lit(None).cast(full.schema[c].dataType).alias(c) for c in full.columns[2:]])
    empty = full.filter("seq = 0").select(F.concat(F.lit("empty_"), "session_id").alias("session_id"))
    return C.format_transcript(full.union(nulls), full.select("session_id").union(empty))


_ALL = (t1_explode_tool_calls, t3_resolve_calls, t4_parse_arguments, t5_execute_calls, t6_screen_commands, t7_confine_paths, t8_check_arguments, t8_check_file_arguments, t9_join_calls_results, t10_reconstruct_turns, c1_to_openai_messages, c3_build_chat_requests, c4_parse_chat_responses, c5_to_claude_messages, c6_from_claude_responses, c7_from_gemini_responses, c8_tool_results_to_messages, c10_format_transcript)
QUERIES = {f.__name__: f for f in _ALL}

_READ = "(cast(session_id as bigint) % 12 > 3)"
_KNOWN = "name in ('click', 'view', 'purchase')"
_OK = "coalesce(json_valid(arguments) and json_type(case when json_valid(arguments) then arguments else 'null' end) in ('OBJECT', 'NULL'), false)"
_NOT_FOUND = """concat('{"error": "tool ', name, ' not found"}')"""
_FULL = f"""{ctes("messages")}, full_ as (select session_id, seq, case when seq % 4 = 3 then 'tool' else role end "role", content, reasoning_content, concat('n', seq) "name",
  case when seq % 2 = 1 then 1 else 0 end n, seq % 8 = 3 has_result from messages)"""
_INDENT = "concat('  ', replace({}, chr(10), concat(chr(10), '  ')))"
ORACLE_SQL = {
    "t1_explode_tool_calls": f"with {ctes('tool_calls')} select session_id, row_number() over (partition by session_id order by seq) - 1 ord, call_id, name from tool_calls",
    "t3_resolve_calls": f"with {ctes('tool_calls')} select session_id, call_id, {_KNOWN} found, case when not {_KNOWN} then {_NOT_FOUND} end \"content\", not {_KNOWN} is_error from tool_calls",
    "t4_parse_arguments": f"""with {ctes('tool_calls')}, c as (select *, {_OK} ok, seq % 7 = 4 twice from tool_calls)
      select session_id, call_id, ok or twice ok, case when twice then concat('{{"n":', seq, ',"s":"a"}}') when ok and arguments <> 'null' then cast(json(arguments) as varchar) end args,
        case when twice then seq end n from c""",
    "t5_execute_calls": f"""with {ctes("tool_calls")}, c as (select *, {_KNOWN} found, {_OK} ok from tool_calls)
      select session_id, seq, call_id, case when not found then {_NOT_FOUND} when not ok then '{T.BAD_ARGUMENTS}'
        when name = 'click' then concat('{{"got": ', arguments, '}}') when name = 'view' then '"seen"'
        else concat('{{"n": ', case when arguments = 'null' then 0 else len(json_keys(arguments)) end, '}}') end "content", not (found and ok) is_error from c""",
    "t6_screen_commands": f"""with {ctes("commands")}, r as (select call_id, command, case
        when regexp_matches(command, '^rm\\s+-rf', 'i') then 1 when regexp_matches(command, 'mkfs\\s+', 'i') then 2
        when regexp_matches(command, 'dd\\s+if=/dev/zero', 'i') then 3 when regexp_matches(command, '^rd\\s+/s', 'i') then 4
        when regexp_matches(command, '^del\\s+/s', 'i') then 5 when contains(command, ';') then 6 when contains(command, '&&') then 7 when contains(command, '||') then 8 end "rule" from commands)
      select call_id, command, cast(coalesce("rule", 0) as int) "rule", "rule" is not null blocked, case when command = '' then 'command must be a non-empty string'
        when "rule" is not null then concat('dangerous command blocked: ', command) end "error" from r""",
    "t7_confine_paths": f"""with {ctes("paths")} select page_id, path, case page_id % 5 when 0 then concat(page_id % 4, '/b') when 1 then '../x' when 2 then concat(page_id % 4, '/c')
        when 3 then '..y' else concat(page_id % 4, '/d/e') end "relative", page_id % 5 in (1, 3) denied from paths""",
    "t8_check_arguments": f"""with {ctes("commands")} select call_id, case when command in ('a; b', 'a || b') then null else command end command,
        cast(floor(case when command not in ('a; b', 'a && b', 'a || b') and timeout > 0 then timeout else 30 end) as bigint) timeout_s,
        case when command = 'ls' then '/tmp' end cwd, case when command in ('a; b', '') then 'command must be a non-empty string' when command = 'a || b' then '{T.NOT_AN_OBJECT}' end "error" from commands""",
    "t8_check_file_arguments": f"""with {ctes("paths")}, k as (select page_id, page_id % 6 k, path, tool from paths cross join (values ('read'), ('write'), ('list')) t(tool)),
        c as (select *, case when k in (0, 1, 4) then path when tool = 'list' and k <> 5 then '.' end got, case when tool = 'write' then case k when 0 then 'text' when 1 then '' when 2 then 'x' end end body from k)
      select page_id, tool, got path, body "content", case when k = 5 then '{T.NOT_AN_OBJECT}' when got is null then 'path must be a non-empty string' when tool = 'write' and body is null then 'content must be a string' end "error" from c""",
    "t9_join_calls_results": f"""with {ctes("tool_calls", "tool_results")} select coalesce(c.session_id, r.session_id) session_id, coalesce(c.call_id, r.call_id) call_id, c.name, r.content, r.is_error,
        case when r.call_id is null then 'unanswered' when c.call_id is null then 'orphan' else 'answered' end status
      from tool_calls c full join tool_results r on c.session_id = r.session_id and c.call_id = r.call_id""",
    "t10_reconstruct_turns": f"""with {ctes("messages")}, m as (select *, case when role = 'assistant' and seq % 3 = 1 then seq else 0 end n,
        sum(case when role = 'user' then 1 else 0 end) over (partition by session_id order by seq) turn from messages)
      select session_id, cast(turn as bigint) turn_id, min(seq) first_seq, count(*) filter (role = 'assistant' and n > 0) rounds,
        cast(coalesce(sum(n) filter (role = 'assistant'), 0) as bigint) calls, arg_min(content, seq) filter (role = 'assistant' and n = 0) final
      from m where turn > 0 group by session_id, turn""",
    "c1_to_openai_messages": f"""with {_FULL} select session_id, seq, "role", case when "role" = 'tool' and has_result then 'first' else content end "content", reasoning_content,
        case when "role" = 'tool' then "name" else '' end tool_call_id, cast(case when "role" = 'assistant' and n > 0 then n else -1 end as bigint) n_calls from full_""",
    "c4_parse_chat_responses": f"""with {ctes("messages")} select id, 'm' model, ts created, case when ok then 'assistant' end "role", case when ok then content end "content",
        case when ok and seq % 2 = 1 then reasoning_content end reasoning_content, case when ok and seq % 3 = 1 then concat('t', seq) end call_id, case when ok and seq % 3 = 1 then 'function' end call_type,
        case when ok and seq % 3 = 1 then 'f' end call_name, case when ok and seq % 3 = 1 then '{{"a":1}}' end arguments, case when ok then 'stop' end finish_reason, cast(1 as bigint) prompt_tokens, cast(length(content) as bigint) completion, cast(length(content) + 1 as bigint) total_tokens,
        case when not ok then 'empty choices' end "error" from (select *, seq % 5 = 1 ok from messages where role = 'assistant' and {_READ})
      union all select null, null, null, null, null, null, null, null, null, null, null, null, null, null, 'bad JSON' from messages where role = 'assistant' and not {_READ}""",
    "c6_from_claude_responses": f"""with {ctes("messages")} select id, 'assistant' "role", content, concat('t', seq) call_id, 'function' call_type, 'f' call_name, concat('{{"n":', seq, '}}') arguments, cast(1 as bigint) n_calls,
        cast(null as varchar) "error" from messages where role = 'assistant' and {_READ}
      union all select id, 'assistant', null, null, null, null, null, null, 'bad JSON' from messages where role = 'assistant' and not {_READ}""",
    "c7_from_gemini_responses": f"""with {ctes("messages")} select id, case when ok then 'assistant' end "role", case when ok then content end "content", case when ok then 'gemini-f-1' end call_id, case when ok then 'function' end call_type, case when ok then 'f' end call_name,
        case when ok then concat('{{"n":', seq, '}}') end arguments, case when not {_READ} then 'bad JSON' end "error" from (select *, seq % 5 = 1 and {_READ} ok from messages where role = 'assistant')""",
    "c8_tool_results_to_messages": f"with {ctes('tool_calls', 'tool_results')} select session_id, 'tool' \"role\", call_id \"name\", content, is_error from tool_results",
    "c3_build_chat_requests": f"""with {_FULL}, m as (select session_id, seq, concat('{{"role":', to_json("role"), ',"content":', to_json(case when "role" = 'tool' and has_result then 'first' else content end),
        case when reasoning_content <> '' then concat(',"reasoning_content":', to_json(reasoning_content)) else '' end,
        case when "role" = 'assistant' and n > 0 then concat(',"tool_calls":[{{"id":"c', seq, '","type":"function","function":{{"name":"f","arguments":"{{\\"a\\":1}}"}}}}]') else '' end,
        case when "role" = 'tool' then concat(',"tool_call_id":"', "name", '"') else '' end, '}}') m from full_)
      select session_id, concat('{{"model":"some-model","messages":[', string_agg(m, ',' order by seq),
        '],"max_tokens":512,"tools":[{{"type":"function","function":{{"name":"f","description":"does f","parameters":{{"type":"object"}}}}}}],"thinking":{{}}}}') request from m group by session_id""",
    "c5_to_claude_messages": f"""with {_FULL} select session_id, seq, case when "role" = 'tool' then 'user' else "role" end "role",
        case when "role" = 'tool' then concat('[{{"type":"tool_result"', case when content <> '' then concat(',"text":', to_json(content)) else '' end, ',"id":"', "name", '"}}]')
          when n > 0 then concat('[', case when content <> '' then concat('{{"type":"text","text":', to_json(content), '}},') else '' end, '{{"type":"tool_use","id":"c', seq, '","name":"f","input":{{"a":1}}}}]')
          else cast(to_json(content) as varchar) end "content" from full_""",
    "c10_format_transcript": f"""with {_FULL}, b as (select session_id, seq, row_number() over (partition by session_id order by seq) + case when cast(session_id as bigint) % 7 = 0 then 1 else 0 end i,
        concat('{C.ROLE}', role, case when seq % 2 = 0 then concat('{C.NAME}', "name") else '' end, case when seq % 5 = 4 then '{C.PARTIAL}' else '' end, chr(10), '{C.CONTENT}', chr(10),
          {_INDENT.format("case when content = '' then '(空)' else content end")}, chr(10),
          case when reasoning_content <> '' then concat('{C.REASONING}', chr(10), {_INDENT.format("reasoning_content")}, chr(10)) else '' end,
          case when n > 0 then concat('{C.CALLS}', chr(10), '  #1', chr(10), '    {C.CALL_ID}c', seq, chr(10), '    {C.CALL_TYPE}function', chr(10), '    {C.CALL_NAME}f', chr(10), '    {C.CALL_ARGUMENTS}', chr(10), '      {{"a":1}}', chr(10)) else '' end,
          case when has_result then concat('{C.RESULTS}', chr(10), '  #1', chr(10), '    {C.RESULT_ID}c', chr(10), '    {C.RESULT_ERROR}{C.NO}', chr(10), '    {C.RESULT_CONTENT}', chr(10), '      first', chr(10)) else '' end,
          case when seq % 3 = 1 then concat('{C.TOKENS[0]}2{C.TOKENS[1]}', length(content), '{C.TOKENS[2]}', length(content) + 2, chr(10)) else '' end, chr(10)) b from full_)
      select session_id, concat(string_agg(concat('{C.RULE}', chr(10), '{C.NUMBER}', i, chr(10), '{C.RULE}', chr(10), b), '' order by seq), '{C.RULE}') transcript from b group by session_id
      union all select concat('empty_', session_id), '{C.NONE}' from full_ where seq = 0""",
}
