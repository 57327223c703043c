"""Messages to and from the formats of providers, and transcripts. Projections; only requests and transcripts group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import indent, json_object, strict_json
from tracemill.operators.streams import USAGE
from tracemill.sources.tables import CALL

# fixed values: the lines and labels of a transcript
RULE = "────────────────────────────────────────────────────────────────"
NONE, EMPTY = "📭 无消息", "(空)"
NUMBER, ROLE, NAME, PARTIAL = "📨 消息 #", "🎭 角色: ", " | 🏷️ 名称: ", " | ⏳ [未完成]"
CONTENT, REASONING = "📝 内容:", "💭 思考内容:"
CALLS, CALL_ID, CALL_TYPE, CALL_NAME, CALL_ARGUMENTS = "🔧 工具调用:", "🆔 ID: ", "📌 类型: ", "📦 函数: ", "📋 参数:"
RESULTS, RESULT_ID, RESULT_ERROR, YES, NO, RESULT_CONTENT = "📊 工具结果:", "🔗 调用ID: ", "⚠️ 错误: ", "❌ 是", "✅ 否", "📄 内容:"
TOKENS = ("💰 Token 使用: 提示=", ", 完成=", ", 总计=")

# binary stands for any JSON as it is written
CHAT_RESPONSE = f"struct<id:string,model:string,created:long,choices:array<struct<index:int,message:struct<role:string,content:string,reasoning_content:string,tool_calls:array<{CALL}>>,finish_reason:string>>,usage:{USAGE}>"
CLAUDE_RESPONSE = "struct<content:array<struct<type:string,text:string,id:string,name:string,input:binary>>>"
GEMINI_RESPONSE = "struct<candidates:array<struct<content:struct<role:string,parts:array<struct<text:string,functionCall:struct<name:string,args:binary>>>>>>>"
BAD_JSON = "bad JSON"


def _read(responses: DataFrame, kind: str) -> DataFrame:
    """responses with ``r``, the body read by strict rules, and ``__bad`` where it isn't what it should be."""
    read = F.explode(F.array(strict_json(F.col("body"), kind)))  # a generator, so that the body is read once
    return responses.select("*", read.alias("__read")).select(*responses.columns, F.col("__read.value").alias("r"), (~F.col("__read.ok")).alias("__bad"))


def _blank(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _call(id_: Column, name: Column, arguments: Column) -> Column:
    return F.struct(id_.alias("id"), F.lit("function").alias("type"), F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))


def to_openai_messages(messages: DataFrame) -> DataFrame:
    """messages (.., role, content, reasoning_content, name, tool_calls, tool_results) with those columns replaced by role,
    content, reasoning_content, tool_calls (assistant only) and tool_call_id (tool only: its name). A tool message's
    content is its first result's, if it has any; name is never kept."""
    tool = F.col("role") == "tool"
    content = F.when(tool & (F.size("tool_results") > 0), F.get("tool_results", F.lit(0))["content"]).otherwise(F.col("content"))
    calls = F.when((F.col("role") == "assistant") & (F.size("tool_calls") > 0), F.col("tool_calls"))
    keys = [c for c in messages.columns if c not in ("role", "content", "reasoning_content", "name", "tool_calls", "tool_results")]
    return messages.select(*keys, "role", content.alias("content"), "reasoning_content", calls.alias("tool_calls"), F.when(tool, F.col("name")).otherwise("").alias("tool_call_id"))


def build_chat_requests(api: DataFrame, model: str, tools: list[dict] | None = None, stream: bool = False, thinking: str = "", **options: float) -> DataFrame:
    """(session_id, request): one request as JSON text for each session of ``to_openai_messages`` rows with seq. Options
    that are zero or empty are left out; ``thinking`` is always there."""
    message = F.struct("role", "content", _blank("reasoning_content").alias("reasoning_content"), "tool_calls", _blank("tool_call_id").alias("tool_call_id"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("seq", message.alias("m")))), lambda r: r["m"])
    fields = [F.lit(model).alias("model"), F.col("messages"), *[F.lit(v).alias(k) for k, v in options.items() if v]]
    if tools:
        wrapped = [F.struct(F.lit("function").alias("type"), F.struct(*[F.lit(t.get(k, "")).alias(k) for k in ("name", "description")], F.parse_json(F.lit(t.get("parameters", "{}"))).alias("parameters")).alias("function")) for t in tools]
        fields.append(F.array(*wrapped).alias("tools"))
    fields += [F.struct(_blank(F.lit(thinking)).alias("type")).alias("thinking")] + ([F.lit(True).alias("stream")] if stream else [])
    return api.groupBy("session_id").agg(rows.alias("messages")).select("session_id", F.to_json(F.struct(*fields)).alias("request"))


def parse_chat_responses(responses: DataFrame) -> DataFrame:
    """responses (.., body) -> id, model, created, role, content, reasoning_content, tool_calls, finish_reason, usage
    columns and ``error``; the message is the first choice's, whole. A body is one JSON value of the right types and nothing
    else, or bad JSON."""
    r = _read(responses, CHAT_RESPONSE)
    first = F.get("r.choices", F.lit(0))
    error = F.when(F.col("__bad"), BAD_JSON).when(F.coalesce(F.size("r.choices"), F.lit(0)) < 1, "empty choices")
    keys = [c for c in responses.columns if c != "body"]
    return r.select(*keys, error.alias("error"), "r.id", "r.model", "r.created", first["message"]["role"].alias("role"), *[first["message"][c].alias(c) for c in ("content", "reasoning_content", "tool_calls")], first["finish_reason"].alias("finish_reason"), "r.usage.prompt_tokens", "r.usage.completion", "r.usage.total_tokens")


def to_claude_messages(messages: DataFrame) -> DataFrame:
    """messages -> role and content as JSON text: a string, or blocks for tool results and for messages with calls. A call's
    input is the JSON object of its arguments (see ``json_object``), left out where they aren't one."""
    block = "struct<type:string,text:string,id:string,name:string,input:variant>"
    text_of = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    result = F.to_json(F.array(F.struct(F.lit("tool_result").alias("type"), _blank("content").alias("text"), _blank("name").alias("id"))))
    said = F.when(F.coalesce(F.col("content"), F.lit("")) != "", F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), *(F.lit(None).cast("string").alias(x) for x in ("id", "name")), F.lit(None).cast("variant").alias("input")).cast(block))).otherwise(F.array().cast(f"array<{block}>"))
    calls = F.transform("tool_calls", lambda c: F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), _blank(c["id"]).alias("id"), _blank(c["function"]["name"]).alias("name"), json_object(c["function"]["arguments"]).alias("input")).cast(block))
    content = F.when(F.col("role") == "tool", result).when(F.size("tool_calls") > 0, F.to_json(F.concat(said, calls))).otherwise(text_of(F.coalesce("content", F.lit(""))))
    keys = [c for c in messages.columns if c not in ("role", "content", "reasoning_content", "name", "tool_calls", "tool_results")]
    return messages.select(*keys, F.when(F.col("role") == "tool", "user").otherwise(F.col("role")).alias("role"), content.alias("content"))


def from_claude_responses(responses: DataFrame) -> DataFrame:
    """responses (.., body) -> role, content (text blocks joined), tool_calls (arguments as written) and ``error``. A body is
    one JSON value of the right types and nothing else, or bad JSON, which has no content and no calls."""
    r = _read(responses, CLAUDE_RESPONSE)
    content = F.array_join(F.transform(F.filter("r.content", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")
    calls = F.transform(F.filter("r.content", lambda b: b["type"] == "tool_use"), lambda b: _call(b["id"], b["name"], b["input"]))
    error = F.when(F.col("__bad"), BAD_JSON)
    keys = [c for c in responses.columns if c != "body"]
    return r.select(*keys, F.lit("assistant").alias("role"), content.alias("content"), calls.alias("tool_calls"), error.alias("error"))


def from_gemini_responses(responses: DataFrame) -> DataFrame:
    """responses (.., body) -> role, content, tool_calls of the first candidate, and ``error``; nulls without one. A call's id
    is its name and its number among the calls. A body is one JSON value of the right types and nothing else, or bad JSON."""
    r = _read(responses, GEMINI_RESPONSE).withColumn("p", F.get("r.candidates", F.lit(0))["content"]["parts"])
    content = F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "")
    calls = F.transform(F.filter("p", lambda x: x["functionCall"].isNotNull()), lambda x, i: _call(F.concat(F.lit("gemini-"), x["functionCall"]["name"], F.lit("-"), i.cast("string")), x["functionCall"]["name"], x["functionCall"]["args"]))
    some = F.coalesce(F.size("r.candidates"), F.lit(0)) > 0
    keys = [c for c in responses.columns if c != "body"]
    return r.select(*keys, F.when(some, "assistant").alias("role"), F.when(some, content).alias("content"), F.when(some, calls).alias("tool_calls"), F.when(F.col("__bad"), BAD_JSON).alias("error"))


def tool_results_to_messages(results: DataFrame) -> DataFrame:
    """results (.., call_id, content, is_error) -> a tool message each: role, name, content, tool_results."""
    keys = [c for c in results.columns if c not in ("call_id", "content", "is_error")]
    return results.select(*keys, F.lit("tool").alias("role"), F.col("call_id").alias("name"), "content", F.array(F.struct("call_id", "content", "is_error")).alias("tool_results"))


def format_transcript(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, transcript) of messages (session_id, seq, role, content, ...); optional columns: reasoning_content,
    name, partial, tool_calls, tool_results, usage. Messages are numbered from 1 by seq. A row without role and content is
    a null message: it has a number but no text. With ``sessions``, those without messages get the line for that."""
    has = set(messages.columns)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    or_empty = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit(EMPTY)).otherwise(c)
    number = lambda j: text("  #", (j + 1).cast("string"), "\n    ")

    def call(c: Column, j: Column) -> Column:
        f = c["function"]
        return text(number(j), CALL_ID, c["id"], "\n    " + CALL_TYPE, c["type"], "\n    " + CALL_NAME, f["name"], f"\n    {CALL_ARGUMENTS}\n", indent(or_empty(f["arguments"]), "      "), "\n")

    def result(r: Column, j: Column) -> Column:
        return text(number(j), RESULT_ID, r["call_id"], "\n    " + RESULT_ERROR, F.when(r["is_error"], YES).otherwise(NO), f"\n    {RESULT_CONTENT}\n", indent(or_empty(r["content"]), "      "), "\n")

    listed = lambda c, title, one: F.when(F.size(c) > 0, text(title + "\n", F.array_join(F.transform(c, one), "")))
    u = F.col("usage")
    optional = {
        "name": F.when(F.col("name") != "", text(NAME, F.col("name"))),
        "partial": F.when(F.col("partial"), PARTIAL),
        "content": text(f"\n{CONTENT}\n", indent(or_empty(F.col("content")), "  "), "\n"),
        "reasoning_content": F.when(F.col("reasoning_content") != "", text(REASONING + "\n", indent(F.col("reasoning_content"), "  "), "\n")),
        "tool_calls": listed("tool_calls", CALLS, call),
        "tool_results": listed("tool_results", RESULTS, result),
        "usage": F.when(u.isNotNull(), text(TOKENS[0], u["prompt_tokens"].cast("string"), TOKENS[1], u["completion"].cast("string"), TOKENS[2], u["total_tokens"].cast("string"), "\n")),
    }
    body = text(ROLE, F.coalesce("role", F.lit("")), *[F.coalesce(c, F.lit("")) for k, c in optional.items() if k in has], "\n")
    some = F.when(F.col("role").isNotNull() | F.col("content").isNotNull(), body)
    rows = F.sort_array(F.collect_list(F.struct("seq", some.alias("b"))))
    numbered = F.filter(F.transform(rows, lambda r, i: F.concat(F.lit(f"{RULE}\n{NUMBER}"), (i + 1).cast("string"), F.lit(f"\n{RULE}\n"), r["b"])), lambda x: x.isNotNull())
    told = messages.groupBy("session_id").agg(F.concat(F.array_join(numbered, ""), F.lit(RULE)).alias("transcript"))
    if sessions is None:
        return told
    return sessions.select("session_id").distinct().join(told, "session_id", "left").select("session_id", F.coalesce("transcript", F.lit(NONE)).alias("transcript"))
