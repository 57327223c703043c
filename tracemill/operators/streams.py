"""Logs of streamed responses: event lines to chunks, chunks to messages.

Rows carry (stream_id, seq); nothing relies on the order of lines in a file. All steps group by stream_id, so the rows of
a stream shuffle once. ``assemble_messages`` folds with partial, order-aware aggregates; ``chunk_states`` folds sorted rows
as they pass.

A chunk is read as strictly as the type it stands for asks: a line is one JSON object and nothing else, texts are strings or
null, counts are whole numbers of 0 or more; any other line is skipped whole.

The index of a part of a tool call comes from a model and says how many calls there are: a stream has at most ``max_calls``.
Parts with a lower or higher index aren't merged; every fold counts them in ``refused``, and ``refused_parts`` lists them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import ordered_text, strict_json
from tracemill.sources.tables import CALL

PREFIX = "data: "
DONE = "[DONE]"
MAX_CALLS = 1024
SPAN = 4096
PARTS = "array<struct<index:int,id:string,type:string,function:struct<name:string,arguments:string>>>"
USAGE = "struct<prompt_tokens:decimal(20,0),completion:decimal(20,0),total_tokens:decimal(20,0)>"
CHUNK = f"struct<choices:array<struct<index:int,delta:struct<role:string,content:string,reasoning_content:string,tool_calls:{PARTS}>,finish_reason:string,usage:{USAGE}>>>"


def data_lines(lines: DataFrame, *kept: str) -> DataFrame:
    """(stream_id, seq, data, and columns to keep): the lines that start with the prefix, without it and without a trailing \\r."""
    line = F.regexp_replace("line", "\r$", "")
    return lines.filter(F.col("line").startswith(PREFIX)).select("stream_id", "seq", F.substr(line, F.lit(len(PREFIX) + 1)).alias("data"), *kept)


def cut_done(data: DataFrame) -> DataFrame:
    """Without [DONE] (that text alone) and what follows it in its stream."""
    end = F.min(F.when(F.col("data") == DONE, F.col("seq"))).over(Window.partitionBy("stream_id"))
    return data.withColumn("__end", end).filter(F.col("__end").isNull() | (F.col("seq") < F.col("__end"))).drop("__end")


def _choice(data: Column) -> Column:
    """An array of the first choice of a chunk as ``c``; empty where the text isn't a chunk, or one without choices."""
    blank = lambda delta, c: F.coalesce(delta[c], F.lit("")).alias(c)

    def first(read: Column) -> Column:
        choice = read["value"]["choices"][0]
        texts = [blank(choice["delta"], c) for c in ("role", "content", "reasoning_content")]
        return F.struct(F.struct(*texts, choice["delta"]["tool_calls"].alias("tool_calls"), choice["finish_reason"].alias("finish_reason"), choice["usage"].alias("usage")).alias("c"))

    return F.transform(F.filter(F.array(strict_json(data, CHUNK)), lambda r: F.size(r["value"]["choices"]) > 0), first)


def chunk(data: Column) -> Column:
    """The chunk that a text is, or null: role, content, reasoning_content, tool_calls, finish_reason, usage."""
    return F.get(_choice(data), F.lit(0))["c"]


def parse_chunks(data: DataFrame, *kept: str) -> DataFrame:
    """(stream_id, seq, role, content, reasoning_content, tool_calls, finish_reason, usage, and columns to keep) of the first
    choice; lines that aren't JSON objects of the right types alone, and those without choices, are skipped."""
    # a filter on what from_json gives would be pushed below it and parse each line twice; an outer generator parses once
    rows = data.select("stream_id", "seq", *kept, F.explode_outer(_choice(F.col("data"))).alias("k")).filter("k is not null")
    return rows.select("stream_id", "seq", *(f"k.c.{c}" for c in ("role", "content", "reasoning_content", "tool_calls", "finish_reason", "usage")), *kept)


def parse_sse(lines: DataFrame) -> DataFrame:
    """Lines to chunks, cut at [DONE]."""
    return parse_chunks(cut_done(data_lines(lines)))


def sticky_role(chunks: DataFrame) -> DataFrame:
    """role becomes the latest one given so far, empty before the first."""
    so_far = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("role", F.coalesce(F.last(F.nullif("role", F.lit("")), ignorenulls=True).over(so_far), F.lit("")))


def _latest(value: str, order: Column) -> Column:
    return F.coalesce(F.max_by(F.when(F.col(value) != "", F.col(value)), F.when(F.col(value) != "", order)), F.lit("")).alias(value)


def tool_parts(chunks: DataFrame) -> DataFrame:
    """(stream_id, seq, ord, idx, id, type, name, args): parts of calls; ord orders parts of one chunk."""
    parts = chunks.select("stream_id", "seq", F.posexplode("tool_calls").alias("ord", "t"))
    text = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    return parts.select("stream_id", "seq", "ord", F.coalesce("t.index", F.lit(0)).alias("idx"), text("t.id", "id"), text("t.type", "type"), text("t.function.name", "name"), text("t.function.arguments", "args"))


def refused_parts(parts: DataFrame, max_calls: int = MAX_CALLS) -> DataFrame:
    """The parts of ``tool_parts`` that no call takes, with the reason as ``error``."""
    reason = F.when(F.col("idx") < 0, F.lit("negative index of a call")).otherwise(F.lit(f"more than {max_calls} calls"))
    return parts.filter(~F.col("idx").between(0, max_calls - 1)).withColumn("error", reason)


def merge_tool_deltas(parts: DataFrame, max_calls: int = MAX_CALLS) -> DataFrame:
    """(stream_id, idx, id, type, name, args), one row per call from 0 to the stream's largest index; gaps are empty
    calls. Arguments are concatenated in order, the rest is the latest that isn't empty. See ``refused_parts``."""
    order = F.struct("seq", "ord")
    merged = parts.filter(F.col("idx").between(0, max_calls - 1)).groupBy("stream_id", "idx").agg(_latest("id", order), _latest("type", order), _latest("name", order), ordered_text(order, F.col("args")).alias("args"))
    calls = merged.groupBy("stream_id").agg(F.max("idx").alias("n"), F.map_from_entries(F.collect_list(F.struct("idx", F.struct("id", "type", "name", "args")))).alias("calls"))
    filled = calls.select("stream_id", F.explode(F.sequence(F.lit(0), "n")).alias("idx"), "calls").withColumn("c", F.col("calls")[F.col("idx")])
    return filled.select("stream_id", "idx", *[F.coalesce(F.col(f"c.{x}"), F.lit("")).alias(x) for x in ("id", "type", "name", "args")])


def _able(part: Column, max_calls: int) -> Column:
    return F.coalesce(part["index"], F.lit(0)).between(0, max_calls - 1)


def count_refused(parts: Column, max_calls: int = MAX_CALLS) -> Column:
    """How many of an array of parts ``fold_calls`` leaves out."""
    return F.size(F.filter(parts, lambda p: ~_able(p, max_calls))).cast("long")


def fold_calls(parts: Column, max_calls: int = MAX_CALLS) -> Column:
    """The calls that an array of parts, in order, adds up to: from 0 to the largest index, gaps are empty calls."""
    index = lambda p: F.coalesce(p["index"], F.lit(0))

    def call(i: Column) -> Column:
        own = F.filter(parts, lambda p: index(p) == i)
        latest = lambda of: F.coalesce(F.try_element_at(F.filter(F.transform(own, of), lambda x: x != ""), F.lit(-1)), F.lit(""))
        arguments = F.array_join(F.transform(own, lambda p: F.coalesce(p["function"]["arguments"], F.lit(""))), "")
        function = F.struct(latest(lambda p: p["function"]["name"]).alias("name"), arguments.alias("arguments"))
        return F.struct(latest(lambda p: p["id"]).alias("id"), latest(lambda p: p["type"]).alias("type"), function.alias("function"))

    top = F.array_max(F.transform(F.filter(parts, lambda p: _able(p, max_calls)), index))
    return F.when(top.isNotNull(), F.transform(F.sequence(F.lit(0), top), call)).otherwise(F.array().cast(f"array<{CALL}>"))


def chunk_states(chunks: DataFrame, max_calls: int = MAX_CALLS) -> DataFrame:
    """Every chunk with its sticky role, its own deltas, the calls merged so far, and whether there are any yet.

    Chunks are sorted within their partition and folded as they pass, with one stream's state at a time: the work grows with
    chunks and with what comes out, which repeats the calls so far."""
    ordered = chunks.select("stream_id", "seq", "role", "content", "reasoning_content", "tool_calls").repartition("stream_id").sortWithinPartitions("stream_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, role, calls = object(), "", []
        for batch in batches:
            roles, states = [], []
            for key, given, parts in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "role", "tool_calls"))):
                if key != stream:
                    stream, role, calls = key, "", []
                role = given or role
                calls = _merged(calls, parts, max_calls) if parts else calls
                roles.append(role)
                states.append(calls)
            kept = {c: batch.column(c) for c in ("stream_id", "seq", "content", "reasoning_content")}
            yield pa.RecordBatch.from_pydict(kept | {"role": pa.array(roles, pa.string()), "tool_calls": pa.array(states, _CALLS)})

    folded = ordered.mapInArrow(run, f"stream_id {chunks.schema['stream_id'].dataType.simpleString()}, seq long, content string, reasoning_content string, role string, tool_calls array<{CALL}>")
    return folded.select("stream_id", "seq", "role", "content", "reasoning_content", "tool_calls", (F.size("tool_calls") > 0).alias("is_tool_call"))


_CALLS = pa.list_(pa.struct([("id", pa.string()), ("type", pa.string()), ("function", pa.struct([("name", pa.string()), ("arguments", pa.string())]))]))


def _merged(calls: list[dict], parts: list[dict | None], max_calls: int) -> list[dict]:
    """A new list of calls with the parts of a chunk taken in."""
    out = list(calls)
    for part in parts:
        part = part or {}
        i, function = part.get("index") or 0, part.get("function") or {}
        if 0 <= i < max_calls:
            out += [{"id": "", "type": "", "function": {"name": "", "arguments": ""}}] * (i + 1 - len(out))
            was = out[i]
            named = {"name": function.get("name") or was["function"]["name"], "arguments": was["function"]["arguments"] + (function.get("arguments") or "")}
            out[i] = {"id": part.get("id") or was["id"], "type": part.get("type") or was["type"], "function": named}
    return out


def stream_usage(chunks: DataFrame) -> DataFrame:
    """(stream_id, prompt_tokens, completion, total_tokens): the last usage of a stream, zeros if there is none."""
    last = chunks.groupBy("stream_id").agg(F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("seq"))).alias("u"))
    return last.select("stream_id", *[F.coalesce(F.col(f"u.{c}"), F.lit(0).cast("long")).alias(c) for c in ("prompt_tokens", "completion", "total_tokens")])


def assemble_messages(chunks: DataFrame, streams: DataFrame | None = None, max_calls: int = MAX_CALLS) -> DataFrame:
    """(stream_id, role, content, reasoning_content, tool_calls, n_chunks, refused): deltas concatenated, the role the latest
    one given, calls as ``fold_calls`` merges them. With ``streams``, those without chunks are empty assistant messages.

    Chunks are folded by spans of ``SPAN`` seqs first, and spans to messages then: of a stream of very many chunks no task holds
    more rows than a span has, until the texts of its spans, which are the message, are joined."""
    listed = lambda own: F.flatten(F.transform(F.sort_array(F.collect_list(own)), lambda r: r["parts"])).alias("parts")
    seq, span = F.col("seq"), F.col("span")
    some = F.when(F.size("tool_calls") > 0, F.struct("seq", F.col("tool_calls").alias("parts")))
    spans = chunks.groupBy("stream_id", F.floor(seq / SPAN).alias("span")).agg(
        _latest("role", seq), ordered_text(seq, F.col("content")).alias("content"), ordered_text(seq, F.col("reasoning_content")).alias("reasoning_content"), listed(some), F.count(F.lit(1)).alias("n")
    )
    folded = spans.groupBy("stream_id").agg(
        _latest("role", span), ordered_text(span, F.col("content")).alias("content"), ordered_text(span, F.col("reasoning_content")).alias("reasoning_content"),
        listed(F.when(F.size("parts") > 0, F.struct("span", "parts"))).alias("__parts"), F.sum("n").alias("n_chunks"),
    )
    folded = folded.select("stream_id", "role", "content", "reasoning_content", fold_calls(F.col("__parts"), max_calls).alias("tool_calls"), "n_chunks", count_refused(F.col("__parts"), max_calls).alias("refused"))
    if streams is None:
        return folded
    full = streams.select("stream_id").distinct().join(folded, "stream_id", "left")
    blank = {"role": "assistant", "content": "", "reasoning_content": ""}
    calls = F.coalesce("tool_calls", F.array().cast(f"array<{CALL}>")).alias("tool_calls")
    return full.select("stream_id", *[F.when(F.col("n_chunks").isNull(), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in blank.items()], calls, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_chunks", "refused")])


def cut_stream(chunks: DataFrame, stop: Column) -> DataFrame:
    """Up to and with the first chunk of a stream where ``stop`` holds; ``cancelled`` tells whether there was one."""
    at = F.min(F.when(stop, F.col("seq"))).over(Window.partitionBy("stream_id"))
    found = chunks.withColumn("__at", at)
    return found.filter(F.col("__at").isNull() | (F.col("seq") <= F.col("__at"))).withColumn("cancelled", F.col("__at").isNotNull()).drop("__at")
