"""Queries of the stream operators. Inputs are taken apart from a column, so that column is the answer in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill.jobs.fixtures import frame, sse_lines, tool_deltas
from tracemill.operators import memory, messages, tools
from tracemill.operators import streams as S
from tracemill.sources.shared import shared_dir, written
from tracemill.sources.tables import read_sse_lines, table, write_sse_lines
from tracemill.streaming import assemble

#: Files that a batch of the live fold takes: with 8, streams of a large feed came into many batches each.
FILES = 64


def _chunks(spark, d):
    return S.parse_sse(sse_lines(spark, d))


def _flat(df):
    """tool_calls as text: id/name/arguments of each, with ; between."""
    one = lambda c: F.concat_ws("/", c["id"], c["function"]["name"], c["function"]["arguments"])
    return df.withColumns({"n_calls": F.size("tool_calls").cast("long"), "calls": F.array_join(F.transform("tool_calls", one), ";")}).drop("tool_calls")


def s1_parse_sse(spark, d):
    return _chunks(spark, d).select("stream_id", "seq", "role", "content", "reasoning_content", F.coalesce(F.size("tool_calls"), F.lit(0)).cast("long").alias("n_parts"))


def s2_cut_done(spark, d):
    return S.cut_done(S.data_lines(sse_lines(spark, d))).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_lines"), F.max("seq").alias("last_seq"))


def s3_sticky_role(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise("").alias("role"))
    return S.sticky_role(events)


def s4_merge_tool_deltas(spark, d):
    return S.merge_tool_deltas(tool_deltas(spark, d))


def s5_chunk_states(spark, d):
    return _flat(S.chunk_states(_chunks(spark, d)).select("stream_id", "seq", "role", "content", "reasoning_content", "is_tool_call", "tool_calls"))


def s6_assemble_messages(spark, d):
    lines = sse_lines(spark, d)
    return _flat(S.assemble_messages(S.parse_sse(lines), lines))


def s7_stream_usage(spark, d):
    return S.stream_usage(_chunks(spark, d))


def s4_refused_parts(spark, d):
    return S.refused_parts(S.tool_parts(_chunks(spark, d))).select("stream_id", "seq", "idx", "id", "error")


def s8_cut_stream(spark, d):
    cut = S.cut_stream(_chunks(spark, d), F.col("content").contains("th"))
    return cut.groupBy("stream_id").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_chunks"), F.max("cancelled").alias("cancelled"))


def _folder(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def _deliveries(spark, d):
    """The feed in deliveries (k), written once: seqs below 5, 41, 1001, all others, and what comes after [DONE] two hours
    later. Every seventh conversation's streams just stop, without [DONE] and what comes after it."""
    seq, ends = F.col("seq"), F.split("stream_id", "_")[0].cast("long") % 7 != 3
    number = F.when(seq < 5, 0).when(seq < 41, 1).when(seq < 1001, 2).when(seq <= 1 << 40, 3).otherwise(4)
    lines = sse_lines(spark, d).filter(ends | (seq < 1 << 40)).withColumn("k", number)
    timed = lines.withColumn("time", F.timestamp_seconds(1704067200 + F.when(F.col("k") == 4, 7200).otherwise(F.col("k") * 60)))
    folder = _folder(spark)
    timed.write.partitionBy("k").parquet(folder)
    return spark.read.schema(timed.schema).parquet(folder)


def _live(spark, d, **options):
    """The live fold over two starts; what comes after [DONE] is there for the second one only."""
    folder, lines = _folder(spark), _deliveries(spark, d)
    for delivered in (range(4), range(4, 5)):
        for k in delivered:
            write_sse_lines(lines.filter(F.col("k") == k), f"{folder}/feed", "append", timed=True)
        feed = read_sse_lines(spark, f"{folder}/feed", live=True, files_per_trigger=FILES, timed=True)
        assemble.run_once(assemble.assemble_messages_streaming(feed, **options), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(assemble.OUT).parquet(f"{folder}/out")


def s9_assemble_messages_streaming(spark, d):
    return _flat(_live(spark, d)).drop("last_seq")


def s8_cut_stream_live(spark, d):
    return _live(spark, d, stop=F.col("content").contains("th")).select("stream_id", "last_seq", "n_chunks", "cancelled")


def s10_fan_out(spark, d):
    folder = _folder(spark)
    write_sse_lines(sse_lines(spark, d), f"{folder}/feed")
    to = lambda name: lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={k}")
    assemble.fan_out(S.data_lines(read_sse_lines(spark, f"{folder}/feed", live=True)), [to("one"), to("two")], f"{folder}/state").awaitTermination()
    one, two = (spark.read.parquet(f"{folder}/{x}").select("stream_id", F.lit(x).alias("sink")) for x in ("one", "two"))
    return one.union(two).groupBy("sink", "stream_id").agg(F.count(F.lit(1)).alias("n_lines"))


def w2_stream_to_history(spark, d):
    """Streamed answers to full messages, their calls to results, and both behind the users' messages of the conversation."""
    # three joins and unions read it: written, so that lines are parsed and folded once
    said = written(S.assemble_messages(_chunks(spark, d))).withColumn("session_id", F.split("stream_id", "_")[0]).withColumn("turn", F.split("stream_id", "_")[1].cast("long") * 10_000)
    calls = tools.explode_tool_calls(said.select("stream_id", "tool_calls")).select(F.col("stream_id").alias("session_id"), F.col("ord").cast("long").alias("seq"), "call.id", "call.function.name", "call.function.arguments")
    registry = spark.createDataFrame([("search",)], "name string")
    results = tools.execute_calls(calls.withColumnRenamed("id", "call_id"), registry, {"search": F.concat(F.lit('{"got":'), "arguments", F.lit("}"))})
    answers = messages.tool_results_to_messages(results).join(said.select(F.col("stream_id").alias("session_id"), F.col("session_id").alias("conv"), "turn"), "session_id")
    columns = ["session_id", "seq", "role", "content", "reasoning_content", "name"]
    new = said.select("session_id", F.col("turn").alias("seq"), "role", "content", "reasoning_content", F.lit("").alias("name")).union(answers.select("conv", F.col("turn") + 1 + F.col("seq"), "role", "content", F.lit(""), "name"))
    history = frame(spark, d, "messages").filter("role = 'user'").withColumn("name", F.lit("")).select(*columns)
    return memory.append_messages(history, new)


QUERIES = {f.__name__: f for f in (s1_parse_sse, s2_cut_done, s3_sticky_role, s4_merge_tool_deltas, s4_refused_parts, s5_chunk_states, s6_assemble_messages, s7_stream_usage, s8_cut_stream, s8_cut_stream_live, s9_assemble_messages_streaming, s10_fan_out, w2_stream_to_history)}

_CHAT = """chat as (select concat(conv_id, '_', turn) stream_id, conv_id, turn, text, cast(ceil(length(text) / 16.0) as bigint) n, conv_id % 4 = 1 asks, conv_id % 5 = 0 critic,
    case when conv_id % 8 = 1 then '' else '//;//;' end gap from conversations where role = 'assistant')"""
_PIECES = f"""{_CHAT}, cut as (select * exclude (piece_), piece_ piece, case when i % 3 = 0 then substr(piece_, 1, 3) else '' end reason, case when i = 0 then 'assistant' when i = 2 and critic then 'critic' else '' end said
    from (select *, substr(text, cast(i * 16 + 1 as int), 16) piece_ from (select *, unnest(range(0, n)) i from chat)))"""


def _calls_sql(i: str) -> str:
    """The calls that are known after chunk i, as ``_flat`` writes them."""
    first = f"concat(case when {i} > 2 then 'last_' else 'call_' end, stream_id, '/search/{{\"q\":', case when {i} > 1 then '7' else '' end, case when {i} > 2 then '}}' else '' end)"
    return f"case when not asks or {i} < 1 then '' else concat(gap, {first}, case when {i} > 1 then concat(';more_', stream_id, '/lookup/{{}}') else '' end) end"


def _n_calls_sql(i: str) -> str:
    return f"cast(case when not asks or {i} < 1 then 0 else case when gap = '' then 0 else 2 end + case when {i} > 1 then 2 else 1 end end as bigint)"


_MESSAGES = f"""said as (select stream_id, any_value(conv_id) conv_id, any_value(turn) turn, case when any_value(critic) and any_value(n) > 2 then 'critic' else 'assistant' end "role", any_value(text) "content",
    string_agg(reason, '' order by i) reasoning_content, any_value({_calls_sql("n - 1")}) calls, any_value({_n_calls_sql("n - 1")}) n_calls, any_value(n) n_chunks, any_value(asks) asks, any_value(gap) gap from cut group by stream_id)"""
_REFUSED = "cast(case when asks and n_chunks > 3 then 2 else 0 end as bigint) refused"
ORACLE_SQL = {
    "s1_parse_sse": f"with {_PIECES} select stream_id, i * 2 seq, said \"role\", piece \"content\", reason reasoning_content, cast(case when asks and i in (1, 2, 3) then i else 0 end as bigint) n_parts from cut",
    "s2_cut_done": f"""with {_PIECES} select stream_id, cast(sum(1 + case when i % 4 >= 2 then 1 else 0 end) as bigint) n_lines,
      max(case when i % 4 >= 2 then i * 2 + 1 else i * 2 end) last_seq from cut group by stream_id""",
    "s3_sticky_role": """select cast(user_id as varchar) stream_id, event_id seq, coalesce(last_value(case when event_id % 4 = 0 then event_type end ignore nulls)
      over (partition by user_id order by event_id rows between unbounded preceding and current row), '') "role" from events""",
    "s4_merge_tool_deltas": """with e as (select *, (event_id % 2) * 2 top from events where length(props) > 0)
      select concat('s', event_id) stream_id, cast(idx as int) idx, case when idx = top then concat('call_', event_id) else '' end id,
        case when idx = top then 'function' else '' end "type", case when idx = top and length(props) > 4 then event_type else '' end "name",
        case when idx = top then props else '' end args
      from (select *, unnest(range(0, top + 1)) idx from e)""",
    "s4_refused_parts": f"""with {_PIECES} select stream_id, i * 2 seq, cast(idx as int) idx, concat(case when idx < 0 then 'minus_' else 'far_' end, stream_id) id,
      case when idx < 0 then 'negative index of a call' else 'more than 1024 calls' end "error" from cut cross join (values (-1), (2000)) t(idx) where asks and i = 3""",
    "s5_chunk_states": f"with {_PIECES} select stream_id, i * 2 seq, case when critic and i > 1 then 'critic' else 'assistant' end \"role\", piece \"content\", reason reasoning_content, asks and i > 0 is_tool_call, {_calls_sql('i')} calls, {_n_calls_sql('i')} n_calls from cut",
    "s6_assemble_messages": f"with {_PIECES}, {_MESSAGES} select stream_id, \"role\", \"content\", reasoning_content, calls, n_calls, n_chunks, {_REFUSED} from said",
    "s7_stream_usage": f"with {_PIECES} select stream_id, cast(3 as bigint) prompt_tokens, cast(length(piece) as bigint) completion, cast(length(piece) + 3 as bigint) total_tokens from cut where i = 0",
    **dict.fromkeys(("s8_cut_stream", "s8_cut_stream_live"), f"""with {_PIECES}, stops as (select stream_id, min(i) filter (contains(piece, 'th')) stop from cut group by stream_id)
      select stream_id, max(i) * 2 last_seq, count(*) n_chunks, max(stop is not null) cancelled from cut join stops using (stream_id) where stop is null or i <= stop group by stream_id"""),
    "s9_assemble_messages_streaming": f"with {_PIECES}, {_MESSAGES} select stream_id, \"role\", \"content\", reasoning_content, calls, n_calls, n_chunks, {_REFUSED}, conv_id % 7 <> 3 complete, false cancelled from said",
    "s10_fan_out": f"""with {_PIECES}, counted as (select stream_id, cast(sum(1 + case when i % 4 >= 2 then 1 else 0 end) + 2 as bigint) n_lines from cut group by stream_id)
      select sink, stream_id, n_lines from counted cross join (values ('one'), ('two')) s(sink)""",
    "w2_stream_to_history": f"""with {_PIECES}, {_MESSAGES},
      called as (select conv_id, turn, stream_id, n_chunks, gap, unnest(range(0, n_calls)) k from said where n_calls > 0),
      named as (select *, k - case when gap = '' then 0 else 2 end j from called),
      new as (
        select conv_id, turn * 10000 o, "role", "content", reasoning_content, '' "name" from said
        union all select conv_id, turn * 10000 + 1 + k, 'tool', case when j = 0 and n_chunks > 3 then '{{"got":{{"q":7}}}}' when j = 0 then '{tools.BAD_ARGUMENTS}'
          when j = 1 then '{{"error": "tool lookup not found"}}' else '{{"error": "tool  not found"}}' end, '',
          case when j = 0 then concat(case when n_chunks > 3 then 'last_' else 'call_' end, stream_id) when j = 1 then concat('more_', stream_id) else '' end from named),
      last as (select conv_id, max(turn) last from conversations where role = 'user' group by conv_id)
      select cast(conv_id as varchar) session_id, turn seq, role, text "content", '' reasoning_content, '' "name" from conversations where role = 'user'
      union all select cast(conv_id as varchar), coalesce(last, -1) + row_number() over (partition by conv_id order by o), "role", "content", reasoning_content, "name" from new left join last using (conv_id)""",
}
