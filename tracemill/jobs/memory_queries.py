"""Queries of the memory operators, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracemill.jobs.fixtures import ctes, frame
from tracemill.operators import memory as M
from tracemill.operators.recall_index import build_recall_index, recall_indexed
from tracemill.sources import tables
from tracemill.sources.shared import shared_dir
from tracemill.sources.store import MessageStore

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HIT = f"({_FOLD.format('m.content')} like '%' || {_FOLD.format('q.q')} || '%' or {_FOLD.format('m.reasoning_content')} like '%' || {_FOLD.format('q.q')} || '%')"
_RECALLED = f"""recalled as (select * from (
  select q.session_id, q.q_seq, m.role, m.content, m.reasoning_content,
    cast(row_number() over (partition by q.session_id, q.q_seq order by m.ts desc, m.seq desc) as int) rn
  from recall_queries q join messages m on m.session_id = q.session_id and {_HIT}) where rn <= 3)"""
_PROMPTS = f"""prompts as (select session_id, q_seq, concat('{M.HEADER}', chr(10), string_agg('[' || role || ']: ' || content, chr(10) order by rn), chr(10), '{M.FOOTER}') prompt
  from recalled group by session_id, q_seq)"""


def _messages(spark, d):
    return frame(spark, d, "messages")


def _folder(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def a1_read_messages(spark, d):
    """Written in buckets of sessions and read back."""
    folder = _folder(spark)
    tables.write_messages(_messages(spark, d), folder, buckets=16)
    return tables.read_messages(spark, folder)


def a2_chat_json_round_trip(spark, d):
    """Messages with calls and results, as JSON lines in files, and read back."""
    call = F.struct(F.concat(F.lit("c"), "seq").alias("id"), F.lit("function").alias("type"), F.struct(F.lit("f").alias("name"), F.to_json(F.struct("content")).alias("arguments")).alias("function"))
    result = F.struct(F.lit("c").alias("call_id"), "content", (F.col("seq") % 6 == 0).alias("is_error"))
    listed = lambda wanted, x, kind: F.when(wanted, F.array(x)).otherwise(F.array()).cast(f"array<{kind}>")
    extra = {"name": F.when(F.col("seq") % 4 == 0, "n").otherwise(""), "partial": F.col("seq") % 2 == 1, "tool_calls": listed(F.col("seq") % 2 == 0, call, tables.CALL), "tool_results": listed(F.col("seq") % 3 == 0, result, tables.RESULT)}
    folder = _folder(spark)
    tables.write_chat_json(_messages(spark, d).withColumns(extra), folder)
    back, first = tables.read_chat_json(spark, folder), lambda c: F.get(c, F.lit(0))
    made, got = first("tool_calls"), first("tool_results")
    return back.select("session_id", "seq", "role", "content", "reasoning_content", "name", "partial", made["id"].alias("call_id"), made["function"]["arguments"].alias("arguments"), got["content"].alias("result"), got["is_error"].alias("is_error"))


def m1_save_turns(spark, d):
    """Two saves into a stored table, which is then read: all messages, then new and changed ones, some of them twice."""
    id_ = F.concat(F.lit("c"), F.col("seq").cast("string"))
    call = F.array(F.struct(id_.alias("id"), F.lit("function").alias("type"), F.struct(F.lit("f").alias("name"), F.lit('{"a":"\\n"}').alias("arguments")).alias("function")))
    store = MessageStore(spark, _folder(spark), buckets=16)
    store.save(_messages(spark, d).withColumn("write_seq", F.lit(0)))
    store.save(frame(spark, d, "updates").withColumn("tool_calls", F.when(F.col("seq") % 2 == 1, call)))
    return store.read()


def m2_recall_topk(spark, d):
    return M.recall_topk(_messages(spark, d), frame(spark, d, "recall_queries"))


def m2_recall_indexed(spark, d):
    """The same, by way of a stored index of trigrams; every fifth query has wildcards between the literal parts."""
    folder = _folder(spark)
    build_recall_index(_messages(spark, d)).write.parquet(folder)
    return recall_indexed(spark.read.parquet(folder), _messages(spark, d), frame(spark, d, "long_queries"))


def m3_get_session(spark, d):
    return M.get_sessions(_messages(spark, d))


def m4_get_session_with_reasoning(spark, d):
    return M.get_sessions(_messages(spark, d), reasoning=True)


def m5_clear_sessions(spark, d):
    m = _messages(spark, d)
    return M.clear_sessions(m, m.filter("cast(session_id as bigint) % 3 = 0").select("session_id").distinct())


def m6_memory_prompt(spark, d):
    return M.memory_prompt(m2_recall_topk(spark, d))


def m7_build_context(spark, d):
    prompts = m6_memory_prompt(spark, d).select("session_id", "prompt")
    return M.build_context(frame(spark, d, "shifted").select("session_id", "seq", "role", "content"), prompts)


def m8_replay_prompts(spark, d):
    return M.replay_prompts(_messages(spark, d))


def m8_replay_prompts_bounded(spark, d):
    return M.replay_prompts(_messages(spark, d), max_history=2)


def m9_keep_system(spark, d):
    return M.keep_system(frame(spark, d, "shifted")).select("session_id", "seq", "content")


def m11_append_messages(spark, d):
    m = _messages(spark, d)
    return M.append_messages(m, m.filter("role = 'user'")).select("session_id", "seq", "role", "content")


def m11_replace_messages(spark, d):
    m = _messages(spark, d)
    return M.replace_messages(m, m.filter("role = 'system'")).select("session_id", "seq", "role", "content")


QUERIES = {f.__name__: f for f in (a1_read_messages, a2_chat_json_round_trip, m1_save_turns, m2_recall_topk, m2_recall_indexed, m3_get_session, m4_get_session_with_reasoning, m5_clear_sessions, m6_memory_prompt, m7_build_context, m8_replay_prompts, m8_replay_prompts_bounded, m9_keep_system, m11_append_messages, m11_replace_messages)}

_REPLAY_HIT = f"({_FOLD.format('m.content')} like '%' || {_FOLD.format('u.content')} || '%' or {_FOLD.format('m.reasoning_content')} like '%' || {_FOLD.format('u.content')} || '%')"
_REPLAY = f"""with {ctes("messages")}, placed_ as (select *, row_number() over (partition by session_id order by seq) pos from messages),
      turns as (select session_id, seq turn_seq, content, pos from placed_ where role = 'user'),
      recalled as (select * from (select u.session_id, u.turn_seq, m.role, m.content,
          row_number() over (partition by u.session_id, u.turn_seq order by m.ts desc, m.seq desc) rn
        from turns u join placed_ m on m.session_id = u.session_id and m.seq < u.turn_seq and {_REPLAY_HIT} and NEAR) where rn <= 3),
      prompts as (select session_id, turn_seq, concat('{M.HEADER}', chr(10), string_agg('[' || role || ']: ' || content, chr(10) order by rn), chr(10), '{M.FOOTER}') prompt
        from recalled group by session_id, turn_seq),
      history as (select u.session_id, u.turn_seq, m.seq, m.role, m.content from turns u join placed_ m on m.session_id = u.session_id and m.seq <= u.turn_seq and NEAR),
      firsts as (select session_id, turn_seq, min(seq) filter (role = 'system') first from history group by session_id, turn_seq),
      placed as (
        select h.session_id, h.turn_seq, h.seq a, 0 b, h.role, h.content from history h join firsts f using (session_id, turn_seq) left join prompts p using (session_id, turn_seq)
        where p.prompt is null or f.first is null or h.seq >= f.first
        union all select session_id, turn_seq, coalesce(first, -1), 1, 'system', prompt from prompts join firsts using (session_id, turn_seq)
        union all select session_id, turn_seq, 1000000000, 2, 'user', content from turns)
      select session_id, turn_seq, cast(row_number() over (partition by session_id, turn_seq order by a, b) as int) pos, role, content from placed"""
ORACLE_SQL = {
    "a1_read_messages": f"with {ctes('messages')} select * from messages",
    "a2_chat_json_round_trip": f"""with {ctes('messages')} select session_id, seq, role, content, reasoning_content, case when seq % 4 = 0 then 'n' else '' end "name", seq % 2 = 1 partial,
      case when seq % 2 = 0 then concat('c', seq) end call_id, case when seq % 2 = 0 then concat('{{"content":', to_json(content), '}}') end arguments,
      case when seq % 3 = 0 then content end result, case when seq % 3 = 0 then seq % 6 = 0 end is_error from messages""",
    "m1_save_turns": f"""with {ctes("messages", "updates")}, every as (
        select *, 0 write_seq from messages union all select id, session_id, seq, role, content, reasoning_content, ts,
          case when seq % 2 = 1 then concat('[{{"id":"c', seq, '","type":"function","function":{{"name":"f","arguments":"{{\\"a\\":\\"\\\\n\\"}}"}}}}]') else 'null' end metadata, write_seq from updates)
      select id, session_id, seq, role, content, reasoning_content, ts, metadata from every qualify row_number() over (partition by id order by write_seq desc) = 1""",
    "m2_recall_topk": f"with {ctes('messages', 'recall_queries')}, {_RECALLED} select session_id, q_seq, rn, role, content, reasoning_content from recalled",
    "m2_recall_indexed": f"with {ctes('messages', 'long_queries')}, {_RECALLED.replace('recall_queries', 'long_queries')} select session_id, q_seq, rn, role, content, reasoning_content from recalled",
    "m3_get_session": f"with {ctes('messages')} select session_id, cast(row_number() over (partition by session_id order by ts, seq) as int) pos, role, content from messages",
    "m4_get_session_with_reasoning": f"with {ctes('messages')} select session_id, cast(row_number() over (partition by session_id order by ts, seq) as int) pos, role, content, reasoning_content from messages",
    "m5_clear_sessions": f"with {ctes('messages')} select * from messages where cast(session_id as bigint) % 3 <> 0",
    "m6_memory_prompt": f"with {ctes('messages', 'recall_queries')}, {_RECALLED}, {_PROMPTS} select session_id, q_seq, prompt from prompts",
    "m7_build_context": f"""with {ctes("messages", "recall_queries", "shifted")}, {_RECALLED}, {_PROMPTS},
      firsts as (select session_id, min(seq) filter (role = 'system') first from shifted group by session_id),
      placed as (
        select s.session_id, s.seq a, 0 b, s.role, s.content from shifted s join firsts f using (session_id) left join prompts p using (session_id)
        where p.prompt is null or f.first is null or s.seq >= f.first
        union all
        select session_id, coalesce(first, -1) a, 1 b, 'system' as "role", prompt content from prompts join firsts using (session_id))
      select session_id, cast(row_number() over (partition by session_id order by a, b) as int) pos, role, content from placed""",
    "m8_replay_prompts": _REPLAY.replace("NEAR", "true"),
    "m8_replay_prompts_bounded": _REPLAY.replace("NEAR", "m.pos >= u.pos - 2"),
    "m9_keep_system": f"with {ctes('messages', 'shifted')} select session_id, seq, content from shifted where role = 'system'",
    "m11_append_messages": f"""with {ctes("messages")}, last as (select session_id, max(seq) last from messages group by session_id)
      select session_id, seq, role, content from messages
      union all select m.session_id, last + row_number() over (partition by m.session_id order by seq), role, content from messages m join last l on l.session_id = m.session_id where role = 'user'""",
    "m11_replace_messages": f"""with {ctes("messages")}
      select session_id, seq, role, content from messages m where role = 'system' or not exists (select 1 from messages s where s.session_id = m.session_id and s.role = 'system')""",
}
