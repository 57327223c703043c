"""Inputs of the queries, derived from the given tables.

``SQL`` holds derivations that Spark and DuckDB both run; names in braces are tables or other derivations. The frames
below them are made apart from a column with Spark, so that column is the expected answer.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.tables import table

SQL = {
    "messages": """
        select concat(conv_id, '_', turn) id, cast(conv_id as varchar(20)) session_id, turn seq, role, text content,
          case when role = 'assistant' then substr(text, 1, 24) else '' end reasoning_content,
          1704067200 + conv_id * 60 + cast(floor(turn / 2) as bigint) ts, 'null' metadata
        from {conversations}""",
    "shifted": """
        select m.id, m.session_id, case when cast(m.session_id as bigint) % 3 = 0 then (m.seq + 2) % n.n else m.seq end seq,
          m.role, m.content, m.reasoning_content, m.ts, m.metadata
        from {messages} m join (select session_id, count(*) n from {messages} group by session_id) n on n.session_id = m.session_id""",
    "recall_queries": """
        select m.session_id, m.seq q_seq, case cast(m.session_id as bigint) % 10 when 0 then '%' when 1 then '' else substr(m.content, 1, 3) end q
        from {messages} m join (select session_id, max(seq) seq from {messages} where role = 'user' group by session_id) l
          on l.session_id = m.session_id and l.seq = m.seq""",
    "long_queries": """
        select session_id, seq q_seq, case seq % 5 when 0 then concat(substr(content, 3, 4), '%', substr(content, 12, 3)) when 1 then upper(substr(content, 5, 7)) when 2 then substr(content, 2, 2)
          when 3 then concat(substr(content, 1, 3), '_', substr(content, 5, 4)) else concat(substr(content, 1, 5), 'zzz') end q
        from {messages}""",
    "updates": """
        select id, session_id, seq, role, concat(content, '!') content, reasoning_content, ts + 5 ts, 1 write_seq from {messages} where seq % 3 = 0
        union all
        select id, session_id, seq, role, concat(content, '?') content, reasoning_content, ts + 6 ts, 2 write_seq from {messages} where seq % 6 = 0
        union all
        select concat(session_id, '_new') id, session_id, 1000 seq, 'user' role, 'new' content, '' reasoning_content, ts, 3 write_seq
        from {messages} where seq = 0""",
    "tool_calls": """
        select cast(user_id as varchar(20)) session_id, event_id seq, concat('call_', event_id) call_id, event_type name,
          case event_id % 7 when 0 then '' when 1 then '[1]' when 2 then concat(props, ' x') when 3 then 'null' else props end arguments
        from {events}""",
    "tool_results": """
        select session_id, call_id, concat('result of ', name) content, cast(seq % 9 = 0 as boolean) is_error from {tool_calls} where seq % 5 <> 0
        union all
        select session_id, concat('call_x', seq) call_id, 'orphan' content, false is_error from {tool_calls} where seq % 50 = 0""",
    "commands": """
        select concat('call_', event_id) call_id, value - 20 timeout,
          case event_id % 8 when 0 then 'ls' when 1 then 'rm  -RF /tmp' when 2 then 'sudo rm -rf /' when 3 then 'mkfs /dev/x'
            when 4 then 'a; b' when 5 then 'a && b' when 6 then 'a || b' else '' end command
        from {events}""",
    "paths": """
        select page_id, concat('/w/', page_id % 4, case page_id % 5 when 0 then '/a/../b' when 1 then '/../../x' when 2 then '/./c'
          when 3 then '/../..y' else '/d//e' end) path
        from {pages}""",
    "task_rows": """
        select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) ord,
          count(*) over (partition by l_orderkey) n
        from {lineitem}""",
    "tasks": """
        select cast(l_orderkey as varchar(20)) plan_id, cast(ord as int) ord, concat('task_', ord) id, concat('step ', ord, ' of ', n) description,
          case when l_orderkey % 10 = 0 and ord = 2 then 'missing' when l_orderkey % 10 = 1 and ord = 1 then 'out_2'
            when ord > 1 then concat('out_', ord - 1) end input,
          concat('out_', ord) output, case l_returnflag when 'R' then 'success' when 'A' then 'failed' else 'pending' end state
        from {task_rows}""",
    "task_events": """
        select plan_id, id, ord * 10 + 1 event_seq, 'running' state, cast(null as varchar(20)) result, cast(null as varchar(20)) error from {tasks} where state <> 'pending'
        union all
        select plan_id, id, ord * 10 + 2 event_seq, 'success' state, concat('r', ord) result, cast(null as varchar(20)) error from {tasks} where state = 'success' or ord % 4 = 0
        union all
        select plan_id, id, ord * 10 + 3 event_seq, 'failed' state, cast(null as varchar(20)) result, concat('e', ord) error from {tasks} where state = 'failed'
        union all
        select plan_id, cast(null as varchar(20)) id, 100000 event_seq, 'cancelled' state, cast(null as varchar(20)) result, cast(null as varchar(20)) error
        from {tasks} where ord = 1 and cast(plan_id as bigint) % 13 = 0""",
    "slots": """
        select plan_id workflow_id, output slot, concat('v', ord) value, cast(ord as bigint) write_seq, cast(null as varchar(20)) err from {tasks} where state = 'success'
        union all
        select plan_id workflow_id, output slot, 'late' value, cast(ord as bigint) + 1000 write_seq, cast(null as varchar(20)) err from {tasks} where state = 'success'
        union all
        select plan_id workflow_id, output slot, 'bad' value, cast(0 as bigint) write_seq, 'boom' err from {tasks} where state = 'failed'""",
    "loop_log": """
        select event_id loop_id, cast(event_id % 12 as int) iterations, cast(case event_id % 3 when 0 then 0 else 8 end as int) max_iterations,
          event_id % 11 = 0 timed_out, event_id % 13 = 0 cancelled
        from {events}""",
}
#: Texts that a strict reader doesn't take for chunks.
BAD_CHUNKS = (
    "{bad",
    '{"choices":[{"delta":{"content":"X"}}]} junk',
    '{"choices":[{"delta":{"content":"X"}}]}{"choices":[]}',
    '{"choices":[{"delta":{"content":NaN}}]}',
    '{"choices":[{"delta":{"content":7}}]}',
    '{"choices":[{"delta":{"role":["X"],"content":"X"}}]}',
    '{"choices":[{"delta":{"content":"X"}}]},{"choices":[]}',
    '{"choices":[{"delta":{"content":"X","tool_calls":[{"index":0,"function":{"name":5}}]}}]}',
    '{"choices":[{"delta":{"content":"X"},"usage":{"prompt_tokens":-1}}]}',
    '{"choices":[{"delta":{"content":"X"}},{"delta":{"content":{}}}]}',
    "{'choices':[{'delta':{'content':'X'}}]}",
    '[{"delta":{"content":"X"}}]',
)
TABLES = ("conversations", "events", "pages", "lineitem")


def needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", SQL[name])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derivation."""
    if name not in SQL:
        return table(spark, sf_dir, name)
    return spark.sql(SQL[name], **{x: frame(spark, sf_dir, x) for x in dict.fromkeys(needs(name))})


def ctes(*names: str) -> str:
    """The derivations, and those they need, as ``name as (...)`` in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in SQL and name not in done:
            for x in needs(name):
                add(x)
            done[name] = f"{name} as ({re.sub(r'[{}]', '', SQL[name])})"

    for name in names:
        add(name)
    return ", ".join(done.values())


def pieces(text: str, size: int):
    """An array of a text's pieces of ``size`` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sse_lines(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """(stream_id, seq, line): assistant messages in chunks, with noise, [DONE], and a line too late. Every third chunk has
    reasoning; every fifth conversation changes the role at its third chunk; every fourth has deltas of two tool calls,
    which start at index 0 or, with a gap before them, at 2, and two parts that no call can take. The noise holds lines that
    are nearly chunks."""
    chat = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", F.concat_ws("_", "conv_id", "turn").alias("stream_id"), "text")
    cut = chat.select("conv_id", "stream_id", F.posexplode(pieces("text", size)).alias("i", "piece"))
    role = F.when(F.col("i") == 0, "assistant").when((F.col("i") == 2) & (F.col("conv_id") % 5 == 0), "critic")
    reason = F.when(F.col("i") % 3 == 0, F.substring("piece", 1, 3))
    top = F.when(F.col("conv_id") % 8 == 1, 0).otherwise(2)
    part = lambda index, id_, type_, name, args: F.struct(index.alias("index"), id_.cast("string").alias("id"), F.lit(type_).cast("string").alias("type"), F.struct(F.lit(name).cast("string").alias("name"), F.lit(args).alias("arguments")).alias("function"))
    given = lambda prefix: F.concat(F.lit(prefix), "stream_id")
    asks = (F.col("conv_id") % 4 == 1) & F.col("i").between(1, 3)
    calls = (
        F.when(asks & (F.col("i") == 1), F.array(part(top, given("call_"), "function", "search", '{"q":')))
        .when(asks & (F.col("i") == 2), F.array(part(top, F.lit(None), None, None, "7"), part(top + 1, given("more_"), "function", "lookup", "{}")))
        .when(asks, F.array(part(top, given("last_"), None, None, "}"), part(F.lit(-1), given("minus_"), None, "x", "x"), part(F.lit(2000), given("far_"), None, "x", "x")))
    )
    delta = F.struct(role.alias("role"), F.col("piece").alias("content"), reason.alias("reasoning_content"), calls.alias("tool_calls"))
    usage = F.when(F.col("i") == 0, F.struct(F.lit(3).alias("prompt_tokens"), F.length("piece").alias("completion"), (F.length("piece") + 3).alias("total_tokens")))
    chunk = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), usage.alias("usage"))).alias("choices")))
    broken = F.get(F.array(*[F.lit(x) for x in BAD_CHUNKS]), (F.floor(F.col("i") / 4) % len(BAD_CHUNKS)).cast("int"))
    noise = F.get(F.array(F.lit(""), F.lit(": ping"), F.concat(F.lit("data: "), broken), F.lit('data: {"choices":[]}')), (F.col("i") % 4).cast("int"))
    data = cut.select("stream_id", (F.col("i") * 2).cast("long").alias("seq"), F.concat(F.lit("data: "), chunk).alias("line"))
    noisy = cut.select("stream_id", (F.col("i") * 2 + 1).cast("long").alias("seq"), noise.alias("line"))
    end = chat.select("stream_id", F.lit(1 << 40).alias("seq"), F.lit("data: [DONE]").alias("line"))
    late = chat.select("stream_id", F.lit((1 << 40) + 1).alias("seq"), F.lit('data: {"choices":[{"index":0,"delta":{"role":"late","content":"LATE"}}]}').alias("line"))
    return data.union(noisy).union(end).union(late)


def tool_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, ord, idx, id, type, name, args): one call of each event, its props in pieces; calls at 0 or 2."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    cut = events.select("event_id", "event_type", F.posexplode(pieces("props", 4)).alias("i", "args"))
    only = lambda at, c: F.when(F.col("i") == at, c).otherwise(F.lit(""))
    return cut.select(
        F.concat(F.lit("s"), "event_id").alias("stream_id"),
        F.floor(F.col("i") / 2).cast("long").alias("seq"),
        (F.col("i") % 2).cast("int").alias("ord"),
        ((F.col("event_id") % 2) * 2).cast("int").alias("idx"),
        only(0, F.concat(F.lit("call_"), "event_id")).alias("id"),
        only(0, F.lit("function")).alias("type"),
        only(1, F.col("event_type")).alias("name"),
        "args",
    )


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, goal, raw): the tasks of a plan as JSON in the wrappings that models give; every sixth is broken."""
    tasks = frame(spark, sf_dir, "tasks")
    listed = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    one = F.struct("ord", F.struct("id", "description", listed("input").alias("inputs"), listed("output").alias("outputs")).alias("task"))
    body = F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["task"]).alias("tasks")))
    k = F.col("plan_id").cast("long") % 6
    raw = (
        F.when(k == 0, F.col("body"))
        .when(k == 1, F.concat(F.lit("```json\n"), "body", F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("  ```JSON "), "body", F.lit("``` \n")))
        .when(k == 3, F.concat(F.lit("Here is the plan:\n"), "body"))
        .when(k == 4, F.concat("body", F.lit("\nThat is all.")))
        .otherwise(F.concat(F.lit('{"tasks": [{"id": '), F.col("plan_id"), F.lit("}")))
    )
    return tasks.groupBy("plan_id").agg(body.alias("body")).select("plan_id", F.concat(F.lit("goal "), "plan_id").alias("goal"), raw.alias("raw"))
