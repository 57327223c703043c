"""Queries of the plan and file operators, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.jobs.fixtures import ctes, frame, pieces, plan_texts, sse_lines
from tracemill.functions.text import ordered_text
from tracemill.operators import plans as P
from tracemill.operators.streams import data_lines
from tracemill.sources import files
from tracemill.sources.shared import shared_dir
from tracemill.sources.tables import read_sse_files, read_sse_lines, table, write_sse_lines


def _tasks(spark, d):
    """Tasks with array columns, as the operators take them."""
    listed = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    return frame(spark, d, "tasks").withColumns({"inputs": listed("input"), "outputs": listed("output")}).drop("input", "output")


def _plans(spark, d):
    return frame(spark, d, "tasks").select("plan_id").distinct().withColumn("goal", F.concat(F.lit("goal "), "plan_id"))


def a3_read_sse_lines(spark, d):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_sse_lines(sse_lines(spark, d).withColumn("line", F.concat("line", F.lit("\r"))), folder)
    return data_lines(read_sse_lines(spark, folder)).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_data"))


def a3_read_sse_files(spark, d):
    """A file of event lines for each type of event; a line holds its own number."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    number = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    numbered = table(spark, d, "events").select("event_type", number.alias("n"), F.concat_ws(" ", F.lit("data:"), number.cast("string"), "event_id", "props").alias("value"))
    numbered.repartition("event_type").sortWithinPartitions("event_type", "n").select("event_type", "value").write.partitionBy("event_type").text(folder)
    kind = F.regexp_extract("_metadata.file_path", "/event_type=([^/]*)/", 1)
    return read_sse_files(spark, folder, name=kind).select("stream_id", "seq", "line")


def a4_file_inventory(spark, d):
    """The files of events, one for every 16 users."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    events = table(spark, d, "events").select(F.expr("user_id div 16").alias("group"), F.concat_ws(" ", "event_type", "props").alias("value"))
    events.repartition("group").write.partitionBy("group").text(folder)
    found = files.file_inventory(spark, folder).withColumn("group", F.regexp_extract("path", "/group=([0-9]+)/", 1).cast("long"))
    dated = F.every(F.col("mod_time").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$")).alias("dated")
    return found.filter(F.col("name").endswith(".txt")).groupBy("group", "type").agg(F.sum(F.col("size").cast("long")).alias("n_bytes"), dated)


def a5_read_bounded_text(spark, d):
    """The documents, in pieces of which none comes near the limit, written to files of a sixteenth of it on average; a file
    over the limit, and paths that aren't allowed or not there."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    limit = files.MAX_BYTES
    documents = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", " ").alias("text"))
    cut = documents.select("doc_id", F.posexplode_outer(pieces("text", limit // 64)).alias("i", "piece"))
    rows = cut.select(F.concat("doc_id", F.lit(" "), F.coalesce("i", F.lit(0)), F.lit(" "), F.coalesce("piece", F.lit(""))).alias("value"))
    size = rows.agg(F.sum(F.octet_length("value").cast("long") + 1)).first()[0] or 0
    rows.repartition(max(2, -(-16 * size // limit))).write.text(f"{folder}/docs")
    spark.range(1).select(F.repeat(F.lit("x"), limit)).coalesce(1).write.text(f"{folder}/large")
    root = f"{folder}/"
    found = files.file_inventory(spark, folder).filter(F.col("name").endswith(".txt")).select(F.substring_index("path", root.rsplit("/", 2)[1] + "/", -1).alias("path"))
    wrong = spark.createDataFrame([("docs/../../outside.txt",), ("docs/none.txt",)], "path string")
    read = files.read_requested(spark, found.union(wrong), folder, limit)
    part = F.split("line", " ", 3)
    lines = read.filter("error is null").select(F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    texts = lines.select(part[0].cast("long").alias("doc_id"), part[1].cast("int").alias("i"), part[2].alias("piece")).groupBy("doc_id").agg(F.md5(ordered_text(F.col("i"), F.col("piece"))).alias("text_md5"))
    # a refused part of the documents is a failure of the query, any other refusal a row
    lost = F.raise_error(F.concat_ws(": ", "error", "path")).cast("string")
    told = F.when(F.col("path").rlike("^docs/part-"), lost).otherwise(F.regexp_replace("error", "[0-9]+ bytes.*", "refused"))
    return texts.union(read.filter("error is not null").select(F.lit(None).cast("long"), told))


def p1_trim_json_wrapper(spark, d):
    from tracemill.functions.text import trim_json_wrapper

    body = F.to_json(F.struct("event_id", "event_type"))
    k = F.col("event_id") % 6
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("\n```json\n"), body, F.lit("\n```  "))).when(k == 2, F.concat(F.lit("```JSON"), body, F.lit("```"))).when(k == 3, F.concat(F.lit("So: "), body, F.lit(" done"))).when(k == 4, F.concat(F.lit("list [1, "), F.col("event_id").cast("string"), F.lit("] end"))).otherwise(F.lit(" none "))
    return table(spark, d, "events").select("event_id", trim_json_wrapper(raw).alias("body"))


def p2_parse_plans(spark, d):
    return P.parse_plans(plan_texts(spark, d)).select("plan_id", "goal", "status", F.size("tasks").cast("long").alias("n_tasks"))


def p3_explode_tasks(spark, d):
    rows = P.explode_tasks(P.parse_plans(plan_texts(spark, d)))
    one = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit("")).alias(c)
    return rows.select("plan_id", "ord", "id", "description", one("inputs"), one("outputs"), "state")


def p4_parse_task_outputs(spark, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("answer: "), "props")).when(k == 2, F.lit("no json")).otherwise(F.concat("props", F.lit(" ok")))
    return P.parse_task_outputs(table(spark, d, "events").select("event_id", raw.alias("raw")))


def p5_task_edges(spark, d):
    return P.task_edges(_tasks(spark, d))


def p6_ready_tasks(spark, d):
    return P.ready_tasks(_tasks(spark, d), P.resolve_slots(frame(spark, d, "slots")))


def p7_execution_levels(spark, d):
    return P.execution_levels(_tasks(spark, d))


def p8_stuck_tasks(spark, d):
    return P.stuck_tasks(_tasks(spark, d))


def p9_fold_task_events(spark, d):
    return P.fold_task_events(_tasks(spark, d), frame(spark, d, "task_events"))


def p10_plan_status(spark, d):
    return P.plan_status(_plans(spark, d), _tasks(spark, d))


def p11_merge_replan(spark, d):
    texts = plan_texts(spark, d)
    old = frame(spark, d, "tasks").filter("ord = 1").select("plan_id", F.array(F.named_struct(*[x for k, v in (("id", F.col("id")), ("description", F.lit("old")), ("state", F.lit("failed")), ("error", F.lit("boom"))) for x in (F.lit(k), v)])).alias("o"))
    task = lambda t: F.struct(t["id"].alias("id"), t["description"].alias("description"), F.array().cast("array<string>").alias("inputs"), F.array().cast("array<string>").alias("outputs"), t["state"].alias("state"), F.lit(None).cast("map<string,string>").alias("result"), t["error"].alias("error"))
    plans = texts.join(old, "plan_id").select("plan_id", "goal", F.transform("o", task).cast(f"array<{P.TASK}>").alias("tasks"), F.lit("task_1").alias("failed_id"), "raw")
    out = P.merge_replan(plans).select("plan_id", "goal", F.explode_outer("tasks").alias("t")).filter("t is not null")
    return out.select("plan_id", "goal", "t.id", "t.description", "t.state", F.coalesce("t.error", F.lit("")).alias("error"))


def p12_synthesize_results(spark, d):
    result = F.when(F.col("state") == "success", F.create_map(F.lit("b"), "id", F.lit("a"), F.lit("x")))
    return P.synthesize_results(_plans(spark, d), _tasks(spark, d).withColumn("result", result))


def p13_plan_state_json(spark, d):
    return P.plan_state_json(P.parse_plans(plan_texts(spark, d)))


def p14_resolve_slots(spark, d):
    return P.resolve_slots(frame(spark, d, "slots"))


def p15_route_rows(spark, d):
    events = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 5 > 0, F.col("value")))
    return P.route_rows(events, F.col("v") > 50, "high", "low").select("event_id", "route")


def p16_barrier_complete(spark, d):
    tasks = frame(spark, d, "tasks")
    waits = tasks.filter("ord <= 2").groupBy("plan_id").agg(F.sort_array(F.collect_list("output")).alias("keys"))
    return P.barrier_complete(P.resolve_slots(frame(spark, d, "slots")), waits.withColumnRenamed("plan_id", "workflow_id"))


def p17_classify_loops(spark, d):
    return P.classify_loops(frame(spark, d, "loop_log")).select("loop_id", "status", "message", "success", "error")


def p18_task_prompts(spark, d):
    return P.task_prompts(_tasks(spark, d), P.resolve_slots(frame(spark, d, "slots")))


def p19_audit_plans(spark, d):
    return P.audit_plans(_tasks(spark, d))


_ALL = (a3_read_sse_lines, a3_read_sse_files, a4_file_inventory, a5_read_bounded_text, p1_trim_json_wrapper, p2_parse_plans, p3_explode_tasks, p4_parse_task_outputs, p5_task_edges, p6_ready_tasks, p7_execution_levels, p8_stuck_tasks, p9_fold_task_events, p10_plan_status, p11_merge_replan, p12_synthesize_results, p13_plan_state_json, p14_resolve_slots, p15_route_rows, p16_barrier_complete, p17_classify_loops, p18_task_prompts, p19_audit_plans)
QUERIES = {f.__name__: f for f in _ALL}

_T = ctes("tasks")
_TS = ctes("tasks", "slots")
_SLOTS = "resolved as (select workflow_id, slot, arg_min(value, write_seq) value from slots where err is null group by workflow_id, slot)"
_EVENT_JSON = "concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\"}')"
_LEVELS = f"""with recursive {_T}, lv as (
    select plan_id, id, ord, output, 0 level from tasks where input is null
    union all select t.plan_id, t.id, t.ord, t.output, lv.level + 1 from lv join tasks t on t.plan_id = lv.plan_id and t.input = lv.output)"""
_STUCK = """made as (select distinct plan_id, output from tasks),
    stuck as (select t.plan_id, t.id, case when m.output is null then 'missing input' else 'blocked' end reason
      from tasks t left join made m on m.plan_id = t.plan_id and m.output = t.input where not exists (select 1 from lv where lv.plan_id = t.plan_id and lv.id = t.id))"""
_K = "cast(plan_id as bigint) % 6"
ORACLE_SQL = {
    "a3_read_sse_lines": """with chat as (select concat(conv_id, '_', turn) stream_id, cast(ceil(length(text) / 16.0) as bigint) n from conversations where role = 'assistant'),
      cut as (select stream_id, unnest(range(0, n)) i from chat) select stream_id, cast(sum(1 + case when i % 4 >= 2 then 1 else 0 end) + 2 as bigint) n_data from cut group by stream_id""",
    "a3_read_sse_files": """select event_type stream_id, n seq, concat_ws(' ', 'data:', n, event_id, props) line
      from (select *, row_number() over (partition by event_type order by event_id) - 1 n from events)""",
    "a4_file_inventory": """select user_id // 16 "group", 'file' "type", cast(sum(strlen(event_type) + 1 + coalesce(strlen(props), -1) + 1) as bigint) n_bytes, true dated from events group by user_id // 16""",
    "a5_read_bounded_text": """select doc_id, md5(replace(text, chr(10), ' ')) text_md5 from documents
      union all select null, unnest(['path access denied: docs/../../outside.txt', 'file not found: docs/none.txt', 'file too large: refused'])""",
    "p1_trim_json_wrapper": f"select event_id, case event_id % 6 when 4 then concat('[1, ', event_id, ']') when 5 then 'none' else {_EVENT_JSON} end body from events",
    "p2_parse_plans": f"with {_T} select plan_id, concat('goal ', plan_id) goal, case when {_K} = 5 then 'error' else 'ok' end status, case when {_K} = 5 then 0 else count(*) end n_tasks from tasks group by plan_id",
    "p3_explode_tasks": f"with {_T} select plan_id, ord, id, description, coalesce(input, '') inputs, output outputs, 'pending' state from tasks where {_K} <> 5",
    "p4_parse_task_outputs": """select event_id, case when event_id % 4 = 2 then null else json_keys(props)[1] end slot,
      case when event_id % 4 = 2 then null else json_extract_string(props, '$.' || json_keys(props)[1]) end "value", case when event_id % 4 = 2 then 'not a JSON object' end "error" from events""",
    "p5_task_edges": f"with {_T} select a.plan_id, a.output \"key\", a.id producer, b.id consumer from tasks a join tasks b on a.plan_id = b.plan_id and a.output = b.input",
    "p6_ready_tasks": f"with {_TS}, {_SLOTS} select plan_id, id from tasks t where state = 'pending' and (input is null or exists (select 1 from resolved r where r.workflow_id = t.plan_id and r.slot = t.input))",
    "p7_execution_levels": f"{_LEVELS} select plan_id, id, cast(level as int) \"level\" from lv",
    "p8_stuck_tasks": f"{_LEVELS}, {_STUCK} select plan_id, id, reason from stuck",
    "p9_fold_task_events": f"""with {ctes("tasks", "task_events")}, own as (select plan_id, id, arg_max(state, event_seq) state, arg_max(result, event_seq) filter (result is not null) result,
        arg_max(error, event_seq) filter (error is not null) error from task_events where id is not null group by plan_id, id)
      select t.plan_id, t.id, case when cast(t.plan_id as bigint) % 13 = 0 then 'cancelled' else coalesce(o.state, 'pending') end state, o.result, o.error
      from tasks t left join own o on o.plan_id = t.plan_id and o.id = t.id""",
    "p10_plan_status": f"with {_T} select plan_id, bool_and(state = 'success') completed, arg_min(id, ord) filter (state = 'failed') first_failed from tasks group by plan_id",
    "p11_merge_replan": f"""with {_T} select plan_id, concat('goal ', plan_id) goal, id, description, 'pending' state, '' "error" from tasks where {_K} <> 5
      union all select plan_id, concat('goal ', plan_id), id, 'old', 'pending', '' from tasks where {_K} = 5 and ord = 1""",
    "p12_synthesize_results": f"""with {_T} select plan_id, concat('{P.REPORT[0]}goal ', plan_id, '{P.REPORT[1]}', chr(10), string_agg(concat(case when state = 'failed' then '✗' else '✓' end, ' ', description, ': map[',
      case when state = 'success' then concat('a:x b:', id) else '' end, ']'), chr(10) order by ord)) report from tasks group by plan_id""",
    "p13_plan_state_json": f"""with {_T} select plan_id, concat('{{"goal":"goal ', plan_id, '","tasks":', case when {_K} = 5 then 'null' else concat('[', string_agg(concat('{{"id":"', id, '","description":"', description,
        '","inputs":[', case when input is null then '' else concat('"', input, '"') end, '],"outputs":["', output, '"],"state":null,"result":null,"error":null}}'), ',' order by ord), ']') end, '}}') state
      from tasks group by plan_id""",
    "p14_resolve_slots": f"with {_TS}, {_SLOTS} select * from resolved",
    "p15_route_rows": "select event_id, case when event_id % 5 > 0 and value > 50 then 'high' else 'low' end route from events",
    "p16_barrier_complete": f"with {_TS}, {_SLOTS} select plan_id workflow_id, bool_and(exists (select 1 from resolved r where r.workflow_id = t.plan_id and r.slot = t.output)) complete from tasks t where ord <= 2 group by plan_id",
    "p17_classify_loops": f"""with {ctes("loop_log")}, s as (select *, case when timed_out then 'timeout' when cancelled then 'cancelled' when max_iterations > 0 and iterations >= max_iterations then 'max_iterations' else 'completed' end status from loop_log)
      select loop_id, status, case status when 'timeout' then concat('timeout: executed ', iterations, ' iterations') when 'cancelled' then 'cancelled: context canceled'
        when 'max_iterations' then concat('max_iterations_reached: ', iterations, '/', max_iterations) else concat('completed: ', iterations, ' iterations') end message,
        status = 'completed' success, status in ('cancelled', 'timeout') "error" from s""",
    "p18_task_prompts": f"""with {_TS}, {_SLOTS} select t.plan_id, t.id, case when input is null then '' else concat(input, ': ', coalesce(r.value, '')) end inputs_text,
      concat('{{', chr(10), chr(9), '"', output, '": "<', output, '的结果>"', chr(10), '}}') output_template from tasks t left join resolved r on r.workflow_id = t.plan_id and r.slot = t.input""",
    "p19_audit_plans": f"""{_LEVELS}, {_STUCK} select t.plan_id, count(*) n_tasks, true ids_ok, count(*) between 3 and 8 size_ok,
      count(*) filter (reason = 'missing input') n_missing, count(*) filter (reason = 'blocked') n_blocked from tasks t left join stuck s on s.plan_id = t.plan_id and s.id = t.id group by t.plan_id""",
}
