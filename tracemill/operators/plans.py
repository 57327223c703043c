"""Plans of tasks as tables: parse, dependencies, readiness, state, re-plans and reports.

Tasks are rows (plan_id, ord, id, description, inputs array, outputs array, state, ...). Everything groups by plan_id;
logs fold with partial aggregates. Levels, stuck tasks and audits read a plan of usual size in one row, as the answer that it
came from was, and larger ones wave by wave.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import alone, json_value, let, ordered_text, trim_json_wrapper
from tracemill.sources.shared import written

TASK = "struct<id:string,description:string,inputs:array<string>,outputs:array<string>,state:string,result:map<string,string>,error:string>"
PLAN = f"struct<goal:string,tasks:array<{TASK}>>"
MIN_TASKS, MAX_TASKS = 3, 8
ROW_TASKS = 128
MISSING, BLOCKED = "missing input", "blocked"
# fixed values: the words of reports and prompts
REPORT, DONE, FAILED = ("目标「", "」已完成，执行结果："), "✓", "✗"
PLACE = ("<", "的结果>")


def _parsed(answers: DataFrame, kind: str) -> DataFrame:
    """answers with the JSON part of ``raw`` as ``__body``, its ``__value`` of the type ``kind``, and whether it is
    ``__wrong``: not one object of that type. The text is read once."""
    read = answers.withColumn("__body", trim_json_wrapper(F.col("raw"))).withColumn("__read", json_value(F.col("__body"), kind))
    right = F.col("__read._bad").isNull() & (F.col("__read.end") == 1) & F.col("__body").startswith("{") & alone(F.col("__body"))
    return read.withColumn("__wrong", ~F.coalesce(right, F.lit(False))).withColumn("__value", F.col("__read.value")).drop("__read")


def parse_plans(answers: DataFrame) -> DataFrame:
    """answers (plan_id, goal, raw) -> plan_id, goal, status (ok, empty, error), tasks. The goal is the caller's; text that
    can't be parsed is an error where it speaks of "tasks", and else an empty plan."""
    parsed = _parsed(answers, PLAN)

    def speaks(rest: Column) -> Column:  # what stands behind the first brace: "tasks", and a closing brace behind that
        at = F.instr(rest, '"tasks"')
        return (at > 0) & (F.instr(F.substr(rest, at + 7), "}") > 0)

    behind = F.when(F.instr("__body", "{") > 0, F.substr(F.col("__body"), F.instr("__body", "{") + 1))
    status = F.when(~F.col("__wrong"), "ok").when(let(behind, speaks), "error").otherwise("empty")
    none = F.array().cast(f"array<{TASK}>")
    return parsed.select("plan_id", "goal", status.alias("status"), F.when(~F.col("__wrong"), F.coalesce("__value.tasks", none)).otherwise(none).alias("tasks"))


def explode_tasks(plans: DataFrame) -> DataFrame:
    """One row per task, ord from 1, all pending."""
    # outer: else the optimizer tests the size of tasks first, and parses the answers twice
    rows = plans.select("plan_id", F.posexplode_outer("tasks").alias("i", "t")).filter("i is not null")
    listed = lambda c: F.coalesce(F.col(f"t.{c}"), F.array().cast("array<string>")).alias(c)
    return rows.select("plan_id", (F.col("i") + 1).alias("ord"), "t.id", "t.description", listed("inputs"), listed("outputs"), F.lit("pending").alias("state"))


def parse_task_outputs(answers: DataFrame) -> DataFrame:
    """answers (keys.., raw) -> keys.., slot, value: one row per key of the answer's JSON object; where it isn't one, a row
    with ``error``."""
    keys = [c for c in answers.columns if c != "raw"]
    rows = _parsed(answers, "map<string,string>").withColumn("__map", F.when(~F.col("__wrong"), F.col("__value")))
    return rows.select(*keys, F.explode_outer("__map").alias("slot", "value"), F.when(F.col("__wrong"), "not a JSON object").alias("error")).filter(F.col("slot").isNotNull() | F.col("error").isNotNull())


def task_edges(tasks: DataFrame) -> DataFrame:
    """(plan_id, key, producer, consumer): consumer needs a key that producer gives."""
    made = tasks.select("plan_id", F.col("id").alias("producer"), F.explode("outputs").alias("key"))
    used = tasks.select("plan_id", F.col("id").alias("consumer"), F.explode("inputs").alias("key"))
    return made.join(used, ["plan_id", "key"])


def ready_tasks(tasks: DataFrame, slots: DataFrame) -> DataFrame:
    """(plan_id, id) of pending tasks whose inputs all have a value in slots (workflow_id, slot)."""
    have = slots.select(F.col("workflow_id").alias("plan_id"), F.col("slot").alias("key"), F.lit(True).alias("found")).distinct()
    wanted = tasks.filter("state = 'pending'").select("plan_id", "id", F.explode_outer("inputs").alias("key"))
    found = wanted.join(have, ["plan_id", "key"], "left")
    return found.groupBy("plan_id", "id").agg(F.every(F.col("key").isNull() | F.coalesce("found", F.lit(False))).alias("ready")).filter("ready").select("plan_id", "id")


def _waves(tasks: Column) -> Column:
    """For an array of tasks with inputs and outputs: the wave each can run in, from 0, and null for those that never can."""
    state = "struct<have:array<string>,levels:array<int>,done:boolean>"
    none = F.struct(F.array().alias("have"), F.transform(tasks, lambda _: F.lit(None)).alias("levels"), F.lit(False).alias("done")).cast(state)

    def wave(acc: Column, r: Column) -> Column:
        given = lambda t: F.forall(F.coalesce(t["inputs"], F.array().cast("array<string>")), lambda k: F.coalesce(F.array_contains(acc["have"], k), F.lit(False)))
        now = F.transform(tasks, lambda t, i: F.get(acc["levels"], i).isNull() & given(t))

        def taken(runs: Column) -> Column:
            outputs = F.flatten(F.transform(F.filter(tasks, lambda t, i: F.get(runs, i)), lambda t: F.coalesce(t["outputs"], F.array().cast("array<string>"))))
            levels = F.zip_with(acc["levels"], runs, lambda old, x: F.when(x, r).otherwise(old))
            return F.struct(F.array_union(acc["have"], F.filter(outputs, lambda k: k.isNotNull())).alias("have"), levels.alias("levels"), (~F.exists(runs, lambda x: x)).alias("done")).cast(state)

        return F.when(acc["done"], acc).otherwise(let(now, taken))

    return F.aggregate(F.sequence(F.lit(0), F.size(tasks) - 1), none, wave, lambda acc: acc["levels"])


def _small_plans(tasks: DataFrame) -> DataFrame:
    """``_levelled`` of plans that fit in a row: one shuffle, no joins or rounds."""
    made = F.array_distinct(F.flatten(F.transform("tasks", lambda t: F.coalesce(t["outputs"], F.array().cast("array<string>")))))
    lacks = lambda t: F.exists(F.coalesce(t["inputs"], F.array().cast("array<string>")), lambda k: ~F.coalesce(F.array_contains(F.col("made"), k), F.lit(False)))
    plans = tasks.groupBy("plan_id").agg(F.collect_list(F.struct("id", "ord", "inputs", "outputs")).alias("tasks"))
    read = plans.withColumns({"levels": _waves(F.col("tasks")), "made": made})
    rows = read.select("plan_id", F.explode(F.transform("tasks", lambda t, i: F.struct(t["id"].alias("id"), t["ord"].alias("ord"), F.get("levels", i).alias("level"), lacks(t).alias("missing")))).alias("t"))
    return rows.select("plan_id", "t.*")


def _large_plans(tasks: DataFrame) -> DataFrame:
    """``_levelled`` of plans of any size, wave by wave over written tables. A wave joins the keys that the one before has newly
    given with what waits for them; there are as many rounds as the deepest plan has waves."""
    same = lambda a, b: a["plan_id"].eqNullSafe(b["plan_id"]) & (a["key"] == b["key"])
    rows = written(tasks.withColumn("n", F.monotonically_increasing_id()))
    keys = lambda c: rows.select("plan_id", "n", F.explode(c).alias("key")).filter("key is not null").distinct()
    needs, gives = written(keys("inputs")), written(keys("outputs"))
    never = F.exists(F.coalesce("inputs", F.array().cast("array<string>")), lambda k: k.isNull())
    waits = rows.select("n", F.size(F.array_distinct(F.coalesce("inputs", F.array().cast("array<string>")))).alias("left"), never.alias("never")).filter(~F.col("never")).drop("never")
    waits, have, levels, level = written(waits), None, [], 0
    while True:
        now = written(waits.filter("left = 0").select("n", F.lit(level).alias("level")))
        if now.isEmpty():
            break
        levels.append(now)
        fresh = gives.join(now.select("n"), "n", "left_semi").select("plan_id", "key").distinct()
        fresh = written(fresh if have is None else fresh.join(have, same(fresh, have), "left_anti"))
        have = fresh if have is None else have.unionByName(fresh)
        got = needs.join(fresh, same(needs, fresh), "left_semi").groupBy("n").agg(F.count(F.lit(1)).alias("got"))
        waits = written(waits.filter("left > 0").join(got, "n", "left").select("n", (F.col("left") - F.coalesce("got", F.lit(0))).cast("int").alias("left")))
        level += 1
    lacking = needs.join(gives, same(needs, gives), "left_anti").select("n").union(rows.filter(never).select("n")).distinct().withColumn("missing", F.lit(True))
    done = reduce(DataFrame.unionByName, levels) if levels else waits.limit(0).select("n", F.lit(0).alias("level"))
    out = rows.select("plan_id", "n", "id", "ord").join(done, "n", "left").join(lacking, "n", "left")
    return out.select("plan_id", "id", "ord", "level", F.coalesce("missing", F.lit(False)).alias("missing"))


def _levelled(tasks: DataFrame) -> DataFrame:
    """(plan_id, id, ord, level, missing): the earliest wave a task can run in, null for those that would wait for ever, and
    whether it has an input that nothing gives. Plans of up to ``ROW_TASKS`` tasks are read in one row each; larger ones,
    that of all tasks without a plan_id among them, are never gathered."""
    own = tasks.select("plan_id", "id", F.col("ord") if "ord" in tasks.columns else F.lit(0).alias("ord"), "inputs", "outputs")
    if own.groupBy("plan_id").count().filter(F.col("count") > ROW_TASKS).isEmpty():
        return _small_plans(own)
    sized = own.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("plan_id")))
    return _small_plans(sized.filter(F.col("size") <= ROW_TASKS).drop("size")).unionByName(_large_plans(sized.filter(F.col("size") > ROW_TASKS).drop("size")))


def _reason() -> Column:
    return F.when(F.col("level").isNull(), F.when(F.col("missing"), MISSING).otherwise(BLOCKED))


def execution_levels(tasks: DataFrame) -> DataFrame:
    """(plan_id, id, level): the earliest wave a task can run in, from 0; tasks that never can are left out."""
    return _levelled(tasks).filter("level is not null").select("plan_id", "id", "level")


def stuck_tasks(tasks: DataFrame) -> DataFrame:
    """(plan_id, id, reason) of tasks that would wait for ever: an own input that nothing gives, or else what they wait
    for is in or behind a cycle or such a task. A null plan_id is a plan of its own; a null key is given by nothing."""
    return _levelled(tasks).withColumn("reason", _reason()).filter("reason is not null").select("plan_id", "id", "reason")


def fold_task_events(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """(plan_id, id, state, result, error) now: the last state wins; result and error each keep their last value. An event
    without id cancels all tasks of its plan."""
    own = events.filter("id is not null")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("event_seq"))).alias(c)
    folded = own.groupBy("plan_id", "id").agg(F.max_by("state", "event_seq").alias("state"), last("result"), last("error"), F.max("event_seq").alias("at"))
    cancelled = events.filter("id is null and state = 'cancelled'").groupBy("plan_id").agg(F.max("event_seq").alias("stop"))
    rows = tasks.select("plan_id", "id").join(folded, ["plan_id", "id"], "left").join(cancelled, "plan_id", "left")
    late = F.col("stop") > F.coalesce("at", F.lit(-1))
    return rows.select("plan_id", "id", F.when(late, "cancelled").otherwise(F.coalesce("state", F.lit("pending"))).alias("state"), "result", "error")


def plan_status(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """(plan_id, completed, first_failed): completed when every task is a success, so an empty plan is."""
    own = tasks.groupBy("plan_id").agg(F.every(F.col("state") == "success").alias("done"), F.min_by(F.when(F.col("state") == "failed", F.col("id")), F.when(F.col("state") == "failed", F.col("ord"))).alias("first_failed"))
    return plans.select("plan_id").join(own, "plan_id", "left").select("plan_id", F.coalesce("done", F.lit(True)).alias("completed"), "first_failed")


def merge_replan(plans: DataFrame) -> DataFrame:
    """plans (plan_id, goal, tasks, failed_id, raw: the new plan's text) -> plan_id, goal, tasks. The new list replaces the
    old, or the old stays where the text can't be parsed; the failed task is pending again without its error, tasks
    without a state are pending, others keep theirs."""
    parsed = _parsed(plans, PLAN)
    tasks = F.when(F.col("__wrong"), F.col("tasks")).otherwise(F.coalesce("__value.tasks", F.array().cast(f"array<{TASK}>")))

    def reset(t: Column) -> Column:
        failed = F.coalesce(t["id"] == F.col("failed_id"), F.lit(False))
        state = F.when(failed | (F.coalesce(t["state"], F.lit("")) == ""), "pending").otherwise(t["state"])
        return t.withField("state", state).withField("error", F.when(failed, F.lit("")).otherwise(t["error"]))

    return parsed.withColumn("tasks", tasks).select("plan_id", "goal", F.transform("tasks", reset).alias("tasks"))


def synthesize_results(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """(plan_id, report): the goal, then each task with its mark and its results (result: map<string,string>) as
    ``map[key:value ...]``, keys in order."""
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce("result", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    line = F.concat(F.when(F.col("state") == "failed", FAILED).otherwise(DONE), F.lit(" "), "description", F.lit(": map["), F.array_join(entries, " "), F.lit("]"))
    lines = tasks.groupBy("plan_id").agg(ordered_text(F.col("ord"), line, "\n").alias("lines"))
    head = F.concat(F.lit(REPORT[0]), "goal", F.lit(REPORT[1]))
    return plans.select("plan_id", "goal").join(lines, "plan_id", "left").select("plan_id", F.concat(head, F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n"), "lines")).otherwise("")).alias("report"))


def plan_state_json(plans: DataFrame) -> DataFrame:
    """(plan_id, state) of plans (plan_id, goal, tasks): goal and tasks as JSON; no tasks are null, a null goal is {}."""
    body = F.to_json(F.struct("goal", F.when(F.size("tasks") > 0, F.col("tasks")).alias("tasks")), {"ignoreNullFields": "false"})
    return plans.select("plan_id", F.when(F.col("goal").isNull(), "{}").otherwise(body).alias("state"))


def resolve_slots(writes: DataFrame) -> DataFrame:
    """(workflow_id, slot, value): the first write without an error wins."""
    return writes.filter("err is null").groupBy("workflow_id", "slot").agg(F.min_by("value", "write_seq").alias("value"))


def route_rows(rows: DataFrame, condition: Column, true_key: str, false_key: str) -> DataFrame:
    """rows with ``route``: true_key where the condition holds, false_key where it doesn't or is null."""
    return rows.withColumn("route", F.when(condition, F.lit(true_key)).otherwise(F.lit(false_key)))


def barrier_complete(slots: DataFrame, waits: DataFrame) -> DataFrame:
    """(workflow_id, complete) of waits (workflow_id, keys array): whether every awaited key is in slots."""
    have = slots.select("workflow_id", F.col("slot").alias("key"), F.lit(True).alias("found")).distinct()
    wanted = waits.select("workflow_id", F.explode_outer("keys").alias("key")).join(have, ["workflow_id", "key"], "left")
    return wanted.groupBy("workflow_id").agg(F.every(F.col("key").isNull() | F.coalesce("found", F.lit(False))).alias("complete"))


def classify_loops(log: DataFrame) -> DataFrame:
    """log (.., iterations, max_iterations, timed_out, cancelled) with status, message, success and error."""
    n = F.col("iterations").cast("string")
    hit = (F.col("max_iterations") > 0) & (F.col("iterations") >= F.col("max_iterations"))
    status = F.when(F.col("timed_out"), "timeout").when(F.col("cancelled"), "cancelled").when(hit, "max_iterations").otherwise("completed")
    # fixed values: the messages
    text = (
        F.when(F.col("status") == "timeout", F.concat(F.lit("timeout: executed "), n, F.lit(" iterations")))
        .when(F.col("status") == "cancelled", F.lit("cancelled: context canceled"))
        .when(F.col("status") == "max_iterations", F.concat(F.lit("max_iterations_reached: "), n, F.lit("/"), F.col("max_iterations").cast("string")))
        .otherwise(F.concat(F.lit("completed: "), n, F.lit(" iterations")))
    )
    out = log.withColumn("status", status).withColumn("message", text)
    return out.withColumns({"success": F.col("status").isin("completed", "condition_failed"), "error": F.col("status").isin("cancelled", "timeout")})


def task_prompts(tasks: DataFrame, slots: DataFrame) -> DataFrame:
    """(plan_id, id, inputs_text, output_template), a row for each task: ``key: value`` lines of its inputs in order, and the
    JSON it is to give. Slots are resolved ones (workflow_id, slot, value); an input without a value has an empty one, and so
    have all of a task without a plan_id. Repeated rows are tasks each."""
    entry = lambda o: F.concat(F.lit('\t"'), o, F.lit('": "' + PLACE[0]), o, F.lit(PLACE[1] + '"'))
    body = F.array_join(F.transform("outputs", entry), ",\n")
    template = F.concat(F.lit("{\n"), body, F.when(F.size("outputs") > 0, "\n").otherwise(""), F.lit("}"))
    values = slots.select(F.col("workflow_id").alias("plan_id"), F.col("slot").alias("key"), "value")
    line = lambda k, v: F.concat(k, F.lit(": "), v)
    empty = F.array_join(F.transform(F.filter("inputs", lambda k: k.isNotNull()), lambda k: line(k, F.lit(""))), "\n")
    asked = tasks.select("plan_id", "inputs").filter(F.col("plan_id").isNotNull() & (F.size("inputs") > 0)).distinct()
    wanted = asked.select("plan_id", "inputs", F.posexplode("inputs").alias("i", "key")).join(values, ["plan_id", "key"], "left")
    told = wanted.groupBy("plan_id", "inputs").agg(ordered_text(F.col("i"), line(F.col("key"), F.coalesce("value", F.lit(""))), "\n").alias("told"))
    out = tasks.select("plan_id", "id", "inputs", template.alias("output_template")).join(told, ["plan_id", "inputs"], "left")
    return out.select("plan_id", "id", F.coalesce("told", empty, F.lit("")).alias("inputs_text"), "output_template")


def audit_plans(tasks: DataFrame) -> DataFrame:
    """(plan_id, n_tasks, ids_ok, size_ok, n_missing, n_blocked): the rules that planners are told but nothing checks."""
    ids_ok = F.every(F.coalesce(F.col("id") == F.concat(F.lit("task_"), F.col("ord").cast("string")), F.lit(False)))
    n = lambda reason: F.count(F.when(F.col("reason") == reason, 1))
    plans = _levelled(tasks).withColumn("reason", _reason()).groupBy("plan_id").agg(F.count(F.lit(1)).alias("n_tasks"), ids_ok.alias("ids_ok"), n(MISSING).alias("n_missing"), n(BLOCKED).alias("n_blocked"))
    return plans.select("plan_id", "n_tasks", "ids_ok", F.col("n_tasks").between(MIN_TASKS, MAX_TASKS).alias("size_ok"), "n_missing", "n_blocked")
