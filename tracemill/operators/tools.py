"""Tool calls over whole tables: resolve, parse, run, screen, pair with results, and rebuild turns.

The registry is a small table by nature (one row per tool) and one name dominates calls, so it is joined by broadcast
after a check of its row count; larger ones are joined by shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import fold_path, json_kind, json_object

REGISTRY_ROWS = 10_000
MAX_TIMEOUT_DEFAULT = 30.0
# fixed values: the patterns that block a command, in order
DANGEROUS = (r"(?i)^rm\s+-rf", r"(?i)mkfs\s+", r"(?i)dd\s+if=/dev/zero", r"(?i)^rd\s+/s", r"(?i)^del\s+/s", ";", "&&", r"\|\|")
NOT_AN_OBJECT = "parse arguments failed: not a JSON object"
BAD_ARGUMENTS = f'{{"error": "{NOT_AN_OBJECT}"}}'


def explode_tool_calls(messages: DataFrame) -> DataFrame:
    """One row per call of an array column ``tool_calls``, with ``ord`` from 0."""
    return messages.select(*[c for c in messages.columns if c != "tool_calls"], F.posexplode("tool_calls").alias("ord", "call"))


def error(text: Column) -> Column:
    """``{"error": "<text>"}`` with the text escaped."""
    return F.concat(F.lit('{"error": '), F.regexp_extract(F.to_json(F.struct(text.alias("e"))), r'(?s)^\{"e":(.*)\}$', 1), F.lit("}"))


def resolve_calls(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """calls with ``found`` and, for unknown names, ``content`` and ``is_error``."""
    if registry.groupBy("name").count().filter("count > 1").limit(1).count():
        raise ValueError("a tool is registered twice")
    names = registry.select(F.col("name").alias("__tool"))
    if names.limit(REGISTRY_ROWS + 1).count() <= REGISTRY_ROWS:
        names = F.broadcast(names)
    joined = calls.join(names, F.col("name") == F.col("__tool"), "left").withColumn("found", F.col("__tool").isNotNull()).drop("__tool")
    content = F.when(~F.col("found"), error(F.concat(F.lit("tool "), F.coalesce("name", F.lit("")), F.lit(" not found"))))
    return joined.withColumns({"content": content, "is_error": ~F.col("found")})


def parse_arguments(calls: DataFrame, arguments: str = "arguments") -> DataFrame:
    """calls with ``ok``, whether the arguments are a JSON object or null by strict rules, and ``args``, the object as a VARIANT,
    in which the last of equal keys counts (see ``json_object``); null for null and where it isn't ok."""
    ok = F.coalesce(json_kind(F.col(arguments)).isin("object", "null"), F.lit(False))
    return calls.withColumns({"ok": ok, "args": json_object(F.col(arguments))})


@dataclass(frozen=True)
class Batch:
    """A Python handler that takes the arguments of many calls at once and gives as many results; an exception among them is
    the error of its call. Where it raises one, the calls of the batch are tried one by one."""

    run: Callable[[list[dict | None]], list[object]]


def _results(handler: Callable[[dict | None], object] | Batch, arguments: list[dict | None]) -> list[object]:
    """What a handler gives for each call, exceptions in their places."""
    if isinstance(handler, Batch) and len(arguments) > 1:
        try:
            out = list(handler.run(arguments))
            if len(out) == len(arguments):
                return out
        except Exception:  # which call it was is found out below
            pass
    one = (lambda a: handler.run([a])[0]) if isinstance(handler, Batch) else handler
    out = []
    for a in arguments:
        try:
            out.append(one(a))
        except Exception as e:  # a handler's failure is that call's result
            out.append(e)
    return out


def _written(result: object) -> tuple[str, bool]:
    """A result as JSON text, and whether it is an error."""
    if not isinstance(result, Exception):
        try:
            return json.dumps(result, ensure_ascii=False, allow_nan=False), False
        except Exception as e:
            result = e
    return json.dumps({"error": str(result)}, ensure_ascii=False), True


def execute_calls(calls: DataFrame, registry: DataFrame, handlers: dict[str, Column | Callable[[dict | None], object] | Batch]) -> DataFrame:
    """(session_id, seq, call_id, content, is_error), one for each call. An unknown tool comes first, then bad arguments,
    then the handler's own error. Handlers that are columns (over ``arguments`` as text or ``args`` as VARIANT) run as such.
    Calls of tools with Python handlers take a way of their own: only they cross to a worker, in Arrow batches, tool by tool."""
    native = {k: h for k, h in handlers.items() if isinstance(h, Column)}
    python = {k: h for k, h in handlers.items() if not isinstance(h, Column)}
    keys = ["session_id", "seq", "call_id"]

    def checked(rows: DataFrame) -> DataFrame:
        done = parse_arguments(resolve_calls(rows, registry))
        good = F.col("found") & F.col("ok")
        own = reduce(lambda acc, k: acc.when(F.col("name") == k, native[k]), native, F.when(F.lit(False), F.lit("")))
        no_handler = good & ~F.coalesce(F.col("name").isin(list(handlers)), F.lit(False))
        content = F.when(~F.col("found"), F.col("content")).when(~F.col("ok"), F.lit(BAD_ARGUMENTS)).when(no_handler, error(F.lit("no handler"))).otherwise(own)
        return done.withColumn("content", content).withColumn("is_error", ~good | no_handler)

    if not python:
        return checked(calls).select(*keys, "content", "is_error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, errors, names = (batch.column(c).to_pylist() for c in ("content", "is_error", "name"))
            arguments = batch.column("arguments").to_pylist()
            for name, handler in python.items():
                asked = [i for i, n in enumerate(names) if n == name and not errors[i]]
                for i, result in zip(asked, _results(handler, [json.loads(arguments[i]) for i in asked])):
                    contents[i], errors[i] = _written(result)
            kept = {c: batch.column(c) for c in keys}
            yield pa.RecordBatch.from_pydict(kept | {"content": pa.array(contents, pa.string()), "is_error": pa.array(errors, pa.bool_())})

    by_python = F.coalesce(F.col("name").isin(list(python)), F.lit(False))
    here = checked(calls.filter(~by_python)).select(*keys, "content", "is_error")
    there = checked(calls.filter(by_python)).select(*keys, "content", "is_error", "name", "arguments")
    return here.union(there.mapInArrow(run, here.schema))


def screen_commands(commands: DataFrame, command: str = "command") -> DataFrame:
    """commands with ``rule`` (the first pattern that matches, from 1), ``blocked`` and ``error``."""
    rule = F.coalesce(*[F.when(F.col(command).rlike(p), F.lit(i + 1)) for i, p in enumerate(DANGEROUS)])
    text = F.when(F.coalesce(F.col(command), F.lit("")) == "", F.lit("command must be a non-empty string")).when(F.col("rule").isNotNull(), F.concat(F.lit("dangerous command blocked: "), F.col(command)))
    return commands.withColumn("rule", rule).withColumn("error", text).withColumn("blocked", F.col("rule").isNotNull())


def confine_paths(paths: DataFrame, base: str, path: str = "path") -> DataFrame:
    """paths with ``relative`` to base after folding . and .. in the text alone, and ``denied`` where that starts with
    two dots (a name that does so at the top is denied too)."""
    whole = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit(base + "/"), F.col(path)))
    top = [p for p in base.split("/") if p not in ("", ".")]
    folded = paths.withColumn("__p", fold_path(whole))
    same = reduce(lambda acc, i: F.when(F.coalesce(F.get("__p", F.lit(i)) == top[i], F.lit(False)), F.lit(i + 1)).otherwise(F.lit(i)) if acc is None else F.when((acc == i) & F.coalesce(F.get("__p", F.lit(i)) == top[i], F.lit(False)), F.lit(i + 1)).otherwise(acc), range(len(top)), None)
    shared = F.lit(0) if same is None else same
    rest = F.slice("__p", shared + 1, F.size("__p"))
    steps = F.concat(F.array_repeat(F.lit(".."), F.lit(len(top)) - shared), rest)
    out = folded.withColumn("relative", F.when(F.size(steps) == 0, F.lit(".")).otherwise(F.array_join(steps, "/")))
    return out.withColumn("denied", F.col("relative").startswith("..")).drop("__p")


def _kind(key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("args", f"$.{key}", "variant"))


def _text(key: str) -> Column:
    """A string of the arguments; other types aren't strings."""
    return F.when(_kind(key) == "STRING", F.try_variant_get("args", f"$.{key}", "string"))


def check_arguments(calls: DataFrame) -> DataFrame:
    """calls (arguments: JSON text, read as ``parse_arguments`` does) with the typed values of a command call: command, timeout
    in whole seconds (30 unless it is a number over 0), cwd (only when it isn't empty), and ``error``."""
    number = F.when(_kind("timeout").rlike("^(BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT|FLOAT)"), F.try_variant_get("args", "$.timeout", "double"))
    typed = {"command": _text("command"), "timeout_s": F.floor(F.when(number > 0, number).otherwise(F.lit(MAX_TIMEOUT_DEFAULT))).cast("long"), "cwd": F.nullif(_text("cwd"), F.lit(""))}
    out = parse_arguments(calls).withColumns(typed)
    return out.withColumn("error", F.when(~F.col("ok"), NOT_AN_OBJECT).when(F.coalesce("command", F.lit("")) == "", "command must be a non-empty string")).drop("ok", "args")


def check_file_arguments(calls: DataFrame, content: bool = False, default: str | None = None) -> DataFrame:
    """calls (arguments: JSON text, read as ``parse_arguments`` does) with ``path``, with ``content`` where it is asked for, and
    ``error``. The path is a string that isn't empty, or else ``default`` (an error where there is none); the content is a
    string, which may be empty."""
    out = parse_arguments(calls)
    out = out.withColumn("path", F.when(F.col("ok"), F.coalesce(F.nullif(_text("path"), F.lit("")), F.lit(default))))
    error_ = F.when(~F.col("ok"), NOT_AN_OBJECT).when(F.col("path").isNull(), "path must be a non-empty string")
    if content:
        out = out.withColumn("content", _text("content"))
        error_ = error_.when(F.col("content").isNull(), "content must be a string")
    return out.withColumn("error", error_).drop("ok", "args")


def join_calls_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(session_id, call_id, name, content, is_error, status): answered, unanswered, or an orphan result."""
    both = calls.select("session_id", "call_id", "name", F.lit(True).alias("a")).join(results.select("session_id", "call_id", "content", "is_error", F.lit(True).alias("b")), ["session_id", "call_id"], "full_outer")
    status = F.when(F.col("a") & F.col("b"), "answered").when(F.col("a"), "unanswered").otherwise("orphan")
    return both.select("session_id", "call_id", "name", "content", "is_error", status.alias("status"))


def reconstruct_turns(messages: DataFrame) -> DataFrame:
    """messages (session_id, seq, role, content, n_calls): one row per turn, which starts with a user message.
    rounds: assistant messages with calls; calls: their calls; final: the first assistant message without."""
    turn = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("seq"))
    rows = messages.withColumn("turn_id", turn).filter("turn_id > 0")
    said = F.col("role") == "assistant"
    asks = said & (F.coalesce("n_calls", F.lit(0)) > 0)
    return rows.groupBy("session_id", "turn_id").agg(
        F.min("seq").alias("first_seq"),
        F.sum(F.when(asks, 1).otherwise(0)).alias("rounds"),
        F.sum(F.when(asks, F.col("n_calls")).otherwise(0)).cast("long").alias("calls"),
        F.min_by(F.when(said & ~asks, F.col("content")), F.when(said & ~asks, F.col("seq"))).alias("final"),
    )
