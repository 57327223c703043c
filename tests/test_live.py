"""Live folds over several deliveries and starts, and files that several tasks read."""

import datetime
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.jobs import stream_queries
from tracemill.jobs.fixtures import BAD_CHUNKS
from tracemill.operators import streams as S
from tracemill.sources import tables
from tracemill.streaming import assemble

MINUTE = 60


def chunk(content, **more):
    return "data: " + json.dumps({"choices": [{"delta": {"content": content, **more}}]})


class Feed:
    """A folder that deliveries are written to, and the messages that come out of it."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.seconds = spark, f"file://{path}", options, 60

    def deliver(self, *rows):
        """rows: (stream, seq, seconds, line)"""
        timed = [(a, b, datetime.datetime.fromtimestamp(1_700_000_000 + c, datetime.UTC), x) for a, b, c, x in rows]
        tables.write_sse_lines(self.spark.createDataFrame(timed, "stream_id string, seq long, time timestamp, line string").coalesce(1), f"{self.path}/feed", "append", timed=True)

    def run(self):
        lines = tables.read_sse_lines(self.spark, f"{self.path}/feed", live=True, timed=True)
        query = assemble.start_once(assemble.assemble_messages_streaming(lines, **self.options), f"{self.path}/out", f"{self.path}/state")
        assert query.awaitTermination(self.seconds), "a query for what is available now must end"
        states = [s for p in query.recentProgress for s in p["stateOperators"]]
        self.rows_in_state = states[-1]["numRowsTotal"] if states else 0
        out = self.spark.read.schema(assemble.OUT).parquet(f"{self.path}/out").collect()
        return sorted((r.stream_id, r.content, r.n_chunks, r.complete, r.cancelled) for r in out)


def test_lines_after_done_in_later_batches(spark, tmp_path):
    """They add no message and no state, in whatever delivery they come."""
    feed = Feed(spark, tmp_path)
    feed.deliver(("s", 1, 0, chunk("b")), ("t", 0, 0, chunk("x")))
    assert feed.run() == []
    feed.deliver(("s", 0, 1, chunk("a")), ("s", 2, 2, "data: [DONE]"), ("s", 3, 2, chunk("LATE")))
    done = [("s", "ab", 2, True, False)]
    assert feed.run() == done
    before = feed.rows_in_state
    feed.deliver(("s", 4, 3, chunk("LATER")))
    feed.deliver(("s", 5, 4, "data: [DONE]"))
    assert feed.run() == done and feed.rows_in_state <= before
    feed.deliver(("t", 1, 5, "data: [DONE]"))
    assert feed.run() == done + [("t", "x", 1, True, False)]


def test_idle_streams_end_by_event_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, idle_ms=5 * MINUTE * 1000, keep_ms=20 * MINUTE * 1000, delay="1 minute")
    feed.deliver(("s", 0, 0, chunk("a")), ("u", 0, 0, chunk("u")))
    assert feed.run() == []
    feed.deliver(("s", 1, 4 * MINUTE, chunk("b")))
    assert feed.run() == []
    feed.deliver(("clock", 0, 7 * MINUTE, chunk("c")))  # u has been idle for longer than 5 minutes, s for 3
    assert feed.run() == [("u", "u", 1, False, False)]
    feed.deliver(("s", 2, 8 * MINUTE, "data: [DONE]"), ("u", 1, 8 * MINUTE, chunk("late")))
    want = [("s", "ab", 2, True, False), ("u", "u", 1, False, False)]
    assert feed.run() == want
    feed.deliver(("clock", 1, 100 * MINUTE, "data: [DONE]"))
    assert feed.run() == [("clock", "c", 1, True, False)] + want
    feed.deliver(("next", 0, 300 * MINUTE, "data: [DONE]"))
    feed.run()
    assert feed.rows_in_state <= 4  # one mark and its timer: all others have gone


def test_live_stop(spark, tmp_path):
    """A stream ends with the first chunk that stops it; the batch operator cuts at the same place."""
    rows = [("s", i, i, chunk(x)) for i, x in enumerate("abcSdS")] + [("t", 0, 0, chunk("a")), ("t", 1, 1, "data: [DONE]"), ("u", 0, 0, chunk("S"))]
    feed = Feed(spark, tmp_path, stop=F.col("content") == "S")
    for low, high in ((0, 2), (2, 5), (5, 9)):
        feed.deliver(*[r for r in rows if low <= r[1] < high])
        got = feed.run()
    assert got == [("s", "abcS", 4, False, True), ("t", "a", 1, True, False), ("u", "S", 1, False, True)]
    lines = spark.createDataFrame([(a, b, x) for a, b, _, x in rows], "stream_id string, seq long, line string")
    cut = S.assemble_messages(S.cut_stream(S.parse_sse(lines), F.col("content") == "S"))
    assert sorted((r.stream_id, r.content, r.n_chunks) for r in cut.collect()) == [g[:3] for g in got]


@pytest.mark.parametrize("text", BAD_CHUNKS)
def test_nearly_chunks(spark, text):
    lines = spark.createDataFrame([("s", 0, f"data: {text}"), ("s", 1, chunk("a")), ("s", 2, "data: [DONE]")], "stream_id string, seq long, line string")
    assert [r.content for r in S.parse_sse(lines).collect()] == ["a"]


def test_chunks_with_nulls_and_more(spark):
    """Nulls stand for nothing, unknown fields are ignored, the last of equal keys counts."""
    good = ['{"choices":[null]}', '{"choices":[{"delta":null,"usage":null}]}', '{"choices":[{"delta":{"role":null,"content":"a","content":"b","x":[1]}}],"y":{}} ', '{"choices":[{"delta":{"tool_calls":[null]}}]}']
    rows = S.parse_sse(spark.createDataFrame([("s", i, f"data: {x}") for i, x in enumerate(good)], "stream_id string, seq long, line string"))
    assert [(r.role, r.content) for r in rows.orderBy("seq").collect()] == [("", ""), ("", ""), ("", "b"), ("", "")]


def test_running_fold_of_a_long_stream(spark):
    """100,000 chunks of one stream, in batches."""
    calls = F.when(F.col("id") % 1000 == 0, F.from_json(F.lit('[{"index":1,"id":"c","function":{"name":"f","arguments":"x"}}]'), S.PARTS))
    chunks = spark.range(100_000).select(F.lit("s").alias("stream_id"), F.col("id").alias("seq"), F.when(F.col("id") == 5, "assistant").otherwise("").alias("role"), F.lit("t").alias("content"), F.lit("").alias("reasoning_content"), calls.alias("tool_calls"))
    rows = S.chunk_states(chunks.repartition(7)).select("seq", "role", "is_tool_call", F.length(F.col("tool_calls")[1]["function"]["arguments"]).alias("n")).orderBy("seq").collect()
    assert [r.n for r in rows] == [i // 1000 + 1 for i in range(100_000)] and all(r.is_tool_call for r in rows) and [r.role for r in rows[4:6]] == ["", "assistant"]


def test_large_files_are_read_in_splits(spark, tmp_path):
    """seq is the number of the line, whatever the split; live it is in the same order."""
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    text = [f"line {i} " + "x" * (i % 300) for i in range(4000)]
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / name).write_text("\n".join(text) + "\n")
    try:
        spark.conf.set(key, 50_000)
        read = tables.read_sse_files(spark, f"file://{tmp_path}/in")
        assert spark.read.text(f"file://{tmp_path}/in").rdd.getNumPartitions() > 8
        want = [(n, i, x) for n in ("a", "b") for i, x in enumerate(text)]
        assert sorted(tuple(r)[:3] for r in read.collect()) == want
        live = tables.read_sse_files(spark, f"file://{tmp_path}/in", live=True)
        assemble.run_once(live, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        rows = spark.read.parquet(f"file://{tmp_path}/out").orderBy("stream_id", "seq").collect()
        assert [(r.stream_id, r.line) for r in rows] == [(n, x) for n, _, x in want]
    finally:
        spark.conf.set(key, before)


def test_a_hot_stream_is_folded_by_spans(spark, monkeypatch):
    """One stream has nearly all chunks; whatever the span, the message is the same, and no group of rows is larger than it."""
    role, part = F.when(F.col("seq") % 700 == 3, F.concat(F.lit("r"), "seq")).otherwise(""), F.from_json(F.lit('[{"index":0,"function":{"arguments":"x"}},{"index":-1}]'), S.PARTS)
    ids = spark.range(30_000).select(F.when(F.col("id") % 1000 == 7, "t").otherwise("s").alias("stream_id"), (F.col("id") * 3 - 5000).alias("seq"))
    chunks = ids.select("stream_id", "seq", role.alias("role"), F.concat("seq", F.lit(",")).alias("content"), F.lit("").alias("reasoning_content"), F.when(F.col("seq") % 1500 == 1, part).alias("tool_calls")).repartition(5)
    rows = chunks.collect()
    want = {}
    for k in ("s", "t"):
        own = sorted((r for r in rows if r.stream_id == k), key=lambda r: r.seq)
        n = sum(r.tool_calls is not None for r in own)
        want[k] = ([r.role for r in own if r.role][-1] if any(r.role for r in own) else "", "".join(r.content for r in own), "x" * n, n, len(own))
    for span in (4096, 10, 1 << 30):
        monkeypatch.setattr(S, "SPAN", span)
        out = S.assemble_messages(chunks)
        assert {r.stream_id: (r.role, r.content, "".join(c.function.arguments for c in r.tool_calls), r.refused, r.n_chunks) for r in out.collect()} == want
    text = S.assemble_messages(chunks)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(stream_id") == 2 and "span" in text


def test_lines_of_a_task_are_one_row_a_stream(monkeypatch):
    """Whatever the batches, and with lines that aren't chunks."""
    fields = ("seq", "role", "content", "reasoning_content", "parts", "stop")
    rows = [{"stream_id": f"s{i % 3}", "seq": i, "ms": 1000 - i, "done": i in (40, 43, 70), "is_chunk": i % 4 > 0, "chunk": dict(zip(fields, (i, "", f"c{i}", "", None, i == 5)))} for i in range(90)]
    schema = pa.schema([("stream_id", pa.string()), ("seq", pa.int64()), ("ms", pa.int64()), ("done", pa.bool_()), ("is_chunk", pa.bool_()), ("chunk", pa.struct([("seq", pa.int64()), *((f, pa.string()) for f in fields[1:5]), ("stop", pa.bool_())]))])
    batches = pa.Table.from_pylist(rows[::-1], schema).to_batches(max_chunksize=7)
    out = [r for b in assemble._packed(iter(batches)) for r in b.to_pylist()]
    assert [(r["stream_id"], r["ms"], r["end"]) for r in out] == [("s0", 1000, None), ("s1", 999, 40), ("s2", 998, None)]
    assert [[c["seq"] for c in r["chunks"]] for r in out] == [[i for i in range(90) if i % 3 == k and i % 4] for k in range(3)]
    monkeypatch.setattr(assemble, "PACK", 10)
    few = [r for b in assemble._packed(iter(batches)) for r in b.to_pylist()]
    assert len(few) <= 24 and sorted(c["seq"] for r in few for c in r["chunks"]) == [i for i in range(90) if i % 4]
    assert not list(assemble._packed(iter([batches[0].slice(0, 0)])))


def test_streamed_answers_are_folded_once(spark):
    """Of the plan that gives the history, only the users' messages read the conversations, in two places."""
    plan = stream_queries.w2_stream_to_history(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "conv_id" in x for x in plan.splitlines()) == 2
