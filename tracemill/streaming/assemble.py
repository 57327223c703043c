"""Live folds of streamed responses, with Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from tracemill.operators.streams import DONE, MAX_CALLS, PARTS, chunk, count_refused, data_lines, fold_calls
from tracemill.sources.tables import CALL

OUT = f"stream_id string, role string, content string, reasoning_content string, tool_calls array<{CALL}>, n_chunks long, refused long, last_seq long, complete boolean, cancelled boolean"
FOLDED = "stream_id string, role string, content string, reasoning_content string, parts string, n_chunks long, last_seq long, complete boolean, cancelled boolean"
CHUNK = "seq:long,role:string,content:string,reasoning_content:string,parts:string,stop:boolean"
PACKED = f"stream_id string, ms long, end long, chunks array<struct<{CHUNK}>>"
KEPT = "pack string"
STATUS = "open boolean, last long, due long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE = 60_000
PACK = 1 << 17
PACK_BYTES = 1 << 25
NEVER = np.iinfo(np.int64).max


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one line each to rows of one stream each, with its chunks as a list: a combiner in front of the shuffle, so that
    the fold gets a row for some thousand lines of a task and not for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK or sum(b.nbytes for b in held) >= PACK_BYTES:
            yield _pack(held)
            held = []
    if any(b.num_rows for b in held):
        yield _pack(held)


def _pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().sort_by([("stream_id", "ascending"), ("seq", "ascending")]).combine_chunks()
    runs = pc.run_end_encode(rows["stream_id"].combine_chunks(), pa.int32())
    ends = runs.run_ends.to_numpy()
    starts = np.append(0, ends[:-1])
    chunk_at = rows["is_chunk"].combine_chunks()
    before = np.append(0, np.cumsum(chunk_at.to_numpy(zero_copy_only=False)))
    fields = [f.name for f in rows.schema.field("chunk").type]
    own = pa.StructArray.from_arrays([rows["chunk"].combine_chunks().field(i).filter(chunk_at) for i in range(len(fields))], fields)
    lists = pa.ListArray.from_arrays(pa.array(np.append(before[starts], before[-1]), pa.int32()), own)
    done = rows["done"].combine_chunks().to_numpy(zero_copy_only=False)
    end = np.minimum.reduceat(np.where(done, rows["seq"].to_numpy(), NEVER), starts)
    newest = np.maximum.reduceat(rows["ms"].to_numpy(), starts)
    return pa.RecordBatch.from_arrays([runs.values, pa.array(newest), pa.array(end, mask=end == NEVER), lists], ["stream_id", "ms", "end", "chunks"])


class _Fold(StatefulProcessor):
    """An open stream has its packs of chunks in a list that grows by what comes in, and a timer that its newest line moves. Once its
    message is sent, a mark stays in place of the list, so that later lines are known to be late, until its own timer."""

    def __init__(self, idle_ms: int, keep_ms: int):
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", STATUS)
        self.packs = handle.getListState("packs", KEPT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = self.status.get()
        is_open, last, due = found or (True, 0, None)
        if not is_open:
            return
        new, end, stopped = [], None, False
        for r in rows:
            last = max(last, r.ms)
            if r.end is not None:
                end = r.end if end is None else min(end, r.end)
            if r.pack != "[]":
                new.append(r.pack)
                stopped = stopped or r.stopped
        if end is None and not stopped:
            if new:
                self.packs.appendList([(p,) for p in new])
            self._wait(True, last, last + self.idle_ms, due)
            return
        yield self._message(key[0], ([r[0] for r in self.packs.get()] if found else []) + new, end)
        self._close(last, due, bool(found))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[Row]:
        is_open, last, due = self.status.get() or (False, 0, None)
        if is_open:
            yield self._message(key[0], [r[0] for r in self.packs.get()], None)
            self._close(last + self.idle_ms, None, True)
        else:
            self.status.clear()

    def _wait(self, is_open: bool, last: int, due: int, before: int | None) -> None:
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        self.status.update((is_open, last, due))

    def _close(self, at: int, due: int | None, stored: bool) -> None:
        if stored:
            self.packs.clear()
        self._wait(False, at, at + self.keep_ms, due)

    @staticmethod
    def _message(stream_id: str, packs: list[str], end: int | None) -> Row:
        rows = (r for pack in packs for r in json.loads(pack))
        own = sorted((r for r in rows if end is None or r["seq"] < end), key=lambda r: r["seq"])
        at = next((i for i, r in enumerate(own) if r["stop"]), None)
        own = own if at is None else own[: at + 1]
        role = next((r["role"] for r in reversed(own) if r["role"]), "" if own else "assistant")
        parts = ",".join(p[1:-1] for r in own if len(p := r.get("parts") or "") > 2)
        text = {c: "".join(r[c] for r in own) for c in ("content", "reasoning_content")}
        last = own[-1]["seq"] if own else None
        return Row(stream_id=stream_id, role=role, **text, parts=f"[{parts}]", n_chunks=len(own), last_seq=last, complete=at is None and end is not None, cancelled=at is not None)


def assemble_messages_streaming(
    lines: DataFrame, idle_ms: int = 10 * MINUTE, keep_ms: int = 60 * MINUTE, delay: str = "10 minutes", stop: Column | None = None, max_calls: int = MAX_CALLS
) -> DataFrame:
    """The message of ``assemble_messages`` for each stream of ``lines`` (stream_id, seq, line, time), sent once:

    - when its [DONE] is there: ``complete``. Lines may come in any order up to the batch of [DONE];
    - when a chunk is there for which ``stop``, a condition on the columns of ``parse_chunks``, holds: ``cancelled``, with the
      chunks up to that one;
    - when event time passes its newest line by ``idle_ms``: neither.

    Lines that come later are ignored, as a reader that has gone doesn't read them: a mark of a few bytes stays for
    ``keep_ms`` of event time. After that, a line of the same stream begins a new one, so ``keep_ms`` should span how late
    lines come. Event time is the newest ``time`` of all streams less ``delay``; lines older than it are dropped by the engine,
    unless a newer line of their stream came with them: lines of a stream that one task reads go to the fold as one row.
    All timers are on event time, so a query that is triggered for what is available now ends. State holds the chunks of open
    streams, in packs that are written once, and marks; it needs RocksDB (see ``run_once``).
    """
    rows = data_lines(lines, "time").withColumn("c", chunk(F.col("data")))
    halted = F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(False)
    flat = rows.select("stream_id", "seq", F.unix_millis("time").alias("ms"), "data", *(F.col(f"c.{c}").alias(c) for c in ("role", "content", "reasoning_content", "tool_calls", "finish_reason", "usage")), "c")
    kept = F.struct("seq", "role", "content", "reasoning_content", F.to_json("tool_calls").alias("parts"), halted.alias("stop"))
    each = flat.select("stream_id", "seq", "ms", (F.col("data") == DONE).alias("done"), F.col("role").isNotNull().alias("is_chunk"), kept.alias("chunk"))
    packs = each.mapInArrow(_packed, PACKED).withColumn("time", F.timestamp_millis("ms")).withWatermark("time", delay)
    chunks = packs.select("stream_id", "time", "ms", "end", F.exists("chunks", lambda c: c["stop"]).alias("stopped"), F.to_json("chunks").alias("pack"))
    folded = chunks.groupBy("stream_id").transformWithState(_Fold(idle_ms, keep_ms), FOLDED, "Append", "EventTime")
    parts = F.from_json("parts", PARTS)
    calls = fold_calls(parts, max_calls).cast(f"array<{CALL}>").alias("tool_calls")
    return folded.select("stream_id", "role", "content", "reasoning_content", calls, "n_chunks", count_refused(parts, max_calls).alias("refused"), "last_seq", "complete", "cancelled")


def fan_out(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Gives every micro-batch to every sink, computed once; a sink gets the batch id, so that it can write again safely.
    A failing sink fails the batch, which then goes to all of them again."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing what a stream gives for the input that is there now, with state in RocksDB. A later start with the same
    folders goes on with what has come in since."""
    spark: SparkSession = stream.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)  # a query takes the session's settings when it starts
    try:
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """``start_once``, and waits for its end."""
    start_once(stream, path, checkpoint).awaitTermination()
