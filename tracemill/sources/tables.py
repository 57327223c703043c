"""Fixed-schema tables: Parquet and JSON lines of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = "struct<id:string,type:string,function:struct<name:string,arguments:string>>"
RESULT = "struct<call_id:string,content:string,is_error:boolean>"
MESSAGES = "id string, session_id string, seq long, role string, content string, reasoning_content string, ts long, metadata string"
CHAT = f"session_id string, seq long, role string, content string, reasoning_content string, name string, partial boolean, tool_calls array<{CALL}>, tool_results array<{RESULT}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_messages``, whether in buckets or not."""
    return spark.read.schema(MESSAGES).parquet(path).select(*T.StructType.fromDDL(MESSAGES).names)


def write_messages(messages: DataFrame, path: str, buckets: int = 0) -> None:
    """Messages clustered by session and sorted in it; with ``buckets``, in folders that a later save can replace alone."""
    columns = T.StructType.fromDDL(MESSAGES).names
    out = messages.select(*columns)
    if buckets:
        out = out.withColumn("bucket", F.pmod(F.hash("session_id"), F.lit(buckets))).repartition("bucket").sortWithinPartitions("bucket", "session_id", "seq")
        out.write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        out.repartition("session_id").sortWithinPartitions("session_id", "seq").write.parquet(path)


def _present(c: str) -> Column:
    return F.when(F.size(c) > 0, F.col(c)).alias(c)


def chat_json(messages: DataFrame) -> DataFrame:
    """(value): one JSON object per message; optional fields that are empty are left out."""
    empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    partial = F.when(F.col("partial"), F.lit(True)).alias("partial")
    fields = ["session_id", "seq", "role", "content", empty("reasoning_content"), empty("name"), partial, _present("tool_calls"), _present("tool_results")]
    return messages.select(F.to_json(F.struct(*fields)).alias("value"))


def from_chat_json(lines: DataFrame) -> DataFrame:
    """The reverse of ``chat_json``: absent strings are empty, absent lists are empty lists."""
    m = lines.select(F.from_json("value", CHAT).alias("m")).select("m.*")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("role", "content", "reasoning_content", "name")}
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return m.withColumns(blank | {"partial": F.coalesce("partial", F.lit(False)), "tool_calls": F.coalesce("tool_calls", none(CALL)), "tool_results": F.coalesce("tool_results", none(RESULT))})


def write_chat_json(messages: DataFrame, path: str) -> None:
    chat_json(messages).write.text(path)


def read_chat_json(spark: SparkSession, path: str) -> DataFrame:
    return from_chat_json(spark.read.text(path))


def read_sse_lines(spark: SparkSession, path: str, live: bool = False, files_per_trigger: int = 8, timed: bool = False) -> DataFrame:
    """(stream_id, seq, line, time) of a captured log: text files whose lines are ``stream_id<TAB>seq<TAB>event line``, or with
    ``timed`` ``stream_id<TAB>seq<TAB>milliseconds<TAB>event line``; else time is that of the file. The order of lines in
    files means nothing. Lines without numbers in their places are left out. ``live``: a stream of new files."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path) if live else spark.read.text(path)
    part = F.split("value", "\t", 4 if timed else 3)
    number = lambda i: F.get(part, F.lit(i)).try_cast("long")
    time = F.timestamp_millis(number(2)) if timed else F.col("_metadata.file_modification_time")
    named = rows.select(F.get(part, F.lit(0)).alias("stream_id"), number(1).alias("seq"), F.get(part, F.lit(3 if timed else 2)).alias("line"), time.alias("time"))
    return named.filter("seq is not null and line is not null and time is not null")


def read_sse_files(spark: SparkSession, path: str, live: bool = False, files_per_trigger: int = 8, name: Column | None = None) -> DataFrame:
    """(stream_id, seq, line, time) of files that hold the event lines of one response each, however large: a file is read in
    splits, by as many tasks. The stream is the file's name, or ``name``, a column of ``_metadata``; time is the file's.

    seq is the number of the line in the file, from 0: lines are counted by split, and the counts, one row a split, tell each
    split where to begin. ``live``, where counts of other splits can't be waited for, it is the place where the line's split begins
    plus the number of the line in it: not gapless, but in the order of lines, since no line is shorter than a byte."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1) if name is None else name
    rows = (spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if live else spark.read).text(path)
    placed = rows.select(name.alias("stream_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_modification_time").alias("time"), F.col("value").alias("line"))
    if live:
        return placed.mapInArrow(_number_lines, placed.schema).select("stream_id", F.col("start").alias("seq"), "line", "time")
    numbered = placed.withColumn("n", F.monotonically_increasing_id())
    splits = numbered.groupBy("file", "start").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "start", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return numbered.join(begins, ["file", "start"]).select("stream_id", (F.col("n") + F.col("shift")).alias("seq"), "line", "time")


def _number_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to ``start`` the number of the row among those of its split, which come one after another."""
    at, n = None, 0
    for batch in batches:
        splits = list(zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()))
        out = []
        for split in splits:
            at, n = (at, n + 1) if split == at else (split, 0)
            out.append(split[1] + n)
        columns = {c: pa.array(out, pa.int64()) if c == "start" else batch.column(c) for c in batch.schema.names}
        yield pa.RecordBatch.from_pydict(columns)


def write_sse_lines(lines: DataFrame, path: str, mode: str = "error", timed: bool = False) -> None:
    """The reverse of ``read_sse_lines``; the rows of a stream go to one file."""
    time = [F.unix_millis("time").cast("string")] if timed else []
    lines.repartition("stream_id").select(F.concat_ws("\t", "stream_id", F.col("seq").cast("string"), *time, "line").alias("value")).write.mode(mode).text(path)
