"""Best-fit packing by minimum bin slack.

Documents become token sequences (ids, then an end id). Only documents over the capacity are cut; all their pieces are
full but the first, which holds the remainder. A full piece is a sequence of its own. For the rest, bins are built one
after another: the longest length left opens a bin, and a bitset subset-sum over the lengths that are left finds the
combination that fills it most; the combination is taken out as often as the counts allow.

Scale: the search sees only how many pieces have each length: at most ``capacity`` counts, whatever the corpus, so the
plan is made on the driver and has a bounded size. Pieces then get a rank within their length (local rank in salted
(bucket, length) groups plus the counts of earlier buckets, so one common length isn't one task) and look up their place
in the plan. Token ids are made once; the pieces, without ids, are written to the shared folder.

Defined cases: null and empty texts are the end id alone; repeated rows and repeated doc_ids are packed like others;
doc_id may be null; a very long text is encoded whole by one task; an empty table gives no pieces; other columns, also ones
called ``piece``, ``rank`` or ``bucket``, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import tokens
from tracemill.llm.common import partitions, written

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    paths = paths or tokens.byte_bpe_paths()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*tokens.encode(text.as_py() or "", paths), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often each, with the largest sum up to ``room``: bitset subset-sum, longest lengths first."""
    reach, seen, full = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:
            step = min(step, left)
            seen.append((length, step, reach))
            reach |= (reach << length * step) & full
            left, step = left - step, step * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, step, before in reversed(seen):
        if not before >> at & 1:  # not reached without this item
            out[length] = out.get(length, 0) + step
            at -= length * step
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank_from, rank_to, times, sequence, offset): ranks of a length go to ``times`` sequences in turn, the
    next ones behind them in the same sequences."""
    left, used, rows, sequence = {k: v for k, v in histogram.items() if v}, {}, [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        combination = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times, offset = min(left[k] // n for k, n in combination.items()), 0
        for length, n in combination.items():
            start = used.get(length, 0)
            rows.append((length, start, start + n * times, times, sequence, offset))
            used[length] = start + n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
            offset += n * length
        sequence += times
    return sorted(rows)


def place(ranked: DataFrame, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """Adds sequence_id and offset to rows with a 0-based ``rank`` within their length."""
    width = 1 << 44
    length, start, _, times, sequence, offset = (np.array(x, np.int64) for x in zip(*rows))
    keys = length * width + start

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(keys, n * width + rank, "right") - 1
            k = rank - start[i]
            out = {x: batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(sequence[i] + k % times[i]), "offset": pa.array(offset[i] + k // times[i] * n)})

    return ranked.mapInArrow(look, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces with the sequence each is in and its place there."""
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, end_id, paths))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if not histogram:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * partitions(spark))))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy("bucket", "length").count().select("bucket", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("local", local).join(before, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    return place(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), plan(histogram, capacity))
