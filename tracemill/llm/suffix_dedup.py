"""Exact substring dedup over bytes by range-partitioned suffixes.

Every suffix is ordered by its first ``length`` bytes; a string of that length repeats where equal neighbours meet. Suffixes
travel in blocks that share an anchor (see ``anchors``), since each by itself would be written hundreds of times the input.
Sampled splitters range-partition the blocks by the leading eight bytes of their anchors. In a range the different suffixes are
brought into the order of their bytes by multikey quicksort, and neighbours are compared byte by byte.

Boundaries: equal strings have equal anchors, and a lead that fills several ranges is cut by the hash of its gram, so all
blocks of a gram are in one range and equal strings never lie on both sides of a boundary: none is left to compare there. The
suffixes of hot grams are dealt by a 128-bit hash of the string instead.

Defined cases: null and empty texts have no bytes; texts under ``length`` bytes keep all; overlapping repeats within a
document count; repeated rows are copies of each other; an empty table gives an empty table; other columns are ignored; a
very long text is one row, and its task needs about thirty times its size. Kept bytes may cut a character in two, so they are
binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import anchors as A
from tracemill.llm import exchange as X
from tracemill.llm import hashing as H
from tracemill.llm.common import text_bytes

LENGTH = 400
GRAM = 128
PART_BYTES = 8 << 20
SAMPLES = 16
_SIGN = np.uint64(1 << 63)  # leads are unsigned, Spark's numbers aren't
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _blocks(texts: list[bytes], length: int, gram: int) -> A.Blocks:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return A.Blocks(data, lambda a, b: H.byte_values(data[a:b]), np.cumsum([len(x) for x in texts], dtype=np.int64), length, gram)


def splitters(docs: DataFrame, parts: int, total: int, length: int, gram: int) -> np.ndarray:
    """Leads of the anchors of about ``SAMPLES`` windows a part, drawn by hash in proportion to length; parts - 1 of their
    quantiles. They are drawn from what is routed by them."""
    data, size = F.encode(F.col("text").cast("string"), "UTF-8"), F.octet_length("text")
    lucky = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    times = F.floor(size * (float(SAMPLES) * parts / max(1, total)) + lucky).cast("int")
    drawn = docs.filter(size >= length).withColumn("times", times).filter("times > 0").select(data.alias("data"), size.alias("size"), "doc_id", F.explode(F.sequence(F.lit(1), "times")).alias("k"))
    at = F.pmod(F.xxhash64("doc_id", "k", "size"), F.col("size") - (length - 1)).cast("int") + 1

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [int(b.lead(np.arange(1))[0]) for x in batch.column(0) for b in [_blocks([x.as_py()], length, gram)]]
            yield pa.RecordBatch.from_arrays([pa.array((np.array(out, np.uint64) ^ _SIGN).view(np.int64))], ["lead"])

    found = drawn.select(F.substring("data", at, F.lit(length)).alias("w")).mapInArrow(leads, "lead long")
    if parts == 1:
        return np.zeros(0, np.uint64)
    shares = [k / parts for k in range(1, parts)]
    cuts = found.agg(F.percentile_approx("lead", shares, max(10_000, 4 * parts))).first()[0]  # quantiles are taken by Spark: one number a part
    return np.array(cuts or [], np.int64).view(np.uint64) ^ _SIGN


def range_of(cuts: np.ndarray, lead: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The range of each lead; where one lead fills several, the hash chooses among them."""
    low, high = np.searchsorted(cuts, lead, "left"), np.searchsorted(cuts, lead, "right")
    return low + ((hashed >> np.uint64(40)).astype(np.int64) * (high - low + 1) >> 24)


def exchange(cuts: np.ndarray, parts: int, length: int = LENGTH, gram: int = GRAM, hot: int = A.HOT) -> A.Repeats:
    """The steps on batches and ranges, as functions of their rows."""

    def made(table: pa.Table) -> tuple[A.Blocks, np.ndarray]:
        rows = X.rows_of(table)
        blocks = _blocks([r[1] or b"" for r in rows], length, gram)
        return blocks, np.zeros(len(blocks.first), np.int64)

    def part(blocks: A.Blocks, of: np.ndarray) -> np.ndarray:
        return range_of(cuts, blocks.lead(of), blocks.gram[of])

    def window_bytes(data: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = A.spans(np.cumsum(size) - size, n)
        return start, np.full(len(start), length)

    def finish(table: pa.Table, blocks: A.Blocks, starts: np.ndarray) -> pa.Table:
        rows = X.rows_of(table)
        n = len(blocks.data) + 1
        gone = np.cumsum(np.bincount(starts, minlength=n) - np.bincount(starts + length, minlength=n)) > 0
        out, at = [], 0
        for doc_id, data in rows:
            n = len(data or b"")
            own = gone[at : at + n]
            spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            out.append((doc_id, n, int(own.sum()), spans, blocks.data[at : at + n][~own].tobytes() if spans else data or b""))
            at += n
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return A.Repeats(made, part, window_bytes, finish, parts, False, hot)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = A.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the kept bytes."""
    gram = min(gram, length)
    if gram < 8:
        raise ValueError("strings of at least 8 bytes are looked for")
    total = text_bytes(docs)
    parts = X.part_count(docs, total, PART_BYTES)
    cuts = splitters(docs, parts, total, length, gram)
    return exchange(cuts, parts, length, gram, hot).run(X.batched(docs, X.batch_count(docs, total)), KEPT)
